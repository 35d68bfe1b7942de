import numpy as np

from quantloom.llm import jaccard
from quantloom.llm.jaccard import Join, jaccard_components
from tests.llm.test_jaccard import brute, got


def test_only_sets_that_may_be_linked_are_sent_in_full(spark, monkeypatch):
    """200 texts share a line and nothing else, and 20 of them have a near copy."""
    line = "free for any use under terms below "
    rows = [(k, line + " ".join(f"w{k}x{j}" for j in range(60))) for k in range(200)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sent, distances, leaves = [], jaccard.distances, jaccard.compare_leaves

    def measured(members, sets, join, *a, **b):
        if not (a or b):
            sent.append(members.count())
        return distances(members, sets, join, *a, **b)

    def compared(groups, sets, join):
        sent.append(groups.count())
        return leaves(groups, sets, join)

    monkeypatch.setattr(jaccard, "distances", measured)
    monkeypatch.setattr(jaccard, "compare_leaves", compared)
    assert got(jaccard_components(df, Join(leaf=12))) == brute(df.collect())
    assert sum(sent) <= 200, sent  # in full and for every region there would be some thousand


def test_sketches_are_never_further_apart_than_sets():
    rng, join = np.random.default_rng(3), Join(sketch_bits=(3, 5))
    for n in (1, 5, 300, 9000):  # the last has counts of more than a byte
        pool = rng.integers(0, 1 << 64, 2 * n + 1, np.uint64)
        for share in (0.5, 0.9, 1.0):
            a, b = (np.unique(pool[rng.random(len(pool)) < share]) for _ in range(2))
            (wx, x), (wy, y) = (jaccard.sketch(s, join) for s in (a, b))
            for to in (8, min(wx, wy)):
                cx, cy = jaccard.read_sketch(x, wx, to), jaccard.read_sketch(y, wy, to)
                assert cx.sum() == len(a) and cy.sum() == len(b) and len(cx) == len(cy) == to
                assert np.minimum(cx, cy).sum() >= jaccard.common(a, b)
