import numpy as np

from quantloom.llm import jaccard
from quantloom.llm.jaccard import Join, jaccard_components
from tests.llm.test_jaccard import brute, got


def near_but_apart(spark, n, seed=1):
    """Copies of one text with words of their own: some pairs are linked, most only almost."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = [f"w{i}" for i in range(200)]
        for i in rng.choice(200, 4 + k % 4, replace=False):
            words[i] = f"x{k}y{i}"
        rows.append((k, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def counted(monkeypatch, name, rows):
    old = getattr(jaccard, name)

    def run(members, *args, **more):
        rows.append(members.count())
        return old(members, *args, **more)
    monkeypatch.setattr(jaccard, name, run)


def test_group_that_no_pivot_parts_is_not_repeated(spark, monkeypatch):
    df = near_but_apart(spark, 130)
    want = brute(df.collect())
    assert len({c for _, _, c in want}) > 20
    measured, compared = [], []
    counted(monkeypatch, "distances", measured)
    counted(monkeypatch, "worth_comparing", compared)
    assert got(jaccard_components(df)) == want
    # before: 10 calls, as rounds of rings did not part the group, and each gave it to the next more than once
    assert len(measured) <= 2
    measured.clear(), compared.clear()
    # a group above the leaf goes to blocks as soon as its pivot leaves it whole
    assert got(jaccard_components(df, Join(leaf=40))) == want
    assert len(measured) <= 6 and sum(compared) < 130 * 30


def test_leaves_are_bounded_by_counts_too(spark):
    df = near_but_apart(spark, 60, 2)
    want = brute(df.collect())
    assert got(jaccard_components(df, Join(leaf_counts=2000))) == want
    assert got(jaccard_components(df, Join(leaf_counts=2000, max_rounds=0))) == want


def test_shingles_of_a_small_group_come_after_single_ones(spark):
    """A group of 40 in a corpus that fills each counter 30 times is told from chance."""
    join = Join(counter_bits=10)
    counts = np.full(1 << 10, 30, np.int32)
    counts[7] += 40
    rows = [(k, p.tobytes()) for k, p in enumerate(np.split(counts, 32))]
    levels = jaccard.shingle_levels(spark.createDataFrame(rows, "part int, counts binary"), join)
    # before, all below twice the mean were of level 0 and 70 was of level 1
    assert levels[8] == 0 and levels[7] >= 10
