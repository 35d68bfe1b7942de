import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import brown as B, queries
from quantloom.llm.common import text_rows, write_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base(rows):
    """(id, held out, tokens, known, training tokens, base score)."""
    c = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    return sorted(((r.doc_id, held(r.doc_id), len(tokens(r.text)), sum(c[t] > 0 for t in tokens(r.text)), n,
                    round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(r.text)), 5)) for r in rows), key=repr)


def got(df):
    return sorted(((*r[:5], round(r.base_score, 5)) for r in df.collect()), key=repr)


def test_query_over_whole_table(spark, sf_dir, docs):
    out = queries.op10_brown(spark, sf_dir)
    rows = out.collect()
    assert got(out.sparkSession.createDataFrame(rows, out.schema)) == base(docs.collect())
    # classes help on texts that nothing was learnt from
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_odd_rows(odd):
    assert got(B.brown_scores(odd, B.Brown(classes=4, rounds=1, block_bytes=1000))) == base(odd.collect())


def test_empty_table(odd):
    assert B.brown_scores(odd.limit(0), B.Brown(rounds=1)).count() == 0


def test_counts_and_model_by_hand(spark):
    """Class bigrams, likelihood and scores against the formula, with the classes that were found."""
    texts = ["a x b y a x", "b y a y b x", "a x rare", "", "b x a y unseen a", "b y b y a x a x"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    brown = B.Brown(classes=4, min_count=3, rounds=3, block_bytes=20)
    coded = write_out(B.coded_blocks(text_rows(df), brown))
    words, matrix, history = B.cluster(coded, brown)
    assert B.likelihood(matrix) == max(history) >= history[0]
    count = Counter(t for k, x in enumerate(texts) if not held(k) for t in tokens(x))
    by_c = {r.key: r for r in words.collect()}
    assert sorted(r.c for r in by_c.values()) == sorted(count.values()) and matrix.sum() == sum(count.values())
    out = {r.doc_id: r for r in B.brown_scores(df, brown).collect()}
    # one distribution over known words and the unknown one, after any class
    n, v = sum(count.values()), len(count)
    size = np.bincount([r.cls for r in by_c.values()], [r.c for r in by_c.values()], 4)
    kinds = np.bincount([r.cls for r in by_c.values()], minlength=4)
    change = (matrix + 0.5) / (matrix.sum(1, keepdims=True) + 2)
    within = sum(change[:, r.cls] * ((r.c + 1) / (size[3] + kinds[3] + 1) if r.cls == 3 else r.c / size[r.cls]) for r in by_c.values())
    within = within + change[:, 3] / (size[3] + kinds[3] + 1)
    empty = [c for c in range(3) if not kinds[c]]
    assert within + change[:, empty].sum(1) == pytest.approx(np.ones(4))
    assert all(r.score < 0 for r in out.values())


def test_best_class_by_trying_all():
    """The gain of a move is the difference in likelihood, row sums and column sums taken one after the other."""
    rng = np.random.default_rng(1)
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    m = rng.integers(20, 60, (5, 5)).astype(float)
    words = [(1, {0: 3, 2: 9, 4: 1}, {1: 8, 2: 4, 4: 1}), (0, {3: 17}, {}), (4, {}, {0: 2, 1: 15})]
    want = []
    for own, after, before in words:
        gains = []
        for b in range(4):
            g = 0.0
            for side, t in ((after, m), (before, m.T)):
                row = t[b].copy()
                if b == own:
                    for c, x in side.items():
                        row[c] -= x
                for c, x in side.items():
                    g += f(row[c] + x) - f(row[c])
                g -= f(row.sum() + sum(side.values())) - f(row.sum())
            gains.append(g)
        want.append(int(np.argmax(gains)))
    flat = sorted((w, s, x) for w, (_, after, before) in enumerate(words) for s, x in [*after.items(), *((5 + c, x) for c, x in before.items())])
    word, slot, n = map(np.array, zip(*flat))
    assert B.best_classes(word, slot, n, np.array([w[0] for w in words]), m).tolist() == want
