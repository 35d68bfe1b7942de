import hashlib
import random
from collections import Counter

from quantloom.llm import queries
from quantloom.llm.repeats import Repeats, remove_repeats


def brute(rows, length=200):
    texts = [(r.doc_id, (r.text or "").encode()) for r in rows]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for k, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_over_whole_table(spark, sf_dir, docs):
    assert got(queries.op9_repeats(spark, sf_dir)) == brute(docs.collect())


def test_odd_rows(odd):
    small = odd.filter("text is null or length(text) < 60000")
    assert got(remove_repeats(small)) == brute(small.collect())


def test_short_windows_and_slices(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(120))) for _ in range(80)] + ["a" * 90, "ab" * 60, "é" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for length, anchor in ((12, 4), (9, 9), (30, 1)):
        assert got(remove_repeats(df, Repeats(length, anchor, slice_bytes=100))) == brute(df.collect(), length)


def test_kept_bytes(spark):
    df = spark.createDataFrame([(1, "x" * 10 + "0123456789abcdef"), (2, "0123456789abcdefy")], "doc_id bigint, text string")
    out = {r.doc_id: bytes(r.kept) for r in remove_repeats(df, Repeats(12, 4), keep_text=True).collect()}
    assert out == {1: b"x" * 10, 2: b"y"}


def test_empty_table(odd):
    assert remove_repeats(odd.limit(0)).count() == 0
