"""Spans are told apart where a hash modulo 2**64 can't: Thue-Morse words and their complements."""

import numpy as np
from pyspark.sql import Row

from quantloom.llm.brown import brown_scores
from quantloom.llm.common import mix64, prefix_hash, span_hash
from quantloom.llm.jaccard import jaccard_components
from quantloom.llm.perplexity import quality
from quantloom.llm.repeats import Repeats, remove_repeats

PRIME, BASE = (1 << 61) - 1, 0x1B7E151628AED2A6


def thue_morse(letters="ab", size=1024):
    word = letters[0]
    while len(word) < size:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


def plain(data: bytes) -> int:
    return sum((b + 1) * pow(BASE, i, PRIME) for i, b in enumerate(data)) % PRIME


def test_spans_equal_plain_arithmetic():
    rng = np.random.default_rng(3)
    buf = np.concatenate((rng.integers(0, 256, 3000), np.full(3000, 255))).astype(np.uint8)
    buf = np.tile(buf, 30)  # beyond one step
    starts = np.append(rng.integers(0, len(buf) - 300, 200), [0, len(buf) - 1, len(buf)])
    ends = np.minimum(starts + rng.integers(0, 300, len(starts)), len(buf))
    want = [plain(buf[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
    assert (span_hash(prefix_hash(buf), starts, ends) == mix64(np.array(want, np.uint64))).all()


def test_no_bytes():
    none = np.zeros(0, np.int64)
    assert len(span_hash(prefix_hash(np.zeros(0, np.uint8)), none, none)) == 0


def test_thue_morse_words_differ():
    for letters in ("ab", "u'"):
        for size in (512, 1024, 4096):
            a, b = thue_morse(letters, size)
            buf = np.frombuffer((a + b).encode(), np.uint8)
            h = span_hash(prefix_hash(buf), np.array([0, size]), np.array([size, 2 * size]))
            assert h[0] != h[1]


def frame(spark, *rows):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="en") for i, t in rows], "doc_id bigint, text string, lang string")


def test_scores_and_links(spark):
    a, b = thue_morse()
    ids = {r.doc_id: r for r in brown_scores(frame(spark, *[(i, f"{a} x y z q") for i in range(40)])).collect()}
    held = next(i for i, r in ids.items() if r.held_out)
    learnt = next(i for i, r in ids.items() if not r.held_out)
    out = {r.doc_id: r for r in brown_scores(frame(spark, (learnt, f"{a} x y z q"), (held, f"{b} x y z q"))).collect()}
    assert out[held].n_known == 5 and out[learnt].n_known == 6
    found = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, (1, f"{a} x y z q"), (2, f"{b} x y z q"), (3, f"{a} x y z q"))).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_windows_and_repeats(spark):
    a, b = thue_morse()
    tail = "one two three four five six seven"
    out = {r.doc_id: r.n_repeat_words for r in quality(frame(spark, (1, f"{a} {tail} {b} {tail}"), (2, f"{a} {tail} {a} {tail}"))).collect()}
    assert out == {1: 0, 2: 16}
    whole = Repeats(length=1024)
    assert {r.doc_id: r.n_removed for r in remove_repeats(frame(spark, (1, a), (2, b)), whole).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.n_removed for r in remove_repeats(frame(spark, (1, a), (2, a)), whole).collect()} == {1: 1024, 2: 1024}
