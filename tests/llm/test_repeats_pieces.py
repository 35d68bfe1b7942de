import random

from quantloom.llm import repeats


def test_a_line_too_short_to_repeat_is_not_taken_apart(spark, monkeypatch):
    """A line of 150 bytes in 60 texts, a passage of 230 in two of them and one text that repeats itself."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line, passage = word(150), word(230)
    texts = [word(300) + line + word(300) + (passage + word(100) if k in (3, 40) else "") for k in range(60)] + ["the same line\n" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts, split = [], repeats.split_runs

    def counted(*args):
        out = split(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(repeats, "split_runs", counted)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(df).collect()}
    data = [t.encode() for t in texts]
    seen = {}
    for i, t in enumerate(data):
        for a in range(len(t) - 199):
            seen.setdefault(t[a:a + 200], []).append((i, a))
    for i, t in enumerate(data):
        covered = bytearray(len(t))
        for a in range(len(t) - 199):
            if len(seen[t[a:a + 200]]) > 1:
                covered[a:a + 200] = b"\x01" * 200
        spans = sum(covered[a] and not (a and covered[a - 1]) for a in range(len(t)))
        assert got[i] == (sum(covered), spans), i
    assert sum(counts) < 1500, counts  # with all windows around the line there are several thousand
