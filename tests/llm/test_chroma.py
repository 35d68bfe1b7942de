import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quantloom.llm import chroma as C, queries
from quantloom.llm.chroma import Chroma, chroma_report

RULE = Chroma()
COLUMNS = ["id", "n_codes", "codes_sha256", "query_id", "offset", "votes", "overlap", "bit_errors"]


def slow_codes(samples, rule=RULE):
    """Filters summed cell by cell instead of by an integral image."""
    c = C.chroma_frames(samples, rule)
    out = []
    for t in range(len(c) - rule.width + 1):
        code = 0
        for kind, y, h, w in rule.filters():
            block = c[t:t + w]
            cell = np.zeros((w, 12))
            if kind == 0:
                cell[:] = -1
                cell[:, y:y + h] = 1
            else:
                up, late = np.arange(12)[None, :] >= y + h // 2, np.arange(w)[:, None] >= w // 2
                plus = {1: up, 2: late, 3: up == late}[kind]
                cell = np.where(np.broadcast_to(plus, (w, 12)), 1, -1) * ((np.arange(12) >= y) & (np.arange(12) < y + h))
            a, b = block[cell > 0].sum(), block[cell < 0].sum()
            v = round(float(np.log1p(max(a, 0)) - np.log1p(max(b, 0))), 9)
            code = code << 2 | (0, 1, 3, 2)[(v >= -rule.bound) + (v >= 0) + (v >= rule.bound)]
        out.append(code)
    return np.array(out, np.uint32)


def brute(rows, rule=RULE):
    prints = [(r.id, C.codes(np.frombuffer(bytes(r.pcm or b""), np.uint8), rule)) for r in rows]
    grams = [[tuple(c[j:j + rule.gram]) for j in range(len(c) - rule.gram + 1)] for _, c in prints]
    owner = {}
    for (i, _), g in zip(prints, grams):
        if i is not None and i % 20 == 0:
            for place, k in enumerate(g):
                owner[k] = min(owner.get(k, (i, place)), (i, place))
    whole = {}
    for i, c in prints:
        whole[i] = min(whole.get(i, c.tobytes()), c.tobytes())
    out = []
    for (i, c), g in zip(prints, grams):
        votes = Counter((owner[k][0], p - owner[k][1]) for p, k in enumerate(g) if k in owner and owner[k][0] != i)
        best = min(((-n, q, o) for (q, o), n in votes.items() if n >= rule.least_votes), default=None)
        row = (i, len(c), hashlib.sha256(c.tobytes()).hexdigest())
        if best:
            n, q, o = best
            other = np.frombuffer(whole[q], np.uint32)
            a, b = c[max(o, 0):], other[max(-o, 0):]
            m = min(len(a), len(b))
            wrong = sum(int(x ^ y).bit_count() for x, y in zip(a[:m].tolist(), b[:m].tolist())) / (32 * m)
            if wrong <= rule.most_errors:
                out.append((*row, q, o, -n, m, round(wrong, 9)))
                continue
        out.append((*row, None, None, None, None, None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((*r[:7], None if r[7] is None else round(r[7], 9)) for r in df.select(COLUMNS).collect()), key=repr)


def recordings(df):
    return df.select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("pcm"))


def test_integral_image():
    x = np.random.default_rng(2).integers(0, 255, 4000).astype(np.uint8)
    assert (C.codes(x, RULE) == slow_codes(x)).mean() > 0.99  # sums in another order may fall on the other side of a bound


def test_query_over_whole_table(spark, sf_dir, docs):
    out = queries.op7_chroma(spark, sf_dir).withColumnRenamed("doc_id", "id")
    assert got(out) == brute(recordings(docs).collect())


def test_shifted_and_noisy_recording(spark):
    rng = np.random.default_rng(1)
    t = np.arange(24_000) / 8000
    tune = sum(np.sin(2 * np.pi * f * t) * (np.sin(2 * np.pi * g * t) > 0) for f, g in ((220, 1.1), (330, 1.7), (494, 2.3), (587, 3.1)))
    first = (6000 * tune).astype("<i2")
    later = np.concatenate((rng.normal(0, 900, 64 * 30), first + rng.normal(0, 30, len(first)))).astype("<i2")
    other = rng.normal(0, 5000, 24_000).astype("<i2")
    df = spark.createDataFrame([(20, first.tobytes()), (21, later.tobytes()), (22, other.tobytes())], "id bigint, pcm binary")
    out = {r.id: r for r in chroma_report(df, F.col("id") % 20 == 0).collect()}
    assert (out[21].query_id, out[21].offset) == (20, 30) and out[21].bit_errors < 0.15
    assert out[22].query_id is None and out[20].query_id is None


def test_odd_rows(odd):
    rows = recordings(odd)
    assert got(chroma_report(rows, F.col("id") % 20 == 0, dtype="u1")) == brute(rows.collect())


def test_empty_table(odd):
    assert chroma_report(recordings(odd.limit(0)), F.col("id") % 20 == 0).count() == 0


def brute_all(rows, rule=RULE):
    """(id, best query, offset, votes, overlap, bit errors, number of query classes) of every recording, all queries compared."""
    prints = [(r.id, C.codes(np.frombuffer(bytes(r.pcm or b""), np.uint8), rule)) for r in rows]
    asked = {}
    for i, c in prints:
        if i is not None and i % 20 == 0:
            asked.setdefault(c.tobytes(), set()).add(i)
    out = []
    for i, c in prints:
        fits = []
        for text, ids in asked.items():
            q, own = min(ids - {i}, default=None), np.frombuffer(text, np.uint32)
            places = {}
            for p in range(len(own) - rule.gram + 1):
                places.setdefault(tuple(own[p:p + rule.gram]), []).append(p)
            votes = Counter(p - o for p in range(len(c) - rule.gram + 1) for o in places.get(tuple(c[p:p + rule.gram]), []))
            for n, o in sorted((-n, o) for o, n in votes.items() if n >= rule.least_votes and q is not None):
                a, b = c[max(o, 0):], own[max(-o, 0):]
                m = min(len(a), len(b))
                wrong = int(np.bitwise_count(a[:m] ^ b[:m]).sum()) / (32 * m)
                if wrong <= rule.most_errors:
                    fits.append((n, q, o, -m, round(wrong, 9)))
                    break
        n, q, o, m, wrong = min(fits, default=(None,) * 5)
        out.append((i, q, o, n and -n, m and -m, wrong, len(fits)))
    return sorted(out, key=repr)


def got_all(df):
    rows = df.select("id", "query_id", "offset", "votes", "overlap", "bit_errors", "n_queries").collect()
    return sorted(((*r[:5], None if r[5] is None else round(r[5], 9), r[6]) for r in rows), key=repr)


def test_later_query_holds_more(spark):
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, 255, 64 * n).astype(np.uint8).tobytes() for n in (60, 40))
    df = spark.createDataFrame([(20, a), (40, a + b), (41, a + b), (42, a)], "id bigint, pcm binary")
    out = {r.id: r for r in chroma_report(df, F.col("id") % 20 == 0, dtype="u1").collect()}
    assert [(out[i].query_id, out[i].n_queries, out[i].class_id) for i in (20, 40, 41, 42)] == [(40, 1, 20), (20, 1, 40), (40, 2, 40), (20, 2, 20)]


def test_all_queries_of_mixed_passages(spark):
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 255, 64 * int(n)).astype(np.uint8).tobytes() for n in rng.integers(12, 40, 8)] + [b"a" * 64 * 30]
    rows = [(int(i), b"".join(parts[k] for k in rng.integers(0, len(parts), int(rng.integers(0, 5))))) for i in rng.integers(0, 12, 90) * 5]
    rows += [(None, rows[4][1]), (None, rows[5][1]), (20, None), rows[7], rows[7], (61, rows[7][1])]
    df = spark.createDataFrame(rows, "id bigint, pcm binary")
    found = got_all(chroma_report(df, F.col("id") % 20 == 0, dtype="u1"))
    assert found == brute_all(df.collect()) and max(r[6] for r in found) > 5


def test_vote_counts_of_common_keys():
    rng = np.random.default_rng(5)
    a, b = np.where(rng.random(3000) < 0.9, 7, rng.integers(0, 9, 3000)), np.where(rng.random(2500) < 0.8, 7, rng.integers(0, 20, 2500))
    slow = sum(np.bincount((np.flatnonzero(a == k)[:, None] - np.flatnonzero(b == k)).ravel() + 2499, minlength=5499) for k in np.unique(a))
    assert (C.vote_counts(a, b, most=1000) == slow).all()
