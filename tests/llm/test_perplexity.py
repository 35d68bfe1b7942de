import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantloom.llm import perplexity as P, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


class Brute:
    """Interpolated modified Kneser-Ney over character tuples, by the formula."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = {order: Counter()}
        for t in texts:
            c = self.chars(t)
            self.counts[order].update(tuple(c[i:i + order]) for i in range(len(t)))
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.taken, self.total, self.rest = {}, {}, {}
        for n, grams in self.counts.items():
            k = Counter(grams.values())
            y = k[1] / (k[1] + 2 * k[2]) if k[1] + k[2] else None
            d = {}
            for i, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
                v = i - (i + 1) * y * k[i + 1] / k[i] if k[i] and y is not None else None
                d[i] = v if v is not None and 0.01 <= v <= i else usual
            self.taken[n], self.total[n], self.rest[n] = d, Counter(), Counter()
            for g, c in grams.items():
                self.total[n][g[:-1]] += c
                self.rest[n][g[:-1]] += d[min(c, 3)]

    def chars(self, t):
        fold = [ord(c.lower()) if "A" <= c <= "Z" else ord(c) for c in t]
        return [0] * (self.order - 1) + [c if c < 2048 else 2048 + c % 2048 for c in fold]

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / 4096
        low = self.p(gram[1:])
        if not self.total[n][gram[:-1]]:
            return low
        c = self.counts[n][gram]
        return (c - self.taken[n][min(c, 3)] if c else 0) / self.total[n][gram[:-1]] + self.rest[n][gram[:-1]] / self.total[n][gram[:-1]] * low

    def log_ppl(self, t):
        c = self.chars(t)
        return -sum(math.log10(min(1, self.p(tuple(c[i:i + self.order])))) for i in range(len(t))) / max(1, len(t))


def test_base_columns_over_whole_table(spark, sf_dir, docs):
    out = {r.doc_id: tuple(r[1:7]) for r in queries.op5_perplexity(spark, sf_dir).collect()}
    assert out == {r.doc_id: base(r.text) for r in docs.collect()}


@pytest.mark.parametrize("slice_bytes", [200, 1 << 20])
def test_model_against_the_formula(docs, slice_bytes):
    """With so many bits few n-grams share a hash, so perplexities agree closely."""
    rules = P.Rules(order=3, hash_bits=24, slice_bytes=slice_bytes)
    some = docs.limit(40)
    rows = some.collect()
    out = {r.doc_id: r for r in P.quality(some, rules).collect()}
    brute = {x: Brute([r.text for r in rows if r.lang == x], 3) for x in {r.lang for r in rows}}
    want = {r.doc_id: brute[r.lang].log_ppl(r.text) for r in rows}
    assert all(abs(out[i].log_ppl - want[i]) < 2e-4 for i in want)
    # bands: exact medians of the rounded values
    by = defaultdict(list)
    for r in rows:
        if not out[r.doc_id].base_failed:
            by[r.lang].append(round(out[r.doc_id].log_ppl * 10000))
    low_median = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    for r in rows:
        v = by[r.lang]
        if v:
            mid = low_median(v)
            mad = max(low_median([abs(x - mid) for x in v]) / 10000, rules.least)
            assert abs(out[r.doc_id].low - (mid / 10000 - 12 * mad)) < 1e-9 and abs(out[r.doc_id].high - (mid / 10000 + 12 * mad)) < 1e-9
            assert out[r.doc_id].kept == (not out[r.doc_id].base_failed and out[r.doc_id].low <= out[r.doc_id].log_ppl <= out[r.doc_id].high)


def test_noise_is_rejected_and_prose_is_kept(spark, docs):
    rng = np.random.default_rng(3)
    noise = [(10_000 + i, "en", " ".join("".join(chr(x) for x in rng.integers(33, 127, 6)) for _ in range(300))) for i in range(5)]
    both = docs.select("doc_id", "lang", "text").unionByName(spark.createDataFrame(noise, "doc_id long, lang string, text string"))
    out = P.quality(both).collect()
    assert all(not r.kept for r in out if r.doc_id >= 10_000)
    assert sum(r.kept for r in out) >= 0.97 * sum(not r.base_failed for r in out if r.doc_id < 10_000)


def test_odd_rows(odd):
    out = P.quality(odd).collect()
    want = sorted([(r.doc_id, *base(r.text)) for r in odd.collect()], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out], key=repr) == want
    assert all(r.kept is not None and math.isfinite(r.perplexity) for r in out)


def test_empty_table(odd):
    assert P.quality(odd.limit(0)).count() == 0
