import re
from collections import Counter, defaultdict

from pyspark.sql import Row

from quantloom.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    lower = {i: i + 32 for i in range(65, 91)}
    docs = [((r.lang or ""), (r.source or ""), [t.translate(lower) for t in TERM.findall(r.text or "")]) for r in rows]
    inside, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        inside[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = [t for t, k in inside[lang].items() if k >= least]

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}
        of = {s: p(c) for (x, s), c in counts.items() if x == lang}
        q = p(sum((c for (x, _), c in counts.items() if x == lang), Counter()))
        for s, mine in of.items():
            pairs = [(o, sum((mine[t] - other[t]) ** 2 // other[t] for t in kept)) for o, other in of.items() if o != s]
            terms = [(t, (mine[t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and mine[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found = sorted(found, key=lambda f: (-f[1], f[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found)}
    return out


def test_query_over_whole_table(spark, sf_dir, docs):
    out = queries.op12_divergence(spark, sf_dir).collect()
    assert len(out) == len(set(out)) and {tuple(r) for r in out} == brute(docs.collect())


def test_odd_rows(spark, odd):
    more = [Row(text=t, lang=lang, source=s) for t, lang, s in (
        ("Straße STRASSE straße[x]y", "en", "s"), ("straße x y", "en", "t"), ("", "en", "empty"), (None, "xx", None), ("alpha one x", None, "t"), ("ünï\x00co\x7fde x y", "en", "t"))]
    rows = odd.select("text", "lang", "source", "token", "n").unionByName(spark.createDataFrame(more, "text string, lang string, source string"), allowMissingColumns=True)
    for least, top in ((3, 200), (1, 2)):
        assert {tuple(r) for r in divergence.divergence_audit(rows, least, top).collect()} == brute(rows.collect(), least, top)
    assert divergence.divergence_audit(rows.limit(0)).count() == 0


def test_buckets_and_blocks_give_the_same_sums(spark, docs):
    counts = divergence.term_counts(docs)
    kept = divergence.kept_terms(counts)
    groups, langs = divergence.group_totals(counts, kept)
    whole = divergence.pair_values(kept, groups, langs).collect()
    assert set(whole) == set(divergence.pair_values(kept, groups, langs, cells=5000, block=7).collect()) and len(whole) == len(set(whole))


def test_many_occurrences_stay_exact(spark):
    n = 3_000_000_000_001
    r = spark.range(1).select(divergence.probability(*map(lambda v: divergence.F.lit(v), (n, 10 * n, 999))).alias("p")).head()
    assert r.p == 1 + 1_000_000_000 * (n + 1) // (10 * n + 999)


def test_bytes_table():
    text = "AbC-dé[È]\x00z\x7fß\n中文"
    assert [t.decode() for t in divergence.terms_of(text.encode())] == [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text)]
