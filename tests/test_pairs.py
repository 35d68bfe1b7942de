import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from quantloom.operators import pairs, pool
from quantloom.settings import Settings

COLS = ["a", "b", "c", "d", "e", "flat", "none"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 900
    x = pd.DataFrame({"date": np.arange(n) // 60, "symbol": [f"s{i % 60}" for i in range(n)], "a": rng.normal(size=n).round(1)})
    x["b"] = x.a + rng.normal(size=n)
    x["c"] = np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))  # a long tie
    x["d"] = -x.b ** 3
    x["e"] = rng.integers(0, 3, n).astype(float)
    x["flat"], x["none"] = 1.0, np.nan
    x.loc[rng.random(n) < 0.2, "a"] = np.nan
    x.loc[x.date < 4, ["b", "d"]] = np.nan  # one pattern for two features
    x.loc[rng.random(n) < 0.5, "e"] = np.nan
    recs = [tuple(None if isinstance(v, float) and np.isnan(v) else (v.item() if hasattr(v, "item") else v) for v in r) for r in x.itertuples(index=False)]
    return x, spark.createDataFrame(recs, "date long, symbol string, " + ", ".join(f"{c} double" for c in COLS))


def same(got, want):
    return (got is None or got != got) and (want is None or want != want) or got == pytest.approx(want, abs=1e-9)


def test_features_null_together_share_a_group(rows):
    assert pairs.null_groups(rows[1], COLS) == [0, 1, 2, 1, 4, 2, 6]


@pytest.mark.parametrize("settings", [Settings(), Settings(heavy_group_rows=100)])
def test_pooled_rank_correlation_over_complete_pairs(rows, settings):
    frame, df = rows
    got = {(r.f1, r.f2): r for r in pairs.pair_spearman(df, COLS, settings=settings).collect()}
    assert list(got) and len(got) == len(COLS) * (len(COLS) - 1) // 2
    for a, b in combinations(COLS, 2):
        both = frame[[a, b]].dropna()
        want = both.rank().corr().iloc[0, 1] if len(both) > 1 and both.nunique().min() > 1 else None
        assert got[a, b].n == len(both) and same(got[a, b].rho, want), (a, b)


@pytest.mark.parametrize("settings", [Settings(), Settings(heavy_group_rows=30)])
def test_rank_correlation_by_date(rows, settings):
    frame, df = rows
    got = {(r.date, r.f1, r.f2): r.rho for r in pairs.pair_spearman(df, COLS, by=("date",), settings=settings).collect()}
    for day, part in frame.groupby("date"):
        want = part[COLS].corr(method="spearman")
        for a, b in combinations(COLS, 2):
            flat = part[[a, b]].dropna().nunique().min() < 2
            assert same(got[day, a, b], None if flat else want.loc[a, b]), (day, a, b)


def test_values_correlate_over_complete_pairs(rows):
    frame, df = rows
    for r in pairs.pair_pearson(df, COLS).collect():
        both = frame[[r.f1, r.f2]].dropna()
        assert r.n == len(both)
        assert same(r.rho, both.corr().iloc[0, 1] if len(both) > 1 and both.nunique().min() > 1 else None), r


def test_empty_table_has_no_pairs(rows):
    assert pairs.pair_spearman(rows[1].limit(0), COLS).count() == 0
    assert all(r.rho is None for r in pairs.pair_pearson(rows[1].limit(0), COLS).collect())


def test_components_of_a_long_chain(spark):
    names = [f"n{i:02d}" for i in range(40)]
    random.Random(1).shuffle(names)
    edges = spark.createDataFrame(list(zip(names[:30], names[1:31])), "a string, b string")
    got = {r.n: r.grp for r in pairs.components(spark.createDataFrame([(n,) for n in names], "n string"), edges, "n").collect()}
    assert {got[n] for n in names[:31]} == {min(names[:31])} and all(got[n] == n for n in names[31:])


@pytest.mark.parametrize("target", [1, 3, 5, 12])
def test_linkage_against_one_merge_at_a_time(spark, target):
    rng = np.random.default_rng(target)
    names = [f"f{i:02d}" for i in range(12)]
    rho = {(a, b): float(rng.uniform(-1, 1)) for a, b in combinations(names, 2)}
    table = spark.createDataFrame([(a, b, r) for (a, b), r in rho.items()], "f1 string, f2 string, rho double")
    ic = {n: float(rng.normal()) for n in names}
    got = pool.cluster_pick(table, spark.createDataFrame(list(ic.items()), "feature string, ic double"), target).collect()
    clusters = [{n} for n in names]
    far = lambda a, b: max(1 - abs(rho[min(x, y), max(x, y)]) for x in a for y in b)
    while len(clusters) > target:
        a, b = min(combinations(clusters, 2), key=lambda p: far(*p))
        clusters = [c for c in clusters if c not in (a, b)] + [a | b]
    want = {frozenset(c) for c in clusters}
    found = {}
    for r in got:
        found.setdefault(r.cluster, set()).add(r.feature)
    assert {frozenset(c) for c in found.values()} == want and all(k == min(c) for k, c in found.items())
    assert {r.feature for r in got if r.keep} == {max(c, key=lambda n: abs(ic[n])) for c in want}


def test_greedy_pick_decides_chains(spark):
    rng = np.random.default_rng(5)
    names = [f"f{i:02d}" for i in range(25)]
    t = {n: float(rng.normal()) for n in names}
    rho = {p: float(rng.uniform(-1, 1)) for p in combinations(names, 2)}
    rho |= {(a, b): 0.99 for a, b in zip(sorted(names, key=lambda n: -abs(t[n])), sorted(names, key=lambda n: -abs(t[n]))[1:]) if (a, b) in rho}
    pick = pool.decorrelated_pick(spark.createDataFrame(list(t.items()), "fid string, fm_t double"),
                                  spark.createDataFrame([(*p, r) for p, r in rho.items()], "f1 string, f2 string, rho double"), 6, max_rho=0.8)
    kept = []
    for n in sorted(names, key=lambda n: (-abs(t[n]), n)):
        if all(abs(rho[min(n, k), max(n, k)]) <= 0.8 for k in kept):
            kept.append(n)
    assert [r.fid for r in pick.orderBy("pick").collect()] == kept[:6]


def test_ranks_meet_again_by_blocks_of_rows_and_tell_the_scores(spark, monkeypatch):
    """Blocks of rows larger than a batch, ties and NULLs; the return is one more feature."""
    from quantloom.operators import pairs as op, pool, xsection as xs
    monkeypatch.setattr(op, "_ALIKE", 100)  # values of ``a`` lie in several parts
    d = spark.range(40_000).selectExpr("cast(id as string) AS symbol", "date'2020-01-01' AS date", "cast(pmod(hash(id), 1000) as double) / 7 AS ret",
                                       "CASE WHEN id % 11 > 0 THEN cast(pmod(hash(id, 1), 50) as double) - 25 END AS a",
                                       "cast(pmod(hash(id, 2), 90000) as double) + a AS b")
    pairs = pool.pooled_spearman(d, ["a", "b", "ret"])
    assert "collect_list" not in pairs._jdf.queryExecution().toString()
    got = {r.feature: r.ic for r in pool.scores_among(pairs).collect()}
    want = {r.feature: r.ic for r in pool.pooled_scores(xs.melt(d, ["a", "b"], ["date", "symbol", "ret"])).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
