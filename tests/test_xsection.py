"""Cross-section operators: both ranking paths, quantiles, buckets, residuals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators import pool, xsection as xs
from quantloom.settings import Settings

SPLIT = Settings(heavy_group_rows=50)  # groups above 50 rows take the split path


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day, n in ((1, 40), (2, 400), (3, 61)):
        x = rng.normal(0, 1, n)
        x[: n // 3] = 0.25  # a third of the rows share one value
        x[n // 3: n // 2] = np.round(x[n // 3: n // 2], 1)
        for i in range(n):
            rows.append((f"f{day % 2}", pd.Timestamp(2020, 1, day).date(), f"s{i:04d}", float(x[i]),
                         float(rng.normal()), float(rng.uniform(1, 9))))
    pdf = pd.DataFrame(rows, columns=["fid", "date", "symbol", "x", "ret", "z"])
    return pdf, spark.createDataFrame(pdf)


def frame(sdf):
    return sdf.toPandas().sort_values(["date", "symbol"]).reset_index(drop=True)


@pytest.mark.parametrize("settings", [Settings(), SPLIT])
def test_average_rank(data, settings):
    pdf, sdf = data
    got = frame(xs.average_rank(sdf, ["date"], "x", "r", settings=settings))
    want = pdf.sort_values(["date", "symbol"]).groupby("date").x.rank().reset_index(drop=True)
    np.testing.assert_array_equal(got.r, want)
    assert got.r_n.tolist() == pdf.sort_values(["date", "symbol"]).groupby("date").x.transform("size").tolist()


@pytest.mark.parametrize("settings", [Settings(), SPLIT])
def test_ordinal_rank_breaks_ties_by_symbol(data, settings):
    pdf, sdf = data
    got = frame(xs.ordinal_rank(sdf, ["date"], "x", "rn", prefix=4, settings=settings))
    want = pdf.sort_values(["date", "x", "symbol"]).copy()
    want["rn"] = want.groupby("date").cumcount() + 1
    np.testing.assert_array_equal(got.rn, want.sort_values(["date", "symbol"]).rn)


@pytest.mark.parametrize("settings", [Settings(), SPLIT])
def test_quantiles_are_exact(data, settings):
    pdf, sdf = data
    qs = [0.01, 0.2, 0.5, 0.8, 0.99]
    got = xs.quantiles(sdf, ["date"], "x", qs, settings=settings).toPandas().set_index("date").q
    for day, g in pdf.groupby("date"):
        np.testing.assert_allclose(got[day], g.x.quantile(qs), rtol=1e-12)


def test_infinite_values_rank_alike_on_both_paths(spark):
    v = [float("-inf"), -1.0, 0.0, 2.0, 2.0, float("inf"), float("inf"), float("nan")]
    d = spark.createDataFrame([(1, x, f"s{i}") for i, x in enumerate(v)], "date int, x double, symbol string")
    for rank in (xs.average_rank, xs.ordinal_rank):
        one, cut = ({r.symbol: r.r for r in rank(d, ["date"], "x", "r", settings=s).collect()}
                    for s in (Settings(), Settings(heavy_group_rows=2)))
        assert one == cut and len(one) == len(v)


def test_order_cell_never_decreases(spark):
    v = sorted([-1e300, -5.0, -1e-9, -0.0, 0.0, 1e-300, 1e-9, 0.1, 0.1 + 1e-16, 5.0, 1e300]
               + list(np.random.default_rng(0).normal(0, 1, 500)))
    rows = spark.createDataFrame([(float(x),) for x in v], "x double").withColumn("c", xs.order_cell(F.col("x")))
    c = [r.c for r in rows.orderBy("x").collect()]
    assert c == sorted(c)


@pytest.mark.parametrize("settings", [Settings(), SPLIT])
def test_quantile_bucket_matches_qcut(data, settings):
    pdf, sdf = data
    got = frame(xs.quantile_bucket(sdf, keys=("date",), settings=settings))
    want = pdf.sort_values(["date", "symbol"]).groupby("date").x.transform(
        lambda x: pd.qcut(x, 5, labels=False, duplicates="drop")).reset_index(drop=True)
    np.testing.assert_array_equal(got.bucket, want)


def test_position_bucket_matches_qcut_of_ranks(data):
    pdf, sdf = data
    got = frame(xs.position_bucket(sdf, keys=("date",)))
    s = pdf.sort_values(["date", "symbol"])
    want = s.groupby("date").x.transform(lambda x: pd.qcut(x.rank(method="first"), 5, labels=False) + 1)
    np.testing.assert_array_equal(got.bucket, want.reset_index(drop=True))


@pytest.mark.parametrize("settings", [Settings(), SPLIT])
def test_rank_ic(data, settings):
    pdf, sdf = data
    got = xs.rank_ic(sdf, keys=("date",), settings=settings).toPandas().set_index("date").ic
    for day, g in pdf.groupby("date"):
        assert got[day] == pytest.approx(g.x.rank().corr(g.ret.rank()), rel=1e-12)
        assert -1 <= got[day] <= 1


def test_flat_group_has_no_ic(spark):
    d = spark.createDataFrame([("f", 1, f"s{i}", 1.0, float(i)) for i in range(40)],
                              "fid string, date int, symbol string, x double, ret double")
    assert xs.rank_ic(d).head().ic is None


@pytest.mark.parametrize("controls", [["z"], ["z", "z2"]])
def test_residuals_are_centred_and_orthogonal(data, controls):
    pdf, sdf = data
    d = sdf.withColumn("z2", F.col("z") * F.col("z"))
    got = frame(xs.neutralise(d, ["x", "ret"], controls, ("date",), 30))
    for day, g in got.groupby("date"):
        src = pdf[pdf.date == day].sort_values("symbol")
        a = np.column_stack([np.ones(len(src)), src.z] + ([src.z ** 2] if "z2" in controls else []))
        want = src.x - a @ np.linalg.lstsq(a, src.x, rcond=None)[0]
        np.testing.assert_allclose(g.x, want, atol=1e-9)
        assert abs(g.x.mean()) < 1e-9 and abs(np.dot(g.x, g.z)) < 1e-6


def test_small_groups_pass_through(data):
    pdf, sdf = data
    got = frame(xs.neutralise(sdf, ["x"], ["z"], ("date",), 41))
    small = got[got.date == got.date.min()]
    np.testing.assert_array_equal(small.x, pdf[pdf.date == pdf.date.min()].sort_values("symbol").x)


@pytest.mark.parametrize("heavy", [False, True])
def test_percent_rank_keeps_null(spark, heavy):
    d = spark.createDataFrame([(1, "a", 3.0), (1, "b", None), (1, "c", 3.0), (1, "d", 1.0)],
                              "date int, symbol string, x double")
    got = {r.symbol: r.rank_x for r in xs.percent_rank(d, ["x"], heavy=heavy, settings=SPLIT).collect()}
    assert got == {"a": pytest.approx(2.5 / 3), "b": None, "c": pytest.approx(2.5 / 3), "d": pytest.approx(1 / 3)}


@pytest.mark.parametrize("settings", [Settings(), SPLIT])
def test_fill_clip_zscore(spark, data, settings):
    pdf, sdf = data
    d = sdf.withColumn("x", F.when(F.col("z") > 8, None).otherwise(F.col("x")))
    got = frame(xs.fill_clip_zscore_wide(d, ["x"], ("date",), 3.0, settings=settings))
    p = pdf.copy()
    p.loc[p.z > 8, "x"] = np.nan

    def one(x):
        x = x.fillna(x.median())
        m = x.median()
        mad = (x - m).abs().median()
        x = x.clip(m - 3 * 1.4826 * mad, m + 3 * 1.4826 * mad)
        return (x - x.mean()) / max(x.std(), 1e-8)

    want = p.sort_values(["date", "symbol"]).groupby("date").x.transform(one)
    np.testing.assert_allclose(got.x, want, atol=1e-9)


def test_zscore_of_equal_values_in_many_parts(spark):
    # a part of 49 rows starts from a mean of 1 / 49 * 49, which is not 1
    d = spark.range(49 * 16, numPartitions=16).select(F.lit(1).alias("date"), F.lit(1.0).alias("v"))
    d = d.union(spark.createDataFrame([(1, None), (2, 4.0), (3, None)], "date int, v double"))
    assert {r.v for r in xs.zscore(d, ["v"], null_flat=True).collect()} == {None}
    for bound in ({"floor": 1e-300}, {"eps": 1e-300}):
        assert {(r.date, r.v) for r in xs.zscore(d, ["v"], **bound).collect()} == {(1, 0.0), (1, None), (2, 0.0), (3, None)}


@pytest.mark.parametrize("heavy", [False, True])
def test_clipped_to_one_value_has_zscore_zero(spark, heavy):
    # three values and 20,000 NULLs filled with their median: clipped at a deviation of 0
    d = spark.range(20_003).select(F.lit(1).alias("date"), F.col("id").cast("string").alias("symbol"),
                                   F.when(F.col("id") < 3, F.col("id") + 57.12345678912345).alias("x"))
    got = xs.fill_clip_zscore_wide(d, ["x"], heavy=heavy).select(F.round("x", 5).alias("x")).groupBy("x").count().collect()
    assert [(r.x, r["count"]) for r in got] == [(0.0, 20_003)]


def test_long_short_by_count(data):
    pdf, sdf = data
    got = xs.long_short_by_count(sdf, keys=("date",)).toPandas().set_index("date").ls
    for day, g in pdf.groupby("date"):
        s = g.sort_values(["x", "symbol"])
        n = max(int(len(s) * 0.2), 1)
        assert got[day] == pytest.approx(s.ret.tail(n).mean() - s.ret.head(n).mean())


def test_cluster_pick_limits_clusters(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.2)], "f1 string, f2 string, rho double")
    ic = spark.createDataFrame([("a", 0.1), ("b", -0.3), ("c", 0.0)], "feature string, ic double")
    two = {r.feature: (r.cluster, r.keep) for r in pool.cluster_pick(pairs, ic, 2).collect()}
    assert two["a"][0] == two["b"][0] != two["c"][0] and two["b"][1] and not two["a"][1]
    assert all(r.keep for r in pool.cluster_pick(pairs, ic).collect())


def test_near_duplicates_ignore_mirrored_features(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.97), ("a", "d", -0.99)], "f1 string, f2 string, rho double")
    ic = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", -0.3), ("d", 0.1)], "feature string, ic double")
    kept = {r.feature for r in pool.near_duplicates(pairs, ic).collect() if r.keep}
    assert kept == {"c", "d"}


# ---- selection by digits --------------------------------------------------------------
def test_radix_quantiles_of_ties_bands_and_extremes(spark):
    rng = np.random.default_rng(9)
    groups = {"tie": np.r_[np.zeros(400), rng.normal(size=201)], "band": 1 + rng.integers(0, 50, 301) * 2.0 ** -52, "one": np.array([-3.5]),
              "signs": np.r_[-0.0, 0.0, -np.inf, np.inf, 5e-324, -5e-324, 1e308, -1e308], "two": np.array([2.0, -7.0])}
    rows = [(g, float(v)) for g, vals in groups.items() for v in vals] + [("tie", None), ("empty", None)]
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r.g: r.q for r in xs.radix_quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", qs).collect()}
    assert set(got) == set(groups)
    for g, vals in groups.items():
        v = np.sort(vals)
        for q, x in zip(qs, got[g]):
            at = (len(v) - 1) * q
            lo, hi = v[int(np.floor(at))], v[int(np.ceil(at))]
            with np.errstate(invalid="ignore"):
                want = lo if lo == hi else lo + (hi - lo) * (at - np.floor(at))
            assert x == want or x != x and want != want, (g, q)


def test_fill_clip_zscore_wide_is_the_same_by_group_and_by_digits(spark):
    rng = np.random.default_rng(4)
    rows = [(d, f"s{i}", float(rng.normal()), None if i % 7 == 0 else float(rng.integers(0, 3)), None if d == 1 else float(i), None)
            for d in range(3) for i in range(40)] + [(9, "alone", 1.0, 2.0, 3.0, None)]
    df = spark.createDataFrame(rows, "date int, symbol string, a double, b double, c double, d double")
    light = {(r.date, r.symbol): r for r in xs.fill_clip_zscore_wide(df, list("abcd"), heavy=False).collect()}
    split = {(r.date, r.symbol): r for r in xs.fill_clip_zscore_wide(df, list("abcd"), heavy=True).collect()}
    assert set(light) == set(split) and len(light) == len(rows)
    for k, r in light.items():
        for c in "abcd":
            assert (r[c] is None) == (split[k][c] is None) and (r[c] is None or r[c] == pytest.approx(split[k][c], abs=1e-9)), (k, c)
    assert light[9, "alone"].a is None and light[1, "s3"].c is None and light[0, "s0"].b is not None


def test_large_cap_features_write_no_raw_panel(spark, sf_dir):
    from pathlib import Path

    from quantloom.operators.layout import shared_dir
    from quantloom.plans import series
    from quantloom.sources import fixtures as fx
    bars = fx.bars(spark, sf_dir)
    before = set(Path(shared_dir(spark)).iterdir())
    assert "forward_ret" in series.large_cap_features(bars, heavy=False).columns
    assert set(Path(shared_dir(spark)).iterdir()) == before
