"""Rolling kernel and time blocks against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import rolling as k
from quantloom.functions.rolling import Rolling, with_exprs
from quantloom.operators.layout import time_blocks
from quantloom.plans import series
from quantloom.settings import Settings


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(7)
    rows = []
    for sym, n in (("a", 400), ("b", 90)):
        c = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        if sym == "b":
            c[30:45] = c[30]  # a flat stretch
        d = pd.date_range("2020-01-01", periods=n, freq="D")
        o = c * (1 + rng.normal(0, 0.01, n))
        v = rng.integers(1, 1000, n).astype(float)
        rows.append(pd.DataFrame({"symbol": sym, "date": d.date, "open": o, "high": np.maximum(o, c) * 1.01,
                                  "low": np.minimum(o, c) * 0.99, "close": c, "volume": v, "amount": v * c,
                                  "turn": rng.random(n)}))
    pdf = pd.concat(rows, ignore_index=True)
    pdf.loc[[5, 17, 200], "turn"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("turn", F.nanvl("turn", F.lit(None).cast("double")))
    return pdf, sdf


def blocked(sdf, rows, back=64, ahead=8):
    return time_blocks(sdf, Settings(block_rows=rows, halo_back=back, halo_forward=ahead, chunk_unit="month"))


def compare(sdf, pdf, spec):
    got = sdf.filter("NOT halo").toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    want = pdf.sort_values(["symbol", "date"]).reset_index(drop=True)
    for name, fn in spec.items():
        w = want.groupby("symbol", group_keys=False).apply(fn, include_groups=False).reset_index(drop=True)
        np.testing.assert_allclose(got[name].astype(float), w.astype(float), rtol=1e-8, atol=1e-9, err_msg=name)


@pytest.mark.parametrize("rows", [100000, 100])
def test_frames_match_pandas_in_one_block_and_in_many(panel, rows):
    pdf, sdf = panel
    r = Rolling()
    df = r.add(blocked(sdf, rows), {"p": r.position()})
    df = r.add(df, {
        "mean": r.mean("turn", 20), "std": r.std("close", 10), "skew": r.skew("volume", 20),
        "kurt": r.kurt("volume", 20), "corr": r.corr("close", "volume", 10), "half": r.relaxed().std("turn", 20),
        "slope": r.slope("close", "p", 10), "top": r.top("high", 14), "any": r.mean("turn", 5, 1),
        "cov": r.cov("close", "volume", 20), "lag": r.lag("close", 3), "next": r.lead("close", 2)})
    compare(df, pdf, {
        "mean": lambda g: g.turn.rolling(20).mean(), "std": lambda g: g.close.rolling(10).std(),
        "skew": lambda g: g.volume.rolling(20).skew(), "kurt": lambda g: g.volume.rolling(20).kurt(),
        "half": lambda g: g.turn.rolling(20, min_periods=10).std(),
        "slope": lambda g: g.close.rolling(10).apply(lambda x: np.polyfit(np.arange(10), x, 1)[0], raw=True),
        "top": lambda g: g.high.rolling(14).max(), "any": lambda g: g.turn.rolling(5, min_periods=1).mean(),
        "cov": lambda g: g.close.rolling(20).cov(g.volume), "lag": lambda g: g.close.shift(3),
        "next": lambda g: g.close.shift(-2)})


def test_flat_frame_has_zero_deviation_and_no_correlation(panel):
    pdf, sdf = panel
    r = Rolling()
    df = r.add(blocked(sdf, 100000), {"s": r.std("close", 5), "c": r.corr("close", "volume", 5)})
    got = df.filter("symbol = 'b'").orderBy("date").toPandas()
    assert (got.s[36:45] == 0).all() and got.c[36:45].isna().all()
    assert got.c[50:].notna().all()


@pytest.mark.parametrize("rows", [100000, 150])
@pytest.mark.parametrize("adjust", [True, False])
def test_exponential_mean(panel, rows, adjust):
    pdf, sdf = panel
    r = Rolling()
    # without gaps the halo must cover the fade of the span: 5 fades to 1e-17 within 100 rows
    df = r.add(blocked(sdf, rows, back=100), {"p": r.position()})
    df = r.ewm(df, {"e": ("close", 5)}, "p", adjust=adjust)
    compare(df, pdf, {"e": lambda g: g.close.ewm(span=5, adjust=adjust).mean()})


def test_exponential_mean_over_several_cells(panel):
    pdf, sdf = panel
    r = Rolling()
    df = r.add(blocked(sdf, 100000), {"p": r.position()})
    df = r.ewm(df, {"e": ("close", 3), "f": ("volume", 3)}, "p")  # cells of 64 rows
    compare(df, pdf, {"e": lambda g: g.close.ewm(span=3).mean(), "f": lambda g: g.volume.ewm(span=3).mean()})


def test_array_expressions(panel):
    pdf, sdf = panel
    r = Rolling()
    df = r.add(blocked(sdf, 100000), {"l": r.values("close", 20)})
    df = with_exprs(df, {"s": "sort_array(l)", "m": "aggregate(l, 0D, (a, v) -> a + v) / size(l)"})
    df = with_exprs(df, {"q": k.sorted_quantile("s", 0.8), "r": k.rank_of_last("s", "close"),
                         "d": k.mean_abs_dev("l", "m"), "hit": k.first_hit("l", "array_max(l)")})
    roll = lambda g: g.close.rolling(20, min_periods=1)
    compare(df, pdf, {"q": lambda g: roll(g).quantile(0.8), "r": lambda g: roll(g).rank(pct=True),
                      "d": lambda g: roll(g).apply(lambda x: np.mean(np.abs(x - x.mean())), raw=True),
                      "hit": lambda g: roll(g).apply(lambda x: x.argmax() + 1, raw=True)})


def test_blocks_keep_every_row_once_and_bound_their_size(panel):
    pdf, sdf = panel
    b = blocked(sdf, 100)
    own = b.filter("NOT halo")
    assert own.count() == len(pdf) and own.select("symbol", "date").distinct().count() == len(pdf)
    assert own.filter("symbol = 'a'").select("blk").distinct().count() > 2
    assert b.groupBy("symbol", "blk").count().agg(F.max("count")).head()[0] < 100 + 31 + 64 + 31 + 8 + 31


@pytest.mark.parametrize("rows", [100000, 100])
def test_growing_frames_in_one_block_and_in_many(panel, rows):
    pdf, sdf = panel
    df = k.growing(k.growing(blocked(sdf, rows), "turn"), "close")
    compare(df, pdf, {
        "turn_sum": lambda g: g.turn.fillna(0).cumsum(), "turn_mean": lambda g: g.turn.expanding().mean(),
        "turn_std": lambda g: g.turn.expanding().std(), "turn_n": lambda g: g.turn.expanding().count(),
        "close_sum": lambda g: g.close.cumsum(), "close_std": lambda g: g.close.expanding().std()})


def test_long_series_and_frames(spark):
    n = 20_000
    days = pd.date_range("1960-01-01", periods=n).date
    pdf = pd.concat([pd.DataFrame({"symbol": s, "date": days[:m], "v": np.arange(m) % 997 + 1.0}) for s, m in (("a", n), ("b", 300))])
    cut = time_blocks(spark.createDataFrame(pdf), Settings(halo_back=2000, halo_forward=200))
    assert cut.select("blk").distinct().count() > 1
    r = Rolling(halo=(2000, 200))
    df = r.add(k.growing(cut, "v"), {"lag": r.lag("v", 1500), "mean": r.mean("v", 1500), "next": r.lead("v", 120)})
    compare(df, pdf, {"v_sum": lambda g: g.v.cumsum(), "v_mean": lambda g: g.v.expanding().mean(), "v_std": lambda g: g.v.expanding().std(),
                      "lag": lambda g: g.v.shift(1500), "mean": lambda g: g.v.rolling(1500).mean(), "next": lambda g: g.v.shift(-120)})


@pytest.mark.parametrize("frame", [lambda r: r.lag("v", 1500), lambda r: r.mean("v", 1500), lambda r: r.top("v", 1500), lambda r: r.lead("v", 120)])
def test_frames_longer_than_the_halo_are_refused(frame):
    with pytest.raises(ValueError, match="halo"):
        frame(Rolling())


def test_daily_features_do_not_depend_on_blocks(panel):
    _, sdf = panel
    names = ["vol_20d", "ivol_20d", "obv_slope_10d", "pv_corr_10d", "turnover_20d", "rsi_14", "ret_60d"]
    one = series.daily_features(blocked(sdf, 100000), only=names).toPandas()
    many = series.daily_features(blocked(sdf, 150, back=140), only=names).toPandas()
    a, b = (x.sort_values(["symbol", "date"]).reset_index(drop=True) for x in (one, many))
    for n in [*names, "forward_ret"]:
        np.testing.assert_allclose(a[n].astype(float), b[n].astype(float), rtol=1e-7, atol=1e-9, err_msg=n)


def test_exponential_means_share_a_sort(panel):
    """Two calls after by_cells(), and a window after them, sort the rows by cell once; values stay those of pandas."""
    pdf, sdf = panel
    r = Rolling()
    df = r.add(blocked(sdf, 100000), {"p": r.position()})
    df = r.ewm(r.by_cells(df, "p", 26), {"e": ("close", 26), "f": ("close", 5)}, "p")
    df = r.add(r.ewm(df, {"g": ("close", 9)}, "p", adjust=False), {"d": r.diff("e")})
    own = r.ewm(df, {"h": ("close", 200)}, "p")  # fades too slowly for these cells
    plan = df._jdf.queryExecution().executedPlan().toString()
    # by date for the positions, by cell for all that follows
    assert plan.count("Sort [symbol") == 2, plan
    compare(own, pdf, {"e": lambda g: g.close.ewm(span=26).mean(), "f": lambda g: g.close.ewm(span=5).mean(),
                       "g": lambda g: g.close.ewm(span=9, adjust=False).mean(), "d": lambda g: g.close.ewm(span=26).mean().diff(),
                       "h": lambda g: g.close.ewm(span=200).mean()})
