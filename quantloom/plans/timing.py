"""Market timing features: an index series and per-date breadth across symbols.

The index has one row per date, so its windows run on a single small series. Breadth
starts from per-symbol windows over blocks and ends in per-date aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.functions.exprs import ratio
from quantloom.functions.rolling import (Rolling, at_least, at_most, div, first_hit, lit,
                                         mean_abs_dev, over, rank_of_last, sorted_quantile,
                                         tail_mean, with_exprs)
from quantloom.operators import xsection as xs
from quantloom.operators.layout import write_out
from quantloom.plans.series import equal_weight_index
from quantloom.settings import DEFAULTS, Settings

BREADTH = ("cross_ret_disp_5d", "cross_ret_disp_20d", "cross_vol_disp_20d", "up_ratio_5d",
           "up_ratio_20d", "down_ratio_5d", "down_ratio_20d", "cross_skew_20d", "cross_kurt_20d",
           "large_ret_disp_20d", "small_ret_disp_20d", "big_small_ret_diff_20d",
           "cross_turnover_disp_20d", "high_low_corr_20d")
EDGE = 50  # fixed value: names in the top and bottom groups


def index_features(index: DataFrame) -> DataFrame:
    """The 81 series features of one bar series per ``series`` key (column required)."""
    r = Rolling(keys=("series",))
    h = r.relaxed()
    df = r.add(index, {"_pc": r.lag("close"), "_pos": r.position(), "_tp": "(high + low + close) / 3"})
    df = with_exprs(df, {
        "_ret": f"{div('close', '_pc')} - 1", "_dc": "close - _pc",
        "_hl2": f"pow(ln({div('high', 'low')}), 2D)",
        "_gk": f"0.5D * pow(ln({div('high', 'low')}), 2D) - {lit(2 * math.log(2) - 1)}"
               f" * pow(ln({div('close', 'open')}), 2D)",
        "_rng": at_least("(high - low)", 1e-8),
    })
    df = r.add(df, {
        "_gain": at_least("_dc", 0), "_loss": f"-{at_most('_dc', 0)}",
        "_rup": at_least("_ret", 0), "_rdn": at_most("_ret", 0), "_nrdn": f"-{at_most('_ret', 0)}",
        "_isup": "CASE WHEN _ret > 0 THEN 1D ELSE 0D END",
        "_signed": "coalesce(signum(_ret), 0D) * volume",
        "_flow": div("(close - low) - (high - close)", "_rng") + " * volume",
        "_mf": "_tp * volume", "_ptp": r.lag("_tp"),
        "_ill": over("abs(_ret)", "volume"),
        "_ush": div("high - greatest(open, close)", "_rng"),
        "_lsh": div("least(open, close) - low", "_rng"),
        "_body": div("abs(close - open)", "_rng"),
    })
    df = r.add(df, {
        "_obv": r.cumulative("_signed"), "_ad": r.cumulative("_flow"),
        # the first bar has no earlier price and counts as a fall
        "_mfp": "CASE WHEN _tp > _ptp THEN _mf ELSE 0D END",
        "_mfn": "CASE WHEN _tp > _ptp THEN 0D ELSE _mf END",
        **{f"_v{w}": r.std("_ret", w) for w in (5, 20, 60)},
        **{f"vol_{w}d": h.std("_ret", w) for w in (5, 10, 20, 60)},
        **{f"_ma{w}": h.mean("close", w) for w in (5, 10, 20, 60, 120)},
        "_sd20": h.std("close", 20), "_tpm": h.mean("_tp", 20), "_rm20": r.mean("_ret", 20),
        "_rm60": r.mean("_ret", 60),
        "_tps": r.values("_tp", 20), "_hs": r.values("high", 25), "_ls": r.values("low", 25),
        "_h25": r.top("high", 25), "_l25": r.bottom("low", 25),
        "_rs20": f"CASE WHEN {r.count('_ret', 20)} >= 20 THEN sort_array({r.values('_ret', 20)}) END",
        "_rs60": f"CASE WHEN {r.count('_ret', 60)} >= 60 THEN sort_array({r.values('_ret', 60)}) END",
        "_h14": r.top("high", 14), "_l14": r.bottom("low", 14),
        **{f"_vm{w}": h.mean("volume", w) for w in (5, 10, 20, 60)},
    })
    df = with_exprs(df, {"_cut20": sorted_quantile("_rs20", 0.05), "_cut60": sorted_quantile("_rs60", 0.05),
                         "_tpa": f"CASE WHEN size(_tps) >= 20 THEN {mean_abs_dev('_tps', '_tpm')} END",
                         "bias_20d": over("(close - _ma20)", "_ma20")})
    df = r.ewm(df, {"_e12": ("close", 12), "_e26": ("close", 26)}, "_pos", adjust=False)
    df = with_exprs(df, {"_macd": "_e12 - _e26"})
    df = r.ewm(df, {"_sig": ("_macd", 9)}, "_pos", adjust=False)
    f = {f"ret_{w}d": r.change("close", w) for w in (1, 3, 5, 10, 20, 60)}
    f |= {f"rev_{w}d": f"-{r.change('close', w)}" for w in (5, 10, 20, 60)}
    for w in (20, 60):
        f[f"parkinson_vol_{w}d"] = f"sqrt({h.total('_hl2', w)} / {lit(w * math.log(2))})"
        gk = h.total("_gk", w)  # a negative estimate has no root
        f[f"garman_klass_vol_{w}d"] = f"CASE WHEN {gk} >= 0 THEN sqrt({gk} / {w}) END"
        f[f"sharpe_{w}d"] = over(r.mean("_ret", w), r.std("_ret", w))
        f[f"sortino_{w}d"] = over(r.mean("_ret", w), r.std("_rdn", w))
        f[f"gain_loss_{w}d"] = over(r.mean("_rup", w), r.mean("_nrdn", w))
        f[f"max_ret_{w}d"], f[f"min_ret_{w}d"] = h.top("_ret", w), h.bottom("_ret", w)
        f[f"trend_slope_{w}d"] = r.trend_strength("close", "_pos", w)
        f[f"vol_of_vol_{w}d"] = h.std("_v20", w)
        f[f"ad_line_slope_{w}d"] = r.trend_strength("_ad", "_pos", w)
        f[f"amihud_{w}d"] = h.mean("_ill", w)
        f[f"cvar_{w}d"] = tail_mean(f"_rs{w}", f"_cut{w}")
    for w in (5, 10, 60, 120):
        f[f"bias_{w}d"] = over(f"(close - _ma{w})", f"_ma{w}")
    for w in (6, 14, 24):
        f[f"rsi_{w}d"] = f"100 - 100 / (1 + {over(r.mean('_gain', w), r.mean('_loss', w))})"
    for w in (60, 120):
        f[f"_reg{w}"] = f"CASE WHEN {r.count('_v20', w)} >= {w} THEN {r.values('_v20', w)} END"
    f |= {
        "vol_ratio_5_20": over("_v5", "_v20"), "vol_ratio_20_60": over("_v20", "_v60"),
        "vol_expansion_20d": over("_v20", "vol_60d"),
        "boll_width_20d": over("(4 * _sd20)", "_ma20"),
        "boll_pctb_20d": over("(close - (_ma20 - 2 * _sd20))", "(4 * _sd20)"),
        "macd_hist": "_macd - _sig", "macd_signal": over("_sig", "close"),
        "cci_20d": over("(_tp - _tpm)", "(0.015D * _tpa)"),
        "volume_ratio_5_20": over("_vm5", "_vm20"), "volume_ratio_10_60": over("_vm10", "_vm60"),
        "volume_shock_5d": over("volume", "_vm20"),
        "obv_slope_20d": r.trend_strength("_obv", "_pos", 20),
        "amt_mom_20d": r.change("amount", 20),
        "aroon_osc_25d": f"CASE WHEN size(_hs) >= 25 THEN ({first_hit('_hs', '_h25')}"
                         f" - {first_hit('_ls', '_l25')}) / 24 END",
        "skew_20d": h.skew("_ret", 20), "kurt_20d": h.kurt("_ret", 20),
        "momentum_vol_ratio": over("(_rm20 * 20)", f"(_v20 * {lit(math.sqrt(20))})"),
        "reversal_vol_ratio": over("bias_20d", "vol_20d"),
        "williams_r_14d": over("(_h14 - close)", "(_h14 - _l14)") + " * -100",
        "mfi_14d": f"100 - 100 / (1 + {over(r.total('_mfp', 14), r.total('_mfn', 14))})",
        "vol_term_5_60": over("_v5", "_v60"), "vol_term_20_60": over("_v20", "_v60"),
        "vol_term_slope": over("(_v5 - _v20)", "_v60"),
        "vol_price_div_5d": f"{r.mean('_ret', 5)} - {r.change('volume', 5)}",
        "vol_mom_accel": f"{r.change('volume', 10)} - {r.change('volume', 20)}",
        "trend_regime": " + ".join(
            f"(CASE WHEN _ma{a} > _ma{b} THEN 1D ELSE -1D END) / 3" for a, b in ((5, 10), (10, 20), (20, 60))),
        "mean_rev_signal": "-" + over(f"({over('(close - _ma60)', '_ma60')})", "_v60"),
        "sentiment_greed": f"({r.mean('_isup', 20)} - 0.5D) * 2 * -signum({r.change('_v20', 10)})",
        "momentum_divergence": over("(_rm20 - _rm60)", "_v60"),
        "upper_shadow_20d": h.mean("_ush", 20), "lower_shadow_20d": h.mean("_lsh", 20),
        "candle_body_20d": h.mean("_body", 20),
    }
    df = r.add(df, f)
    df = with_exprs(df, {"amihud_ratio": over("amihud_20d", "amihud_60d"),
                         **{f"vol_regime_{w}d": rank_of_last(f"_reg{w}", "_v20") for w in (60, 120)}})
    names = [n for n in f if not n.startswith("_")] + [
        "amihud_ratio", "vol_regime_60d", "vol_regime_120d", "bias_20d", "vol_5d", "vol_10d", "vol_20d", "vol_60d"]
    return df.select("series", "date", *sorted(names))


def stock_inputs(bars: DataFrame) -> DataFrame:
    """Per symbol and date: 5 and 20 bar returns, 20 bar volatility, the last 60 returns."""
    r = Rolling()
    df = r.add(bars, {"_pc": r.lag("close"), "_pos": r.position()})
    df = with_exprs(df, {"_lr": f"ln({div(at_least('close', 1e-8), at_least('_pc', 1e-8))})",
                         "_r": f"{div('close', '_pc')} - 1"})
    # the first bar has no return and counts as 0 in the volatility frame
    df = with_exprs(df, {"_lr0": "coalesce(_lr, 0D)"})
    df = r.add(df, {"ret_5d": r.change("close", 5), "ret_20d": r.change("close", 20),
                    "vol_20d": r.std("_lr0", 20), "_last": r.values("_r", 60)})
    return df.filter("NOT halo AND _pos >= 21").select(
        "date", "symbol", "ret_5d", "ret_20d", "vol_20d", "turn", "_last")


def mean_pair_correlation(stocks: DataFrame, rows: int = 60) -> DataFrame:
    """Per date, the mean correlation over all pairs of symbols, without forming pairs.

    With z the standardised last 60 returns of each symbol, the correlations of all pairs
    (self pairs included) sum to mean over k of (sum over symbols z_k) ** 2.
    """
    full = stocks.filter(F.size("_last") >= rows).select("date", "_last")

    def day_sums(batches):
        # one row per date and task leaves
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column("_last").flatten().to_numpy(zero_copy_only=False).reshape(-1, rows)
            varies = last.min(axis=1) != last.max(axis=1)
            date, last = batch.column("date").cast(pa.int32()).to_numpy()[varies], last[varies]
            if not len(last):
                continue
            d = last - last.mean(axis=1, keepdims=True)
            z = d / np.sqrt((d * d).mean(axis=1, keepdims=True))
            order = np.argsort(date, kind="stable")
            days, start, n = np.unique(date[order], return_index=True, return_counts=True)
            for day, total, k in zip(days.tolist(), np.add.reduceat(z[order], start, axis=0), n.tolist()):
                old, m = sums.get(day, (0.0, 0))
                sums[day] = (old + total, m + k)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int32()).cast(pa.date32()), pa.array([t.tolist() for t, _ in sums.values()], pa.list_(pa.float64())),
            pa.array([m for _, m in sums.values()], pa.int64())], ["date", "z", "n"])

    per = full.mapInArrow(day_sums, "date date, z array<double>, n bigint").groupBy("date").agg(
        F.sum("n").alias("_n"), *[F.sum(F.get("z", F.lit(k))).alias(f"_z{k}") for k in range(rows)])
    squares = F.aggregate(F.array(*[F.col(f"_z{k}") for k in range(rows)]), F.lit(0.0), lambda a, v: a + v * v) / rows
    return per.select("date", "_n", squares.alias("_q")).select(
        "date", F.when(F.col("_n") >= 10, ratio(F.col("_q") - F.col("_n"), F.col("_n") * (F.col("_n") - 1)))
        .alias("high_low_corr_20d"))


def breadth_features(bars: DataFrame, heavy: bool | None = None,
                     settings: Settings = DEFAULTS) -> DataFrame:
    """The 14 breadth columns per date; short dates take the neutral defaults."""
    stocks = stock_inputs(bars)
    # the frames of returns are many times a row: they are summed where they form, and not written
    s = write_out(stocks.drop("_last"), "breadth")
    share = lambda c, up: F.coalesce(F.avg(F.when(F.col(c).isNotNull(),
                                                  ((F.col(c) > 0) if up else (F.col(c) < 0)).cast("double"))), F.lit(0.5))
    disp = lambda c: F.when(F.count(c) > 2, F.stddev_pop(c)).otherwise(0.0)
    n = F.count("ret_20d").cast("double")
    skew = F.when(n > 5, F.skewness("ret_20d") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when(n > 5, ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("ret_20d") + 6)).otherwise(0.0)
    days = bars.filter("NOT halo").select("date").distinct()
    base = s.groupBy("date").agg(
        disp("ret_5d").alias("cross_ret_disp_5d"), disp("ret_20d").alias("cross_ret_disp_20d"),
        disp("vol_20d").alias("cross_vol_disp_20d"),
        share("ret_5d", True).alias("up_ratio_5d"), share("ret_20d", True).alias("up_ratio_20d"),
        share("ret_5d", False).alias("down_ratio_5d"), share("ret_20d", False).alias("down_ratio_20d"),
        skew.alias("cross_skew_20d"), kurt.alias("cross_kurt_20d"), disp("turn").alias("cross_turnover_disp_20d"))
    ranked = xs.ordinal_rank(s.select("date", "symbol", "ret_20d"), ["date"], "ret_20d", "_rn",
                             heavy=heavy, settings=settings).filter("_rn_n >= 100")
    top = F.when(F.col("_rn") > F.col("_rn_n") - EDGE, F.col("ret_20d"))
    low = F.when(F.col("_rn") <= EDGE, F.col("ret_20d"))
    edges = ranked.groupBy("date").agg(
        F.stddev_pop(top).alias("large_ret_disp_20d"), F.stddev_pop(low).alias("small_ret_disp_20d"),
        (F.avg(top) - F.avg(low)).alias("big_small_ret_diff_20d"))
    out = (days.join(base, "date", "left").join(edges, "date", "left")
           .join(mean_pair_correlation(stocks), "date", "left"))
    default = {c: 0.5 if "ratio" in c else 0.0 for c in BREADTH}
    return out.select("date", *[F.coalesce(F.col(c), F.lit(default[c])).alias(c) for c in BREADTH])


def timing_raw(bars: DataFrame, heavy: bool | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    index = equal_weight_index(bars).withColumn("series", F.lit("index"))
    return index_features(index).join(breadth_features(bars, heavy, settings), "date")


def timing_features(bars: DataFrame, heavy: bool | None = None, horizon: int = 1,
                    settings: Settings = DEFAULTS) -> DataFrame:
    """All 95 columns as growing z-scores (20 values at least), with the index label.

    One row per date: the growing windows run on a calendar-sized series.
    """
    raw = write_out(timing_raw(bars, heavy, settings), "timing")
    names = [c for c in raw.columns if c not in ("date", "series")]
    w = Window.partitionBy("series").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    stats = raw.select("series", "date", *names, *[
        e for c in names for e in (F.count(c).over(upto).alias(f"_n_{c}"), F.avg(c).over(upto).alias(f"_m_{c}"),
                                   F.stddev_samp(c).over(upto).alias(f"_s_{c}"))])
    z = stats.select("series", "date", *[
        F.when(F.col(f"_n_{c}") >= 20, (F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(1e-8)))
        .alias(c) for c in names])
    close = equal_weight_index(bars).select("date", "close").withColumn("series", F.lit("index"))
    label = close.withColumn("forward_ret", F.try_divide(F.lead("close", horizon).over(w), "close") - 1)
    return z.join(label.select("date", "forward_ret"), "date").drop("series")
