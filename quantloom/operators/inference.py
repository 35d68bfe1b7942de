"""Regression-based statistics over (factor, date) panels.

The per-date step is a map-side-combined aggregate. What follows works on one row per
(factor, date) or per factor, so its windows are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from quantloom.functions.exprs import all_of, ratio, t_two_sided
from quantloom.operators import xsection as xs
from quantloom.settings import DEFAULTS, Settings

MAX_CONDITION = 1e10  # fixed value: designs worse than this are skipped


def daily_regressions(df: DataFrame, x: str = "x", y: str = "ret", keys=("fid", "date"),
                      min_rows: int = 30) -> DataFrame:
    """Per group: slope of y on (1, x) with its t-value, R2 and adjusted R2."""
    keys = list(keys)
    g = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys)
         .agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"),
              F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
              F.covar_pop(x, y).alias("_c")))
    return regressions(g, keys, min_rows)


def regressions(moments: DataFrame, keys: Sequence[str], min_rows: int = 30) -> DataFrame:
    """Regression of each group from its count ``n``, mean ``_mx``, variances ``_vx``, ``_vy`` and covariance ``_c``."""
    g = moments.filter(F.col("n") >= min_rows)
    # condition number of [1, x] from the eigenvalues of its 2x2 gram matrix / n
    q = F.col("_vx") + F.col("_mx") * F.col("_mx")
    top = ((1 + q) + F.sqrt(F.greatest((1 + q) * (1 + q) - 4 * F.col("_vx"), F.lit(0.0)))) / 2
    ok = top * top <= F.lit(MAX_CONDITION * MAX_CONDITION) * F.col("_vx")
    beta = F.col("_c") / F.col("_vx")
    r2 = ratio(F.col("_c") * F.col("_c"), F.col("_vx") * F.col("_vy"))
    dof = F.col("n") - 2
    return (g.filter(ok).withColumn("beta", beta).withColumn("r2", r2)
            .withColumn("adj_r2", 1 - (1 - F.col("r2")) * (F.col("n") - 1) / dof)
            .withColumn("beta_t", ratio(F.col("beta"),
                                        F.sqrt((F.col("_vy") - F.col("beta") * F.col("_c"))
                                               / (F.col("_vx") * dof))))
            .select(*keys, "n", "beta", "r2", "adj_r2", "beta_t"))


def hac_mean(df: DataFrame, value: str, by: Sequence[str], order: str = "date", lags: int = 3) -> DataFrame:
    """Mean of a series with its Newey-West standard error (Bartlett weights, n/(n-1)).

    Lags count the rows present. One row per (by, order) comes in, one per ``by`` leaves.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("_u", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    s = F.sum(F.col("_u") * F.col("_u"))
    for k in range(1, lags + 1):
        d = d.withColumn(f"_u{k}", F.lag("_u", k).over(w))
        s = s + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("_u") * F.col(f"_u{k}")), F.lit(0.0))
    n = F.count(F.lit(1))
    return d.groupBy(*by).agg(F.avg(value).alias("mean"), n.alias("n_periods"),
                              F.sqrt(s / (n * n) * ratio(n, n - 1)).alias("se"))


def fama_macbeth(df: DataFrame, x: str = "x", y: str = "ret", by: Sequence[str] = ("fid",),
                 min_stocks: int = 30, min_periods: int = 10, lags: int = 3, n_groups: int = 5,
                 heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per factor: mean cross-sectional slope with HAC t, fit, rank IC and spread.

    A factor below the period minimums keeps its row with t = 0 and p = 1.
    """
    by = list(by)
    keys = [*by, "date"]
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    buckets = xs.quantile_bucket(df, x, keys, n_groups, "bucket", heavy, settings)
    return _metrics(df.groupBy(*by).agg(F.count_distinct("date").alias("_dates")), daily_regressions(df, x, y, keys, min_stocks),
                    xs.rank_ic(df, x, y, keys, 31, heavy, settings), xs.bucket_returns(buckets, y, by), by, min_stocks, min_periods, lags)


def fama_macbeth_daily(days: DataFrame, by: Sequence[str] = ("fid",), min_stocks: int = 30, min_periods: int = 10,
                       lags: int = 3) -> DataFrame:
    """:func:`fama_macbeth` from the rows of :func:`daily.sections`, one per factor and date."""
    by = list(by)
    moments = days.select(*by, "date", "n", *[F.col(c).alias(f"_{c}") for c in ("mx", "vx", "vy", "c")])
    returns = days.select(*by, F.inline("buckets")).groupBy(*by, "bucket").agg((F.sum("total") / F.sum("n")).alias("mean_ret"))
    ic = days.filter(F.col("n") >= 31).select(*by, "date", "ic")
    return _metrics(days.groupBy(*by).agg(F.count_distinct("date").alias("_dates")), regressions(moments, [*by, "date"], min_stocks),
                    ic, returns, by, min_stocks, min_periods, lags)


def _metrics(dates: DataFrame, reg: DataFrame, ic: DataFrame, returns: DataFrame, by: list[str], min_stocks: int, min_periods: int,
             lags: int) -> DataFrame:
    """The row per factor from its dates' regressions and rank ICs and its buckets' mean returns."""
    nw = hac_mean(reg, "beta", by, "date", lags)
    fit = reg.groupBy(*by).agg(
        F.avg("r2").alias("fm_r2"), F.avg("adj_r2").alias("fm_adj_r2"),
        F.avg((F.col("beta") > 0).cast("double")).alias("pos_ratio"),
        F.avg((F.abs(F.coalesce("beta_t", F.lit(0.0))) > 1.96).cast("double")).alias("sig_ratio"))
    ic = xs.ic_summary(ic, by)
    spread = xs.bucket_spread(returns, by)
    out = dates.join(nw, by, "left").join(fit, by, "left").join(ic, by, "left").join(spread, by, "left")
    ok = (F.col("_dates") >= min_stocks) & (F.coalesce("n_periods", F.lit(0)) >= min_periods)
    t = F.when(F.col("se") > 1e-10, F.col("mean") / F.col("se")).otherwise(0.0)
    zero = lambda c: F.when(ok, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return (out.withColumn("_t", F.when(ok, t).otherwise(0.0))
            .select(*by, zero(F.col("mean")).alias("fm_coef"), zero(F.col("se")).alias("fm_se"),
                    F.col("_t").alias("fm_t"),
                    F.when(ok, t_two_sided(F.col("_t"), F.col("n_periods") - 1)).otherwise(1.0).alias("fm_p"),
                    F.coalesce("n_periods", F.lit(0)).alias("n_periods"),
                    *[zero(F.col(c)).alias(c) for c in ("fm_r2", "fm_adj_r2", "pos_ratio", "sig_ratio",
                                                        "ls_spread")],
                    zero(F.col("ic_mean")).alias("rank_ic"), zero(F.col("icir")).alias("icir"),
                    F.when(ok, F.coalesce("n_buckets", F.lit(0))).otherwise(0).alias("n_buckets")))


def group_effect_regressions(df: DataFrame, group: str, x: str = "x", y: str = "ret",
                             keys=("fid", "date"), min_rows: int = 30) -> DataFrame:
    """Per date slope of y on x with one dummy per value of ``group``.

    Dummies are partialled out by removing group means, which gives the same slope.
    """
    keys = list(keys)
    df = df.filter(all_of([F.col(c).isNotNull() for c in (x, y, group)]))
    means = df.groupBy(*keys, group).agg(F.avg(x).alias("_gx"), F.avg(y).alias("_gy"))
    d = (df.join(means, [*keys, group])
         .withColumn("_dx", F.col(x) - F.col("_gx")).withColumn("_dy", F.col(y) - F.col("_gy")))
    return (d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(F.col("_dx") * F.col("_dy")).alias("_xy"),
                                 F.sum(F.col("_dx") * F.col("_dx")).alias("_xx"))
            .filter((F.col("n") >= min_rows) & (F.col("_xx") > 1e-12))
            .select(*keys, "n", (F.col("_xy") / F.col("_xx")).alias("beta")))


def controlled_regressions(df: DataFrame, control: str, x: str = "x", y: str = "ret", keys=("fid", "date"),
                           min_rows: int = 30, max_values: int = 20) -> DataFrame:
    """Per date slope of y on x with one control: as dummies where the control takes more
    than ``max_values`` distinct values on that date, as a plain column elsewhere.

    Partialling the control out of both sides gives the same slope in either form.
    """
    keys = list(keys)
    df = df.filter(all_of([F.col(c).isNotNull() for c in (x, y, control)]))
    kinds = df.groupBy(*keys).agg((F.count_distinct(control) > max_values).alias("_dummies"))
    d = df.join(kinds, keys)
    many = group_effect_regressions(d.filter("_dummies"), control, x, y, keys, min_rows)
    res = xs.neutralise(d.filter("NOT _dummies").select(*keys, x, y, control), [x, y], [control], keys, min_rows)
    few = daily_regressions(res, x, y, keys, min_rows).select(*keys, "n", "beta")
    return many.unionByName(few)


def _series(by):
    return Window.partitionBy(*by).orderBy("date")


def drawdown(df: DataFrame, ret: str, by: Sequence[str]) -> DataFrame:
    """Most negative distance of the compounded series from its running peak, per series.

    Growth is a running sum of logs; the peak starts at the first value, not at 1.
    """
    w = _series(by).rowsBetween(Window.unboundedPreceding, 0)
    growth = F.sum(F.log(F.greatest(1 + F.col(ret), F.lit(1e-12)))).over(w)
    d = df.withColumn("_g", growth).withColumn("_peak", F.max("_g").over(w))
    return d.groupBy(*by).agg(F.min(F.exp(F.col("_g") - F.col("_peak")) - 1).alias("max_dd"),
                              F.max_by("_g", "date").alias("log_growth"))


def annualised(log_growth: Column, n: Column, per_year: float = 252.0) -> Column:
    """Yearly rate from total log growth; staying in logs keeps a wiped-out series at -1."""
    return F.exp(log_growth * F.lit(per_year) / n) - 1


def timing_eval(df: DataFrame, x: str = "x", y: str = "ret", by: Sequence[str] = ("fid",),
                lags: int = 3, min_rows: int = 50) -> DataFrame:
    """Series regression of y on x with HAC t, and long/flat trading statistics.

    Input has one row per (factor, date).
    """
    by = list(by)
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    whole = Window.partitionBy(*by)
    d = (d.withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") >= min_rows)
         .withColumn("_mx", F.avg(x).over(whole)).withColumn("_my", F.avg(y).over(whole))
         .withColumn("_b", F.covar_pop(x, y).over(whole) / F.var_pop(x).over(whole))
         .withColumn("_e", F.col(y) - F.col("_my") - F.col("_b") * (F.col(x) - F.col("_mx")))
         .withColumn("_h", (F.col(x) - F.col("_mx")) * F.col("_e")))
    s = F.sum(F.col("_h") * F.col("_h"))
    for k in range(1, lags + 1):
        d = d.withColumn(f"_h{k}", F.lag("_h", k).over(_series(by)))
        s = s + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("_h") * F.col(f"_h{k}")), F.lit(0.0))
    d = d.withColumn("_s", F.when(F.col(x) > 0, F.col(y)).otherwise(0.0))
    n = F.count(F.lit(1))
    sxx = F.var_pop(x) * n
    gain = F.sum(F.when(F.col("_s") > 0, F.col("_s")))
    loss = F.sum(F.when(F.col("_s") < 0, F.col("_s")))
    hit = (F.signum(F.col(x)) == F.signum(F.col(y))).cast("double")
    stats = d.groupBy(*by).agg(
        n.alias("n_periods"), F.max("_b").alias("coef"),
        F.sqrt(s * n / (n - 2)).alias("_root"), sxx.alias("_sxx"),
        (F.covar_pop(x, y) * F.covar_pop(x, y)).alias("_c2"),
        (F.var_pop(x) * F.var_pop(y)).alias("_vv"),
        F.avg(hit).alias("direction_accuracy"),
        F.avg("_s").alias("_ms"), F.stddev_pop("_s").alias("_ss"),
        gain.alias("_gain"), loss.alias("_loss"))
    out = stats.join(drawdown(d, "_s", by), by)
    se = F.col("_root") / F.col("_sxx")
    t = F.when(se > 1e-10, F.col("coef") / se).otherwise(0.0)
    return out.select(
        *by, "n_periods", "coef", se.alias("se"), t.alias("t_stat"),
        t_two_sided(t, F.col("n_periods") - 2).alias("p_value"),
        ratio(F.col("_c2"), F.col("_vv")).alias("r2"), "direction_accuracy",
        F.when(F.col("_ss") > 1e-10, F.col("_ms") / F.col("_ss") * F.sqrt(F.lit(252.0)))
        .otherwise(0.0).alias("sharpe"),
        annualised(F.col("log_growth"), F.col("n_periods")).alias("annual_return"),
        F.col("max_dd").alias("max_drawdown"),
        F.coalesce(ratio(F.col("_gain"), F.abs(F.col("_loss"))), F.lit(0.0)).alias("profit_factor"))


def style_orthogonality(ls: DataFrame, styles: DataFrame, style_cols: Sequence[str],
                        lags: int = 5, strong: float = 2.0, marginal: float = 1.5) -> DataFrame:
    """Regress each factor's daily spread (fid, date, ls) on the style series.

    Days are those where every factor that meets the coverage rule and every style are
    present. One series is one row per day, so a factor's rows are bounded by the calendar
    and its small least-squares problem runs in one pandas group.
    """
    cols = list(style_cols)
    k = len(cols) + 1
    w_days = ls.agg(F.count_distinct("date").alias("_days")).withColumn("_one", F.lit(1))
    counts = (ls.filter(F.col("ls").isNotNull()).groupBy("fid").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_one", F.lit(1)).join(F.broadcast(w_days), "_one")
              .filter(F.col("_n") >= F.greatest(F.lit(30), F.floor(F.col("_days") * 0.5)))
              .select("fid"))
    kept = ls.join(counts, "fid", "left_semi").filter(F.col("ls").isNotNull())
    n_f = counts.agg(F.count(F.lit(1)).alias("_nf")).withColumn("_one", F.lit(1))
    complete = (kept.groupBy("date").agg(F.count(F.lit(1)).alias("_k")).withColumn("_one", F.lit(1))
                .join(F.broadcast(n_f), "_one").filter(F.col("_k") == F.col("_nf")).select("date"))
    joined = (kept.join(complete, "date", "left_semi")
              .join(styles.select("date", *cols).dropna(), "date"))
    fields = [("fid", T.StringType())] + [(f"beta_{c}", T.DoubleType()) for c in ["alpha", *cols]]
    fields += [(f"t_{c}", T.DoubleType()) for c in ["alpha", *cols]]
    fields += [("r2", T.DoubleType()), ("n", T.LongType()), ("n_start", T.DateType()), ("n_end", T.DateType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["ls"].to_numpy(float)
        x = np.column_stack([np.ones(len(y)), pdf[cols].to_numpy(float)])
        bread = np.linalg.pinv(x.T @ x)
        beta = bread @ (x.T @ y)
        res = y - x @ beta
        score = x * res[:, None]
        meat = score.T @ score
        for lag in range(1, lags + 1):
            lagged = score[lag:].T @ score[:-lag]
            meat += (1 - lag / (lags + 1)) * (lagged + lagged.T)
        n = len(y)
        se = np.sqrt(np.diag(bread @ meat @ bread) * n / (n - k))
        t = np.where(se > 1e-10, beta / se, 0.0)
        r2 = 1 - (res @ res) / ((y - y.mean()) @ (y - y.mean()))
        return pd.DataFrame([[pdf["fid"].iloc[0], *beta, *t, r2, n,
                              pdf["date"].min(), pdf["date"].max()]], columns=[f[0] for f in fields])

    res = joined.groupBy("fid").applyInPandas(fit, schema)
    at = F.abs(F.col("t_alpha"))
    return (res.withColumnRenamed("beta_alpha", "alpha")
            .withColumn("p_alpha", t_two_sided(F.col("t_alpha"), F.col("n") - k))
            .withColumn("judgment", F.when(at > strong, "Pure Alpha").when(at > marginal, "Marginal")
                        .otherwise("Risk-proxy")))


def segment_fm(df: DataFrame, segments: DataFrame, min_stocks: int = 30, heavy=None,
               settings: Settings = DEFAULTS) -> DataFrame:
    """Fama-MacBeth per (factor, segment); ``segments`` maps date to segment."""
    return fama_macbeth(df.join(segments, "date"), by=["fid", "segment"], min_stocks=min_stocks,
                        heavy=heavy, settings=settings)


def segment_fm_daily(days: DataFrame, segments: DataFrame, min_stocks: int = 30) -> DataFrame:
    """:func:`segment_fm` from the rows of :func:`daily.sections`, one per factor and date."""
    return fama_macbeth_daily(days.join(segments, "date"), by=["fid", "segment"], min_stocks=min_stocks)


def robustness_share(segment_metrics: DataFrame) -> DataFrame:
    """Share of segments (at least 30 periods) with t * IC > 0 and |t| >= 1, per factor."""
    hit = ((F.col("fm_t") * F.col("rank_ic") > 0) & (F.abs("fm_t") >= 1.0)).cast("double")
    return (segment_metrics.filter(F.col("n_periods") >= 30).groupBy("fid")
            .agg(F.avg(hit).alias("robustness"), F.count(F.lit(1)).alias("n_segments")))


def amplitude(df: DataFrame, x: str = "x", y: str = "ret", by: Sequence[str] = ("fid",)) -> DataFrame:
    """Least-squares scale a = sum(y x) / sum(x x); NULL when sum(x x) <= 1e-12."""
    xx = F.sum(F.col(x) * F.col(x))
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    return (df.filter(ok).groupBy(*by)
            .agg(F.sum(F.col(x) * F.col(y)).alias("_xy"), xx.alias("_xx"))
            .select(*by, F.when(F.col("_xx") > 1e-12, F.col("_xy") / F.col("_xx")).alias("amplitude")))


def stable_candidates(metrics: DataFrame, candidates: DataFrame, entrance_t: float = 2.0,
                      min_t: float = 1.0, min_hits: int = 2) -> DataFrame:
    """Pick per group the candidate whose t holds its sign across variants.

    ``metrics`` has (fid, variant, t) with variant ``orig`` plus the perturbed refits;
    ``candidates`` has (fid, grp, complexity, loss).
    """
    orig = metrics.filter(F.col("variant") == "orig").select("fid", F.col("t").alias("orig_t"))
    j = metrics.join(orig, "fid").filter(F.col("t").isNotNull())
    hit = (F.signum("t") == F.signum("orig_t")) & (F.abs("t") >= min_t)
    s = j.groupBy("fid").agg(F.max("orig_t").alias("orig_t"),
                             F.sum(hit.cast("int")).alias("hits"), F.count(F.lit(1)).alias("n_states"))
    s = (s.filter((F.abs("orig_t") >= entrance_t) & (F.col("hits") >= min_hits))
         .withColumn("stability", F.col("hits") / F.col("n_states")).join(candidates, "fid"))
    w = Window.partitionBy("grp").orderBy(F.desc("stability"), F.desc(F.abs("orig_t")), "complexity",
                                          "loss", "fid")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def window_icir(ic: DataFrame, windows: DataFrame, rows: str = "n", min_rows: int = 200,
                min_days: int = 5) -> DataFrame:
    """ICIR per (factor, window) from daily ICs (fid, date, n, ic) and (date, window)."""
    return (ic.join(windows, "date").groupBy("fid", "window")
            .agg(F.sum(rows).alias("n_rows"), F.count("ic").alias("n_days"), F.avg("ic").alias("_m"),
                 F.stddev_samp("ic").alias("_s"))
            .filter((F.col("n_rows") >= min_rows) & (F.col("n_days") >= min_days))
            .select("fid", "window", "n_rows", "n_days", (F.col("_m") / (F.col("_s") + 1e-8)).alias("icir")))


def stability_summary(per_window: DataFrame) -> DataFrame:
    """Mean ICIR, same-sign flag and share of windows that agree with the majority sign."""
    pos = F.avg((F.col("icir") > 0).cast("double"))
    return per_window.groupBy("fid").agg(
        F.avg("icir").alias("mean_icir"), F.min("icir").alias("min_icir"), F.max("icir").alias("max_icir"),
        F.count(F.lit(1)).alias("n_windows"),
        ((F.min("icir") > 0) | (F.max("icir") < 0)).alias("same_sign"),
        F.greatest(pos, F.avg((F.col("icir") < 0).cast("double"))).alias("hit_rate"))


def cross_window(metrics: DataFrame, sources: DataFrame, min_t: float = 2.0,
                 min_periods: int = 30) -> DataFrame:
    """Judge factors found in window i on the test spans of later windows j.

    ``metrics``: (fid, window, n_periods, fm_t, rank_ic, icir) on each test span;
    ``sources``: (fid, src_window, src_t). An equi join on fid, then j > i.
    """
    j = (sources.join(metrics.withColumnRenamed("window", "test_window"), "fid")
         .filter(F.col("test_window") > F.col("src_window")))
    enough = F.col("n_periods") >= min_periods
    sign_ok = (F.col("src_t") == 0) | (F.signum("fm_t") == F.signum("src_t"))
    return j.select("src_window", "fid", "test_window", "n_periods",
                    F.when(enough, F.col("fm_t")).alias("fm_t"),
                    F.when(enough, F.col("rank_ic")).alias("rank_ic"),
                    F.when(enough, F.col("icir")).alias("icir"),
                    (enough & (F.abs("fm_t") >= min_t) & sign_ok).alias("passed"),
                    (~enough).alias("insufficient"))


def cross_window_summary(cross: DataFrame) -> DataFrame:
    ok = ~F.col("insufficient")
    return cross.agg(
        F.count(F.lit(1)).alias("n_evals"),
        F.sum((ok & F.col("passed")).cast("int")).alias("n_passed"),
        F.coalesce(F.avg(F.when(ok, F.col("passed").cast("double"))), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(F.when(ok, F.col("fm_t"))), F.lit(0.0)).alias("mean_t"),
        F.coalesce(F.avg(F.when(ok, F.col("rank_ic"))), F.lit(0.0)).alias("mean_ic"),
        F.coalesce(F.avg(F.when(ok, F.col("icir"))), F.lit(0.0)).alias("mean_icir"))
