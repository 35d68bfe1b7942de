"""Gates, rewards and registry analytics: expressions over one row per factor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Market:
    """Score curve (slope, threshold, weight) per metric and market."""

    t: tuple[float, float, float]
    icir: tuple[float, float, float]
    ic: tuple[float, float, float]


MID_CAP = Market(t=(2.0, 2.0, 0.20), icir=(25.0, 0.10, 1.0), ic=(150.0, 0.03, 1.0))
LARGE_CAP = Market(t=(3.0, 2.0, 0.35), icir=(20.0, 0.08, 1.0), ic=(100.0, 0.02, 1.0))
REWARD_FLOOR, REWARD_TOP = 0.3, 10.0
SIGN_FACTOR, SINGLE_FACTOR, SIMILAR_FACTOR = 0.1, 0.2, 0.1


def _sigmoid(slope: float, x: Column, at: float) -> Column:
    return 1.0 / (1.0 + F.exp(-slope * (x - at)))


def registration_verdict(df: DataFrame, market: Market = MID_CAP, settings: Settings = DEFAULTS,
                         t="fm_t", ic="rank_ic", icir="icir") -> DataFrame:
    """Adds ok, reason and gate_status from the test-set metrics."""
    s, t, ic, icir = settings, F.col(t), F.col(ic), F.col(icir)
    reason = (F.when(~((t * ic > 0) & (t * icir > 0)), "sign")
              .when(F.abs(t) < s.min_abs_t, "t").when(F.abs(ic) < s.min_abs_ic, "ic")
              .when(F.abs(icir) < s.min_abs_icir, "icir").otherwise(""))
    strong = ((F.abs(icir) >= market.icir[1]) & (F.abs(ic) >= market.ic[1])
              & (F.abs(t) >= s.weak_abs_t))
    return (df.withColumn("reason", reason).withColumn("ok", F.col("reason") == "")
            .withColumn("gate_status", F.when(F.col("ok"), F.when(strong, "STRONG").otherwise("WEAK"))))


# Timing thresholds.
TIMING_T, TIMING_DIR, TIMING_SHARPE = 0.8, 0.48, 0.3
TIMING_STRONG_SHARPE, TIMING_STRONG_DIR, TIMING_HIT = 1.0, 0.55, 0.52


def timing_verdict(df: DataFrame) -> DataFrame:
    t, d, s = F.abs("t_stat"), F.col("direction_accuracy"), F.abs("sharpe")
    reason = (F.when(t < TIMING_T, "t").when(d < TIMING_DIR, "direction")
              .when(s < TIMING_SHARPE, "sharpe").otherwise(""))
    strong = (s >= TIMING_STRONG_SHARPE) & (d >= TIMING_STRONG_DIR)
    return (df.withColumn("reason", reason).withColumn("ok", F.col("reason") == "")
            .withColumn("gate_status", F.when(F.col("ok"), F.when(strong, "STRONG").otherwise("WEAK"))))


def production_ready(settings: Settings = DEFAULTS, t="fm_t", ic="rank_ic", icir="icir",
                     n="n_periods", gate="gate_status", min_t=None, min_icir=None, min_ic=None) -> Column:
    s = settings
    return ((F.coalesce(F.col(gate), F.lit("")) != "WEAK")
            & (F.abs(t) >= (min_t or s.prod_abs_t)) & (F.abs(icir) >= (min_icir or s.prod_abs_icir))
            & (F.abs(ic) >= (min_ic or s.prod_abs_ic)) & (F.col(n) >= s.prod_min_periods))


def timing_production_ready(settings: Settings = DEFAULTS) -> Column:
    return ((F.coalesce(F.col("gate_status"), F.lit("")) != "WEAK")
            & (F.abs("t_stat") >= settings.prod_abs_t) & (F.abs("sharpe") >= TIMING_SHARPE)
            & (F.col("direction_accuracy") >= TIMING_HIT) & (F.col("n_periods") >= settings.prod_min_periods))


def monotone(t="fm_t", spread="ls_spread", buckets="n_buckets") -> Column:
    """Spread between the outer buckets has the sign of t; needs five buckets."""
    return (F.col(buckets) >= 5) & (F.when(F.col(t) >= 0, 1).otherwise(-1) * F.col(spread) > 0)


def _adjust(raw: Column, n_features, novel, max_jaccard, robustness) -> Column:
    r = raw
    if n_features is not None:
        r = r * F.when(F.col(n_features) <= 1, SINGLE_FACTOR).otherwise(1.0)
    if novel is not None:
        r = r * F.least(F.lit(1.5), 1.0 + 0.15 * F.col(novel))
    if max_jaccard is not None:
        r = r * F.when(F.col(max_jaccard) > 0.75, SIMILAR_FACTOR).otherwise(1.0)
    if robustness is not None:
        r = r * (0.3 + 0.7 * F.col(robustness))
    return F.greatest(r, F.lit(REWARD_FLOOR))


def quality_reward(market: Market = MID_CAP, t="fm_t", ic="rank_ic", icir="icir", n_features=None,
                   novel=None, max_jaccard=None, robustness=None) -> Column:
    score = F.lit(1.0)
    for name, (slope, at, weight) in ((t, market.t), (icir, market.icir), (ic, market.ic)):
        score = score * F.pow(_sigmoid(slope, F.abs(name), at), F.lit(weight))
    r = REWARD_FLOOR + (REWARD_TOP - REWARD_FLOOR) * score
    mixed = (F.signum(t) * F.signum(ic) < 0) | (F.signum(t) * F.signum(icir) < 0)
    return _adjust(r * F.when(mixed, SIGN_FACTOR).otherwise(1.0), n_features, novel, max_jaccard, robustness)


def timing_reward(n_features=None, novel=None, max_jaccard=None, robustness=None) -> Column:
    score = (F.pow(_sigmoid(2.0, F.abs("sharpe"), TIMING_SHARPE), F.lit(0.5))
             * _sigmoid(10.0, F.col("direction_accuracy"), TIMING_HIT)
             * F.pow(_sigmoid(1.5, F.abs("t_stat"), 1.5), F.lit(0.3)))
    return _adjust(REWARD_FLOOR + (REWARD_TOP - REWARD_FLOOR) * score, n_features, novel, max_jaccard, robustness)


def gate_fraction_reward(passed: list[str], weights: tuple[float, ...] = (1.0, 2.0, 1.5, 1.5)) -> Column:
    """Weighted share of passed gates (boolean columns, in order)."""
    total = sum(weights)
    return sum((F.col(c).cast("double") * w for c, w in zip(passed, weights)), F.lit(0.0)) / total


def raw_ic_reward(ic="rank_ic") -> Column:
    return F.abs(ic)


def funnel(log: DataFrame, stages: list[str]) -> DataFrame:
    """Counts of rows passing each boolean stage and the share kept from the first."""
    counts = log.agg(F.count(F.lit(1)).alias("trials"),
                     *[F.sum(F.col(c).cast("int")).alias(c) for c in stages])
    return counts.withColumn("retention", F.try_divide(F.col(stages[-1]), F.col("trials")))


def compare_registries(factors: DataFrame, production: Column) -> DataFrame:
    """Per registry tag: size, production count, metric levels, feature union, structures.

    ``factors`` has one row per registered factor: tag, fm_t, icir, rank_ic, features, signature.
    """
    base = factors.withColumn("_p", production.cast("int")).groupBy("tag").agg(
        F.count(F.lit(1)).alias("n_registered"), F.sum("_p").alias("n_production"),
        F.avg(F.abs("fm_t")).alias("mean_abs_t"), F.max(F.abs("fm_t")).alias("max_abs_t"),
        F.avg(F.abs("icir")).alias("mean_abs_icir"), F.avg(F.abs("rank_ic")).alias("mean_abs_ic"),
        F.count_distinct("signature").alias("structure_unique"))
    union = (factors.select("tag", F.explode_outer("features").alias("_f")).groupBy("tag")
             .agg(F.count_distinct("_f").alias("feature_union")))
    return base.join(union, "tag")


def rank_among(mined: DataFrame, benchmark: DataFrame, value: str = "sharpe") -> DataFrame:
    """Rank of each mined factor within the benchmark set by ``value`` (1 = best).

    Both are per-factor tables. Sorting the union replaces a comparison of all pairs; the
    one window runs over factors, not rows of the panel.
    """
    both = (benchmark.select("fid", value).withColumn("_b", F.lit(1))
            .unionByName(mined.select("fid", value).withColumn("_b", F.lit(0))))
    upto = (Window.partitionBy(F.lit(0)).orderBy("_v")
            .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = Window.partitionBy("_v")
    return (both.withColumn("_v", -F.col(value))
            .withColumn("rank", F.sum("_b").over(upto) - F.sum("_b").over(ties) + 1)
            .filter("_b = 0").select("fid", value, "rank"))


def top_and_middle(metrics: DataFrame, k: int = 5, t: str = "fm_t") -> DataFrame:
    """Rows labelled top-k by |t|, and the median, best and mean |t| over all factors."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs(t)), "fid")
    every = Window.partitionBy(F.lit(0))
    return (metrics.withColumn("rank", F.row_number().over(w))
            .withColumn("median_abs_t", F.percentile(F.abs(t), 0.5).over(every))
            .withColumn("mean_abs_t", F.avg(F.abs(t)).over(every))
            .filter(F.col("rank") <= k))


def report(metrics: DataFrame, production: Column, t: str = "fm_t") -> DataFrame:
    """Report rows by descending |t| with stars at 2 and 3 and a gate mark."""
    stars = F.when(F.abs(t) >= 3, "***").when(F.abs(t) >= 2, "**").otherwise("")
    mark = F.when(production, "PROD").when(F.col("gate_status") == "WEAK", "WEAK").otherwise("-")
    return (metrics.withColumn("stars", stars).withColumn("mark", mark)
            .orderBy(F.desc(F.abs(t)), "fid"))


def feature_usage(log: DataFrame, min_trials: int = 15) -> DataFrame:
    """Appearances per feature in a trial log (trial, passed, features), overuse and novelty."""
    one = F.lit(1)
    totals = log.agg(F.count(one).alias("trials"), F.sum(F.col("passed").cast("int")).alias("n_passed"))
    use = (log.select("passed", F.explode("features").alias("feature")).groupBy("feature")
           .agg(F.count(one).alias("appearances"), F.sum(F.col("passed").cast("int")).alias("usage")))
    j = use.withColumn("_one", one).join(F.broadcast(totals.withColumn("_one", one)), "_one").drop("_one")
    return (j.withColumn("masked", (F.col("trials") >= min_trials)
                         & (F.col("appearances") > 0.5 * F.col("trials")))
            .withColumn("novel", F.col("usage") <= F.greatest(F.lit(1), F.floor(F.col("n_passed") * 0.15))))


def over_seeds(runs: DataFrame, metrics: list[str], by=("fid",)) -> DataFrame:
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seeds"), *[
        e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))])


def sample_guard(df: DataFrame, x: str = "x", y: str = "ret", min_rows: int = 500) -> DataFrame:
    """Keep factors with enough complete rows: a combined count and a semi join."""
    ok = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("fid").count()
          .filter(F.col("count") >= min_rows).select("fid"))
    return df.join(ok, "fid", "left_semi")


def correlation_summary(pairs: DataFrame) -> DataFrame:
    """Largest and mean absolute off-diagonal correlation and the closest pair."""
    at = F.struct(F.abs("rho"), "f1", "f2")
    return pairs.agg(F.max(F.abs("rho")).alias("max_abs_rho"), F.avg(F.abs("rho")).alias("mean_abs_rho"),
                     F.max(at)["f1"].alias("f1"), F.max(at)["f2"].alias("f2"))


def cross_block(pairs: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """The part of a pair table that links one set of columns to another: (factor, atom, rho)."""
    a = pairs.filter(F.col("f1").isin(left) & F.col("f2").isin(right)).select(
        F.col("f1").alias("factor"), F.col("f2").alias("atom"), "rho")
    b = pairs.filter(F.col("f2").isin(left) & F.col("f1").isin(right)).select(
        F.col("f2").alias("factor"), F.col("f1").alias("atom"), "rho")
    return a.unionByName(b)


def two_part_report(metrics: DataFrame, passed: Column, t: str = "fm_t") -> DataFrame:
    """Report rows in a passed and a failed part, each by descending |t|."""
    return (metrics.withColumn("part", F.when(passed, "passed").otherwise("failed"))
            .orderBy(F.desc("part"), F.desc(F.abs(t)), "fid"))
