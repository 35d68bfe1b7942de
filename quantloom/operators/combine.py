"""Factor combination, synergy and resampling tests."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions import draws
from quantloom.functions.exprs import pearson
from quantloom.operators import xsection as xs
from quantloom.operators.backtest import annualised_stats
from quantloom.operators.layout import write_out
from quantloom.operators.pairs import pair_pearson


def aligned(long: DataFrame) -> DataFrame:
    """Per-date z-scores of every factor, turned round where they correlate negatively with
    the return over all rows."""
    z = write_out(xs.zscore(long, ["x"], ("fid", "date"), eps=1e-12), "scores")
    sign = z.groupBy("fid").agg(pearson(F.col("x"), F.col("ret")).alias("_r"))
    flip = F.when(F.col("_r") < 0, -1.0).otherwise(1.0)
    return z.join(sign, "fid").withColumn("x", F.col("x") * flip).select(z.columns)


def aligned_wide(z: DataFrame, factors: Sequence[str]) -> DataFrame:
    """:func:`aligned` for the wide z-scores of :func:`daily.scores`: a column per factor, a row per (date, symbol)."""
    sign = write_out(z.agg(*[pearson(F.col(f), F.col("ret")).alias(f"_r_{f}") for f in factors]), "signs")
    flip = lambda f: F.when(F.col(f"_r_{f}") < 0, -1.0).otherwise(1.0)
    return z.crossJoin(F.broadcast(sign)).select("date", "symbol", "ret", *[(F.col(f) * flip(f)).alias(f) for f in factors])  # one row


def equal_weight_wide(z: DataFrame, picked: Sequence[str], out: str = "combo") -> DataFrame:
    """Add the null-skipping mean of the picked factors' columns; rows without any of them go."""
    there = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in picked])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in picked])
    return z.withColumn(out, F.try_divide(total, there)).filter(F.col(out).isNotNull())


def score_pairs(z: DataFrame, factors: Sequence[str]) -> DataFrame:
    """(f1, f2, n, rho): correlation of two factors' scores over all rows where both exist."""
    wide = z.groupBy("date", "symbol").pivot("fid", list(factors)).agg(F.first("x"))
    return pair_pearson(wide, factors)


def equal_weight(z: DataFrame, picked: DataFrame | None = None) -> DataFrame:
    """Null-skipping mean of the (picked) factors' aligned scores."""
    if picked is not None:
        z = z.join(picked.select("fid"), "fid", "left_semi")
    return (z.groupBy("date", "symbol").agg(F.avg("x").alias("x"), F.first("ret").alias("ret"))
            .withColumn("fid", F.lit("combo")))


def synergy(combo_ls: DataFrame, single_ls: DataFrame, pair_rho: DataFrame, n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Sharpe of the combination against the mean of its factors, their correlations, and the
    gain's interval over resampled months, which decides: significant where its low end is
    above 0, marginal where at most a tenth of the gains are not."""
    own = single_ls.select("fid").distinct()
    c = annualised_stats(combo_ls).select(F.col("sharpe").alias("combo_sharpe"), F.lit(1).alias("_k"))
    s = annualised_stats(single_ls).agg(F.avg("sharpe").alias("mean_sharpe"), F.count(F.lit(1)).alias("n_factors"))
    near = (pair_rho.join(own.withColumnRenamed("fid", "f1"), "f1", "left_semi").join(own.withColumnRenamed("fid", "f2"), "f2", "left_semi")
            .agg(F.avg(F.abs("rho")).alias("mean_abs_rho"), F.max(F.abs("rho")).alias("max_abs_rho")))
    out = c
    for one in (s, near, month_bootstrap(combo_ls, single_ls, n_boot, seed).drop("n_boot")):
        out = out.join(one.withColumn("_k", F.lit(1)), "_k")  # one row each
    return (out.drop("_k").withColumn("gain", F.col("combo_sharpe") - F.col("mean_sharpe"))
            .withColumn("verdict", F.when(F.col("low") > 0, "significant").when(F.col("p_le0") <= 0.1, "marginal").otherwise("unsupported")))


def _resamples(spark, n_boot: int) -> DataFrame:
    """(boot): one row per resample; all that is drawn for it depends on its number alone."""
    return spark.range(0, n_boot, 1, spark.sparkContext.defaultParallelism * 4).withColumnRenamed("id", "boot")


def _numbered(ic: DataFrame) -> DataFrame:
    """Daily ICs with a 0-based position per factor (rows bounded by the calendar)."""
    return (ic.filter(F.col("ic").isNotNull())
            .withColumn("pos", F.row_number().over(
                Window.partitionBy("fid").orderBy("date")) - 1))


def _t(mean: Column, sd: Column, n: Column) -> Column:
    return F.when(sd > 0, mean / (sd / F.sqrt(n))).otherwise(0.0)


def _deviation(n: Column, s1: Column, s2: Column) -> Column:
    """Sample deviation from a count, a sum and a sum of squares; rounding noise of equal values counts as none."""
    ss = s2 - s1 * s1 / n
    return F.when((n > 1) & (ss > 1e-12 * s2), F.sqrt(ss / (n - 1))).otherwise(0.0)


def stationary_blocks(spark, n_boot: int, length: int, mean_block: int = 10, seed: int = 42) -> DataFrame:
    """(boot, start, size): circular blocks of geometric length that fill ``length`` positions of each resample.

    Blocks are drawn one after the other inside their row until the resample is full; the last one is cut.
    """
    h = lambda k: draws.digest(seed, "block", F.col("boot"), k)
    size = lambda d: 1 + F.floor(F.log(1 - draws.uniform(d)) / F.lit(math.log(1 - 1 / mean_block)))

    def add(acc, k):
        d = h(k)
        block = F.struct(F.floor(draws.uniform(d, 1) * length).alias("start"), F.least(size(d), length - acc.filled).alias("size"))
        grown = F.array_append(acc.blocks, block)
        return F.when(acc.filled >= length, acc).otherwise(
            F.struct((acc.filled + F.element_at(grown, -1).getField("size")).alias("filled"), grown.alias("blocks")))

    none = F.struct(F.lit(0).cast("bigint").alias("filled"), F.expr("cast(array() as array<struct<start:bigint,size:bigint>>)").alias("blocks"))
    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), none, add, lambda acc: acc.blocks)
    return _resamples(spark, n_boot).select("boot", F.inline(drawn))


def circular_prefixes(series: DataFrame, length: int, value: str) -> DataFrame:
    """(fid, pos, n, s1, s2): count, sum and squares of ``value`` before ``pos`` on a circle gone round twice.

    Any circular block of at most ``length`` positions is the difference of two of these rows.
    """
    grid = (series.select("fid").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2 * length))))
            .withColumn("_at", F.col("pos") % length))
    d = grid.join(series.select("fid", F.col("pos").alias("_at"), F.col(value).alias("_v")), ["fid", "_at"], "left")
    before = Window.partitionBy("fid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # 2 * length rows
    so_far = lambda v: F.coalesce(F.sum(v).over(before), F.lit(0.0))
    return d.select("fid", "pos", F.count("_v").over(before).alias("n"), so_far(F.col("_v")).alias("s1"), so_far(F.col("_v") * F.col("_v")).alias("s2"))


def reality_check(ic: DataFrame, n_boot: int = 10000, mean_block: int = 10, seed: int = 42) -> DataFrame:
    """Is the best factor's t above what selection alone gives? Stationary bootstrap of
    centred daily ICs (fid, date, ic) with one index sequence shared by all factors.

    A block of days is the difference of two rows of running sums, so a resample costs two
    lookups per block and factor, however many days it has. A factor with fewer than five
    ICs, or none in a resample, has t = 0.
    """
    spark = ic.sparkSession
    d = write_out(_numbered(ic), "numbered")
    stat = d.groupBy("fid").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.count("ic").alias("n"))
    obs = stat.withColumn("t", F.when(F.col("n") >= 5, _t(F.col("m"), F.col("s"), F.col("n"))).otherwise(0.0))
    head = obs.agg(F.max("t").alias("v"), F.count(F.lit(1)).alias("n_factors"), F.max("n").alias("n_days"), F.min("n").alias("least")).head()
    if head.n_days is None:
        raise ValueError("no daily IC")
    length, v = int(head.n_days), float(head.v)

    centred = (d.join(stat.filter("n >= 5").select("fid", "m"), "fid")
               .select("fid", "pos", (F.col("ic") - F.col("m")).alias("c")))
    # a small table that every task of the lookup reads: two rows per factor and day
    prefixes = write_out(circular_prefixes(centred, length, "c"), "prefixes")
    ends = stationary_blocks(spark, n_boot, length, mean_block, seed).select("boot", F.inline(F.array(
        F.struct(F.col("start").alias("pos"), F.lit(-1).alias("sign")), F.struct((F.col("start") + F.col("size")).alias("pos"), F.lit(1).alias("sign")))))
    total = lambda c: F.sum(F.col(c) * F.col("sign")).alias(c)
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    t = F.when(n > 0, _t(s1 / n, _deviation(n, s1, s2), n)).otherwise(0.0)
    boot = (ends.join(prefixes, "pos").groupBy("boot", "fid").agg(total("n"), total("s1"), total("s2"))
            .withColumn("t", t).groupBy("boot").agg(F.max("t").alias("t")))
    if head.least < 5:
        boot = boot.withColumn("t", F.greatest("t", F.lit(0.0)))
    return boot.agg(F.lit(v).alias("v"), F.avg((F.col("t") >= v).cast("double")).alias("p_value"),
                    F.lit(int(head.n_factors)).alias("n_factors"), F.lit(length).alias("n_days"),
                    F.avg("t").alias("boot_max_mean"), F.percentile("t", 0.95).alias("boot_max_q95"),
                    F.stddev_pop("t").alias("boot_max_std"))


Z_975 = 1.959963984540054  # fixed value: normal 97.5 % quantile


def resampled_means(ic: DataFrame, n_boot: int, seed: int = 42) -> DataFrame:
    """(boot, fid, m): mean of as many independent draws as a factor has ICs, added up inside its row."""
    d = _numbered(ic)
    series = (d.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("pos", "ic"))).alias("_p"))  # bounded by the calendar
              .filter(F.size("_p") >= 5).select("fid", F.transform("_p", lambda p: p.ic).alias("_ic"), F.size("_p").alias("_n")))
    series = write_out(series, "ic-series")
    n, values = F.col("_n"), F.col("_ic")

    def eight(acc, part):
        d = part.digest
        return reduce(lambda a, at: a + F.when(part.first + at < n, F.get(values, draws.below(d, n, at).cast("int"))).otherwise(0.0), range(8), acc)

    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 8).cast("int")), lambda k: F.struct(
        draws.digest(seed, "day", F.col("fid"), F.col("boot"), k).alias("digest"), (8 * k).alias("first")))
    return (_resamples(series.sparkSession, n_boot).withColumn("_one", F.lit(1))
            .join(series.groupBy(F.lit(1).alias("_one")).agg(F.collect_list("fid").alias("_fids")), "_one")
            .select("boot", F.explode("_fids").alias("fid")).join(series, "fid")
            .select("boot", "fid", (F.aggregate(parts, F.lit(0.0), eight) / n).alias("m")))


def selection_interval(ic: DataFrame, best: str, n_boot: int = 10000, alpha: float = 0.05,
                       seed: int = 42) -> DataFrame:
    """Normal interval for the best factor's mean IC and one widened for selection:
    half width = q(1-alpha) - mean of the bootstrap maximum of factor means."""
    top = resampled_means(ic, n_boot, seed).groupBy("boot").agg(F.max("m").alias("m"))
    infl = top.agg((F.percentile("m", 1 - alpha) - F.avg("m")).alias("inflation")).withColumn("_k", F.lit(1))
    b = (ic.filter((F.col("fid") == best) & F.col("ic").isNotNull()).agg(F.avg("ic").alias("mean"),
         (F.stddev_samp("ic") / F.sqrt(F.count("ic"))).alias("se")).withColumn("_k", F.lit(1)))
    half = Z_975 * F.col("se")
    return b.join(infl, "_k").select(
        "mean", (F.col("mean") - half).alias("naive_low"), (F.col("mean") + half).alias("naive_high"),
        (F.col("mean") - F.col("inflation")).alias("sel_low"),
        (F.col("mean") + F.col("inflation")).alias("sel_high"), "inflation")


def month_bootstrap(combo_ls: DataFrame, single_ls: DataFrame, n_boot: int = 2000,
                    seed: int = 42) -> DataFrame:
    """Resample months; gain = Sharpe(combo) - mean Sharpe(factors). A month drawn twice
    counts once, so the picks are made distinct.

    Months are told by the moments of their days, so a resample costs months, not days.
    """
    spark = combo_ls.sparkSession
    every = single_ls.select("fid", "date", "ls").unionByName(
        combo_ls.select(F.lit("combo").alias("fid"), "date", "ls")).filter(F.col("ls").isNotNull())
    # squares of deviations from the series' own mean: no digits are lost when months are put together
    level = every.groupBy("fid").agg(F.avg("ls").alias("level"))
    c = F.col("ls") - F.col("level")
    months = write_out(every.join(level, "fid").groupBy("fid", "level", F.trunc("date", "month").alias("month"))
                       .agg(F.count("ls").alias("n"), F.sum(c).alias("s1"), F.sum(c * c).alias("s2")), "month-moments")
    cal = (combo_ls.select(F.trunc("date", "month").alias("month")).distinct()
           .withColumn("m", F.row_number().over(
               Window.partitionBy(F.lit(0)).orderBy("month")) - 1))
    cal = write_out(cal, "months")
    n = cal.count()  # number of months
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda k: draws.below(
        draws.digest(seed, "month", F.col("boot"), k), F.lit(n)).cast("int")))
    drawn = _resamples(spark, n_boot).select("boot", F.explode(picks).alias("m")).join(cal, "m").join(months, "month")
    total = (drawn.groupBy("boot", "fid", "level")
             .agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")))
    rows, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    sharpe = F.when(rows >= 30, (F.col("level") + s1 / rows) / (_deviation(rows, s1, s2) + 1e-12) * F.sqrt(F.lit(252.0))).otherwise(0.0)
    is_combo = F.col("fid") == "combo"
    # a factor without any day in the months drawn has no row: it counts as 0, as one with few days does
    n_single = F.lit(single_ls.select("fid").distinct().count())
    g = total.withColumn("sharpe", sharpe).groupBy("boot").agg(
        (F.coalesce(F.sum(F.when(is_combo, F.col("sharpe"))), F.lit(0.0)) - F.coalesce(F.sum(F.when(~is_combo, F.col("sharpe"))), F.lit(0.0)) / n_single).alias("gain"))
    return g.agg(F.avg("gain").alias("mean_gain"), F.avg((F.col("gain") <= 0).cast("double")).alias("p_le0"),
                 F.percentile("gain", 0.025).alias("low"), F.percentile("gain", 0.975).alias("high"),
                 F.count("gain").alias("n_boot"))
