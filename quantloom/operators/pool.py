"""Feature-pool selection. Row-level work is aggregated by Spark; what remains per pool is
a table of at most (features x features) numbers, which rounds of joins work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from quantloom.operators import inference, pairs, xsection as xs
from quantloom.operators.layout import write_out
from quantloom.settings import DEFAULTS, Settings


def quality_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, null_share, variance) from one aggregate pass."""
    aggs = [e for c in features for e in (F.avg(F.col(c).isNull().cast("double")).alias(f"n_{c}"),
                                          F.var_pop(c).alias(f"v_{c}"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("null_share"),
                              F.col(f"v_{c}").alias("variance")) for c in features])
    return one.select(F.inline(rows))


def quality_gate(df: DataFrame, features: Sequence[str], max_null: float = 0.30,
                 min_var: float = 1e-6) -> DataFrame:
    q = quality_stats(df, features)
    return q.withColumn("keep", (F.col("null_share") <= max_null)
                        & (F.coalesce("variance", F.lit(0.0)) >= min_var))


def pair_table(wide: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(f1, f2, rho) for f1 before f2: Pearson over the rows where both exist."""
    return pairs.pair_pearson(wide, cols).drop("n")


def pooled_spearman(df: DataFrame, features: Sequence[str], heavy=None,
                    settings: Settings = DEFAULTS) -> DataFrame:
    """(f1, f2, rho): rank correlation over all rows where both exist."""
    return pairs.pair_spearman(df, features, heavy=heavy, settings=settings).drop("n")


def daily_mean_spearman(df: DataFrame, features: Sequence[str], min_rows: int = 30, heavy=None,
                        settings: Settings = DEFAULTS) -> DataFrame:
    """(f1, f2, rho): per-date rank correlation averaged over dates with enough rows; a
    pair's date counts where both exist and differ."""
    days = df.join(df.groupBy("date").count().filter(F.col("count") >= min_rows).select("date"), "date", "left_semi")
    day = pairs.pair_spearman(days, features, by=("date",), heavy=heavy, settings=settings)
    return day.groupBy("f1", "f2").agg(F.avg("rho").alias("rho"))


def pooled_scores(long: DataFrame, heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """(feature, ic): rank correlation with the return over all rows; 0 where it has none."""
    ic = xs.rank_ic(long, keys=("fid",), min_rows=2, heavy=heavy, settings=settings)
    return (long.select("fid").distinct().join(ic, "fid", "left")
            .select(F.col("fid").alias("feature"), F.coalesce("ic", F.lit(0.0)).alias("ic")))


def scores_among(pair_rho: DataFrame, ret: str = "ret") -> DataFrame:
    """:func:`pooled_scores` from pairs of features that include the return as the last one."""
    return pair_rho.filter(F.col("f2") == ret).select(F.col("f1").alias("feature"), F.coalesce("rho", F.lit(0.0)).alias("ic"))


def near_duplicates(pair_rho: DataFrame, scores: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Groups of features linked by rho > threshold (positive only): (feature, ic, grp, keep).

    ``scores`` is (feature, ic); the group's largest |ic| stays.
    """
    scores = write_out(scores, "scores")
    edges = pair_rho.filter(F.col("rho") > threshold).select(F.col("f1").alias("a"), F.col("f2").alias("b"))
    groups = pairs.components(scores, edges, "feature")
    w = Window.partitionBy("grp").orderBy(F.desc(F.abs(F.coalesce("ic", F.lit(0.0)))), "feature")
    return (groups.join(scores, "feature").withColumn("keep", F.row_number().over(w) == 1))


def cluster_pick(pair_rho: DataFrame, scores: DataFrame, target: int = 999) -> DataFrame:
    """Complete-linkage clusters on 1 - |rho|, at most ``target`` of them; best |ic| each.

    A pair without a correlation lies at distance 1. Merges of one height are made together,
    so that there may be fewer clusters than ``target``.
    """
    scores = write_out(scores, "scores")
    far = pair_rho.select(F.col("f1").alias("a"), F.col("f2").alias("b"), (1 - F.abs(F.coalesce("rho", F.lit(0.0)))).alias("d"))
    merges = write_out(pairs.complete_linkage(scores, far, "feature"), "linkage")
    # the first (features - target) merges by height, and those as high as the last of them
    order = Window.partitionBy(F.lit(0)).orderBy("height")  # one row per feature
    need = scores.agg((F.count(F.lit(1)) - target).alias("_need"))
    made = merges.withColumn("_rank", F.rank().over(order)).join(need, F.col("_rank") <= F.col("_need"))
    lab = pairs.components(scores, made.select("a", "b"), "feature").withColumnRenamed("grp", "cluster")
    w = Window.partitionBy("cluster").orderBy(F.desc(F.abs(F.coalesce("ic", F.lit(0.0)))), "feature")
    return lab.join(scores, "feature").withColumn("keep", F.row_number().over(w) == 1)


def univariate_screen(long: DataFrame, top: int, heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """Factors by descending |mean daily rank IC|, first ``top``."""
    s = xs.ic_summary(xs.rank_ic(long, heavy=heavy, settings=settings, min_rows=30))
    return s.orderBy(F.desc(F.abs("ic_mean")), "fid").limit(top)


def icir_screen(long: DataFrame, cut: float = 0.15, heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """Raw and size-neutral ICIR (population deviation); passes above ``cut``.

    ``long`` has fid, date, symbol, x, ret, ln_amt. Only the factor is neutralised.
    """
    raw = xs.ic_summary(xs.rank_ic(long, heavy=heavy, settings=settings, min_rows=21),
                        sample=False, eps=1e-8).select("fid", F.col("icir").alias("raw_icir"))
    # ``ret`` joins the completeness filter but keeps its values: only x is a target
    full = long.filter(F.col("ret").isNotNull())
    res = write_out(xs.neutralise(full, ["x"], ["ln_amt"], min_rows=30), "neutral")
    neu = xs.ic_summary(xs.rank_ic(res, heavy=heavy, settings=settings, min_rows=30),
                        sample=False, eps=1e-8).select("fid", F.col("icir").alias("neutral_icir"))
    return (raw.join(neu, "fid", "left").withColumn("neutral_icir", F.coalesce("neutral_icir", F.lit(0.0)))
            .withColumn("passed", F.col("neutral_icir") > cut))


def feature_metadata(long: DataFrame, pair_rho: DataFrame, heavy=None,
                     settings: Settings = DEFAULTS, pooled: DataFrame | None = None, ics: DataFrame | None = None) -> DataFrame:
    """Five traits per feature, z-scored across features.

    ``long``: train rows (fid, date, symbol, x, ret); ``pair_rho``: Pearson pair table. ``pooled`` (fid, ic) and
    ``ics`` (fid, date, ic) are rank correlations over all rows and per date, where they are known already.
    """
    if pooled is None:
        pooled = xs.rank_ic(long, keys=("fid",), min_rows=2, heavy=heavy, settings=settings)
    if ics is None:
        ics = xs.rank_ic(long, heavy=heavy, settings=settings, min_rows=30)
    daily = xs.ic_summary(ics, eps=1e-8)
    size = long.groupBy("fid").agg(F.tanh(F.avg(F.abs("x"))).alias("level"))
    both = pair_rho.select(F.col("f1").alias("fid"), "rho").unionByName(
        pair_rho.select(F.col("f2").alias("fid"), "rho"))
    orth = both.groupBy("fid").agg((1 - F.avg(F.abs("rho"))).alias("orthogonality"))
    d = (pooled.select("fid", (F.coalesce("ic", F.lit(0.0)) * 10).alias("ic10"))
         .join(daily.select("fid", "icir"), "fid", "left")
         .join(size, "fid").join(orth, "fid")
         .withColumn("icir", F.coalesce("icir", F.lit(0.0))).withColumn("constant", F.lit(0.0)))
    every = Window.partitionBy(F.lit(0))  # one row per feature
    out = []
    for c in ("ic10", "icir", "level", "constant", "orthogonality"):
        sd = F.stddev_pop(c).over(every)
        out.append(((F.col(c) - F.avg(c).over(every)) / F.when(sd < 1e-8, 1.0).otherwise(sd)).alias(c))
    return d.select("fid", *out)


def half_overlap_icir(series: DataFrame, n_rows: int, heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """ICIR over half-overlapping windows of min(60, n // 3) rows of a market series.

    ``series``: (fid, date, x, ret), one row per factor and date.
    """
    size = min(60, n_rows // 3)
    half = size // 2
    starts = list(range(0, n_rows - size, half))
    w = Window.partitionBy("fid").orderBy("date")
    d = series.withColumn("_i", F.row_number().over(w) - 1)
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / F.lit(half))).cast("int")
    high = F.least(F.floor(F.col("_i") / F.lit(half)), F.lit(len(starts) - 1)).cast("int")
    d = d.filter(low <= high).withColumn("window", F.explode(F.sequence(low, high)))
    ic = xs.rank_ic(d, keys=("fid", "window"), min_rows=2, heavy=heavy, settings=settings)
    return xs.ic_summary(ic, eps=1e-8)


def single_feature_table(long: DataFrame, heavy=None, settings: Settings = DEFAULTS, **kw) -> DataFrame:
    """Fama-MacBeth of every feature with flags at |t| 1, 1.5 and 2."""
    fm = inference.fama_macbeth(long, heavy=heavy, settings=settings, **kw)
    a = F.abs("fm_t")
    return fm.withColumn("level", (a >= 1).cast("int") + (a >= 1.5).cast("int") + (a >= 2).cast("int"))


def decorrelated_pick(metrics: DataFrame, pair_rho: DataFrame, k: int, max_rho: float = 0.98,
                      t: str = "fm_t") -> DataFrame:
    """(fid, pick): by descending |t| skip relatives of what was picked; the first ``k``.

    All factors whose stronger relatives are decided are decided together, round by round:
    picked when none of those was, dropped when one was.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs(t)), "fid")  # one row per factor
    ranked = write_out(metrics.select("fid", F.row_number().over(order).alias("at")), "order")
    near = pair_rho.filter(F.abs("rho") > max_rho)
    near = near.select("f1", "f2").unionByName(near.select(F.col("f2").alias("f1"), F.col("f1").alias("f2")))
    at = lambda f: ranked.select(F.col("fid").alias(f), F.col("at").alias(f"{f}_at"))
    # (fid, stronger): the relatives that come before each factor
    before = write_out(near.join(at("f1"), "f1").join(at("f2"), "f2").filter("f2_at < f1_at")
                       .select(F.col("f1").alias("fid"), F.col("f2").alias("stronger")).distinct(), "before")
    state = ranked.withColumn("picked", F.lit(None).cast("boolean"))
    while True:
        known = before.join(state.select(F.col("fid").alias("stronger"), F.col("picked").alias("p")), "stronger")
        told = known.groupBy("fid").agg(F.max("p").alias("any_picked"), F.max(F.col("p").isNull()).alias("open"))
        new = F.when(F.col("picked").isNotNull(), F.col("picked")).when(F.col("any_picked"), False).when(~F.coalesce("open", F.lit(False)), True)
        state = write_out(state.join(told, "fid", "left").select("fid", "at", new.alias("picked")), "picks")
        if state.filter("picked IS NULL").isEmpty():
            break
    return (state.filter("picked").withColumn("pick", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")))
            .filter(F.col("pick") <= k).select("fid", "pick"))
