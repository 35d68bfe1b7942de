"""Cross-sectional operators: statistics, ranks, quantiles and residuals per group.

A cross section (one date) may hold a large part of all rows, so nothing here sends a
whole group through one task unless its size was checked:

* means, deviations, covariances and regressions are map-side-combined aggregates whose
  one-row-per-group result is joined back;
* ranks and quantiles take a plain window while every group is at most
  ``heavy_group_rows`` rows (checked by a count). Larger groups are cut into ordered
  value cells, cells are counted, and running counts give the exact global rank; their
  quantiles are selected digit by digit of the values' bits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from quantloom.functions.exprs import all_of, clip, floor_at, pearson, ratio
from quantloom.operators.layout import has_heavy_group, write_out
from quantloom.settings import DEFAULTS, Settings

MAD_SCALE = 1.4826  # fixed value: normal-consistent scale of the median deviation
CELLS_PER_E = 4096  # ordered cells per factor e in magnitude


def order_cell(x: Column, per_e: int = CELLS_PER_E) -> Column:
    """A bigint that never decreases as x grows: sign and bucketed log-magnitude.

    Infinities, and NaN above them as Spark sorts it, have cells of their own.
    """
    step = (F.floor(F.log(F.abs(x)) * per_e) + F.lit(750 * per_e)).cast("long")
    top, inf = F.lit(1500 * per_e).cast("long"), F.lit(float("inf"))
    return (F.when(F.isnan(x), top + 1).when(x == inf, top).when(x == -inf, -top)
            .when(x > 0, step).when(x < 0, -step).otherwise(F.lit(0).cast("long")))


def _parts(df, keys, x, heavy, settings):
    """Split rows into (rows of ordinary groups, rows of heavy groups or None)."""
    df = df.filter(F.col(x).isNotNull())
    if heavy is None:
        heavy = has_heavy_group(df, keys, settings)
    if not heavy:
        return df, None
    df = write_out(df, "ranked")
    big = (df.groupBy(*keys).count()
           .filter(F.col("count") > settings.heavy_group_rows).select(*keys))
    return df.join(big, keys, "left_anti"), df.join(big, keys, "left_semi")


def _cells(df: DataFrame, keys: Sequence[str], x: str, *finer: Column) -> DataFrame:
    """Exact running counts per distinct value: columns _below, _here and _total.

    Equal values collapse in the map-side combine; a window task holds one cell only,
    and the offsets of cells come from a histogram of a few thousand rows per group.
    """
    keys = list(keys)
    names = [f"_f{i}" for i in range(len(finer))]
    values = df.groupBy(*keys, order_cell(F.col(x)).alias("_cell"), x,
                        *[c.alias(n) for c, n in zip(finer, names)]).agg(F.count(F.lit(1)).alias("_here"))
    hist = values.groupBy(*keys, "_cell").agg(F.sum("_here").alias("_n"))
    wh = Window.partitionBy(*keys).orderBy("_cell")
    hist = (hist.withColumn("_before", F.sum("_n").over(wh) - F.col("_n"))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
            .drop("_n"))
    wv = Window.partitionBy(*keys, "_cell").orderBy(x, *names)
    return (values.join(hist, keys + ["_cell"])
            .withColumn("_below", F.col("_before") + F.sum("_here").over(wv) - F.col("_here"))
            .drop("_before", "_cell"))


def average_rank(df: DataFrame, keys: Sequence[str], x: str, out: str = "rank",
                 heavy: bool | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Add the average-tie rank of ``x`` and the group size ``<out>_n``. NULL rows drop."""
    keys = list(keys)
    light, big = _parts(df, keys, x, heavy, settings)
    w = Window.partitionBy(*keys).orderBy(x)
    res = (light.withColumn(out, F.rank().over(w)
                            + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2)
           .withColumn(f"{out}_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    if big is None:
        return res
    cells = _cells(big, keys, x).select(
        *keys, x, (F.col("_below") + (F.col("_here") + 1) / 2).alias(out),
        F.col("_total").alias(f"{out}_n"))
    return res.unionByName(big.join(cells, [*keys, x]).select(res.columns))


def ordinal_rank(df: DataFrame, keys: Sequence[str], x: str, out: str = "rn",
                 tie: str = "symbol", prefix: int = 6, heavy: bool | None = None,
                 settings: Settings = DEFAULTS) -> DataFrame:
    """Add the 1-based position by (x, tie) and the group size ``<out>_n``. NULL rows drop.

    In a heavy group a run of equal values is cut again by the leading characters of the
    tie-break column, which keeps its order.
    """
    keys = list(keys)
    light, big = _parts(df, keys, x, heavy, settings)
    w = Window.partitionBy(*keys).orderBy(x, tie)
    res = (light.withColumn(out, F.row_number().over(w).cast("long"))
           .withColumn(f"{out}_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))))
    if big is None:
        return res
    head = F.substring(F.col(tie).cast("string"), 1, prefix)
    cells = (_cells(big, keys, x, head).withColumnRenamed("_f0", "_head")
             .select(*keys, x, "_head", "_below", "_total"))
    wc = Window.partitionBy(*keys, x, "_head").orderBy(tie)
    split = (big.withColumn("_head", head).join(cells, [*keys, x, "_head"])
             .withColumn(out, F.col("_below") + F.row_number().over(wc))
             .withColumn(f"{out}_n", F.col("_total")))
    return res.unionByName(split.select(res.columns))


def quantiles(df: DataFrame, keys: Sequence[str], x: str, qs: Sequence[float], out: str = "q",
              heavy: bool | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per group with the exact linear-interpolated quantiles as an array."""
    keys = list(keys)
    df = df.filter(F.col(x).isNotNull())
    if heavy is None:
        heavy = has_heavy_group(df, keys, settings)
    share = lambda d: d.groupBy(*keys).agg(F.percentile(F.col(x), F.array(*[F.lit(float(q)) for q in qs])).alias(out))
    if not heavy:
        return share(df)
    # rows are read again rather than written: the counts and the first digit need no copy of them
    heavy_keys = write_out(df.groupBy(*keys).count().filter(F.col("count") > settings.heavy_group_rows).select(*keys), "heavy")
    res, big = share(df.join(heavy_keys, keys, "left_anti")), df.join(heavy_keys, keys, "left_semi")
    return res.unionByName(radix_quantiles(big, keys, x, qs, out))


@F.pandas_udf(T.LongType())
def _order_bits(x: pd.Series) -> pd.Series:
    """The bits of a double as an integer that orders as the double does; NaN on top, one zero."""
    v = x.to_numpy(float) + 0.0
    b = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pd.Series(np.where(b < 0, b ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), b))


@F.pandas_udf(T.DoubleType())
def _from_bits(b: pd.Series) -> pd.Series:
    v = b.to_numpy(np.int64)
    return pd.Series(np.where(v < 0, v ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), v).view(np.float64))


RADIX_BITS = 16  # a digit; four digits tell a double


def radix_quantiles(df: DataFrame, keys: Sequence[str], x: str, qs: Sequence[float], out: str = "q") -> DataFrame:
    """Exact linear-interpolated quantiles of all groups, digit by digit of the values' bits.

    Each round counts, for every group and wanted rank, the next digit of the values that
    share the digits found so far, and takes the digit where the running count reaches the
    rank. Counts combine before the shuffle, so a round moves at most 2 ** 16 numbers per
    group, rank and task, whatever the group's size or the length of its ties; no task holds
    a group's values. Bands of close values that log-scaled cells can't part are no special case.
    Only values that share the first digit with a wanted rank are written; the rows are read twice for that.
    """
    keys = list(keys)
    bits = df.filter(F.col(x).isNotNull()).select(*keys, _order_bits(F.col(x).cast("double")).alias("_b"))
    wanted = [F.lit(float(q)) for q in qs]
    state = None
    for known in range(0, 64, RADIX_BITS):
        rest = 64 - known - RADIX_BITS
        digit = F.shiftright("_b", rest) if rest else F.col("_b")
        if state is None:
            hist = bits.groupBy(*keys, digit.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
            run = Window.partitionBy(*keys).orderBy("_p")
            sums = hist.select(*keys, "_p", "_n", F.sum("_n").over(run).alias("_upto"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"))
            at = [f((F.col("_size") - 1) * q).cast("bigint") for q in wanted for f in (F.floor, F.ceil)]
            ranks = F.array(*[F.struct(F.lit(i).alias("_t"), r.alias("_r")) for i, r in enumerate(at)])
            sums = sums.select("*", F.inline(ranks))
        else:
            last = state.withColumnRenamed("_p", "_known")
            near = bits.withColumn("_known", F.shiftright("_b", rest + RADIX_BITS)).join(last, [*keys, "_known"])
            hist = near.groupBy(*keys, "_t", "_r", "_size", digit.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
            run = Window.partitionBy(*keys, "_t").orderBy("_p")
            sums = hist.withColumn("_upto", F.sum("_n").over(run))
        # ranks count from 0 inside the digits found
        found = sums.filter((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_n")))
        state = write_out(found.select(*keys, "_t", "_size", "_p", (F.col("_r") - F.col("_upto") + F.col("_n")).alias("_r")), "digits")
        if not known:
            first = state.select(*keys, F.col("_p").alias("_first")).distinct()
            bits = write_out(bits.withColumn("_first", digit).join(first, [*keys, "_first"], "left_semi").drop("_first"), "bits")
    value = state.withColumn("_v", _from_bits("_p")).groupBy(*keys).agg(
        F.first("_size").alias("_size"), *[F.max(F.when(F.col("_t") == i, F.col("_v"))).alias(f"_v{i}") for i in range(2 * len(qs))])
    done = []
    for i, q in enumerate(wanted):
        at = (F.col("_size") - 1) * q
        lo, hi = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        done.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))))
    return value.select(*keys, F.array(*done).alias(out))


def join_stats(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Join one-row-per-group aggregates back; Spark broadcasts them only when small."""
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys))


def zscore(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("date",), eps: float = 1e-8,
           sample: bool = False, floor: float | None = None, null_flat: bool = False,
           suffix: str = "") -> DataFrame:
    """Standardise columns per group: (x - mean) / (std + eps).

    ``floor`` replaces ``+ eps`` by a lower bound; ``null_flat`` gives NULL for std 0.
    Equal values are told by their range: partial moments merge into a mean with a rounding error, and a std of that size.
    """
    sd = F.stddev_samp if sample else F.stddev_pop
    aggs = [a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), sd(c).alias(f"_s_{c}"), (F.max(c) - F.min(c)).alias(f"_r_{c}"))]
    df = join_stats(df, keys, *aggs)
    done = {}
    for c in cols:
        flat = F.col(f"_r_{c}") == 0
        s = F.when(flat, F.col(f"_s_{c}") * 0).otherwise(F.col(f"_s_{c}"))
        if null_flat:
            s = F.nullif(s, F.lit(0.0))
        elif floor is not None:
            s = floor_at(s, floor)
        else:
            s = s + eps
        done[c + suffix] = F.when(flat & F.col(c).isNotNull(), 0.0).otherwise(F.col(c) - F.col(f"_m_{c}")) / s
    keep = [c for c in df.columns if not c.startswith(("_m_", "_s_", "_r_")) and c not in done]
    return df.select(*keep, *[e.alias(n) for n, e in done.items()])


def percent_rank(df: DataFrame, xs: Sequence[str], prefix: str = "rank_", keys: Sequence[str] = ("date",),
                 centred: bool = False, heavy: bool | None = None,
                 settings: Settings = DEFAULTS) -> DataFrame:
    """Average-tie rank over the number of values, one new column per input column.

    NULL stays NULL. Ordinary groups rank all columns on one exchange; heavy groups go
    through the split ranking column by column and are joined back.
    """
    keys, names = list(keys), df.columns
    scale = (lambda p: (p - 0.5) / 0.5) if centred else (lambda p: p)
    if heavy is None:
        heavy = has_heavy_group(df, keys, settings)
    if not heavy:
        out = {}
        for x in xs:
            w = Window.partitionBy(*keys).orderBy(F.col(x).asc_nulls_last())
            r = F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2
            n = F.count(x).over(Window.partitionBy(*keys))
            out[f"{prefix}{x}"] = F.when(F.col(x).isNotNull(), scale(r / n))
        return df.select(*names, *[e.alias(n) for n, e in out.items()])
    df = write_out(df, "ranks")
    for x in xs:
        values = df.select(*keys, x).filter(F.col(x).isNotNull())
        ranked = average_rank(values, keys, x, "_r", True, settings).select(
            *keys, x, scale(F.col("_r") / F.col("_r_n")).alias(f"{prefix}{x}")).distinct()
        df = df.join(ranked, [*keys, x], "left")
    return df.select(*names, *[f"{prefix}{x}" for x in xs])


def melt(df: DataFrame, factors: Sequence[str], keep: Sequence[str], value: str = "x") -> DataFrame:
    """Wide factor columns to long rows (fid, value); a narrow projection, no shuffle."""
    return df.unpivot(list(keep), list(factors), "fid", value)


def mad_bounds(df: DataFrame, keys: Sequence[str], x: str, n: float, heavy=None,
               settings: Settings = DEFAULTS) -> DataFrame:
    """Per group: median and the bounds median +- n * 1.4826 * median |x - median|."""
    keys = list(keys)
    med = quantiles(df, keys, x, [0.5], "_q", heavy, settings).select(
        *keys, F.col("_q")[0].alias("median"))
    if heavy is not False:
        med = write_out(med, "medians")  # a row per group: Spark sees that the rows need not go to it
    dev = df.join(med, keys).withColumn("_dev", F.abs(F.col(x) - F.col("median")))
    mad = quantiles(dev, keys, "_dev", [0.5], "_q", heavy, settings)
    half = n * MAD_SCALE * F.col("_q")[0]
    return med.join(mad, keys).select(
        *keys, "median", (F.col("median") - half).alias("lo"), (F.col("median") + half).alias("hi"))


def winsorize_mad(df, keys, x: str, n: float = 5.0, heavy=None, settings=DEFAULTS) -> DataFrame:
    b = mad_bounds(df, keys, x, n, heavy, settings)
    cols = df.columns
    return (df.join(b, list(keys), "left")
            .withColumn(x, clip(F.col(x), F.col("lo"), F.col("hi"))).select(cols))


def _column_medians(v: np.ndarray) -> np.ndarray:
    """Median of each column's values that are not NaN; NaN where there is none."""
    ordered = np.sort(v, axis=0)  # NaN last
    n = (~np.isnan(ordered)).sum(axis=0)
    pick = lambda at: np.take_along_axis(ordered, np.maximum(at, 0)[None], axis=0)[0]
    lo, hi = pick((n - 1) // 2), pick(n // 2)
    return np.where(n > 0, np.where(n % 2 == 1, lo, lo + (hi - lo) * 0.5), np.nan)


def _clip_moments(v: np.ndarray, n: float) -> np.ndarray:
    """Rows: median, bounds, mean, the mean's own error and std (floored) of each column, filled and clipped; NaN below two values."""
    med = _column_medians(v)
    v = np.where(np.isnan(v), med, v)
    half = n * MAD_SCALE * _column_medians(np.abs(v - med))
    v = np.clip(v, med - half, med + half)
    if len(v) < 2:
        return np.full((6, v.shape[1]), np.nan)
    mean = v.mean(axis=0)
    d = v - mean
    # the mean of many rows is off by their rounding, which shows where the floor of the std divides it
    off = d.mean(axis=0)
    d -= off
    return np.stack((med, med - half, med + half, mean, off, np.maximum(np.sqrt((d * d).sum(axis=0) / (len(v) - 1)), 1e-8)))


def _fill_clip_zscore(v: np.ndarray, n: float) -> np.ndarray:
    """The columns of one group filled, clipped and standardised."""
    med, lo, hi, mean, off, sd = _clip_moments(v, n)
    return (np.clip(np.where(np.isnan(v), med, v), lo, hi) - mean - off) / sd


def _values(table: pa.Table, cols: Sequence[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in cols], axis=1).astype(float)


def _moments_of(cols: list[str], keys: list[str], n: float):
    """A function of a group's rows: its keys and the moments of each column, one after the other."""
    def moments(table: pa.Table) -> pa.Table:
        m = _clip_moments(_values(table, cols), n).T.ravel()
        own = {f"_g{i}": table.column(c).slice(0, 1) for i, c in enumerate(keys)}
        return pa.table(own | {"_mo": pa.array([pa.array(m, pa.float64(), from_pandas=True)], pa.list_(pa.float64()))})
    return moments


def _fill_clip_zscore_passes(df: DataFrame, cols: list[str], keys: list[str], n: float, passes: int) -> DataFrame:
    """:func:`fill_clip_zscore_wide` with an exchange of some columns at a time, for their moments only.

    ``df`` is computed once for each pass, for the pass's columns, and once for the result, which stays where its rows are.
    """
    kinds = dict(df.dtypes)
    out, z = df, {}
    for k in range(passes):
        part = cols[len(cols) * k // passes:len(cols) * (k + 1) // passes]

        schema = ", ".join([*[f"_g{i} {kinds[c]}" for i, c in enumerate(keys)], "_mo array<double>"])
        found = write_out(df.select(*keys, *part).groupBy(*keys).applyInArrow(_moments_of(part, keys, n), schema), "moments")
        names = {**{f"_g{i}": f"_g{k}_{i}" for i in range(len(keys))}, "_mo": f"_mo{k}"}
        found = found.select([F.col(a).alias(b) for a, b in names.items()])
        same = all_of([F.col(c).eqNullSafe(F.col(f"_g{k}_{i}")) for i, c in enumerate(keys)])
        out = out.join(F.broadcast(found), same)  # a row per group
        for j, c in enumerate(part):
            med, lo, hi, mean, off, sd = (F.get(f"_mo{k}", F.lit(6 * j + i)) for i in range(6))
            x = F.when(F.col(c).isNull() | F.isnan(c), med).otherwise(F.col(c).cast("double"))
            v = (F.least(F.greatest(x, lo), hi) - mean - off) / sd
            z[c] = F.when(~F.isnan(v), v)
    return out.select(*[c for c in df.columns if c not in z], *[z[c].alias(c) for c in cols])


def fill_clip_zscore_wide(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("date",),
                          n: float = 3.0, heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """:func:`fill_clip_zscore` for many columns at once, without melting the panel.

    One exchange brings a group of ordinary size together, where all its columns are sorted
    and finished one group at a time; more than ``wide_bytes`` of values take several, of some columns
    each, and only their moments come back. A group whose values (rows times columns) exceed
    ``heavy_group_rows`` times eight takes quantiles digit by digit instead.
    """
    keys, cols = list(keys), list(cols)
    rest = [c for c in df.columns if c not in cols]
    kinds = dict(df.dtypes)
    if heavy is None:
        heavy = has_heavy_group(df, keys, replace(settings, heavy_group_rows=min(settings.heavy_group_rows, max(1, 8 * settings.heavy_group_rows // len(cols)))))
    if not heavy:
        passes = min(len(cols), -(-8 * len(cols) * df.count() // settings.wide_bytes))
        if passes > 1:
            return _fill_clip_zscore_passes(df, cols, keys, n, passes)

        def finish_group(table: pa.Table) -> pa.Table:
            z = _fill_clip_zscore(_values(table, cols), n)
            done = {c: pa.array(z[:, i], pa.float64(), from_pandas=True) for i, c in enumerate(cols)}
            return pa.table({c: table.column(c) for c in rest} | done)
        return df.groupBy(*keys).applyInArrow(finish_group, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], *[f"`{c}` double" for c in cols]]))
    df = write_out(df, "panel")

    def medians(d, tag):
        q = radix_quantiles(melt(d, cols, keys), ["fid", *keys], "x", [0.5], "_q")
        wide = q.groupBy(*keys).pivot("fid", cols).agg(F.first(F.col("_q")[0]))
        return write_out(wide.select(*keys, *[F.col(c).alias(f"{tag}{c}") for c in cols]), "medians")

    med = medians(df, "_m_")
    filled = df.join(med, keys).select(
        *rest, *[F.col(f"_m_{c}") for c in cols],
        *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) for c in cols])
    mad = medians(filled.select(*keys, *[F.abs(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols]), "_d_")
    k = n * MAD_SCALE
    clipped = filled.join(mad, keys).select(
        *rest, *[clip(F.col(c), F.col(f"_m_{c}") - k * F.col(f"_d_{c}"),
                      F.col(f"_m_{c}") + k * F.col(f"_d_{c}")).alias(c) for c in cols])
    return zscore(clipped, cols, keys, sample=True, floor=1e-8)


def fill_clip_zscore(long: DataFrame, keys: Sequence[str] = ("fid", "date"), x: str = "x",
                     n: float = 3.0, heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """Per group: NULL to the median, clip at the MAD bounds, z-score (sample, std >= 1e-8)."""
    keys = list(keys)
    cols = long.columns
    med = quantiles(long, keys, x, [0.5], "_q", heavy, settings).select(
        *keys, F.col("_q")[0].alias("_med"))
    filled = (long.join(med, keys)
              .withColumn(x, F.coalesce(F.col(x), F.col("_med"))).select(cols))
    clipped = winsorize_mad(filled, keys, x, n, heavy, settings)
    return zscore(clipped, [x], keys, sample=True, floor=1e-8).select(cols)


def log_size(amount: Column) -> Column:
    return F.log(F.greatest(amount, F.lit(1.0)))


def neutralise(df: DataFrame, targets: Sequence[str], controls: Sequence[str],
               keys: Sequence[str] = ("fid", "date"), min_rows: int = 30) -> DataFrame:
    """Residuals of each target on a constant and the controls, per group.

    Rows with a missing target or control drop; groups below ``min_rows`` pass through.
    The normal equations are aggregated by Spark; only the k x k solve of each group
    (one row per group) runs in numpy, and not at all for a single control.
    """
    keys, targets, controls = list(keys), list(targets), list(controls)
    cols = df.columns
    df = df.filter(all_of([F.col(c).isNotNull() for c in targets + controls]))
    k = len(controls)
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.avg(c).alias(f"_av_{c}") for c in targets + controls]
    for i, a in enumerate(controls):
        aggs += [F.covar_pop(F.col(a), F.col(b)).alias(f"_cc_{i}_{j}")
                 for j, b in enumerate(controls) if j >= i]
        aggs += [F.covar_pop(F.col(a), F.col(y)).alias(f"_cy_{i}_{y}") for y in targets]
    stats = df.groupBy(*keys).agg(*aggs)
    if k == 1:
        v = F.col("_cc_0_0")
        stats = stats.select(
            "*", *[F.coalesce(F.when(v > 0, F.col(f"_cy_0_{y}") / v), F.lit(0.0)).alias(f"_b_0_{y}")
                   for y in targets])
    else:
        stats = _solve(stats, targets, k)
    out = df.join(stats, keys)
    for y in targets:
        fit = F.col(f"_av_{y}")
        for i, c in enumerate(controls):
            fit = fit + F.col(f"_b_{i}_{y}") * (F.col(c) - F.col(f"_av_{c}"))
        out = out.withColumn(y, F.when(F.col("_n") >= min_rows, F.col(y) - fit).otherwise(F.col(y)))
    return out.select(cols)


def _solve(stats: DataFrame, targets: list[str], k: int) -> DataFrame:
    names = [f"_b_{i}_{y}" for y in targets for i in range(k)]
    schema = T.StructType(stats.schema.fields + [T.StructField(n, T.DoubleType()) for n in names])

    def solve(batches):
        for pdf in batches:
            gram = np.empty((len(pdf), k, k))
            for i in range(k):
                for j in range(i, k):
                    gram[:, i, j] = gram[:, j, i] = pdf[f"_cc_{i}_{j}"].to_numpy()
            inverse = np.linalg.pinv(np.nan_to_num(gram), hermitian=True)
            extra = {}
            for y in targets:
                rhs = np.stack([pdf[f"_cy_{i}_{y}"].to_numpy() for i in range(k)], axis=1)
                beta = np.einsum("nij,nj->ni", inverse, np.nan_to_num(rhs))
                extra.update({f"_b_{i}_{y}": beta[:, i] for i in range(k)})
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(extra)], axis=1)

    return stats.mapInPandas(solve, schema)


def rank_ic(df: DataFrame, x: str = "x", y: str = "ret", keys: Sequence[str] = ("fid", "date"),
            min_rows: int = 31, heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """Spearman correlation per group: Pearson on average ranks. NULL for flat groups."""
    keys = list(keys)
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_rank(df, keys, x, "_rx", heavy, settings)
    ranked = average_rank(ranked, keys, y, "_ry", heavy, settings)
    return (ranked.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_rx"), F.col("_ry")).alias("ic"))
            .filter(F.col("n") >= min_rows))


def ordinal_ic(df: DataFrame, x: str = "x", y: str = "ret", keys=("fid", "date"),
               min_rows: int = 31, heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """As :func:`rank_ic` but with distinct ranks (ties in symbol order)."""
    keys = list(keys)
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, "symbol", x, y)
    ranked = ordinal_rank(df, keys, x, "_rx", heavy=heavy, settings=settings)
    ranked = ordinal_rank(ranked, keys, y, "_ry", heavy=heavy, settings=settings)
    return (ranked.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), pearson(F.col("_rx"), F.col("_ry")).alias("ic"))
            .filter(F.col("n") >= min_rows))


def ic_summary(ic: DataFrame, by: Sequence[str] = ("fid",), sample: bool = True,
               eps: float = 0.0) -> DataFrame:
    sd = F.stddev_samp("ic") if sample else F.stddev_pop("ic")
    return (ic.filter(F.col("ic").isNotNull()).groupBy(*by)
            .agg(F.avg("ic").alias("ic_mean"), sd.alias("_sd"), F.count("ic").alias("n_days"))
            .withColumn("icir", ratio(F.col("ic_mean"), F.col("_sd") + F.lit(eps))).drop("_sd"))


def quantile_bucket(df: DataFrame, x: str = "x", keys=("fid", "date"), n_groups: int = 5,
                    out: str = "bucket", heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """0-based bucket by interpolated quantile edges, right-closed, equal edges merged."""
    keys = list(keys)
    qs = [i / n_groups for i in range(n_groups)]
    edges = quantiles(df, keys, x, qs, "_edges", heavy, settings)
    # -0.0 and 0.0 are one edge
    edges = edges.withColumn("_edges", F.transform("_edges", lambda e: e + F.lit(0.0)))
    inner = F.filter(F.array_distinct(F.col("_edges")),
                     lambda e: (e > F.col("_edges")[0]) & (e < F.col(x)))
    return (df.filter(F.col(x).isNotNull()).join(edges, keys)
            .withColumn(out, F.size(inner).cast("int")).drop("_edges"))


def position_bucket(df: DataFrame, x: str = "x", keys=("fid", "date"), n_groups: int = 5,
                    out: str = "bucket", heavy=None, settings: Settings = DEFAULTS) -> DataFrame:
    """1-based bucket of the ordinal rank: equal counts even when values repeat."""
    r = ordinal_rank(df, keys, x, "_rn", heavy=heavy, settings=settings)
    rn, n = F.col("_rn"), F.col("_rn_n")
    bucket = F.greatest(F.lit(1), F.ceil(F.try_divide((rn - 1) * n_groups, n - 1))).cast("int")
    return r.withColumn(out, bucket).drop("_rn", "_rn_n")


def bucket_returns(bucketed: DataFrame, ret: str = "ret", by=("fid",),
                   bucket: str = "bucket") -> DataFrame:
    return bucketed.groupBy(*by, bucket).agg(F.avg(ret).alias("mean_ret"),
                                             F.count(ret).alias("n"))


def bucket_spread(returns: DataFrame, by=("fid",), bucket: str = "bucket") -> DataFrame:
    """Mean return of the highest bucket minus that of the lowest."""
    return returns.groupBy(*by).agg(
        (F.max_by("mean_ret", bucket) - F.min_by("mean_ret", bucket)).alias("ls_spread"),
        F.count(F.lit(1)).alias("n_buckets"))


def long_short_by_count(df: DataFrame, x: str = "x", ret: str = "ret", keys=("fid", "date"),
                        q: float = 0.2, min_rows: int = 30, heavy=None,
                        settings: Settings = DEFAULTS) -> DataFrame:
    """Per group: mean return of the top max(floor(n q), 1) rows minus that of the bottom."""
    df = df.filter(F.col(ret).isNotNull()).select(*keys, "symbol", x, ret)
    r = ordinal_rank(df, keys, x, "_rn", heavy=heavy, settings=settings)
    cut = F.greatest(F.floor(F.col("_rn_n") * F.lit(float(q))), F.lit(1))
    top = F.when(F.col("_rn") > F.col("_rn_n") - cut, F.col(ret))
    low = F.when(F.col("_rn") <= cut, F.col(ret))
    return (r.filter(F.col("_rn_n") >= min_rows).groupBy(*keys)
            .agg((F.avg(top) - F.avg(low)).alias("ls"), F.count(F.lit(1)).alias("n")))


def long_short_by_quantile(df: DataFrame, x: str = "x", ret: str = "ret", keys=("fid", "date"),
                           q: float = 0.2, min_rows: int = 30, heavy=None,
                           settings: Settings = DEFAULTS) -> DataFrame:
    """Per group: mean return where x >= its 1-q quantile minus where x <= its q quantile."""
    keys = list(keys)
    df = df.filter(F.col(x).isNotNull() & F.col(ret).isNotNull()).select(*keys, x, ret)
    edges = quantiles(df, keys, x, [q, 1 - q], "_q", heavy, settings)
    top = F.when(F.col(x) >= F.col("_q")[1], F.col(ret))
    low = F.when(F.col(x) <= F.col("_q")[0], F.col(ret))
    return (df.join(edges, keys).groupBy(*keys)
            .agg((F.avg(top) - F.avg(low)).alias("ls"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_rows))


def long_short_summary(ls: DataFrame, by=("fid",)) -> DataFrame:
    return ls.groupBy(*by).agg(
        F.avg("ls").alias("ls_mean"),
        (F.stddev_samp("ls") / F.sqrt(F.count("ls"))).alias("ls_se"),
        F.count("ls").alias("n_days"))


def market_state(df: DataFrame, vol: str = "vol_20d", ret: str = "ret_20d", heavy=None,
                 settings: Settings = DEFAULTS) -> DataFrame:
    """Three two-valued states per date: volatility and dispersion against their median
    over dates, trend against zero. NULL inputs are ignored."""
    med = quantiles(df, ["date"], vol, [0.5], "_q", heavy, settings).select(
        "date", F.col("_q")[0].alias("vol_level"))
    day = (df.groupBy("date").agg(F.avg(ret).alias("trend"), F.stddev_samp(ret).alias("dispersion"))
           .join(med, "date"))
    # one row per date from here on, so a single window over all dates is small
    everything = Window.partitionBy(F.lit(0))
    mid = lambda c: F.percentile(F.col(c), 0.5).over(everything)
    state = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    return (day.withColumn("_cv", mid("vol_level")).withColumn("_cd", mid("dispersion"))
            .select("date", "vol_level", "trend", "dispersion",
                    state(F.col("vol_level") >= F.col("_cv"), "high_vol", "low_vol").alias("vol_state"),
                    state(F.col("trend") >= 0, "up_trend", "down_trend").alias("trend_state"),
                    state(F.col("dispersion") >= F.col("_cd"), "high_disp", "low_disp").alias("disp_state")))


STATE_DIMENSIONS = ("vol_state", "trend_state", "disp_state")


def by_state(daily: DataFrame, states: DataFrame) -> DataFrame:
    """Repeat daily rows once per state dimension (three narrow copies)."""
    s = states.unpivot(["date"], list(STATE_DIMENSIONS), "dimension", "state")
    return daily.join(s, "date")


def state_extremes(per_state: DataFrame, value: str = "icir") -> DataFrame:
    """Best and worst state of each factor; ties go to the later label in text order."""
    at = F.struct(value, F.concat_ws(":", "dimension", "state").alias("label"))
    return per_state.groupBy("fid").agg(
        F.max(at)["label"].alias("best_state"), F.max(value).alias("best"),
        F.min(at)["label"].alias("worst_state"), F.min(value).alias("worst"))


def best_per_state(per_state: DataFrame, value: str = "icir") -> DataFrame:
    return per_state.groupBy("dimension", "state").agg(
        F.max(F.struct(value, "fid"))["fid"].alias("best_fid"), F.max(value).alias("best"))


def illiquidity_index(df: DataFrame, min_rows: int = 30) -> DataFrame:
    """Per date mean of |ret| / ln(max(volume, 1)) over at least ``min_rows`` names."""
    x = ratio(F.abs(F.col("ret")), F.log(F.greatest(F.col("volume"), F.lit(1.0))))
    return (df.select("date", x.alias("_x")).groupBy("date")
            .agg(F.avg("_x").alias("illiq"), F.count("_x").alias("n"))
            .filter(F.col("n") >= min_rows))
