"""Time splits. Every split is a small table over distinct days joined back by date.

The day table has one row per calendar day, so windows over all of it are small; the
data rows never pass through an unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quantloom.functions.exprs import clip
from quantloom.operators import xsection as xs
from quantloom.settings import DEFAULTS, Settings


def _all_days():
    """Window over a whole day table; never applied to data rows."""
    return Window.partitionBy(F.lit(0))


def _by_day():
    return _all_days().orderBy("date")


def day_table(df: DataFrame) -> DataFrame:
    """Distinct days with a 0-based index and the number of days."""
    return (df.select("date").distinct()
            .withColumn("day_idx", F.row_number().over(_by_day()) - 1)
            .withColumn("n_days", F.count(F.lit(1)).over(_all_days())))


def _label(days: DataFrame, *parts: tuple[str, Column]) -> DataFrame:
    e = F.lit(None).cast("string")
    for name, cond in reversed(parts):
        e = F.when(cond, name).otherwise(e)
    return days.withColumn("split", e)


def ratio_days(df: DataFrame, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """Days up to index floor(n*train) are train, up to floor(n*(train+val)) validation."""
    d, i = day_table(df), F.col("day_idx")
    tr, va = F.floor(F.col("n_days") * F.lit(train)), F.floor(F.col("n_days") * F.lit(train + val))
    return _label(d, ("train", i <= tr), ("val", i <= va), ("test", i > va)).select("date", "split")


def _anchored(df: DataFrame) -> DataFrame:
    """Day table with the anchor: the first day, or 30 June if data start on 1-10 July."""
    first = F.min("date").over(_all_days())
    early_july = (F.month("_first") == 7) & (F.dayofmonth("_first") <= 10)
    return (df.select("date").distinct().withColumn("_first", first)
            .withColumn("anchor", F.when(early_july, F.make_date(F.year("_first"), F.lit(6), F.lit(30)))
                        .otherwise(F.col("_first"))))


def month_days(df: DataFrame, train: int = 36, val: int = 12, test: int = 12) -> DataFrame:
    """Calendar-month boundaries from the anchor, left-open and right-closed."""
    d, c = _anchored(df), F.col("date")
    at = lambda m: F.add_months("anchor", m)
    return _label(d, ("train", c <= at(train)), ("val", c <= at(train + val)),
                  ("test", c <= at(train + val + test))).select("date", "split")


def warmup_days(df: DataFrame, warm: int = 12, train: int = 36, val: int = 12,
                test: int = 12) -> DataFrame:
    """As :func:`month_days` after ``warm`` months that only serve as history."""
    d, c = _anchored(df), F.col("date")
    start = F.add_months("anchor", warm)
    at = lambda m: F.add_months(start, m)
    return _label(d, ("warmup", c < start), ("train", c <= at(train)), ("val", c <= at(train + val)),
                  ("test", c <= at(train + val + test))).select("date", "split")


def month_number(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def july_days(df: DataFrame, train: int = 36, val: int = 12, test: int = 12) -> DataFrame:
    """Month offsets from the first July on or after the first day; earlier rows get NULL."""
    d = df.select("date").distinct().withColumn("_first", F.min("date").over(_all_days()))
    year = F.year("_first") + (F.month("_first") > 7).cast("int")
    off = month_number(F.col("date")) - (year * 12 + 6)
    return _label(d, ("train", (off >= 0) & (off < train)),
                  ("val", (off >= train) & (off < train + val)),
                  ("test", (off >= train + val) & (off < train + val + test))).select("date", "split")


def with_split(df: DataFrame, days: DataFrame) -> DataFrame:
    return df.join(days, "date", "left")


def walk_forward(df: DataFrame, settings: Settings = DEFAULTS, train: int | None = None,
                 val: int | None = None, test: int | None = None) -> DataFrame:
    """Rows (window, date, split) of all rolling windows with purge and embargo applied.

    A day belongs to window w and one split by its month offset, so assignment is an
    explode of at most (train+val+test)/test windows per day. Windows from the first one
    whose test part is too short onwards are dropped.
    """
    s = settings
    tr, va, te = train or s.train_months, val or s.val_months, test or s.test_months
    whole = tr + va + te
    days = df.select("date").distinct()
    m = month_number(F.col("date"))
    days = days.withColumn("_m", m - F.min(m).over(_all_days()))
    low = F.greatest(F.lit(0), F.ceil((F.col("_m") - whole + 1) / F.lit(te))).cast("int")
    high = F.floor(F.col("_m") / F.lit(te)).cast("int")
    d = (days.withColumn("window", F.explode(F.sequence(low, high)))
         .withColumn("_o", F.col("_m") - F.col("window") * te))
    d = d.withColumn("split", F.when(F.col("_o") < tr, "train")
                     .when(F.col("_o") < tr + va, "val").otherwise("test"))
    part = Window.partitionBy("window", "split")
    d = (d.withColumn("_i", F.row_number().over(part.orderBy("date")))
         .withColumn("_j", F.row_number().over(part.orderBy(F.desc("date"))))
         .withColumn("_n", F.count(F.lit(1)).over(part)))
    p, e, i, j, n = s.purge_days, s.embargo_days, F.col("_i"), F.col("_j"), F.col("_n")
    is_ = lambda name: F.col("split") == name
    cut = ((is_("train") & (n >= p) & (j <= p))
           | (is_("val") & (n >= e) & (i <= e)) | (is_("val") & (n >= p + e) & (j <= p))
           | (is_("test") & (n >= e) & (i <= e)))
    d = d.filter(~cut).select("window", "date", "split")
    tests = d.groupBy("window").agg(F.sum(F.when(is_("test"), 1).otherwise(0)).alias("_t"))
    first_bad = F.min(F.when(F.col("_t") < s.min_test_days, F.col("window"))).over(_all_days())
    good = (tests.withColumn("_bad", first_bad)
            .filter(F.col("_bad").isNull() | (F.col("window") < F.col("_bad"))).select("window"))
    return d.join(good, "window", "left_semi")


def list_windows(windows: DataFrame) -> DataFrame:
    return windows.groupBy("window", "split").agg(
        F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.count(F.lit(1)).alias("n_days"))


def standardise(df: DataFrame, features: list[str], label: str = "forward_ret", heavy=None,
                settings: Settings = DEFAULTS) -> DataFrame:
    """Scale all rows by the train mean and population deviation (below 1e-8 counts as 1);
    clip the label at the train 1st and 99th percentiles. ``df`` carries ``split``."""
    cols = df.columns
    train = df.filter(F.col("split") == "train").withColumn("_all", F.lit(1))
    aggs = [a for c in features for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    stats = train.groupBy("_all").agg(*aggs)
    q = xs.quantiles(train, ["_all"], label, [0.01, 0.99], "_q", heavy, settings)
    one = stats.join(q, "_all")  # a single row
    sd = {c: F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}")) for c in features}
    return (df.withColumn("_all", F.lit(1)).join(F.broadcast(one), "_all")
            .withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / sd[c] for c in features}
                         | {label: clip(F.col(label), F.col("_q")[0], F.col("_q")[1])})
            .select(cols))


def equal_parts(days: DataFrame, n_parts: int = 3) -> DataFrame:
    """Cut ordered days into ``n_parts`` parts at day index floor(i*n/parts): (date, part)."""
    d = day_table(days)
    # day k lies in the last part whose start floor(i*n/parts) <= k
    part = F.floor((F.col("day_idx") * n_parts + n_parts - 1) / F.col("n_days"))
    return d.select("date", F.least(part, F.lit(n_parts - 1)).cast("int").alias("part"))


def array_parts(days: DataFrame, n_parts: int = 3) -> DataFrame:
    """Cut ordered days into parts whose sizes differ by one, longer parts first."""
    d = day_table(days)
    size, extra = F.floor(F.col("n_days") / n_parts), F.col("n_days") % n_parts
    head = extra * (size + 1)
    part = F.when(F.col("day_idx") < head, F.floor(F.col("day_idx") / (size + 1))).otherwise(
        extra + F.floor((F.col("day_idx") - head) / size))
    return d.select("date", part.cast("int").alias("part"))


def rolling_month_windows(days: DataFrame, win: int = 4, stride: int = 2) -> DataFrame:
    """(date, window) for month windows of ``win`` months every ``stride`` months."""
    d = days.select("date").distinct()
    m = month_number(F.col("date"))
    d = (d.withColumn("_m", m - F.min(m).over(_all_days())).withColumn("_last", F.max("_m").over(_all_days())))
    low = F.greatest(F.lit(0), F.ceil((F.col("_m") - win + 1) / F.lit(stride))).cast("int")
    high = F.floor(F.col("_m") / F.lit(stride)).cast("int")
    return (d.withColumn("window", F.explode(F.sequence(low, high)))
            .filter(F.col("window") * stride + win - 1 <= F.col("_last"))
            .select("date", "window"))


def edge_variants(days: DataFrame) -> DataFrame:
    """(variant, date): the days without their first, and without their last, k days,
    with k = min(5, max(1, n // 2))."""
    d = day_table(days)
    k = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("n_days") / 2)))
    v = F.array(F.when(F.col("day_idx") >= k, "head"),
                F.when(F.col("day_idx") < F.col("n_days") - k, "tail"))
    return d.select("date", F.explode(F.array_compact(v)).alias("variant"))


def parse_windows(text: str, n: int) -> list[int]:
    """"1,3" or "1-6" to sorted window ids within 1..n; empty text means all."""
    if not text.strip():
        return list(range(1, n + 1))
    ids: set[int] = set()
    for piece in text.split(","):
        lo, _, hi = piece.strip().partition("-")
        ids.update(range(int(lo), int(hi or lo) + 1))
    return sorted(i for i in ids if 1 <= i <= n)
