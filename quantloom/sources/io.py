"""Bar, panel, style-factor and report sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

NUMERIC = ("open", "high", "low", "close", "volume", "amount", "turn", "pctChg")
REQUIRED_BARS = ("date", "symbol", "open", "high", "low", "close", "volume")
REQUIRED_STYLES = ("date", "MKT", "SMB", "HML", "RMW", "CMA")

# Header names of the style-factor file in both languages.
STYLE_HEADERS = {
    "trddy": "date", "date": "date", "交易日期": "date", "日期": "date",
    "mkt_rf": "MKT", "mkt": "MKT", "市场风险溢价因子": "MKT", "市场因子": "MKT",
    "smb": "SMB", "规模因子": "SMB", "hml": "HML", "账面市值比因子": "HML",
    "rmw": "RMW", "盈利能力因子": "RMW", "cma": "CMA", "投资模式因子": "CMA",
    "rf": "RF", "无风险利率": "RF", "mkt_raw": "MKT_RAW", "市场收益率": "MKT_RAW",
}


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def check_schema(df: DataFrame, required: Sequence[str] = REQUIRED_BARS) -> DataFrame:
    gap = missing_columns(df, required)
    if gap:
        raise ValueError(f"missing columns: {', '.join(gap)}")
    return df


def coerce(df: DataFrame, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """Numeric columns to double; cells that do not parse (or are NaN) become NULL."""
    out = {c: F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))) for c in numeric if c in df.columns}
    if "code" in df.columns and "symbol" not in df.columns:
        df = df.withColumnRenamed("code", "symbol")
    day = F.coalesce(F.col("date").try_cast("date"), F.try_to_timestamp("date").cast("date")) \
        if dict(df.dtypes)["date"] == "string" else F.col("date").cast("date")
    return df.withColumns(out | {"date": day, "symbol": F.col("symbol").cast("string")})


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bar panel from csv or parquet, chosen by extension; anything else is an error."""
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        raw = spark.read.parquet(path)
    elif low.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported bar file: {path}")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return coerce(raw)


def splice_panels(panels: Sequence[DataFrame]) -> DataFrame:
    """Concatenate panels; the earliest panel wins a repeated (symbol, date).

    A combined aggregate picks the winner, so a symbol's rows need not meet in one task.
    """
    cols = panels[0].columns
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [p.withColumn("_src", F.lit(i)) for i, p in enumerate(panels)])
    rest = [c for c in both.columns if c not in ("symbol", "date", "_src")]
    win = both.groupBy("symbol", "date").agg(F.min_by(F.struct(*rest), "_src").alias("_r"))
    return win.select("symbol", "date", "_r.*").select(cols)


def splice_files(spark: SparkSession, paths: str) -> DataFrame:
    """A comma list of files, spliced in order."""
    return splice_panels([read_bars(spark, p.strip()) for p in paths.split(",") if p.strip()])


def normalise_fetch(parts: Sequence[DataFrame]) -> DataFrame:
    """Per-code downloads to one panel: coerce, drop rows without close or volume."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return coerce(both).dropna(subset=["close", "volume"])


def panel_name(index: str, start: str, end: str) -> str:
    return f"{index}_daily_{start}_to_{end}"


def write_panel(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a panel ordered within files; the order across files follows the ranges."""
    out = df.repartitionByRange("symbol", "date").sortWithinPartitions("symbol", "date").write.mode("overwrite")
    if fmt == "parquet":
        out.parquet(path)
    else:
        out.option("header", True).csv(path)
    return path


# Exchange prefixes.
EXCHANGES = (("上海", "sh."), ("SH", "sh."), ("深圳", "sz."), ("SZ", "sz."), ("北京", "bj."), ("BJ", "bj."))


def constituent_codes(df: DataFrame, code: str = "code", exchange: str = "exchange") -> DataFrame:
    """Distinct prefixed codes; an unknown exchange counts as Shanghai."""
    prefix = F.lit("sh.")
    for mark, p in reversed(EXCHANGES):
        prefix = F.when(F.contains(F.upper(F.col(exchange)), F.lit(mark)), p).otherwise(prefix)
    return df.select(F.concat(prefix, F.col(code).cast("string")).alias("symbol")).distinct().orderBy("symbol")


def allow_charset(spark: SparkSession, encoding: str) -> None:
    """Spark 4 reads a short list of charsets unless the session allows all Java ones."""
    if encoding.lower() not in ("utf-8", "utf-16", "utf-32", "us-ascii", "iso-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_style_factors(spark: SparkSession, path: str, encoding: str = "GBK") -> DataFrame:
    """Style-factor csv to (date, MKT, SMB, HML, RMW, CMA); MKT = raw market - RF if absent."""
    allow_charset(spark, encoding)
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    names = {c: STYLE_HEADERS.get(c.strip().lstrip("﻿").lower()) for c in raw.columns}
    df = raw.select([F.col(c).alias(n) for c, n in names.items() if n])
    value = lambda c: F.col(c).try_cast("double")
    if "MKT" not in df.columns and {"MKT_RAW", "RF"} <= set(df.columns):
        df = df.withColumn("MKT", value("MKT_RAW") - value("RF"))
    check_schema(df, REQUIRED_STYLES)
    return df.select(F.col("date").try_cast("date").alias("date"),
                     *[value(c).alias(c) for c in REQUIRED_STYLES[1:]]).orderBy("date")


def merge_extra(panel: DataFrame, extra: DataFrame, keys: Sequence[str] = ("date", "symbol")) -> DataFrame:
    """Add the columns the panel lacks from a second panel by left join."""
    new = [c for c in extra.columns if c not in panel.columns]
    if not new:
        return panel
    return panel.join(extra.select(*keys, *new).dropDuplicates(list(keys)), list(keys), "left")


def append_audit(events: DataFrame, path: str) -> None:
    """Append events as JSON lines with the time of writing."""
    events.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)


def markdown(df: DataFrame, max_rows: int = 1000) -> str:
    """A per-factor table as markdown text; refuses anything larger than a report."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write the table instead")
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def fixed_width(df: DataFrame, widths: dict[str, int], max_rows: int = 1000) -> str:
    rows = df.select(*widths).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows; write the table instead")
    fmt = lambda v, w: (f"{v:.4f}" if isinstance(v, float) else str(v if v is not None else ""))[:w].rjust(w)
    return "\n".join(["".join(c.rjust(w) for c, w in widths.items())]
                     + ["".join(fmt(r[c], w) for c, w in widths.items()) for r in rows])
