"""Row filters and value repairs applied to bars and feature panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quantloom.functions.exprs import clip, finite
from quantloom.operators import xsection as xs
from quantloom.settings import DEFAULTS, Settings

SPECIAL = r"ST|\*ST|PT"  # fixed value: marks of specially treated listings


def drop_special_symbols(df: DataFrame, pattern: str = SPECIAL) -> DataFrame:
    return df.filter(~F.coalesce(F.col("symbol").rlike(pattern), F.lit(False)))


def drop_suspended(df: DataFrame) -> DataFrame:
    idle = F.coalesce(F.col("volume") == 0, F.lit(True))
    flat = ((F.col("open") == F.col("high")) & (F.col("high") == F.col("low"))
            & (F.col("low") == F.col("close")))
    return df.filter(~(idle & F.coalesce(flat, F.lit(False))))


def drop_price_anomalies(df: DataFrame) -> DataFrame:
    bad = ((F.col("high") < F.greatest("open", "close"))
           | (F.col("low") > F.least("open", "close")))
    return df.filter(~F.coalesce(bad, F.lit(False)))


def min_history(df: DataFrame, min_bars: int = 252) -> DataFrame:
    """Keep symbols with enough rows: a combined count, then a semi join (no window, so a
    symbol with very many rows never lands in one task)."""
    kept = df.groupBy("symbol").count().filter(F.col("count") >= min_bars).select("symbol")
    return df.join(kept, "symbol", "left_semi")


def winsorize_daily(df: DataFrame, col: str = "pctChg", pct: float = 0.01, heavy=None,
                    settings: Settings = DEFAULTS) -> DataFrame:
    """Per date, clip ``col`` to its pct and 1-pct linear-interpolated quantiles."""
    cols = df.columns
    q = xs.quantiles(df, ["date"], col, [pct, 1 - pct], "_q", heavy, settings)
    return (df.join(q, "date", "left")
            .withColumn(col, F.when(F.col("_q").isNull(), F.col(col))
                        .otherwise(clip(F.col(col), F.col("_q")[0], F.col("_q")[1])))
            .select(cols))


def derive_ret(df: DataFrame) -> DataFrame:
    return df.withColumn("ret", F.col("pctChg") / 100.0)


def clean_bars(df: DataFrame, settings: Settings = DEFAULTS, heavy=None) -> DataFrame:
    """The full cleaning sequence in its fixed order."""
    df = drop_price_anomalies(drop_suspended(drop_special_symbols(df)))
    df = min_history(df, settings.min_bars)
    if "pctChg" in df.columns:
        df = derive_ret(winsorize_daily(df, "pctChg", settings.winsor_pct, heavy, settings))
    return df


def drop_null_rows(df: DataFrame, features: list[str], max_share: float = 0.50) -> DataFrame:
    """Drop rows whose share of missing features exceeds ``max_share``."""
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in features])
    return df.filter(missing / F.lit(len(features)) <= max_share)


def null_to_zero(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in features})


def clip_range(df: DataFrame, features: list[str], bound: float = 1e3) -> DataFrame:
    return df.withColumns({c: clip(F.col(c), -bound, bound) for c in features})


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.filter(F.col("date") >= F.to_date(F.lit(start)))
    if end:
        df = df.filter(F.col("date") <= F.to_date(F.lit(end)))
    return df


def subset(df: DataFrame, features: list[str], keys=("date", "symbol", "forward_ret", "amount", "split")) -> DataFrame:
    """Key columns and the requested features that exist; Catalyst prunes the scan."""
    have = [f for f in features if f in df.columns]
    if not have:
        raise ValueError("none of the requested features exist")
    return df.select(*[k for k in keys if k in df.columns], *have)


def label_rows(df: DataFrame) -> DataFrame:
    """Keep rows that carry keys and a label."""
    return df.dropna(subset=["forward_ret", "date", "symbol"])
