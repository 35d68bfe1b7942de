"""Shared inputs of the registered queries and the matching SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.functions.exprs import rounded
from quantloom.operators import daily, xsection as xs
from quantloom.operators.layout import has_heavy_group, write_out
from quantloom.plans import series
from quantloom.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

FACTORS = ["body_ratio", "ret_2d", "rev_3d", "amount_shock_5d", "vol_20d", "pv_corr_10d",
           "illiq_spread", "turnover_20d"]
EXTRA = ["ret_1d", "ret_20d"]
CARRY = ("open", "close", "volume", "amount", "turn")

_heavy: dict[tuple, bool] = {}


def heavy(spark: SparkSession, sf: str) -> bool:
    """Largest cross section above the row limit of one task? Checked once per input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _heavy:
        _heavy[key] = has_heavy_group(fx.raw_weekly_bars(spark, sf), ["date"])
    return _heavy[key]


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, bars, ret = next return, features): written once per session."""
    def build():
        d = series.daily_features(fx.weekly_bars(spark, sf), carry=CARRY, only=FACTORS + EXTRA)
        return d.filter(F.col("forward_ret").isNotNull()).withColumnRenamed("forward_ret", "ret")
    return fx.stored(spark, ("panel", sf), build)


def long_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, ret, ln_amt, fid, x): a narrow melt of the stored panel."""
    p = panel(spark, sf).withColumn("ln_amt", xs.log_size(F.col("amount")))
    return xs.melt(p, FACTORS, ["date", "symbol", "ret", "ln_amt"])


def neutral_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The long panel with factor and return made orthogonal to size, written once."""
    def build():
        return xs.neutralise(long_panel(spark, sf), ["x", "ret"], ["ln_amt"])
    return fx.stored(spark, ("neutral", sf), build)


def sized_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The stored panel's factors, return and log size, one row per (date, symbol)."""
    return panel(spark, sf).select("date", "symbol", "ret", xs.log_size(F.col("amount")).alias("ln_amt"), *FACTORS)


def neutral_days(spark: SparkSession, sf: str) -> DataFrame:
    """One row per factor and date of the size-neutral panel, shared by the queries that need no more of it.

    Not for dates of more rows than one task should hold: those take the long panel.
    """
    return fx.stored(spark, ("neutral_days", sf), lambda: daily.sections(sized_panel(spark, sf), FACTORS, size="ln_amt"))


def neutral_ic(spark: SparkSession, sf: str, min_rows: int = 30) -> DataFrame:
    """(fid, date, n, ic) of the size-neutral panel."""
    if heavy(spark, sf):
        return xs.rank_ic(neutral_panel(spark, sf), min_rows=min_rows, heavy=True)
    return daily.ics(neutral_days(spark, sf), min_rows)


def neutral_spread(spark: SparkSession, sf: str) -> DataFrame:
    """(fid, date, ls, n) of the size-neutral panel."""
    if heavy(spark, sf):
        return xs.long_short_by_count(neutral_panel(spark, sf), heavy=True)
    return daily.long_short(neutral_days(spark, sf))


def out(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles and bigint counts, so both engines print the same values."""
    df = rounded(df, digits)
    return df.select([F.col(n).cast("bigint").alias(n) if t in ("int", "smallint") else F.col(n)
                      for n, t in df.dtypes])


# ---- SQL side -------------------------------------------------------------------------

BARS_SQL = """
lines AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
         l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity AS qty,
         l_extendedprice AS money, l_shipdate, l_orderkey, l_linenumber, l_partkey
  FROM lineitem),
bars0 AS (
  SELECT symbol, date,
         first(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, qty, money) AS open,
         max(price) AS high, min(price) AS low,
         last(price ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, qty, money) AS close,
         sum(qty) AS volume, CAST(sum(CAST(money AS DECIMAL(18,4))) AS DOUBLE) AS amount
  FROM lines GROUP BY symbol, date),
bars AS (
  SELECT *, pctChg / 100.0 AS ret FROM (
    SELECT b.*, 100.0 * volume / sum(volume) OVER (PARTITION BY date) AS turn,
           100.0 * (close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) AS pctChg
    FROM bars0 b))"""


def W(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


WS = "(PARTITION BY symbol ORDER BY date)"


def roll(fn: str, x: str, n: int, need: int | None = None) -> str:
    k = n if need is None else need
    return f"(CASE WHEN count({x}) OVER {W(n)} >= {k} THEN {fn}({x}) OVER {W(n)} END)"


def std(x: str, n: int, need: int | None = None) -> str:
    return roll("stddev_samp", x, n, need)


def mean(x: str, n: int, need: int | None = None) -> str:
    return roll("avg", x, n, need)


def pair(fn: str, x: str, y: str, n: int) -> str:
    return f"(CASE WHEN count({x} + {y}) OVER {W(n)} >= {n} THEN {fn}({x}, {y}) OVER {W(n)} END)"


def fin(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


def lag(x: str, d: int = 1) -> str:
    return f"lag({x}, {d}) OVER {WS}"


def chg(x: str, d: int = 1) -> str:
    return f"({x} / nullif({lag(x, d)}, 0) - 1)"


def R(e: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({e} AS DOUBLE), {digits}) + 0.0 AS {name}"


def at_least(x: str, lo: float) -> str:
    """Lower clip that keeps NULL (greatest() skips it)."""
    return f"(CASE WHEN {x} < {lo} THEN {lo} ELSE {x} END)"


def avg_rank(part: str, x: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {x})"
            f" + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)")


PANEL_SQL = BARS_SQL + f""",
base1 AS (
  SELECT *, close / nullif({lag('close')}, 0) AS gr, greatest(high - low, 1e-8) AS hl,
         {mean('volume', 60)} AS v60 FROM bars),
base2 AS (SELECT *, ln(gr) AS lr, volume / {at_least('v60', 1)} AS vb FROM base1),
panel AS (
  SELECT * FROM (
    SELECT date, symbol, open, close, volume, amount, turn, ln(greatest(amount, 1)) AS ln_amt,
      lead(close, 1) OVER {WS} / nullif(close, 0) - 1 AS ret,
      abs(close - open) / hl AS body_ratio,
      {chg('close', 2)} AS ret_2d, -{chg('close', 3)} AS rev_3d,
      amount / {at_least(mean('amount', 20), 1)} AS amount_shock_5d,
      {std('lr', 20)} * sqrt(252) AS vol_20d,
      {fin(pair('corr', 'close', 'volume', 10))} AS pv_corr_10d,
      (high - low) / nullif(close, 0) AS illiq_spread,
      {mean('vb', 20)} AS turnover_20d,
      {chg('close', 1)} AS ret_1d, {chg('close', 20)} AS ret_20d
    FROM base2) WHERE ret IS NOT NULL)"""

LONG_SQL = PANEL_SQL + f""",
long AS (UNPIVOT (SELECT date, symbol, ret, ln_amt, {', '.join(FACTORS)} FROM panel)
         ON {', '.join(FACTORS)} INTO NAME fid VALUE x)"""

# Residuals on a constant and log size; cross sections below 30 names pass through.
NEUTRAL_SQL = LONG_SQL + """,
moments AS (
  SELECT fid, date, count(*) AS n, avg(x) AS mx, avg(ret) AS mr, avg(ln_amt) AS mz, var_pop(ln_amt) AS vz,
         covar_pop(x, ln_amt) AS cx, covar_pop(ret, ln_amt) AS cr
  FROM long GROUP BY fid, date),
neutral AS (
  SELECT fid, date, symbol, ln_amt,
    CASE WHEN n >= 30 THEN x - mx - coalesce(cx / nullif(vz, 0), 0) * (ln_amt - mz) ELSE x END AS x,
    CASE WHEN n >= 30 THEN ret - mr - coalesce(cr / nullif(vz, 0), 0) * (ln_amt - mz) ELSE ret END AS ret
  FROM long JOIN moments USING (fid, date))"""


def rank_ic_sql(src: str, keys: str = "fid, date", min_rows: int = 31, x: str = "x", y: str = "ret") -> str:
    return f"""(SELECT {keys}, count(*) AS n, {fin('corr(rx, ry)')} AS ic FROM (
      SELECT {keys}, {avg_rank(keys, x)} AS rx, {avg_rank(keys, y)} AS ry
      FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {keys} HAVING count(*) >= {min_rows})"""


class Catalog:
    """Collects queries and their SQL twins."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return wrap
