"""Sources, cleaning and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.catalog.base import BARS_SQL, FACTORS, PANEL_SQL, WS, Catalog, R, heavy, out, panel
from quantloom.operators import clean
from quantloom.operators.layout import shared_dir
from quantloom.plans import series
from quantloom.sources import fixtures as fx, io, registry

C = Catalog()
BAR = ["open", "high", "low", "close", "volume", "amount", "turn", "pctChg", "ret"]
BAR_COLS = ", ".join(R(c, c, 8) for c in BAR)  # prices have up to 7 exact decimals

# marks on some symbols and dates exercise the filters on whole tables
MARKED_SQL = BARS_SQL + """,
marked AS (
  SELECT CASE WHEN CAST(symbol AS BIGINT) % 17 = 3 THEN 'ST' || symbol ELSE symbol END AS symbol, date, open,
         CASE WHEN volume % 13 = 5 THEN open * 0.9 ELSE high END AS high, low, close,
         CASE WHEN open = close AND high = low THEN 0 ELSE volume END AS volume, amount, turn, pctChg, ret
  FROM bars)"""


def marked(spark, sf):
    b = fx.plain_bars(spark, sf).drop("blk", "halo")
    return b.withColumns({
        "symbol": F.when(F.col("symbol").cast("bigint") % 17 == 3, F.concat(F.lit("ST"), "symbol"))
        .otherwise(F.col("symbol")),
        "high": F.when(F.col("volume") % 13 == 5, F.col("open") * 0.9).otherwise(F.col("high")),
        "volume": F.when((F.col("open") == F.col("close")) & (F.col("high") == F.col("low")), 0.0)
        .otherwise(F.col("volume"))})


@C.add("bars_weekly", f"WITH {BARS_SQL} SELECT date, symbol, {BAR_COLS} FROM bars")
def bars_weekly(spark, sf):
    return out(fx.plain_bars(spark, sf).select("date", "symbol", *BAR), 8)


EVENT_SQL = """
ticks AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, value, ts, event_id FROM events),
bars0 AS (SELECT symbol, date, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) * 1.0 AS volume,
  CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS amount FROM ticks GROUP BY symbol, date)"""


@C.add("bars_daily_events", f"""WITH {EVENT_SQL} SELECT date, symbol,
  {', '.join(R(c, c) for c in ['open', 'high', 'low', 'close', 'volume', 'amount'])} FROM bars0""")
def bars_daily_events(spark, sf):
    d = fx.daily_bars(spark, sf).filter("NOT halo")
    return out(d.select("date", "symbol", "open", "high", "low", "close", "volume", "amount"))


@C.add("source_csv_round_trip", f"WITH {BARS_SQL} SELECT date, symbol, {BAR_COLS} FROM bars")
def source_csv(spark, sf):
    path = f"{shared_dir(spark)}/bars_{abs(hash(sf))}.csv"
    b = fx.plain_bars(spark, sf).select("date", F.col("symbol").alias("code"), *BAR)
    b.write.mode("overwrite").option("header", True).csv(path)
    d = io.check_schema(io.read_bars(spark, path))
    return out(d.withColumn("ret", F.col("ret").cast("double")).select("date", "symbol", *BAR), 8)


@C.add("splice_panels", f"""WITH {BARS_SQL}, cut AS (SELECT max(date) AS hi, min(date) AS lo FROM bars)
  SELECT date, symbol, {R('CASE WHEN date <= lo + 1400 THEN close ELSE close + 1 END', 'close', 8)}, {R('volume', 'volume', 8)}
  FROM bars, cut""")
def splice(spark, sf):
    b = fx.plain_bars(spark, sf).select("date", "symbol", "close", "volume")
    lo = b.agg(F.min("date").alias("lo"))
    edge = F.date_add(F.lit(lo.head().lo), 1400)
    first = b.filter(F.col("date") <= edge)
    second = b.withColumn("close", F.col("close") + 1)
    return out(io.splice_panels([first, second]), 8)


@C.add("normalise_fetch", f"""WITH {BARS_SQL}, t AS (SELECT date, symbol,
    CASE WHEN volume % 11 = 0 THEN NULL ELSE close END AS close,
    CASE WHEN volume % 7 = 0 THEN NULL ELSE volume END AS volume FROM bars)
  SELECT date, symbol, {R('close', 'close', 8)}, {R('volume', 'volume', 8)} FROM t
  WHERE close IS NOT NULL AND volume IS NOT NULL""")
def fetch(spark, sf):
    b = fx.plain_bars(spark, sf)
    text = b.select(
        F.col("date").cast("string").alias("date"), F.col("symbol").alias("code"),
        F.when(F.col("volume") % 11 == 0, "n/a").otherwise(F.col("close").cast("string")).alias("close"),
        F.when(F.col("volume") % 7 == 0, "").otherwise(F.col("volume").cast("string")).alias("volume"))
    d = io.normalise_fetch([text.filter("volume < '5'"), text.filter("NOT volume < '5'")])
    return out(d.select("date", "symbol", "close", "volume"), 8)


@C.add("constituent_codes", """SELECT DISTINCT (CASE n_name WHEN 'CHINA' THEN 'sz.' WHEN 'INDIA' THEN 'bj.' ELSE 'sh.' END)
   || CAST(s_suppkey AS VARCHAR) AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def codes(spark, sf):
    s = fx.table(spark, sf, "supplier").join(fx.table(spark, sf, "nation"),
                                             F.col("s_nationkey") == F.col("n_nationkey"))
    ex = F.when(F.col("n_name") == "CHINA", "SZ").when(F.col("n_name") == "INDIA", "BJ").otherwise("other")
    return io.constituent_codes(s.select(F.col("s_suppkey").alias("code"), ex.alias("exchange")))


@C.add("merge_extra_panel", f"""WITH {PANEL_SQL} SELECT date, symbol, {R('ret', 'ret')},
   {R('body_ratio * 2', 'extra_a')}, {R('ret_2d', 'ret_2d')}
   FROM panel""")
def merge(spark, sf):
    p = panel(spark, sf)
    extra = p.select("date", "symbol", F.lit(9.0).alias("ret"), (F.col("body_ratio") * 2).alias("extra_a"))
    return out(io.merge_extra(p.select("date", "symbol", "ret", "ret_2d"), extra))


@C.add("audit_log", f"""WITH {PANEL_SQL} SELECT date, 'signal' AS event, CAST(count(*) AS BIGINT) AS trial
   FROM panel GROUP BY date""")
def audit(spark, sf):
    import uuid
    path = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    ev = panel(spark, sf).groupBy("date").agg(F.lit("signal").alias("event"), F.count(F.lit(1)).alias("trial"))
    io.append_audit(ev, path)
    return spark.read.schema("date date, event string, trial bigint, ts timestamp").json(path).drop("ts")


STYLE_FILE_SQL = f"""WITH {BARS_SQL}, d AS (SELECT date, avg(ret) AS raw, stddev_samp(ret) AS b, avg(turn) AS c,
    max(ret) AS d1, min(ret) AS e FROM bars GROUP BY date)
  SELECT date, {R('raw - 0.001', 'MKT')}, {R('b', 'SMB')}, {R('c', 'HML')}, {R('d1', 'RMW')}, {R('e', 'CMA')} FROM d"""


@C.add("style_factor_file", STYLE_FILE_SQL)
def style_file(spark, sf):
    import uuid
    path = f"{shared_dir(spark)}/styles-{uuid.uuid4().hex}"
    d = fx.plain_bars(spark, sf).groupBy("date").agg(
        F.avg("ret").alias("raw"), F.stddev_samp("ret").alias("b"), F.avg("turn").alias("c"),
        F.max("ret").alias("d1"), F.min("ret").alias("e"))
    io.allow_charset(spark, "GBK")
    (d.select(F.col("date").alias("日期"), F.col("raw").alias("市场收益率"), F.lit(0.001).alias("RF"),
              F.col("b").alias("规模因子"), F.col("c").alias("HML"), F.col("d1").alias("RMW"), F.col("e").alias("CMA"))
     .write.option("header", True).option("encoding", "GBK").csv(path))
    return out(io.read_style_factors(spark, path))


@C.add("drop_special_symbols", f"""WITH {MARKED_SQL} SELECT date, symbol, {BAR_COLS} FROM marked
   WHERE NOT regexp_matches(symbol, 'ST|\\*ST|PT')""")
def special(spark, sf):
    return out(clean.drop_special_symbols(marked(spark, sf)).select("date", "symbol", *BAR), 8)


@C.add("drop_suspended", f"""WITH {MARKED_SQL} SELECT date, symbol, {BAR_COLS} FROM marked
   WHERE NOT (coalesce(volume, 0) = 0 AND open = high AND high = low AND low = close)""")
def suspended(spark, sf):
    return out(clean.drop_suspended(marked(spark, sf)).select("date", "symbol", *BAR), 8)


@C.add("drop_price_anomalies", f"""WITH {MARKED_SQL} SELECT date, symbol, {BAR_COLS} FROM marked
   WHERE NOT (high < greatest(open, close) OR low > least(open, close))""")
def anomalies(spark, sf):
    return out(clean.drop_price_anomalies(marked(spark, sf)).select("date", "symbol", *BAR), 8)


CLEAN_SQL = MARKED_SQL + """,
kept AS (SELECT * FROM marked WHERE NOT regexp_matches(symbol, 'ST|\\*ST|PT')
  AND NOT (coalesce(volume, 0) = 0 AND open = high AND high = low AND low = close)
  AND NOT (high < greatest(open, close) OR low > least(open, close))),
lasting AS (SELECT * FROM kept WHERE symbol IN (SELECT symbol FROM kept GROUP BY symbol HAVING count(*) >= 150)),
q AS (SELECT date, quantile_cont(pctChg, 0.01) AS lo, quantile_cont(pctChg, 0.99) AS hi FROM lasting GROUP BY date),
cleaned AS (SELECT l.* EXCLUDE (pctChg, ret), CASE WHEN pctChg IS NOT NULL THEN least(greatest(pctChg, lo), hi) END AS pctChg
  FROM lasting l JOIN q USING (date))"""


@C.add("clean_bars", f"""WITH {CLEAN_SQL} SELECT date, symbol, {', '.join(R(c, c, 8) for c in BAR[:-1])},
   {R('pctChg / 100', 'ret', 8)} FROM cleaned""")
def cleaned(spark, sf):
    from quantloom.settings import Settings
    d = clean.clean_bars(marked(spark, sf), Settings(min_bars=150), heavy(spark, sf))
    return out(d.select("date", "symbol", *BAR), 8)


@C.add("forward_label", f"""WITH {BARS_SQL}, l AS (SELECT date, symbol,
   lead(close, 5) OVER {WS} / nullif(close, 0) - 1 AS forward_ret FROM bars)
   SELECT date, symbol, {R('forward_ret', 'forward_ret')} FROM l WHERE forward_ret IS NOT NULL""")
def label5(spark, sf):
    d = series.daily_features(fx.bars(spark, sf), horizon=5, only=["ret_1d"])
    return out(clean.label_rows(d).select("date", "symbol", "forward_ret"))


@C.add("date_range_scan", f"""WITH {BARS_SQL} SELECT date, symbol, {R('close', 'close', 8)} FROM bars
   WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""")
def ranged(spark, sf):
    return out(clean.date_range(fx.plain_bars(spark, sf), "1997-01-01", "1999-12-31").select("date", "symbol", "close"), 8)


@C.add("column_subset", f"""WITH {PANEL_SQL} SELECT date, symbol, {R('amount', 'amount', 4)}, {R('vol_20d', 'vol_20d')}, {R('ret_2d', 'ret_2d')} FROM panel""")
def column_subset(spark, sf):
    return out(clean.subset(panel(spark, sf), ["vol_20d", "ret_2d", "no_such_feature"])).select(
        "date", "symbol", "amount", "vol_20d", "ret_2d")


NULLY = ["vol_20d", "pv_corr_10d", "amount_shock_5d", "turnover_20d", "ret_2d", "rev_3d"]


@C.add("factor_panel", f"""WITH {PANEL_SQL} SELECT date, symbol, {', '.join(R(c, c, 5) for c in FACTORS)},
   {R('ret', 'ret')} FROM panel""")
def factor_panel(spark, sf):
    return out(out(panel(spark, sf).select("date", "symbol", *FACTORS), 5).join(
        panel(spark, sf).select("date", "symbol", "ret"), ["date", "symbol"]))


@C.add("drop_null_rows_fill_zero", f"""WITH {PANEL_SQL} SELECT date, symbol,
   {', '.join(R(f'least(greatest(coalesce({c}, 0), -1000), 1000)', c) for c in NULLY)} FROM panel
   WHERE ({' + '.join(f'({c} IS NULL)::INT' for c in NULLY)}) / {len(NULLY)}.0 <= 0.5""")
def null_rows(spark, sf):
    d = clean.drop_null_rows(panel(spark, sf), NULLY, 0.5)
    return out(clean.clip_range(clean.null_to_zero(d, NULLY), NULLY).select("date", "symbol", *NULLY))


REGISTRY = [
    ("F1", "abs(rev_3d)/(vol_20d+0.25)", ["rev_3d", "vol_20d"], "WEAK", 2.3, 0.018, 0.22),
    ("F2", "body_ratio*abs(ret_2d) + 0.3*turnover_20d", ["body_ratio", "ret_2d", "turnover_20d"], "STRONG", 4.4, 0.041, 0.42),
    ("F3", "(rev_3d-amount_shock_5d)*body_ratio", ["rev_3d", "amount_shock_5d", "body_ratio"], "STRONG", -3.1, -0.036, -0.33),
    ("F4", "log1p(abs(vol_20d)) - inv(illiq_spread)", ["vol_20d", "illiq_spread"], None, 2.9, 0.031, 0.31),
    ("F5", "sign(ret_2d)*turnover_20d/(vol_20d+0.5)", ["ret_2d", "turnover_20d", "vol_20d"], "STRONG", 3.1, 0.033, 0.3),
    ("F6", "unknown_feature*2", ["unknown_feature"], "STRONG", 2.0, 0.01, 0.1),
    ("F7", "0.5*body_ratio*turnover_20d*body_ratio", ["body_ratio", "turnover_20d"], "STRONG", 3.6, 0.037, 0.39),
]


def registry_table(spark):
    """Registry as written and read back from its JSON document."""
    import uuid
    rows = [(fid, f, fs, g, f"2026-08-{i + 1:02d}", (f, fs, t, 200, ic, icir, 0.001))
            for i, (fid, f, fs, g, t, ic, icir) in enumerate(REGISTRY)]
    df = spark.createDataFrame(rows, "fid string, formula string, features array<string>, gate_status string, "
                               "registered_at string, metrics struct<formula: string, features: array<string>, "
                               "FM_tstat: double, FM_n_periods: bigint, Rank_IC: double, ICIR: double, LS_spread: double>")
    path = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    registry.write_registry(df, path)
    return registry.read_registry(spark, path)
