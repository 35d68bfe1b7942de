"""Inference, formulas, gates, backtests, combination and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.catalog.base import (BARS_SQL, FACTORS, LONG_SQL, NEUTRAL_SQL, PANEL_SQL, Catalog, R, at_least, avg_rank,
                                    fin, heavy, long_panel, neutral_days, neutral_ic, neutral_panel, neutral_spread, out,
                                    panel, rank_ic_sql, sized_panel)
from quantloom.catalog.bars import REGISTRY, registry_table
from quantloom.catalog.sections import DAYS_SQL, LS_SQL, POOLED_SQL, WF_SQL
from quantloom.functions import formula
from quantloom.functions.exprs import rounded
from quantloom.operators import backtest, combine, daily, gates, inference, models, pool, splits, xsection as xs
from quantloom.operators.layout import write_out
from quantloom.plans import series
from quantloom.sources import fixtures as fx, io, registry

C = Catalog()


def fm_sql(src: str, by: str = "fid", min_stocks: int = 30) -> str:
    """CTEs ending in fm: one row per ``by`` group."""
    k = f"{by}, date"
    return f"""
  r0 AS (SELECT {k}, count(*) AS n, avg(x) AS mx, var_pop(x) AS vx, var_pop(ret) AS vy, covar_pop(x, ret) AS c
         FROM {src} WHERE x IS NOT NULL AND ret IS NOT NULL GROUP BY {k} HAVING count(*) >= {min_stocks} AND var_pop(x) > 1e-18),
  r1 AS (SELECT {k}, n, c / vx AS beta, c * c / (vx * vy) AS r2, 1 - (1 - c * c / (vx * vy)) * (n - 1) / (n - 2) AS adj,
         (c / vx) / sqrt((vy - c / vx * c) / (vx * (n - 2))) AS bt FROM r0),
  r2 AS (SELECT *, beta - avg(beta) OVER (PARTITION BY {by}) AS u FROM r1),
  r3 AS (SELECT *, lag(u, 1) OVER w AS u1, lag(u, 2) OVER w AS u2, lag(u, 3) OVER w AS u3 FROM r2 WINDOW w AS (PARTITION BY {by} ORDER BY date)),
  r4 AS (SELECT {by}, avg(beta) AS coef, count(*) AS n_periods, avg(r2) AS fm_r2, avg(adj) AS fm_adj_r2,
         avg((beta > 0)::INT) AS pos_ratio, avg((abs(bt) > 1.96)::INT) AS sig_ratio,
         sqrt((sum(u * u) + 2 * (0.75 * coalesce(sum(u * u1), 0) + 0.5 * coalesce(sum(u * u2), 0) + 0.25 * coalesce(sum(u * u3), 0)))
              / (count(*) * count(*)) * count(*) / (count(*) - 1.0)) AS se FROM r3 GROUP BY {by}),
  r5 AS (SELECT {by}, avg(ic) AS rank_ic, avg(ic) / stddev_samp(ic) AS icir FROM {rank_ic_sql(src, k)} WHERE ic IS NOT NULL GROUP BY {by}),
  r6 AS (SELECT {k}, min(x) AS lo, list_distinct(list_transform(quantile_cont(x, [0.2, 0.4, 0.6, 0.8]), lambda v: v + 0.0)) AS e FROM {src}
         WHERE x IS NOT NULL AND ret IS NOT NULL GROUP BY {k}),
  r7 AS (SELECT {by}, len(list_filter(e, lambda v: v > lo AND v < x)) AS bucket, avg(ret) AS m FROM {src} JOIN r6 USING ({k})
         WHERE x IS NOT NULL AND ret IS NOT NULL GROUP BY ALL),
  r8 AS (SELECT {by}, arg_max(m, bucket) - arg_min(m, bucket) AS ls_spread, count(*) AS n_buckets FROM r7 GROUP BY {by}),
  fm AS (SELECT *, CASE WHEN se > 1e-10 THEN coef / se ELSE 0 END AS t FROM r4 JOIN r5 USING ({by}) JOIN r8 USING ({by}) WHERE n_periods >= 10)"""


FM_COLS = f"""{R('coef', 'fm_coef')}, {R('se', 'fm_se')}, {R('t', 'fm_t', 5)}, n_periods, {R('fm_r2', 'fm_r2')}, {R('fm_adj_r2', 'fm_adj_r2')},
   {R('pos_ratio', 'pos_ratio')}, {R('sig_ratio', 'sig_ratio')}, {R('ls_spread', 'ls_spread')}, {R('rank_ic', 'rank_ic')}, {R('icir', 'icir')},
   n_buckets"""


def fm_out(df, by=("fid",)):
    cols = ["fm_coef", "fm_se", "fm_t", "n_periods", "fm_r2", "fm_adj_r2", "pos_ratio", "sig_ratio", "ls_spread",
            "rank_ic", "icir", "n_buckets"]
    d = df.select(*by, *[F.round(c, 5).alias(c) if c == "fm_t" else F.col(c) for c in cols])
    return out(d)


def neutral_fm(spark, sf, **kw):
    if heavy(spark, sf):
        return inference.fama_macbeth(neutral_panel(spark, sf), heavy=True, **kw)
    return inference.fama_macbeth_daily(neutral_days(spark, sf), **kw)


def stored_fm(spark, sf):
    """Metrics of the neutral panel: one row per factor, shared by the gate queries."""
    return fx.stored(spark, ("fm", sf), lambda: neutral_fm(spark, sf))


NEUTRAL_FM = f"WITH {NEUTRAL_SQL}, {fm_sql('neutral')}"


@C.add("fama_macbeth", f"WITH {LONG_SQL}, {fm_sql('long')} SELECT fid, {FM_COLS} FROM fm")
def fm_raw(spark, sf):
    return fm_out(inference.fama_macbeth(long_panel(spark, sf), heavy=heavy(spark, sf)))


@C.add("fama_macbeth_neutral", f"{NEUTRAL_FM} SELECT fid, {FM_COLS} FROM fm")
def fm_neutral(spark, sf):
    return fm_out(neutral_fm(spark, sf))




# The twin adds up the finite series of Student's t for whole degrees of freedom, in powers of the cosine of atan(t / sqrt(df)).
@C.add("fama_macbeth_p_values", f"""{NEUTRAL_FM}, an AS (SELECT fid, t, n_periods, n_periods - 1 AS df, atan(abs(t) / sqrt(n_periods - 1)) AS a FROM fm),
  tm AS (SELECT fid, df, a, sum(CASE WHEN j.range = 0 THEN (df % 2) * ln(cos(a)) WHEN df % 2 = 0 THEN ln((2.0 * j.range - 1) / (2 * j.range)) + 2 * ln(cos(a))
         ELSE ln(2.0 * j.range / (2 * j.range + 1)) + 2 * ln(cos(a)) END) OVER (PARTITION BY fid ORDER BY j.range) AS l FROM an, range(100000) j WHERE j.range < df // 2),
  sr AS (SELECT fid, sum(exp(l)) AS s FROM tm GROUP BY fid)
  SELECT fid, {R('t', 'fm_t', 5)}, {R('1 - CASE WHEN df % 2 = 0 THEN sin(a) * s ELSE 2 / pi() * (a + sin(a) * coalesce(s, 0)) END', 'fm_p', 10)}, n_periods
  FROM an LEFT JOIN sr USING (fid)""")
def fm_p(spark, sf):
    return out(stored_fm(spark, sf).select("fid", F.round("fm_t", 5).alias("fm_t"), "fm_p", "n_periods"), 10)


def flagship(spark, sf, min_stocks: int = 30):
    """Size-neutral predictive power of last week's return: rank IC, HAC t, spread."""
    p = panel(spark, sf).select("date", "symbol", "ret", F.lit("ret_1d").alias("fid"), F.col("ret_1d").alias("x"),
                                xs.log_size(F.col("amount")).alias("ln_amt"))
    n = write_out(xs.neutralise(p, ["x", "ret"], ["ln_amt"], min_rows=min_stocks), "flagship")
    ic = xs.ic_summary(xs.rank_ic(n, min_rows=min_stocks, heavy=heavy(spark, sf)))
    fm = inference.fama_macbeth(n, min_stocks=min_stocks, heavy=heavy(spark, sf))
    return out(ic.join(fm.select("fid", "fm_coef", "fm_se", "fm_t", "n_periods", "fm_r2"), "fid"))


FLAG_SQL = NEUTRAL_SQL.replace("long AS (UNPIVOT", "unused AS (UNPIVOT").replace(
    "moments AS", "long AS (SELECT 'ret_1d' AS fid, date, symbol, ret, ln_amt, ret_1d AS x FROM panel WHERE ret_1d IS NOT NULL),\nmoments AS")


@C.add("flagship_reversal", f"""WITH {FLAG_SQL}, {fm_sql('neutral')},
   i30 AS (SELECT fid, avg(ic) AS m, avg(ic) / stddev_samp(ic) AS ii, count(ic) AS nd FROM {rank_ic_sql('neutral', min_rows=30)} WHERE ic IS NOT NULL GROUP BY fid)
   SELECT fid, {R('m', 'ic_mean')}, nd AS n_days, {R('ii', 'icir')}, {R('coef', 'fm_coef')}, {R('se', 'fm_se')}, {R('t', 'fm_t')}, n_periods,
   {R('fm_r2', 'fm_r2')} FROM fm JOIN i30 USING (fid)""")
def flagship_query(spark, sf):
    return flagship(spark, sf)


@C.add("group_effects", f"""WITH {LONG_SQL}, g AS (SELECT *, CAST(symbol AS BIGINT) % 7 AS grp FROM long),
  d AS (SELECT fid, date, x - avg(x) OVER (PARTITION BY fid, date, grp) AS dx, ret - avg(ret) OVER (PARTITION BY fid, date, grp) AS dy FROM g),
  b AS (SELECT fid, date, count(*) AS n, sum(dx * dy) / sum(dx * dx) AS beta FROM d GROUP BY fid, date HAVING count(*) >= 30 AND sum(dx * dx) > 1e-12)
  SELECT fid, count(*) AS n_periods, {R('avg(beta)', 'fm_coef')} FROM b GROUP BY fid""")
def group_fx(spark, sf):
    d = long_panel(spark, sf).withColumn("grp", F.col("symbol").cast("bigint") % 7)
    b = inference.group_effect_regressions(d, "grp")
    return out(b.groupBy("fid").agg(F.count(F.lit(1)).alias("n_periods"), F.avg("beta").alias("fm_coef")))


@C.add("controlled_regressions", f"""WITH {LONG_SQL}, g AS (SELECT *, CAST(symbol AS BIGINT) % (CASE WHEN month(date) % 2 = 0 THEN 7 ELSE 25 END) * 1.0 AS grp FROM long),
  k AS (SELECT fid, date, count(DISTINCT grp) > 20 AS many FROM g GROUP BY fid, date),
  d AS (SELECT fid, date, many, CASE WHEN many THEN x - avg(x) OVER (PARTITION BY fid, date, grp) ELSE x END AS dx,
        CASE WHEN many THEN ret - avg(ret) OVER (PARTITION BY fid, date, grp) ELSE ret END AS dy, grp FROM g JOIN k USING (fid, date)),
  m AS (SELECT fid, date, any_value(many) AS many, count(*) AS n, sum(dx * dx) AS xx, sum(dx * dy) AS xy, var_pop(dx) AS vx, var_pop(grp) AS vg,
        covar_pop(dx, grp) AS cx, covar_pop(dy, grp) AS cy, covar_pop(dx, dy) AS c FROM d GROUP BY fid, date HAVING count(*) >= 30),
  b AS (SELECT fid, date, n, CASE WHEN many THEN xy / nullif(xx, 0) ELSE (c - cx * cy / vg) / nullif(vx - cx * cx / vg, 0) END AS beta FROM m)
  SELECT fid, count(*) AS n_periods, {R('avg(beta)', 'fm_coef')} FROM b WHERE beta IS NOT NULL GROUP BY fid""")
def controlled(spark, sf):
    width = F.when(F.month("date") % 2 == 0, 7).otherwise(25)
    d = long_panel(spark, sf).withColumn("grp", (F.col("symbol").cast("bigint") % width).cast("double"))
    b = inference.controlled_regressions(d, "grp")
    return out(b.groupBy("fid").agg(F.count(F.lit(1)).alias("n_periods"), F.avg("beta").alias("fm_coef")))


# ---- timing series --------------------------------------------------------------------
TIMING_X = ["ret_5d", "bias_20d", "trend_slope_20d"]
INDEX_SQL = f"""
  i0 AS (SELECT date, avg(close) AS close FROM bars GROUP BY date),
  i1 AS (SELECT date, close, lead(close) OVER (ORDER BY date) / close - 1 AS ret, row_number() OVER (ORDER BY date) AS pos FROM i0),
  i2 AS (SELECT date, ret, close / lag(close, 5) OVER (ORDER BY date) - 1 AS ret_5d,
    CASE WHEN count(close) OVER w20 >= 10 THEN close / avg(close) OVER w20 - 1 END AS bias_20d,
    CASE WHEN count(close) OVER w20 >= 20 THEN regr_slope(close, pos) OVER w20 / (stddev_pop(close) OVER w20 + 1e-8) END AS trend_slope_20d
    FROM i1 WINDOW w20 AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  tl AS (UNPIVOT (SELECT * FROM i2 WHERE ret IS NOT NULL) ON {', '.join(TIMING_X)} INTO NAME fid VALUE x)"""


def timing_long(spark, sf):
    def build():
        from quantloom.plans import timing
        idx = series.equal_weight_index(fx.bars(spark, sf)).withColumn("series", F.lit("index"))
        f = timing.index_features(idx).select("date", *TIMING_X)
        y = series.equal_weight_index(fx.bars(spark, sf)).select("date", "close").withColumn("_k", F.lit(0))
        from pyspark.sql import Window
        y = y.withColumn("ret", F.try_divide(F.lead("close").over(Window.partitionBy("_k").orderBy("date")), "close") - 1)
        return xs.melt(f.join(y.select("date", "ret").filter("ret IS NOT NULL"), "date"), TIMING_X, ["date", "ret"])
    return fx.stored(spark, ("timing_long", sf), build)


@C.add("timing_eval", f"""WITH {BARS_SQL}, {INDEX_SQL},
  a AS (SELECT *, avg(x) OVER p AS mx, avg(ret) OVER p AS my, covar_pop(x, ret) OVER p / var_pop(x) OVER p AS b FROM tl WINDOW p AS (PARTITION BY fid)),
  h AS (SELECT *, (x - mx) * (ret - my - b * (x - mx)) AS h, CASE WHEN x > 0 THEN ret ELSE 0 END AS s FROM a),
  l AS (SELECT *, lag(h, 1) OVER w AS h1, lag(h, 2) OVER w AS h2, lag(h, 3) OVER w AS h3,
        exp(sum(ln(1 + s)) OVER (PARTITION BY fid ORDER BY date ROWS UNBOUNDED PRECEDING)) AS nav FROM h WINDOW w AS (PARTITION BY fid ORDER BY date)),
  d AS (SELECT *, nav / max(nav) OVER (PARTITION BY fid ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM l),
  g AS (SELECT fid, count(*) AS n, max(b) AS coef, sqrt((sum(h * h) + 2 * (0.75 * sum(h * h1) + 0.5 * sum(h * h2) + 0.25 * sum(h * h3)))
        * count(*) / (count(*) - 2.0)) / (var_pop(x) * count(*)) AS se, power(corr(x, ret), 2) AS r2,
        avg((sign(x) = sign(ret))::INT) AS acc, avg(s) / stddev_pop(s) * sqrt(252) AS sharpe, min(dd) AS mdd, arg_max(nav, date) AS fin,
        sum(s) FILTER (WHERE s > 0) / abs(sum(s) FILTER (WHERE s < 0)) AS pf FROM d GROUP BY fid)
  SELECT fid, n AS n_periods, {R('coef', 'coef')}, {R('se', 'se')}, {R('coef / se', 't_stat', 5)}, {R('r2', 'r2')}, {R('acc', 'direction_accuracy')},
  {R('sharpe', 'sharpe', 5)}, {R('power(fin, 252.0 / n) - 1', 'annual_return', 5)}, {R('mdd', 'max_drawdown')}, {R('pf', 'profit_factor', 5)} FROM g""")
def timing_eval(spark, sf):
    d = inference.timing_eval(timing_long(spark, sf))
    return out(d.select("fid", "n_periods", "coef", "se", F.round("t_stat", 5).alias("t_stat"), "r2", "direction_accuracy",
                        F.round("sharpe", 5).alias("sharpe"), F.round("annual_return", 5).alias("annual_return"), "max_drawdown",
                        F.round("profit_factor", 5).alias("profit_factor")))


@C.add("timing_backtest", f"""WITH {BARS_SQL}, {INDEX_SQL},
  a AS (SELECT *, CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END AS p FROM tl),
  b AS (SELECT *, abs(p - coalesce(lag(p) OVER (PARTITION BY fid ORDER BY date), 0)) AS c FROM a),
  e AS (SELECT *, p * ret - c * 0.001 AS net FROM b),
  f AS (SELECT *, exp(sum(ln(1 + net)) OVER w) AS nav, exp(sum(ln(1 + ret)) OVER w) AS bh FROM e
        WINDOW w AS (PARTITION BY fid ORDER BY date ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT *, nav / max(nav) OVER (PARTITION BY fid ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM f)
  SELECT fid, count(*) AS n_days, CAST(sum(p) AS BIGINT) AS n_hold_days, {R('sum(c)', 'turnover')}, {R('avg(net) / stddev_pop(net) * sqrt(252)', 'sharpe', 5)},
  {R('avg((sign(x) = sign(ret))::INT)', 'direction_accuracy')}, {R('sum(net) FILTER (WHERE net > 0) / abs(sum(net) FILTER (WHERE net < 0))', 'profit_factor', 5)},
  {R('min(dd)', 'max_drawdown')}, {R('arg_max(nav, date) - 1', 'total_return', 5)}, {R('power(arg_max(bh, date), 252.0 / count(*)) - 1', 'bh_annual_return', 5)} FROM g GROUP BY fid""")
def timing_bt(spark, sf):
    d = backtest.timing_backtest(timing_long(spark, sf))
    return out(d.select("fid", "n_days", "n_hold_days", "turnover", F.round("sharpe", 5).alias("sharpe"), "direction_accuracy",
                        F.round("profit_factor", 5).alias("profit_factor"), "max_drawdown",
                        F.round("total_return", 5).alias("total_return"),
                        F.round("bh_annual_return", 5).alias("bh_annual_return")))


TE_SQL = C.sql["timing_eval"]


@C.add("timing_gate", TE_SQL[:TE_SQL.rindex("SELECT fid, n AS")].rstrip() + f""",
  m AS (SELECT fid, n, coef / se AS t, acc, sharpe FROM g),
  v AS (SELECT *, CASE WHEN abs(t) < 0.8 THEN 't' WHEN acc < 0.48 THEN 'direction' WHEN abs(sharpe) < 0.3 THEN 'sharpe' ELSE '' END AS reason FROM m),
  z AS (SELECT *, CASE WHEN reason = '' THEN CASE WHEN abs(sharpe) >= 1 AND acc >= 0.55 THEN 'STRONG' ELSE 'WEAK' END END AS gate_status FROM v)
  SELECT fid, reason = '' AS ok, reason, gate_status,
   {R("greatest(0.3, 0.3 + 9.7 * power(1 / (1 + exp(-2 * (abs(sharpe) - 0.3))), 0.5) * (1 / (1 + exp(-10 * (acc - 0.52)))) * power(1 / (1 + exp(-1.5 * (abs(t) - 1.5))), 0.3))", 'reward', 5)},
   coalesce(gate_status, '') <> 'WEAK' AND abs(t) >= 3 AND abs(sharpe) >= 0.3 AND acc >= 0.52 AND n >= 30 AS production FROM z""")
def timing_gate(spark, sf):
    t = gates.timing_verdict(inference.timing_eval(timing_long(spark, sf)))
    return out(t.withColumn("reward", gates.timing_reward()).withColumn("production", gates.timing_production_ready())
               .select("fid", "ok", "reason", "gate_status", F.round("reward", 5).alias("reward"), "production"))


@C.add("half_overlap_icir", f"""WITH {BARS_SQL}, {INDEX_SQL},
  c AS (SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY date) - 1 AS i, x, ret FROM tl WHERE x IS NOT NULL),
  mn AS (SELECT min(k) AS n FROM (SELECT count(*) AS k FROM c GROUP BY fid)),
  w AS (SELECT unnest(range(0, n - least(60, n // 3), least(60, n // 3) // 2)) AS a, least(60, n // 3) AS size FROM mn),
  e AS (SELECT fid, a AS k, x, ret FROM c JOIN w ON i >= a AND i < a + size),
  d AS (SELECT fid, k, {fin('corr(rx, ry)')} AS ic FROM (SELECT fid, k, {avg_rank('fid, k', 'x')} AS rx, {avg_rank('fid, k', 'ret')} AS ry FROM e) GROUP BY fid, k)
  SELECT fid, {R('avg(ic)', 'ic_mean')}, count(ic) AS n_days, {R('avg(ic) / (stddev_samp(ic) + 1e-8)', 'icir')} FROM d WHERE ic IS NOT NULL GROUP BY fid""")
def half(spark, sf):
    t = timing_long(spark, sf).filter("x IS NOT NULL")
    n = t.groupBy("fid").count().agg(F.min("count").alias("n")).head().n  # rows of one series
    return out(pool.half_overlap_icir(t, int(n)))


# ---- style orthogonality --------------------------------------------------------------
STYLE_SQL = f"""
  sty0 AS (SELECT date, ret, amount, turn, symbol, row_number() OVER (PARTITION BY date ORDER BY amount, symbol) AS ra,
     row_number() OVER (PARTITION BY date ORDER BY close, symbol) AS rc, row_number() OVER (PARTITION BY date ORDER BY turn, symbol) AS rt,
     count(*) OVER (PARTITION BY date) AS n FROM panel),
  sty AS (SELECT date, avg(ret) AS "MKT", avg(ret) FILTER (WHERE ra <= n // 2) - avg(ret) FILTER (WHERE ra > n // 2) AS "SMB",
     avg(ret) FILTER (WHERE rc > n // 2) - avg(ret) FILTER (WHERE rc <= n // 2) AS "HML",
     avg(ret) FILTER (WHERE rt > n // 2) - avg(ret) FILTER (WHERE rt <= n // 2) AS "RMW",
     stddev_samp(ret) AS "CMA" FROM panel JOIN sty0 USING (date, ret, amount, turn, symbol) GROUP BY date)"""
STYLES = ["MKT", "SMB", "HML", "RMW", "CMA"]


def styles(spark, sf):
    def build():
        p = panel(spark, sf).select("date", "symbol", "ret", "amount", "close", "turn")
        for c, n in (("amount", "ra"), ("close", "rc"), ("turn", "rt")):
            p = xs.ordinal_rank(p, ["date"], c, n, heavy=heavy(spark, sf))
        half = F.floor(F.col("ra_n") / 2)
        top = lambda c: F.avg(F.when(F.col(c) > half, F.col("ret")))
        low = lambda c: F.avg(F.when(F.col(c) <= half, F.col("ret")))
        return p.groupBy("date").agg(F.avg("ret").alias("MKT"), (low("ra") - top("ra")).alias("SMB"),
                                     (top("rc") - low("rc")).alias("HML"), (top("rt") - low("rt")).alias("RMW"),
                                     F.stddev_samp("ret").alias("CMA"))
    return fx.stored(spark, ("styles", sf), build)


def _gs_sql() -> str:
    """Sequential orthogonalisation of (MKT..CMA, 1) and y; the constant comes last, so its
    coefficient is alpha and its residual carries the score of alpha."""
    cols = [f'"{c}"' for c in STYLES] + ["one"]
    steps, prev = [], "jn"
    for i, c in enumerate(cols):
        later = cols[i + 1:] + ["y"]
        sel = ", ".join(f"{v} - {c} * (sum({v} * {c}) OVER p / sum({c} * {c}) OVER p) AS {v}" for v in later)
        extra = ", one AS r0, sum(y * one) OVER p / sum(one * one) OVER p AS alpha" if c == "one" else ""
        steps.append(f"g{i} AS (SELECT fid, date, y0{extra}, {sel} FROM {prev} WINDOW p AS (PARTITION BY fid))")
        prev = f"g{i}"
    return ",\n  ".join(steps)


@C.add("style_orthogonality", f"""WITH {NEUTRAL_SQL}, {LS_SQL.format(src='neutral')}, {STYLE_SQL},
  nd AS (SELECT count(DISTINCT date) AS d FROM ls),
  kf AS (SELECT fid FROM ls, nd GROUP BY fid, d HAVING count(*) >= greatest(30, floor(d * 0.5))),
  kd AS (SELECT date FROM ls WHERE fid IN (SELECT fid FROM kf) GROUP BY date HAVING count(*) = (SELECT count(*) FROM kf)),
  jn AS (SELECT fid, date, ls AS y, ls AS y0, 1.0 AS one, "MKT", "SMB", "HML", "RMW", "CMA" FROM ls JOIN sty USING (date)
         WHERE fid IN (SELECT fid FROM kf) AND date IN (SELECT date FROM kd)),
  {_gs_sql()},
  sc AS (SELECT *, r0 * y AS s FROM g5),
  lg AS (SELECT *, lag(s, 1) OVER w AS s1, lag(s, 2) OVER w AS s2, lag(s, 3) OVER w AS s3, lag(s, 4) OVER w AS s4, lag(s, 5) OVER w AS s5
         FROM sc WINDOW w AS (PARTITION BY fid ORDER BY date)),
  fz AS (SELECT fid, max(alpha) AS alpha, count(*) AS n, sum(r0 * r0) AS q, 1 - sum(y * y) / (var_pop(y0) * count(*)) AS r2,
    sum(s * s) + 2 * (5 / 6.0 * sum(s * s1) + 4 / 6.0 * sum(s * s2) + 3 / 6.0 * sum(s * s3) + 2 / 6.0 * sum(s * s4) + 1 / 6.0 * sum(s * s5)) AS hac
    FROM lg GROUP BY fid),
  tt AS (SELECT *, alpha / (sqrt(hac * n / (n - 6.0)) / q) AS t FROM fz)
  SELECT fid, {R('alpha', 'alpha', 5)}, {R('t', 't_alpha', 4)}, {R('r2', 'r2', 5)}, n,
  CASE WHEN abs(t) > 2 THEN 'Pure Alpha' WHEN abs(t) > 1.5 THEN 'Marginal' ELSE 'Risk-proxy' END AS judgment FROM tt""")
def orthogonality(spark, sf):
    ls = neutral_spread(spark, sf)
    d = inference.style_orthogonality(write_out(ls, "ls"), styles(spark, sf), STYLES)
    return out(d.select("fid", F.round("alpha", 5).alias("alpha"), F.round("t_alpha", 4).alias("t_alpha"),
                        F.round("r2", 5).alias("r2"), "n", "judgment"))


# ---- segments, stability, walk-forward ------------------------------------------------
SEG_SQL = f"""sg0 AS (SELECT date, i, n, CASE WHEN i <= floor(n * 0.6) THEN 1 ELSE 0 END AS tr FROM days),
  sg1 AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS m FROM sg0 WHERE tr = 1),
  sg AS (SELECT date, 'part' || CAST(CASE WHEN k < (m % 3) * (m // 3 + 1) THEN k // (m // 3 + 1)
         ELSE m % 3 + (k - (m % 3) * (m // 3 + 1)) // (m // 3) END AS VARCHAR) AS segment FROM sg1
         UNION ALL SELECT date, 'val' FROM days WHERE i > floor(n * 0.6) AND i <= floor(n * 0.8)),
  segd AS (SELECT n.*, segment FROM neutral n JOIN sg USING (date))"""
NEUTRAL_DAYS = NEUTRAL_SQL + DAYS_SQL[len(PANEL_SQL):]


def segments(spark, sf):
    days = splits.ratio_days(panel(spark, sf).select("date"))
    train = splits.array_parts(days.filter("split = 'train'"), 3).select(
        "date", F.concat(F.lit("part"), F.col("part").cast("string")).alias("segment"))
    return train.unionByName(days.filter("split = 'val'").select("date", F.lit("val").alias("segment")))


def neutral_segments(spark, sf):
    """Fama-MacBeth per (factor, segment) of the size-neutral panel."""
    if heavy(spark, sf):
        return inference.segment_fm(neutral_panel(spark, sf), segments(spark, sf), heavy=True)
    return inference.segment_fm_daily(neutral_days(spark, sf), segments(spark, sf))


@C.add("sub_period_metrics", f"WITH {NEUTRAL_DAYS}, {SEG_SQL}, {fm_sql('segd', 'fid, segment')} SELECT fid, segment, {FM_COLS} FROM fm")
def sub_periods(spark, sf):
    return fm_out(neutral_segments(spark, sf), ("fid", "segment"))


@C.add("sub_period_robustness", f"""WITH {NEUTRAL_DAYS}, {SEG_SQL}, {fm_sql('segd', 'fid, segment')}
   SELECT fid, {R('avg((t * rank_ic > 0 AND abs(t) >= 1)::INT)', 'robustness')}, count(*) AS n_segments FROM fm WHERE n_periods >= 30 GROUP BY fid""")
def robust(spark, sf):
    m = neutral_segments(spark, sf)
    return out(inference.robustness_share(m))


@C.add("amplitude_refit", f"""WITH {PANEL_SQL}{DAYS_SQL[len(PANEL_SQL):]}, l2 AS (UNPIVOT (SELECT date, symbol, ret, {', '.join(FACTORS)} FROM panel)
     ON {', '.join(FACTORS)} INTO NAME fid VALUE x), tr AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS m FROM days WHERE i <= floor(n * 0.6)),
  v AS (SELECT date, 'head' AS variant FROM tr WHERE k >= 5 UNION ALL SELECT date, 'tail' FROM tr WHERE k < m - 5)
  SELECT fid, variant, {R('CASE WHEN sum(x * x) > 1e-12 THEN sum(ret * x) / sum(x * x) END', 'amplitude')} FROM l2 JOIN v USING (date) GROUP BY fid, variant""")
def amp(spark, sf):
    days = splits.ratio_days(panel(spark, sf).select("date")).filter("split = 'train'")
    d = long_panel(spark, sf).join(splits.edge_variants(days), "date")
    return out(inference.amplitude(d, by=("fid", "variant")))


@C.add("stable_candidates", f"""WITH {PANEL_SQL}{DAYS_SQL[len(PANEL_SQL):]}, l2 AS (UNPIVOT (SELECT date, symbol, ret, ln_amt, {', '.join(FACTORS)} FROM panel)
     ON {', '.join(FACTORS)} INTO NAME fid VALUE x), tr AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS m FROM days WHERE i <= floor(n * 0.6)),
  v AS (SELECT date, 'head' AS variant FROM tr WHERE k >= 5 UNION ALL SELECT date, 'tail' FROM tr WHERE k < m - 5),
  am AS (SELECT fid, variant, sum(ret * x) / sum(x * x) AS a FROM l2 JOIN v USING (date) GROUP BY fid, variant),
  vd AS (SELECT date FROM days WHERE i > floor(n * 0.6) AND i <= floor(n * 0.8)),
  vl AS (SELECT l2.* FROM l2 JOIN vd USING (date)),
  bt AS (SELECT fid, 'orig' AS variant, date, symbol, ret, ln_amt, x FROM vl UNION ALL
         SELECT fid, variant, date, symbol, ret, ln_amt, x * a FROM vl JOIN am USING (fid)),
  mo AS (SELECT fid, variant, date, count(*) AS n, avg(x) AS mx, avg(ret) AS mr, avg(ln_amt) AS mz, var_pop(ln_amt) AS vz,
         covar_pop(x, ln_amt) AS cx, covar_pop(ret, ln_amt) AS cr FROM bt GROUP BY ALL),
  nv AS (SELECT fid, variant, date, symbol, CASE WHEN n >= 30 THEN x - mx - coalesce(cx / nullif(vz, 0), 0) * (ln_amt - mz) ELSE x END AS x,
         CASE WHEN n >= 30 THEN ret - mr - coalesce(cr / nullif(vz, 0), 0) * (ln_amt - mz) ELSE ret END AS ret FROM bt JOIN mo USING (fid, variant, date)),
  {fm_sql('nv', 'fid, variant')},
  og AS (SELECT fid, t AS orig_t FROM fm WHERE variant = 'orig'),
  st AS (SELECT fid, max(orig_t) AS orig_t, CAST(sum((sign(t) = sign(orig_t))::INT) AS BIGINT) AS hits, count(*) AS n_states FROM fm JOIN og USING (fid) GROUP BY fid)
  SELECT fid, {R('orig_t', 'orig_t', 4)}, hits, n_states, {R('hits / n_states', 'stability')}, 'all' AS grp, CAST(1 AS BIGINT) AS complexity, CAST(0 AS DOUBLE) AS loss
  FROM st WHERE hits >= 2 ORDER BY hits / n_states DESC, abs(orig_t) DESC, fid LIMIT 1""")
def stable(spark, sf):
    days = splits.ratio_days(panel(spark, sf).select("date"))
    d = long_panel(spark, sf)
    amp_ = inference.amplitude(d.join(splits.edge_variants(days.filter("split = 'train'")), "date"), by=("fid", "variant"))
    val = d.join(days.filter("split = 'val'").select("date"), "date", "left_semi")
    scaled = val.join(amp_, "fid").withColumn("x", F.col("x") * F.col("amplitude")).drop("amplitude")
    both = write_out(val.withColumn("variant", F.lit("orig")).unionByName(scaled), "variants")
    n = xs.neutralise(both, ["x", "ret"], ["ln_amt"], ("fid", "variant", "date"))
    m = inference.fama_macbeth(n, by=("fid", "variant"), heavy=heavy(spark, sf)).select("fid", "variant", F.col("fm_t").alias("t"))
    cand = spark.createDataFrame([(f, "all", 1, 0.0) for f in FACTORS], "fid string, grp string, complexity int, loss double")
    d = inference.stable_candidates(write_out(m, "variant_t"), cand, entrance_t=0.0, min_t=0.0)
    return out(d.withColumn("orig_t", F.round("orig_t", 4)))


ICW = rank_ic_sql('neutral', min_rows=30)


@C.add("window_icir", f"""WITH {NEUTRAL_DAYS}, dw AS (SELECT date, least(2, floor((i * 3 + 2) / n)) AS part FROM days), ic AS (SELECT * FROM {ICW})
   SELECT fid, CAST(part AS BIGINT) AS "window", CAST(sum(n) AS BIGINT) AS n_rows, count(ic) AS n_days, {R('avg(ic) / (stddev_samp(ic) + 1e-8)', 'icir')}
   FROM ic JOIN dw USING (date) GROUP BY fid, part HAVING sum(n) >= 200 AND count(ic) >= 5""")
def wicir(spark, sf):
    ic = neutral_ic(spark, sf)
    w = splits.equal_parts(panel(spark, sf).select("date"), 3).withColumnRenamed("part", "window")
    return out(inference.window_icir(ic, w))


@C.add("stability_summary", f"""WITH {NEUTRAL_DAYS}, mo AS (SELECT date, year(date) * 12 + month(date) - (year(d0) * 12 + month(d0)) AS m FROM days),
  rw AS (SELECT date, k FROM mo, (SELECT unnest(range(0, 200)) AS k) w WHERE m >= 2 * k AND m < 2 * k + 4 AND 2 * k + 3 <= (SELECT max(m) FROM mo)),
  ic AS (SELECT * FROM {ICW}), pw AS (SELECT fid, k, avg(ic) / (stddev_samp(ic) + 1e-8) AS icir FROM ic JOIN rw USING (date) GROUP BY fid, k
         HAVING sum(n) >= 200 AND count(ic) >= 5)
  SELECT fid, {R('avg(icir)', 'mean_icir')}, {R('min(icir)', 'min_icir')}, {R('max(icir)', 'max_icir')}, count(*) AS n_windows,
  (min(icir) > 0 OR max(icir) < 0) AS same_sign, {R('greatest(avg((icir > 0)::INT), avg((icir < 0)::INT))', 'hit_rate')} FROM pw GROUP BY fid""")
def stability(spark, sf):
    ic = neutral_ic(spark, sf)
    w = splits.rolling_month_windows(panel(spark, sf).select("date"))
    return out(inference.stability_summary(inference.window_icir(ic, w)))


CROSS_SQL = NEUTRAL_SQL + WF_SQL[len(PANEL_SQL):] + f""",
  wt AS (SELECT n.*, w."window" FROM neutral n JOIN wf w USING (date) WHERE split = 'test'),
  wv AS (SELECT n.*, w."window" FROM neutral n JOIN wf w USING (date) WHERE split = 'val'),
  {fm_sql('wt', 'fid, "window"')}"""


def _cross(spark, sf):
    w = splits.walk_forward(panel(spark, sf).select("date"), train=36, val=12, test=12)
    t = neutral_panel(spark, sf).join(w.filter("split = 'test'").select("date", "window"), "date")
    m = write_out(inference.fama_macbeth(t, by=("fid", "window"), heavy=heavy(spark, sf)), "window_fm")
    src = m.select("fid", F.col("window").alias("src_window"), F.col("fm_t").alias("src_t"))
    return inference.cross_window(m, src)


@C.add("cross_window", f"""WITH {CROSS_SQL} SELECT CAST(a."window" AS BIGINT) AS src_window, fid, CAST(b."window" AS BIGINT) AS test_window, b.n_periods,
   {R('CASE WHEN b.n_periods >= 30 THEN b.t END', 'fm_t', 5)}, {R('CASE WHEN b.n_periods >= 30 THEN b.rank_ic END', 'rank_ic')},
   {R('CASE WHEN b.n_periods >= 30 THEN b.icir END', 'icir')},
   b.n_periods >= 30 AND abs(b.t) >= 2 AND (a.t = 0 OR sign(a.t) = sign(b.t)) AS passed, b.n_periods < 30 AS insufficient
   FROM fm a JOIN fm b USING (fid) WHERE b."window" > a."window\"""")
def cross(spark, sf):
    return out(_cross(spark, sf).withColumn("fm_t", F.round("fm_t", 5)))


CW_SQL = C.sql["cross_window"]


@C.add("cross_window_summary", CW_SQL[:CW_SQL.rindex("SELECT CAST(a.")].rstrip() + f""", cw AS (SELECT b.n_periods >= 30 AS enough, b.t, b.rank_ic, b.icir,
   b.n_periods >= 30 AND abs(b.t) >= 2 AND (a.t = 0 OR sign(a.t) = sign(b.t)) AS passed FROM fm a JOIN fm b USING (fid) WHERE b."window" > a."window")
   SELECT count(*) AS n_evals, CAST(sum(passed::INT) AS BIGINT) AS n_passed, {R('coalesce(avg(passed::INT) FILTER (WHERE enough), 0)', 'hit_rate')},
   {R('coalesce(avg(t) FILTER (WHERE enough), 0)', 'mean_t', 5)}, {R('coalesce(avg(rank_ic) FILTER (WHERE enough), 0)', 'mean_ic')},
   {R('coalesce(avg(icir) FILTER (WHERE enough), 0)', 'mean_icir')} FROM cw""")
def cross_sum(spark, sf):
    return out(inference.cross_window_summary(_cross(spark, sf)).withColumn("mean_t", F.round("mean_t", 5)))


# ---- formulas and registry ------------------------------------------------------------
REG_VALUES = ", ".join(
    f"('{fid}', '{f}', [{', '.join(repr(x) for x in fs)}], {repr(g) if g else 'NULL'}, {t}, {ic}, {icir})"
    for fid, f, fs, g, t, ic, icir in REGISTRY)
REG_SQL = f"reg(fid, formula, features, gate_status, fm_t, rank_ic, icir) AS (VALUES {REG_VALUES})"


@C.add("registry_factors", f"""WITH {REG_SQL}, {PANEL_SQL}, n AS (SELECT count(*) AS panel_rows FROM panel)
   SELECT fid, formula, gate_status, CAST(len(features) AS BIGINT) AS n_features, {R('fm_t', 'fm_t')}, panel_rows FROM reg, n""")
def registry_rows(spark, sf):
    n = panel(spark, sf).agg(F.count(F.lit(1)).alias("panel_rows")).withColumn("_k", F.lit(1))
    r = registry_table(spark).withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")
    return out(r.select("fid", "formula", "gate_status", F.size("features").alias("n_features"), "fm_t", "panel_rows"))


FORMULA_SQL = {
    "F1": "abs(rev_3d) / (vol_20d + 0.25)", "F2": "body_ratio * abs(ret_2d) + 0.3 * turnover_20d",
    "F3": "(rev_3d - amount_shock_5d) * body_ratio",
    "F4": "ln(1 + abs(vol_20d)) - CASE WHEN abs(illiq_spread) > 1e-8 THEN 1 / illiq_spread ELSE 0 END",
    "F5": "sign(ret_2d) * turnover_20d / (vol_20d + 0.5)", "F6": "CAST(NULL AS DOUBLE)",
    "F7": "0.5 * body_ratio * turnover_20d * body_ratio",
}
EVAL_COLS = ", ".join(R(e, k, 3 if k in ("F3", "F4") else 5) for k, e in FORMULA_SQL.items())


def formula_panel(spark, sf, mode="safe"):
    # the registry is a document of a few formulas; their texts become one projection
    texts = {r.fid: r.formula for r in registry_table(spark).select("fid", "formula").collect()}
    return formula.evaluate(panel(spark, sf), dict(sorted(texts.items())), ["date", "symbol", "ret", "amount"], mode)


@C.add("formula_panel", f"WITH {PANEL_SQL} SELECT date, symbol, {R('ret', 'ret')}, {EVAL_COLS} FROM panel")
def formulas(spark, sf):
    d = formula_panel(spark, sf)
    return d.select("date", "symbol", (F.round("ret", 6) + F.lit(0.0)).alias("ret"),
                    *[(F.round(k, 3 if k in ("F3", "F4") else 5) + F.lit(0.0)).alias(k) for k in FORMULA_SQL])


SIGNED = {
    "A": ("log1p(ret_2d)", "sign(ret_2d) * ln(1 + abs(ret_2d))"), "B": ("sqrt(rev_3d)", "sqrt(abs(rev_3d))"),
    "C": ("tanh(cube(rev_3d))", "tanh(least(greatest(power(least(greatest(rev_3d, -10), 10), 3), -10), 10))"),
    "D": ("sigmoid(exp(body_ratio))", "1 / (1 + exp(-exp(body_ratio)))"),
    "E": ("max(body_ratio, illiq_spread) - min(body_ratio, illiq_spread)", "greatest(body_ratio, illiq_spread) - least(body_ratio, illiq_spread)"),
    "F": ("neg(sin(ret_2d) * cos(ret_2d)) + log(ret_2d)", "-(sin(ret_2d) * cos(ret_2d)) + ln(abs(ret_2d) + 1e-10)"),
    "G": ("div(ret_2d, illiq_spread)", "CASE WHEN abs(illiq_spread) >= 1e-8 THEN ret_2d / illiq_spread ELSE 0 END"),
}


@C.add("formula_functions_signed", f"""WITH {PANEL_SQL} SELECT date, symbol, {', '.join(R(s, k, 4) for k, (_, s) in SIGNED.items())}
   FROM panel WHERE rev_3d IS NOT NULL AND ret_2d IS NOT NULL""")
def signed(spark, sf):
    d = panel(spark, sf).filter("rev_3d IS NOT NULL AND ret_2d IS NOT NULL")
    return out(formula.evaluate(d, {k: f for k, (f, _) in SIGNED.items()}, ["date", "symbol"], "signed"), 4)


NF = [k for k in FORMULA_SQL if k != "F6"]


@C.add("neutral_formula_panel", f"""WITH {PANEL_SQL}, w AS (SELECT date, symbol, ret, ln_amt, {', '.join(f'{FORMULA_SQL[k]} AS {k}' for k in NF)} FROM panel),
  long AS (UNPIVOT w ON {', '.join(NF)} INTO NAME fid VALUE x),
  m AS (SELECT fid, date, count(*) AS n, avg(x) AS mx, avg(ln_amt) AS mz, covar_pop(x, ln_amt) / nullif(var_pop(ln_amt), 0) AS b FROM long GROUP BY fid, date)
  SELECT fid, date, symbol, {R('ret', 'ret')}, {R('CASE WHEN n >= 30 THEN x - mx - coalesce(b, 0) * (ln_amt - mz) ELSE x END', 'x', 2)} FROM long JOIN m USING (fid, date)""")
def formula_neutral(spark, sf):
    d = formula_panel(spark, sf).withColumn("ln_amt", xs.log_size(F.col("amount")))
    long = xs.melt(d, [k for k in FORMULA_SQL if k != "F6"], ["date", "symbol", "ret", "ln_amt"])
    return out(xs.neutralise(long, ["x"], ["ln_amt"]).select("fid", "date", "symbol", "ret", F.round("x", 2).alias("x")))


@C.add("formula_sensitivity", f"""WITH {PANEL_SQL}, v AS (SELECT date, symbol, ret, ln_amt, body_ratio * ret_2d AS raw, power(body_ratio * ret_2d, 2) AS sq,
   sign(body_ratio * ret_2d) * sqrt(abs(body_ratio * ret_2d)) AS rt, abs(body_ratio * ret_2d) AS ab FROM panel),
  long AS (UNPIVOT v ON raw, sq, rt, ab INTO NAME fid VALUE x){NEUTRAL_SQL[len(LONG_SQL):]},
  bth AS (SELECT fid || '/raw' AS fid, date, symbol, x, ret FROM long UNION ALL SELECT fid || '/neutral', date, symbol, x, ret FROM neutral),
  {fm_sql('bth')} SELECT fid, {FM_COLS} FROM fm""")
def sensitivity(spark, sf):
    base = "(body_ratio*ret_2d)"
    forms = {"raw": base, "sq": f"square({base})", "rt": f"sign({base})*sqrt(abs({base}))", "ab": f"abs({base})"}
    d = panel(spark, sf).withColumn("ln_amt", xs.log_size(F.col("amount")))
    long = xs.melt(formula.evaluate(d, forms, ["date", "symbol", "ret", "ln_amt"]), list(forms), ["date", "symbol", "ret", "ln_amt"])
    neu = xs.neutralise(long, ["x", "ret"], ["ln_amt"])
    tag = lambda df, t: df.withColumn("fid", F.concat("fid", F.lit(f"/{t}"))).select("fid", "date", "symbol", "x", "ret")
    both = write_out(tag(long, "raw").unionByName(tag(neu, "neutral")), "forms")
    return fm_out(inference.fama_macbeth(both, heavy=heavy(spark, sf)))


# structures worked out by hand for the registered formulas
SHAPES = {"F1": "(abs(Feat)/(Feat+K))", "F2": "((Feat*abs(Feat))+Feat)", "F3": "((Feat-Feat)*Feat)",
          "F4": "(log1p(abs(Feat))-inv(Feat))", "F5": "((Feat*sign(Feat))/(Feat+K))", "F6": "Feat", "F7": "(Feat*Feat*Feat)"}


@C.add("structure_signatures", f"""WITH {REG_SQL}, {PANEL_SQL}, n AS (SELECT count(*) AS panel_rows FROM panel)
   SELECT fid, formula, CASE fid {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SHAPES.items())} END AS signature, panel_rows FROM reg, n""")
def signatures(spark, sf):
    s = formula.with_signature(registry_table(spark))
    n = panel(spark, sf).agg(F.count(F.lit(1)).alias("panel_rows")).withColumn("_k", F.lit(1))
    return out(s.withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k").select("fid", "formula", "signature", "panel_rows"))


@C.add("decode_placeholders", f"""WITH {LONG_SQL}, s AS (SELECT fid, avg(ic) AS m FROM {rank_ic_sql('long', min_rows=30)} WHERE ic IS NOT NULL GROUP BY fid),
   o AS (SELECT fid, row_number() OVER (ORDER BY abs(m) DESC, fid) - 1 AS i FROM s),
   p AS (SELECT max(fid) FILTER (WHERE i = 0) AS x0, max(fid) FILTER (WHERE i = 1) AS x1, max(fid) FILTER (WHERE i = 3) AS x3 FROM o)
   SELECT 'G1' AS fid, 'add(mul(' || x0 || ', ' || x3 || '), sub(' || x1 || ', 0.5))' AS decoded, CAST(3 AS BIGINT) AS n_used FROM p
   UNION ALL SELECT 'G2', 'div(X12, ' || x1 || ')', 1 FROM p UNION ALL SELECT 'G3', 'log1p(' || x1 || ')', 1 FROM p""")
def decode(spark, sf):
    # feature numbers follow the pool order given by the univariate screen
    order = pool.univariate_screen(long_panel(spark, sf), len(FACTORS), heavy=heavy(spark, sf))
    from pyspark.sql import Window
    feats = order.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("ic_mean")), "fid")) - 1).alias("idx"),
                         F.col("fid").alias("feature"))
    reg = spark.createDataFrame([("G1", "add(mul(X0, X3), sub(X1, 0.5))"), ("G2", "div(X12, X1)"), ("G3", "log1p(X1)")],
                                "fid string, formula string")
    d = formula.decode_placeholders(reg, feats)
    return out(d.select("fid", "decoded", F.size("used").alias("n_used")))


@C.add("feature_overlap", f"""WITH {REG_SQL}, {PANEL_SQL}, n AS (SELECT count(*) AS panel_rows FROM panel),
   lead AS (SELECT features AS lf FROM reg ORDER BY abs(fm_t) DESC, fid LIMIT 1)
   SELECT fid, {R('len(list_intersect(features, lf)) / len(list_distinct(list_concat(features, lf)))', 'jaccard')},
   CAST(len(list_filter(features, lambda f: contains(formula, f))) AS BIGINT) AS effective, panel_rows FROM reg, lead, n""")
def overlap(spark, sf):
    # every factor against the strongest one: a single row is attached, no pairs are formed
    n = panel(spark, sf).agg(F.count(F.lit(1)).alias("panel_rows")).withColumn("_k", F.lit(1))
    r = registry_table(spark)
    lead = r.agg(F.max_by("features", F.struct(F.abs("fm_t"), "fid")).alias("lf")).withColumn("_k", F.lit(1))
    j = r.withColumn("_k", F.lit(1)).join(F.broadcast(lead), "_k").join(F.broadcast(n), "_k")
    return out(j.select("fid", formula.jaccard(F.col("features"), F.col("lf")).alias("jaccard"),
                        formula.effective_features(F.col("formula"), F.col("features")).alias("effective"), "panel_rows"))


@C.add("best_per_formula", f"""WITH {LONG_SQL}, i AS (SELECT fid, date, ic FROM {rank_ic_sql('long')} WHERE ic IS NOT NULL),
   y AS (SELECT fid, year(date) AS yr, avg(ic) / stddev_samp(ic) AS fitness FROM i GROUP BY fid, yr HAVING count(*) >= 10)
   SELECT fid AS formula, {R('max(fitness)', 'fitness')}, arg_max(fid || '_' || yr, fitness) AS fid FROM y GROUP BY y.fid ORDER BY max(fitness) DESC, formula LIMIT 5""")
def hall(spark, sf):
    ic = xs.rank_ic(long_panel(spark, sf), heavy=heavy(spark, sf)).filter("ic IS NOT NULL")
    runs = xs.ic_summary(ic.withColumn("yr", F.year("date")), ("fid", "yr")).filter("n_days >= 10").select(
        F.col("fid").alias("formula"), F.col("icir").alias("fitness"), F.concat_ws("_", "fid", "yr").alias("fid"))
    return out(formula.best_per_formula(runs, 5))


@C.add("rank_gaussian", f"""WITH {PANEL_SQL}, r AS (SELECT date, symbol, {avg_rank('date', 'ret')} AS rk FROM panel)
   SELECT date, symbol, {R('rk', 'rank', 1)} FROM r""")
def gaussian(spark, sf):
    p = panel(spark, sf).select("date", "symbol", "ret")
    n = p.groupBy("date").agg(F.count("ret").alias("n"))
    g = models.rank_gaussian(p, "ret", ["date"], "g", bound=9.0, heavy=heavy(spark, sf)).join(n, "date")
    # back through the normal CDF to the rank, so the SQL twin needs no quantile function
    from quantloom.functions.exprs import normal_tail
    tail = normal_tail(F.col("g")) / 2
    p = F.when(F.col("g") < 0, tail).otherwise(1 - tail)
    return out(g.select("date", "symbol", (F.round(p * (F.col("n") + 1) * 2) / 2).alias("rank")), 1)


CAND = models.sweep_candidates(FACTORS, n_trials=2)
# the same templates as SQL, in the same order
ONE_SQL = ("{a}", "({a}) * ({a})", "abs({a})", "ln(1 + (CASE WHEN {a} < -0.999 THEN -0.999 ELSE {a} END))", "sign({a})",
           "CASE WHEN abs({a}) > 1e-8 THEN 1 / {a} WHEN {a} IS NOT NULL THEN 0 END")
TWO_SQL2 = ("{a} + {b}", "{a} - {b}", "{a} * {b}", "{a} / nullif({b}, 0)", "({a} * {b}) * ({a} * {b})", "{a} * abs({b})")


def _as_sql(text: str) -> str:
    for a in FACTORS:
        for t, q in zip(models.ONE, ONE_SQL):
            if text == t.format(a=a):
                return q.format(a=a)
        for b in FACTORS:
            for t, q in zip(models.TWO, TWO_SQL2):
                if text == t.format(a=a, b=b):
                    return q.format(a=a, b=b)
    raise ValueError(text)


@C.add("candidate_sweep", f"""WITH {PANEL_SQL}, w AS (SELECT date, symbol, ret, {', '.join(f'CAST({_as_sql(t)} AS DOUBLE) AS {f}' for f, t, _ in CAND)} FROM panel),
  long AS (UNPIVOT w ON {', '.join(f for f, _, _ in CAND)} INTO NAME fid VALUE x),
  s AS (SELECT fid, avg(ic) AS m, count(ic) AS n_days, avg(ic) / stddev_samp(ic) AS icir FROM {rank_ic_sql('long')} WHERE ic IS NOT NULL GROUP BY fid),
  t(fid, formula, complexity) AS (VALUES {', '.join(f"('{f}', '{t}', {c})" for f, t, c in CAND)})
  SELECT fid, {R('m', 'ic_mean')}, n_days, {R('icir', 'icir')}, formula, CAST(complexity AS BIGINT) AS complexity, {R('abs(icir)', 'score')}
  FROM s JOIN t USING (fid) ORDER BY round(abs(icir), 9) DESC, complexity, fid LIMIT 10""")
def sweep(spark, sf):
    cand = CAND
    return out(models.score_candidates(panel(spark, sf), cand, heavy=heavy(spark, sf)))


# ---- gates ----------------------------------------------------------------------------
VERDICT = """CASE WHEN NOT (t * rank_ic > 0 AND t * icir > 0) THEN 'sign' WHEN abs(t) < 2 THEN 't' WHEN abs(rank_ic) < 0.01 THEN 'ic'
   WHEN abs(icir) < 0.1 THEN 'icir' ELSE '' END"""
GATE_SQL = f"""{NEUTRAL_FM}, vd AS (SELECT *, {VERDICT} AS reason FROM fm),
  gt AS (SELECT *, reason = '' AS ok, CASE WHEN reason = '' THEN CASE WHEN abs(icir) >= 0.1 AND abs(rank_ic) >= 0.03 AND abs(t) >= 2.5
         THEN 'STRONG' ELSE 'WEAK' END END AS gate_status FROM vd)"""


def gated(spark, sf):
    return gates.registration_verdict(stored_fm(spark, sf))


@C.add("registration_verdict", f"{GATE_SQL} SELECT fid, ok, reason, gate_status FROM gt")
def verdict(spark, sf):
    return gated(spark, sf).select("fid", "ok", "reason", "gate_status")


PROD_SQL = "coalesce(gate_status, '') <> 'WEAK' AND abs(t) >= 0.5 AND abs(icir) >= 0.02 AND abs(rank_ic) >= 0.001 AND n_periods >= 30"


def _prod():
    return gates.production_ready(min_t=0.5, min_icir=0.02, min_ic=0.001)


@C.add("production_and_monotone", f"""{GATE_SQL} SELECT fid, {PROD_SQL} AS production, n_buckets >= 5 AND (CASE WHEN t >= 0 THEN 1 ELSE -1 END) * ls_spread > 0 AS monotone FROM gt""")
def production(spark, sf):
    return gated(spark, sf).select("fid", _prod().alias("production"), gates.monotone().alias("monotone"))


def _sig(s, x, a):
    return f"(1 / (1 + exp(-{s} * ({x} - {a}))))"


@C.add("quality_rewards", f"""{GATE_SQL} SELECT fid,
   {R(f"greatest(0.3, (0.3 + 9.7 * power({_sig(2, 'abs(t)', 2)}, 0.2) * {_sig(25, 'abs(icir)', 0.1)} * {_sig(150, 'abs(rank_ic)', 0.03)}) * CASE WHEN sign(t) * sign(rank_ic) < 0 OR sign(t) * sign(icir) < 0 THEN 0.1 ELSE 1 END)", 'reward')},
   {R('abs(rank_ic)', 'raw_reward')},
   {R('((abs(t) >= 2)::INT * 1.0 + (abs(rank_ic) >= 0.01)::INT * 2.0 + (abs(icir) >= 0.1)::INT * 1.5 + (t * rank_ic > 0)::INT * 1.5) / 6', 'gate_share')} FROM gt""")
def rewards(spark, sf):
    d = stored_fm(spark, sf).withColumns({
        "g1": F.abs("fm_t") >= 2, "g2": F.abs("rank_ic") >= 0.01, "g3": F.abs("icir") >= 0.1,
        "g4": F.col("fm_t") * F.col("rank_ic") > 0})
    return out(d.select("fid", gates.quality_reward().alias("reward"), gates.raw_ic_reward().alias("raw_reward"),
                        gates.gate_fraction_reward(["g1", "g2", "g3", "g4"]).alias("gate_share")))


@C.add("funnel_counts", f"""{GATE_SQL} SELECT count(*) AS trials, CAST(sum((n_periods >= 30)::INT) AS BIGINT) AS tested, CAST(sum((t * rank_ic > 0)::INT) AS BIGINT) AS signed,
   CAST(sum(ok::INT) AS BIGINT) AS registered, {R('sum(ok::INT) / count(*)', 'retention')} FROM gt""")
def funnel(spark, sf):
    d = gated(spark, sf).withColumns({"tested": F.col("n_periods") >= 30, "signed": F.col("fm_t") * F.col("rank_ic") > 0,
                                      "registered": F.col("ok")})
    return out(gates.funnel(d, ["tested", "signed", "registered"]))


@C.add("registry_comparison", f"""WITH {REG_SQL}, {NEUTRAL_SQL}, {fm_sql('neutral')},
  al AS (SELECT 'mined' AS tag, fm_t AS t, icir, rank_ic, features, fid AS s FROM reg UNION ALL
         SELECT 'single', t, icir, rank_ic, [fid], 'Feat' FROM fm)
  SELECT tag, count(*) AS n_registered, CAST(sum((abs(t) >= 3 AND abs(icir) >= 0.3 AND abs(rank_ic) >= 0.03)::INT) AS BIGINT) AS n_production,
  {R('avg(abs(t))', 'mean_abs_t', 5)}, {R('max(abs(t))', 'max_abs_t', 5)}, {R('avg(abs(icir))', 'mean_abs_icir')}, {R('avg(abs(rank_ic))', 'mean_abs_ic')},
  count(DISTINCT f) AS feature_union FROM (SELECT * FROM al) GROUP BY tag""".replace("count(DISTINCT f) AS feature_union FROM (SELECT * FROM al) GROUP BY tag",
  "len(list_distinct(flatten(list(features)))) AS feature_union FROM al GROUP BY tag"))
def compare(spark, sf):
    mined = registry_table(spark).select(F.lit("mined").alias("tag"), "fm_t", "icir", "rank_ic", "features", F.col("fid").alias("signature"))
    single = stored_fm(spark, sf).select(F.lit("single").alias("tag"), "fm_t", "icir", "rank_ic", F.array("fid").alias("features"),
                                         F.lit("Feat").alias("signature"))
    prod = (F.abs("fm_t") >= 3) & (F.abs("icir") >= 0.3) & (F.abs("rank_ic") >= 0.03)
    d = gates.compare_registries(mined.unionByName(single), prod).drop("structure_unique")
    return out(d.withColumns({c: F.round(c, 5) for c in ("mean_abs_t", "max_abs_t")}))


@C.add("report_table", f"""{GATE_SQL} SELECT fid, {R('t', 'fm_t', 5)}, CASE WHEN abs(t) >= 3 THEN '***' WHEN abs(t) >= 2 THEN '**' ELSE '' END AS stars,
   CASE WHEN {PROD_SQL} THEN 'PROD' WHEN gate_status = 'WEAK' THEN 'WEAK' ELSE '-' END AS mark FROM gt ORDER BY abs(t) DESC""")
def report(spark, sf):
    return out(gates.report(gated(spark, sf), _prod()).select("fid", F.round("fm_t", 5).alias("fm_t"), "stars", "mark"))


@C.add("top_and_middle", f"""{NEUTRAL_FM} SELECT fid, {R('t', 'fm_t', 5)}, rank, {R('med', 'median_abs_t', 5)}, {R('av', 'mean_abs_t', 5)} FROM (
   SELECT fid, t, row_number() OVER (ORDER BY abs(t) DESC, fid) AS rank, quantile_cont(abs(t), 0.5) OVER () AS med, avg(abs(t)) OVER () AS av FROM fm) WHERE rank <= 5""")
def top5(spark, sf):
    return out(gates.top_and_middle(stored_fm(spark, sf).select("fid", "fm_t")), 5)


@C.add("single_feature_table", f"""WITH {NEUTRAL_DAYS}, vl AS (SELECT n.* FROM neutral n JOIN days USING (date) WHERE i > floor(n * 0.6)),
   {fm_sql('vl')} SELECT fid, {FM_COLS}, CAST((abs(t) >= 1)::INT + (abs(t) >= 1.5)::INT + (abs(t) >= 2)::INT AS BIGINT) AS level FROM fm""".replace(
    "SELECT n.* FROM neutral n JOIN days USING (date) WHERE i > floor(n * 0.6)",
    "SELECT q.* FROM neutral q JOIN days d ON q.date = d.date WHERE d.i > floor(d.n * 0.6)"))
def singles(spark, sf):
    days = splits.ratio_days(panel(spark, sf).select("date")).filter("split <> 'train'").select("date")
    d = pool.single_feature_table(neutral_panel(spark, sf).join(days, "date", "left_semi"), heavy=heavy(spark, sf))
    return fm_out(d).join(d.select("fid", F.col("level").cast("bigint").alias("level")), "fid")


@C.add("feature_usage", f"""WITH {LONG_SQL}, i AS (SELECT fid, date, ic FROM {rank_ic_sql('long')} WHERE ic IS NOT NULL),
   lg AS (SELECT date, list(fid) AS f, avg(ic) > 0 AS passed FROM i WHERE abs(ic) > 0.1 GROUP BY date),
   tot AS (SELECT count(*) AS trials, CAST(sum(passed::INT) AS BIGINT) AS n_passed FROM lg),
   us AS (SELECT feature, count(*) AS appearances, CAST(sum(passed::INT) AS BIGINT) AS usage FROM (SELECT unnest(f) AS feature, passed FROM lg) GROUP BY feature)
   SELECT feature, appearances, usage, trials, n_passed, trials >= 15 AND appearances > 0.5 * trials AS masked,
   usage <= greatest(1, floor(n_passed * 0.15)) AS novel FROM us, tot""")
def usage(spark, sf):
    ic = xs.rank_ic(long_panel(spark, sf), heavy=heavy(spark, sf)).filter("ic IS NOT NULL AND abs(ic) > 0.1")
    log = ic.groupBy("date").agg(F.collect_list("fid").alias("features"), (F.avg("ic") > 0).alias("passed"))
    return out(gates.feature_usage(log))


@C.add("multi_seed_summary", f"""WITH {LONG_SQL}, i AS (SELECT fid, date, ic FROM {rank_ic_sql('long')} WHERE ic IS NOT NULL),
   s AS (SELECT fid, year(date) % 4 AS seed, avg(ic) AS rank_ic, avg(ic) / stddev_samp(ic) AS icir FROM i GROUP BY ALL)
   SELECT fid, count(*) AS n_seeds, {R('avg(rank_ic)', 'rank_ic_mean')}, {R('stddev_samp(rank_ic)', 'rank_ic_std')}, {R('avg(icir)', 'icir_mean')},
   {R('stddev_samp(icir)', 'icir_std')} FROM s GROUP BY fid""")
def seeds(spark, sf):
    ic = xs.rank_ic(long_panel(spark, sf), heavy=heavy(spark, sf)).withColumn("seed", F.year("date") % 4)
    s = xs.ic_summary(ic, ("fid", "seed")).withColumnRenamed("ic_mean", "rank_ic")
    return out(gates.over_seeds(s, ["rank_ic", "icir"]))


@C.add("sample_guard", f"""WITH {LONG_SQL} SELECT fid, count(*) AS n, {R('avg(x)', 'mean_x', 4)} FROM long GROUP BY fid HAVING count(*) >= (SELECT count(*) * 0.95 FROM panel)""")
def guard(spark, sf):
    n = panel(spark, sf).count()
    d = gates.sample_guard(long_panel(spark, sf), min_rows=-(-n * 95 // 100))
    return out(d.filter("x IS NOT NULL").groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x")), 4)


@C.add("correlation_summary", f"""WITH {POOLED_SQL} SELECT {R('max(abs(rho))', 'max_abs_rho')}, {R('avg(abs(rho))', 'mean_abs_rho')},
   arg_max(f1, abs(rho)) AS f1, arg_max(f2, abs(rho)) AS f2 FROM pr""")
def corr_sum(spark, sf):
    return out(gates.correlation_summary(pool.pooled_spearman(panel(spark, sf), FACTORS)))


@C.add("factor_atom_block", f"""WITH {POOLED_SQL} SELECT CASE WHEN f1 IN ('ret_2d', 'vol_20d') THEN f1 ELSE f2 END AS factor,
   CASE WHEN f1 IN ('ret_2d', 'vol_20d') THEN f2 ELSE f1 END AS atom, {R('rho', 'rho')} FROM pr WHERE (f1 IN ('ret_2d', 'vol_20d')) <> (f2 IN ('ret_2d', 'vol_20d'))""")
def block(spark, sf):
    mined = ["ret_2d", "vol_20d"]
    pairs = pool.pooled_spearman(panel(spark, sf), FACTORS)
    return out(gates.cross_block(pairs, mined, [f for f in FACTORS if f not in mined]))


@C.add("two_part_report", f"""{GATE_SQL} SELECT fid, {R('t', 'fm_t', 5)}, reason, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS part FROM gt""")
def two_parts(spark, sf):
    return out(gates.two_part_report(gated(spark, sf), F.col("ok")).select("fid", F.round("fm_t", 5).alias("fm_t"), "reason", "part"))


# ---- backtests ------------------------------------------------------------------------
# line items of one supplier repeat weekly, so a month has about four trading days
def bt_sql(q: int = 5, limit: float = 0.10) -> str:
    """CTEs ending in rt (basket returns) and tn (turnover)."""
    return f"""
  pb AS (SELECT l.fid, l.date, l.symbol, l.x, l.ret, p.open, p.close, CAST(date_trunc('month', l.date) AS DATE) AS month
         FROM long l JOIN panel p USING (date, symbol)),
  pw AS (SELECT *, lag(close) OVER (PARTITION BY fid, symbol ORDER BY date) AS prev FROM pb),
  dy AS (SELECT DISTINCT fid, date, month FROM pw),
  cl AS (SELECT *, lead(date) OVER (PARTITION BY fid ORDER BY date) AS nxt FROM dy),
  fs AS (SELECT fid, month, min(date) AS d0, arg_min(nxt, date) AS entry_day, max(date) AS last_day FROM cl GROUP BY fid, month),
  sg AS (SELECT w.fid, w.month, w.symbol, f.entry_day, f.last_day, row_number() OVER (PARTITION BY w.fid, w.month ORDER BY x, w.symbol) AS rn,
         count(*) OVER (PARTITION BY w.fid, w.month) AS n FROM pw w JOIN fs f ON w.fid = f.fid AND w.date = f.d0),
  sq AS (SELECT *, greatest(1, ceil((rn - 1) * {q}.0 / (n - 1))) AS q FROM sg WHERE n >= 50 AND entry_day IS NOT NULL AND entry_day <= last_day),
  sf AS (SELECT s.*, w.open AS o, w.prev AS p FROM sq s LEFT JOIN pw w ON w.fid = s.fid AND w.date = s.entry_day AND w.symbol = s.symbol),
  mb AS (SELECT fid, month, entry_day, symbol, 'Q' || CAST(CAST(q AS INT) AS VARCHAR) AS basket FROM sf
         UNION ALL SELECT fid, month, entry_day, symbol, 'LONG' FROM sf WHERE q = {q} AND o < p * (1 + {limit})
         UNION ALL SELECT fid, month, entry_day, symbol, 'SHORT' FROM sf WHERE q = 1 AND o > p * (1 - {limit})),
  tm AS (SELECT fid, month, row_number() OVER (PARTITION BY fid ORDER BY month) AS seq FROM (SELECT fid, month FROM mb GROUP BY fid, month
         HAVING bool_or(basket = 'LONG') AND bool_or(basket = 'SHORT'))),
  mm AS (SELECT mb.*, seq FROM mb JOIN tm USING (fid, month)),
  tn AS (SELECT a.fid, a.month, a.seq, a.basket, 1 - count(b.symbol) / count(*) AS turnover FROM mm a LEFT JOIN mm b
         ON a.fid = b.fid AND a.basket = b.basket AND a.symbol = b.symbol AND b.seq = a.seq - 1
         WHERE a.basket IN ('LONG', 'SHORT') GROUP BY ALL),
  sz AS (SELECT fid, month, seq, basket, entry_day, count(*) AS n FROM mm GROUP BY ALL),
  hd AS (SELECT z.*, d.date FROM sz z JOIN dy d ON z.fid = d.fid AND z.month = d.month AND d.date >= z.entry_day),
  sm AS (SELECT m.fid, m.month, m.basket, w.date, sum(CASE WHEN w.date = m.entry_day THEN w.close / nullif(w.open, 0) - 1
         ELSE w.close / nullif(w.prev, 0) - 1 END) AS s FROM mm m JOIN pw w ON w.fid = m.fid AND w.month = m.month AND w.symbol = m.symbol
         AND w.date >= m.entry_day GROUP BY ALL),
  rt AS (SELECT h.fid, h.month, h.seq, h.basket, h.date, h.date = h.entry_day AS is_entry, coalesce(s, 0) / n AS r
         FROM hd h LEFT JOIN sm USING (fid, month, basket, date))"""


def legs_sql(costs) -> str:
    return f"""
  cs AS (SELECT CAST(unnest([{', '.join(str(float(c)) for c in costs)}]) AS DOUBLE) AS cost_bps),
  lg AS (SELECT cost_bps, r.fid, r.month, r.date, r.basket, r.r + CASE WHEN is_entry THEN (CASE WHEN r.basket = 'LONG' THEN -1 ELSE 1 END)
         * turnover * cost_bps / 10000 ELSE 0 END AS r FROM rt r JOIN tn USING (fid, month, basket), cs),
  dl AS (SELECT cost_bps, fid, month, date, max(r) FILTER (WHERE basket = 'LONG') AS long_r, max(r) FILTER (WHERE basket = 'SHORT') AS short_r
         FROM lg GROUP BY ALL),
  dd AS (SELECT *, long_r - short_r AS ls FROM dl),
  mr AS (SELECT cost_bps, fid, month, exp(sum(ln(greatest(1 + long_r, 1e-12)))) - 1 AS long_r,
         exp(sum(ln(greatest(1 + short_r, 1e-12)))) - 1 AS short_r FROM dd GROUP BY ALL)"""


def bt_close_sql() -> str:
    """The same run holding from the signal close on forward returns: no fills, no entry day."""
    s = bt_sql(limit=1e9)
    s = s.replace("arg_min(nxt, date) AS entry_day", "min(date) AS entry_day")
    s = s.replace("AND o < p * (1 + 1000000000.0)", "").replace("AND o > p * (1 - 1000000000.0)", "")
    return s.replace("""sum(CASE WHEN w.date = m.entry_day THEN w.close / nullif(w.open, 0) - 1
         ELSE w.close / nullif(w.prev, 0) - 1 END) AS s""", "sum(w.ret) AS s")


COSTS = (0.0, 30.0)


_runs: dict = {}


def run(spark, sf) -> backtest.Backtest:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _runs:
        _runs[key] = backtest.Backtest(panel(spark, sf), COSTS, heavy=heavy(spark, sf), factors=FACTORS)
    return _runs[key]


BT = f"WITH {LONG_SQL}, {bt_sql()}"


@C.add("backtest_baskets", f"{BT} SELECT fid, month, basket, symbol FROM mm")
def bt_members(spark, sf):
    return run(spark, sf).members.select("fid", "month", "basket", "symbol")


@C.add("backtest_turnover", f"{BT} SELECT fid, month, basket, seq, {R('turnover', 'turnover')} FROM tn")
def bt_turnover(spark, sf):
    return out(run(spark, sf).turnover.select("fid", "month", "basket", "seq", "turnover"))


@C.add("backtest_daily", f"{BT}, {legs_sql(COSTS)} SELECT cost_bps, fid, month, date, {R('long_r', 'long', 5)}, {R('short_r', 'short', 5)}, {R('ls', 'ls', 5)} FROM dd")
def bt_daily(spark, sf):
    return out(run(spark, sf).daily.drop("seq"), 5)


@C.add("backtest_monthly", f"{BT}, {legs_sql(COSTS)} SELECT cost_bps, fid, month, {R('long_r', 'long', 4)}, {R('short_r', 'short', 4)}, {R('long_r - short_r', 'ls', 4)} FROM mr")
def bt_monthly(spark, sf):
    return out(run(spark, sf).monthly(), 4)


@C.add("backtest_buckets", f"""{BT}, qm AS (SELECT fid, basket, month, exp(sum(ln(greatest(1 + r, 1e-12)))) - 1 AS m FROM rt WHERE basket LIKE 'Q%' GROUP BY ALL)
   SELECT fid, basket, {R('avg(m)', 'mean_month', 4)} FROM qm GROUP BY ALL""")
def bt_buckets(spark, sf):
    return out(run(spark, sf).buckets(), 4)


@C.add("backtest_summary", f"""{BT}, {legs_sql(COSTS)},
  nv AS (SELECT cost_bps, fid, date, ls, long_r, exp(sum(ln(greatest(1 + ls, 1e-12))) OVER w) AS nav, exp(sum(ln(greatest(1 + long_r, 1e-12))) OVER w) AS nl
         FROM dd WINDOW w AS (PARTITION BY cost_bps, fid ORDER BY date ROWS UNBOUNDED PRECEDING)),
  pk AS (SELECT *, nav / max(nav) OVER w - 1 AS d, nl / max(nl) OVER w - 1 AS dl FROM nv WINDOW w AS (PARTITION BY cost_bps, fid ORDER BY date ROWS UNBOUNDED PRECEDING)),
  a AS (SELECT cost_bps, fid, count(*) AS n_days, avg(ls) / (stddev_pop(ls) + 1e-8) * sqrt(252) AS ls_day_sharpe, min(d) AS ls_day_max_dd,
        avg(long_r) / (stddev_pop(long_r) + 1e-8) * sqrt(252) AS long_day_sharpe, min(dl) AS long_day_max_dd FROM pk GROUP BY ALL),
  b AS (SELECT cost_bps, fid, count(*) AS n_months, avg(long_r - short_r) / (stddev_pop(long_r - short_r) + 1e-8) * sqrt(12) AS ls_month_sharpe FROM mr GROUP BY ALL),
  t AS (SELECT fid, avg(turnover) FILTER (WHERE basket = 'LONG') AS turnover_long, avg(turnover) FILTER (WHERE basket = 'SHORT') AS turnover_short
        FROM tn WHERE seq > 1 GROUP BY fid)
  SELECT cost_bps, fid, n_months, n_days, {', '.join(R(c, c, 4) for c in ('ls_month_sharpe', 'ls_day_sharpe', 'ls_day_max_dd', 'long_day_sharpe',
  'long_day_max_dd', 'turnover_long', 'turnover_short'))} FROM a JOIN b USING (cost_bps, fid) JOIN t USING (fid)""")
def bt_summary(spark, sf):
    return out(run(spark, sf).summary().select("cost_bps", "fid", "n_months", "n_days", "ls_month_sharpe", "ls_day_sharpe", "ls_day_max_dd",
                                               "long_day_sharpe", "long_day_max_dd", "turnover_long", "turnover_short"), 4)


def _annual(c: str, n: str, per_year: int) -> str:
    """Growth a year in logs, which no spread is too large for."""
    return f"sum(ln(greatest(1 + {c}, 1e-12))) * {per_year}.0 / {n}"


@C.add("backtest_annualised", f"""{BT}, {legs_sql(COSTS)},
  a AS (SELECT cost_bps, fid, {_annual('ls', 'count(*)', 252)} AS d, {_annual('long_r', 'count(*)', 252)} AS l FROM dd GROUP BY ALL),
  mn AS (SELECT cost_bps, fid, {_annual('(long_r - short_r)', 'count(*)', 12)} AS m FROM mr GROUP BY ALL)
  SELECT cost_bps, fid, {R('m', 'ls_month_log_annual', 4)}, {R('d', 'ls_day_log_annual', 4)}, {R('l', 'long_day_log_annual', 4)} FROM a JOIN mn USING (cost_bps, fid)""")
def bt_annual(spark, sf):
    return out(run(spark, sf).summary().select("cost_bps", "fid", "ls_month_log_annual", "ls_day_log_annual", "long_day_log_annual"), 4)


@C.add("backtest_cost_drag", f"""{BT}, {legs_sql(COSTS)}, m AS (SELECT fid, cost_bps, avg(long_r - short_r) AS mean_ls FROM mr GROUP BY ALL)
   SELECT a.fid, a.cost_bps, {R('a.mean_ls', 'mean_ls', 4)}, {R('b.mean_ls', 'gross', 4)}, {R('(b.mean_ls - a.mean_ls) * 10000', 'drag_bps', 2)}
   FROM m a JOIN m b ON a.fid = b.fid AND b.cost_bps = 0""")
def bt_drag(spark, sf):
    d = backtest.cost_drag(run(spark, sf).monthly())
    return out(d.withColumns({"mean_ls": F.round("mean_ls", 4), "gross": F.round("gross", 4), "drag_bps": F.round("drag_bps", 2)}))


@C.add("backtest_close_execution", f"""WITH {LONG_SQL}, {bt_close_sql()}, {legs_sql((30.0,))},
  b AS (SELECT cost_bps, fid, count(*) AS n_months, avg(long_r - short_r) / (stddev_pop(long_r - short_r) + 1e-8) * sqrt(12) AS ls_month_sharpe FROM mr GROUP BY ALL),
  a AS (SELECT cost_bps, fid, count(*) AS n_days, avg(ls) / (stddev_pop(ls) + 1e-8) * sqrt(252) AS ls_day_sharpe FROM dd GROUP BY ALL)
  SELECT cost_bps, fid, n_months, n_days, {R('ls_month_sharpe', 'ls_month_sharpe', 4)}, {R('ls_day_sharpe', 'ls_day_sharpe', 4)} FROM a JOIN b USING (cost_bps, fid)""")
def bt_close(spark, sf):
    d = backtest.Backtest(panel(spark, sf), (30.0,), open_execution=False, heavy=heavy(spark, sf), factors=FACTORS).summary()
    return out(d.select("cost_bps", "fid", "n_months", "n_days", "ls_month_sharpe", "ls_day_sharpe"), 4)


@C.add("mined_against_singles", f"""{BT}, {legs_sql((30.0,))}, s AS (SELECT fid, avg(ls) / (stddev_pop(ls) + 1e-8) * sqrt(252) AS sharpe FROM dd GROUP BY fid),
   m AS (SELECT * FROM s WHERE fid IN ('body_ratio', 'ret_2d')), o AS (SELECT * FROM s WHERE fid NOT IN ('body_ratio', 'ret_2d'))
   SELECT fid, {R('sharpe', 'sharpe', 4)}, (SELECT count(*) FROM o WHERE o.sharpe > m.sharpe) + 1 AS rank FROM m""")
def mined_rank(spark, sf):
    s = write_out(run(spark, sf).summary().filter("cost_bps = 30").select("fid", F.col("ls_day_sharpe").alias("sharpe")), "sharpes")
    own = F.col("fid").isin("body_ratio", "ret_2d")
    return out(gates.rank_among(s.filter(own), s.filter(~own)), 4)


LSN = f"WITH {NEUTRAL_SQL}, {LS_SQL.format(src='neutral')}"


def ls_panel(spark, sf):
    return fx.stored(spark, ("ls", sf), lambda: neutral_spread(spark, sf))


@C.add("annualised_spreads", f"""{LSN} SELECT fid, count(ls) AS n_days, {R('CASE WHEN avg(ls) > -1 THEN 252 * ln(1 + avg(ls)) END', 'log_annual', 4)}, {R('avg(ls) / (stddev_samp(ls) / sqrt(count(ls)))', 't_mean', 5)},
   {R('CASE WHEN count(ls) >= 30 THEN avg(ls) / (stddev_samp(ls) + 1e-12) * sqrt(252) ELSE 0 END', 'sharpe', 5)} FROM ls GROUP BY fid""")
def ann(spark, sf):
    d = backtest.annualised_stats(ls_panel(spark, sf))
    return out(d.select("fid", "n_days", F.round("log_annual", 4).alias("log_annual"), "t_mean", "sharpe"), 5)


# Draws are sha-256 digests of (seed, stream, resample, counter); the twins put the days of every resample together one by one.
def _hex(h: str, start: int | str, digits: int) -> str:
    return f"CAST('0x' || substr({h}, {start} + 1, {digits}) AS BIGINT)"


# ---- combination ----------------------------------------------------------------------
MAX_RHO, PICKS = 0.3, 4  # lower than the protocol's 0.98 and 5, which drop none of the eight

COMBO_SQL = f"""
  zr AS (SELECT n.fid, date, symbol, l.ret, (n.x - avg(n.x) OVER p) / (stddev_pop(n.x) OVER p + 1e-12) AS z FROM neutral n JOIN long l USING (fid, date, symbol)
         WINDOW p AS (PARTITION BY n.fid, date)),
  al AS MATERIALIZED (SELECT fid, date, symbol, ret, z * CASE WHEN c < 0 THEN -1 ELSE 1 END AS x FROM zr JOIN (SELECT fid, corr(z, ret) AS c FROM zr GROUP BY fid) USING (fid)),
  zp AS MATERIALIZED (SELECT a.fid AS f1, b.fid AS f2, corr(a.x, b.x) AS rho FROM al a JOIN al b USING (date, symbol) WHERE a.fid < b.fid GROUP BY a.fid, b.fid),
  od AS MATERIALIZED (SELECT fid, row_number() OVER (ORDER BY abs(t) DESC, fid) AS i FROM fm),
  close_to AS MATERIALIZED (SELECT o.fid, list(CASE WHEN f1 = o.fid THEN f2 ELSE f1 END) FILTER (WHERE abs(rho) > {MAX_RHO}) AS near FROM od o
     JOIN zp ON f1 = o.fid OR f2 = o.fid GROUP BY o.fid),
  walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL
     SELECT o.i, CASE WHEN len(kept) < {PICKS} AND NOT coalesce(list_has_any(near, kept), false) THEN list_append(kept, o.fid) ELSE kept END
     FROM walk w JOIN od o ON o.i = w.i + 1 JOIN close_to c ON c.fid = o.fid),
  picked AS MATERIALIZED (SELECT unnest(kept) AS fid, unnest(range(1, len(kept) + 1)) AS pick FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)),
  cb AS (SELECT 'combo' AS fid, date, symbol, avg(x) AS x, any_value(ret) AS ret FROM al WHERE fid IN (SELECT fid FROM picked) GROUP BY date, symbol)"""
COMBO = f"WITH RECURSIVE {NEUTRAL_SQL}, {fm_sql('neutral')}, {COMBO_SQL}"


def aligned(spark, sf):
    return fx.stored(spark, ("aligned", sf), lambda: combine.aligned(xs.neutralise(long_panel(spark, sf), ["x"], ["ln_amt"])))


def aligned_wide(spark, sf):
    """The scores as one column per factor: they leave their dates as they came and are not put together again."""
    z = fx.stored(spark, ("scores", sf), lambda: daily.scores(sized_panel(spark, sf), FACTORS))
    return combine.aligned_wide(z, FACTORS)


def score_rho(spark, sf):
    if heavy(spark, sf):
        return fx.stored(spark, ("score_rho", sf), lambda: combine.score_pairs(aligned(spark, sf), FACTORS))
    return fx.stored(spark, ("score_rho", sf), lambda: pool.pair_table(aligned_wide(spark, sf), FACTORS))


def picked(spark, sf):
    return fx.stored(spark, ("picked", sf), lambda: pool.decorrelated_pick(stored_fm(spark, sf), score_rho(spark, sf), PICKS, max_rho=MAX_RHO))


@C.add("decorrelated_pick", f"{COMBO} SELECT fid, pick FROM picked")
def pick(spark, sf):
    return out(picked(spark, sf))


@C.add("score_pairs", f"{COMBO} SELECT least(f1, f2) AS f1, greatest(f1, f2) AS f2, {R('rho', 'rho')} FROM zp")
def rho_of_scores(spark, sf):
    d = score_rho(spark, sf)
    return out(d.select(F.least("f1", "f2").alias("f1"), F.greatest("f1", "f2").alias("f2"), "rho"))


@C.add("equal_weight_combo", f"{COMBO} SELECT date, symbol, {R('x', 'x', 4)} FROM cb")
def combo(spark, sf):
    if heavy(spark, sf):
        return out(combine.equal_weight(aligned(spark, sf), picked(spark, sf)).select("date", "symbol", "x"), 4)
    return out(combine.equal_weight_wide(aligned_wide(spark, sf), _picks(spark, sf), "x").select("date", "symbol", "x"), 4)


def _picks(spark, sf):
    return [r.fid for r in picked(spark, sf).orderBy("pick").collect()]  # at most PICKS names


def _spreads(spark, sf):
    """(fid, date, ls, n) of the picked factors and their combination."""
    def build():
        names = _picks(spark, sf)
        wide = combine.equal_weight_wide(aligned_wide(spark, sf), names)
        return daily.long_short(daily.sections(wide, [*names, "combo"]))
    return fx.stored(spark, ("spreads", sf), build)


def _combo_ls(spark, sf):
    if not heavy(spark, sf):
        return _spreads(spark, sf).filter("fid = 'combo'")
    return fx.stored(spark, ("combo_ls", sf), lambda: xs.long_short_by_count(combine.equal_weight(aligned(spark, sf), picked(spark, sf)), heavy=heavy(spark, sf)))


def _picked_ls(spark, sf):
    if not heavy(spark, sf):
        return _spreads(spark, sf).filter("fid <> 'combo'")

    def build():
        own = aligned(spark, sf).join(picked(spark, sf).select("fid"), "fid", "left_semi")
        return xs.long_short_by_count(own, heavy=heavy(spark, sf))
    return fx.stored(spark, ("picked_ls", sf), build)


COMBO_LS_SQL = f"""ps AS (SELECT * FROM al WHERE fid IN (SELECT fid FROM picked)),
  {LS_SQL.format(src='ps')}, {LS_SQL.format(src='cb').replace('rk AS', 'rk2 AS').replace('ls AS (', 'ls2 AS (').replace('FROM rk ', 'FROM rk2 ')},
  sd AS (SELECT fid, date_trunc('month', date) AS month, ls FROM ls UNION ALL SELECT 'combo', date_trunc('month', date), ls FROM ls2),
  cal AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS m, count(*) OVER () AS n FROM (SELECT DISTINCT month FROM sd WHERE fid = 'combo')),
  pk AS (SELECT DISTINCT b.range AS boot, ({_hex(f"sha256('42:month:' || b.range || ':' || k.m)", 0, 8)} * n) >> 32 AS m FROM range(2000) b, cal k),
  sh AS (SELECT boot, fid, CASE WHEN count(ls) >= 30 THEN avg(ls) / (stddev_samp(ls) + 1e-12) * sqrt(252) ELSE 0 END AS s
         FROM pk JOIN cal USING (m) JOIN sd USING (month) GROUP BY boot, fid),
  ga AS (SELECT boot, sum(s) FILTER (WHERE fid = 'combo') - sum(s) FILTER (WHERE fid <> 'combo') / (SELECT count(DISTINCT fid) FROM ls) AS g FROM sh GROUP BY boot),
  mb AS (SELECT avg(g) AS mean_gain, avg((g <= 0)::INT) AS p_le0, quantile_cont(g, 0.025) AS low, quantile_cont(g, 0.975) AS high, count(g) AS n_boot FROM ga)"""


@C.add("synergy", f"""{COMBO}, {COMBO_LS_SQL},
  a AS (SELECT avg(ls) / (stddev_samp(ls) + 1e-12) * sqrt(252) AS c FROM ls2),
  b AS (SELECT avg(s) AS m, count(*) AS k FROM (SELECT avg(ls) / (stddev_samp(ls) + 1e-12) * sqrt(252) AS s FROM ls GROUP BY fid)),
  nr AS (SELECT avg(abs(rho)) AS mean_rho, max(abs(rho)) AS max_rho FROM zp WHERE f1 IN (SELECT fid FROM picked) AND f2 IN (SELECT fid FROM picked))
  SELECT {R('c', 'combo_sharpe', 5)}, {R('m', 'mean_sharpe', 5)}, k AS n_factors, {R('c - m', 'gain', 5)}, {R('mean_rho', 'mean_abs_rho', 5)}, {R('max_rho', 'max_abs_rho', 5)},
  {R('mean_gain', 'mean_gain', 5)}, {R('p_le0', 'p_le0', 5)}, {R('low', 'low', 5)}, {R('high', 'high', 5)},
  CASE WHEN low > 0 THEN 'significant' WHEN p_le0 <= 0.1 THEN 'marginal' ELSE 'unsupported' END AS verdict FROM a, b, nr, mb""")
def synergy(spark, sf):
    return out(combine.synergy(_combo_ls(spark, sf), _picked_ls(spark, sf), score_rho(spark, sf)), 5)


def daily_ic(spark, sf):
    return fx.stored(spark, ("daily_ic", sf), lambda: neutral_ic(spark, sf))


IC_SQL = f"""ic AS (SELECT fid, date, ic, row_number() OVER (PARTITION BY fid ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY fid) AS n
   FROM {rank_ic_sql('neutral', min_rows=30)} WHERE ic IS NOT NULL)"""


@C.add("reality_check", f"""WITH {NEUTRAL_SQL}, {IC_SQL},
  st AS (SELECT fid, CASE WHEN count(ic) < 5 OR stddev_samp(ic) = 0 THEN 0 ELSE avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END AS t FROM ic GROUP BY fid),
  len AS (SELECT max(n) AS n FROM ic),
  dg AS (SELECT b.range AS boot, k.range AS k, n, sha256('42:block:' || b.range || ':' || k.range) AS h FROM range(10000) b, len, range(n) k),
  bl AS (SELECT boot, n, CAST(floor({_hex('h', 13, 13)} / 4503599627370496.0 * n) AS BIGINT) AS start,
         1 + CAST(floor(ln(1 - {_hex('h', 0, 13)} / 4503599627370496.0) / ln(0.9)) AS BIGINT) AS size, k FROM dg),
  fi AS (SELECT *, sum(size) OVER (PARTITION BY boot ORDER BY k) - size AS filled FROM bl),
  dy AS (SELECT boot, unnest(list_transform(range(least(size, n - filled)::BIGINT), lambda i: (start + i) % n)) AS pos FROM fi WHERE filled < n),
  ce AS (SELECT fid, pos, ic - avg(ic) OVER (PARTITION BY fid) AS c FROM ic WHERE n >= 5),
  bt AS (SELECT boot, fid, avg(c) / (stddev_samp(c) / sqrt(count(c))) AS t FROM dy JOIN ce USING (pos) GROUP BY boot, fid),
  mx AS (SELECT boot, max(t) AS t FROM bt GROUP BY boot)
  SELECT {R('(SELECT max(t) FROM st)', 'v')}, {R('avg((t >= (SELECT max(t) FROM st))::INT)', 'p_value')}, (SELECT count(*) FROM st) AS n_factors,
  (SELECT n FROM len) AS n_days, {R('avg(t)', 'boot_max_mean')}, {R('quantile_cont(t, 0.95)', 'boot_max_q95')}, {R('stddev_pop(t)', 'boot_max_std')} FROM mx""")
def reality(spark, sf):
    return out(combine.reality_check(daily_ic(spark, sf)))


@C.add("selection_interval", f"""WITH {NEUTRAL_SQL}, {IC_SQL}, sr AS (SELECT DISTINCT fid, n FROM ic WHERE n >= 5),
  dg AS (SELECT fid, n, b.range AS boot, k.range AS k, sha256('42:day:' || fid || ':' || b.range || ':' || k.range) AS h FROM sr, range(10000) b, range((n + 7) // 8) k),
  dy AS (SELECT fid, boot, ({_hex('h', '8 * j.range', 8)} * n) >> 32 AS pos FROM dg, range(8) j WHERE 8 * k + j.range < n),
  mn AS (SELECT boot, fid, avg(ic) AS m FROM dy JOIN ic USING (fid, pos) GROUP BY boot, fid),
  mx AS (SELECT max(m) AS m FROM mn GROUP BY boot),
  inf AS (SELECT quantile_cont(m, 0.95) - avg(m) AS i FROM mx),
  b AS (SELECT avg(ic) AS m, {combine.Z_975} * stddev_samp(ic) / sqrt(count(ic)) AS h FROM ic WHERE fid = 'rev_3d')
  SELECT {R('m', 'mean')}, {R('m - h', 'naive_low')}, {R('m + h', 'naive_high')}, {R('m - i', 'sel_low')}, {R('m + i', 'sel_high')}, {R('i', 'inflation')} FROM b, inf""")
def interval(spark, sf):
    return out(combine.selection_interval(daily_ic(spark, sf), "rev_3d"))


@C.add("month_bootstrap", f"""{COMBO}, {COMBO_LS_SQL}
  SELECT {R('mean_gain', 'mean_gain', 5)}, {R('p_le0', 'p_le0', 5)}, {R('low', 'low', 5)}, {R('high', 'high', 5)}, n_boot FROM mb""")
def months(spark, sf):
    return out(combine.month_bootstrap(_combo_ls(spark, sf), _picked_ls(spark, sf)), 5)


@C.add("gbt_importances")
def gbt(spark, sf):
    d = splits.with_split(panel(spark, sf).dropna(subset=FACTORS), splits.ratio_days(panel(spark, sf).select("date")))
    _, imp = models.gbt_baseline(d, FACTORS, label="ret", trees=10, depth=4)
    return out(imp, 4)


@C.add("gbt_test_metrics")
def gbt_fm(spark, sf):
    d = splits.with_split(panel(spark, sf).dropna(subset=FACTORS), splits.ratio_days(panel(spark, sf).select("date")))
    pred, _ = models.gbt_baseline(d, FACTORS, label="ret", trees=10, depth=4)
    long = pred.select(F.lit("gbt").alias("fid"), "date", "symbol", "x", "ret", xs.log_size(F.col("amount")).alias("ln_amt"))
    n = write_out(xs.neutralise(write_out(long, "gbt"), ["x", "ret"], ["ln_amt"]), "gbt_neutral")
    return fm_out(inference.fama_macbeth(n, heavy=heavy(spark, sf)))
