"""Cross-sectional operators, pool selection, splits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from quantloom.catalog.base import (BARS_SQL, FACTORS, LONG_SQL, NEUTRAL_SQL, PANEL_SQL, Catalog, R, at_least,
                                    avg_rank, fin, heavy, long_panel, neutral_ic, neutral_panel, neutral_spread, out, panel, rank_ic_sql,
                                    sized_panel)
from quantloom.operators import daily, pool, splits, xsection as xs
from quantloom.operators.layout import write_out
from quantloom.settings import Settings
from quantloom.sources import fixtures as fx

C = Catalog()
K = "PARTITION BY fid, date"


@C.add("zscore", f"""WITH {LONG_SQL} SELECT fid, date, symbol,
   {R(f'(x - avg(x) OVER ({K})) / (stddev_pop(x) OVER ({K}) + 1e-8)', 'z', 5)} FROM long""")
def zscore(spark, sf):
    d = long_panel(spark, sf).filter("x IS NOT NULL")
    return out(xs.zscore(d, ["x"], ("fid", "date")).select("fid", "date", "symbol", F.col("x").alias("z")), 5)


@C.add("zscore_null_flat", f"""WITH {BARS_SQL}, f AS (SELECT date, symbol, CASE WHEN month(date) = 3 THEN 1.0 ELSE turn END AS v FROM bars)
   SELECT date, symbol, {R('(v - avg(v) OVER d) / nullif(stddev_pop(v) OVER d, 0)', 'v', 5)} FROM f WINDOW d AS (PARTITION BY date)""")
def zflat(spark, sf):
    d = fx.plain_bars(spark, sf).select("date", "symbol", F.when(F.month("date") == 3, 1.0).otherwise(F.col("turn")).alias("v"))
    return out(xs.zscore(d, ["v"], null_flat=True), 5)


@C.add("percent_rank", f"""WITH {PANEL_SQL} SELECT date, symbol,
   {R(f"CASE WHEN vol_20d IS NOT NULL THEN {avg_rank('date, vol_20d IS NULL', 'vol_20d')} / count(vol_20d) OVER (PARTITION BY date) END", 'rank_vol_20d')},
   {R(f"{avg_rank('date', 'body_ratio')} / count(*) OVER (PARTITION BY date)", 'rank_body_ratio')} FROM panel""")
def pct(spark, sf):
    return out(xs.percent_rank(panel(spark, sf).select("date", "symbol", "vol_20d", "body_ratio"),
                               ["vol_20d", "body_ratio"], heavy=heavy(spark, sf)).drop("vol_20d", "body_ratio"))


MAD_SQL = """
  md AS (SELECT fid, date, quantile_cont(x, 0.5) AS m FROM long GROUP BY fid, date),
  dv AS (SELECT fid, date, quantile_cont(abs(x - m), 0.5) AS d FROM long JOIN md USING (fid, date) GROUP BY fid, date)"""


@C.add("winsorize_mad", f"""WITH {LONG_SQL}, {MAD_SQL} SELECT fid, date, symbol,
   {R('least(greatest(x, m - 5 * 1.4826 * d), m + 5 * 1.4826 * d)', 'x')}
   FROM long JOIN md USING (fid, date) JOIN dv USING (fid, date)""")
def mad(spark, sf):
    d = long_panel(spark, sf).filter("x IS NOT NULL")
    return out(xs.winsorize_mad(d, ["fid", "date"], "x", 5.0, heavy(spark, sf)).select("fid", "date", "symbol", "x"))


@C.add("winsorize_mad_series", f"""WITH {LONG_SQL},
  md AS (SELECT fid, quantile_cont(x, 0.5) AS m FROM long GROUP BY fid),
  dv AS (SELECT fid, quantile_cont(abs(x - m), 0.5) AS d FROM long JOIN md USING (fid) GROUP BY fid)
  SELECT fid, count(*) AS n, {R('avg(least(greatest(x, m - 5 * 1.4826 * d), m + 5 * 1.4826 * d))', 'mean_clipped')},
  {R('max(m)', 'median')}, {R('max(d)', 'mad')} FROM long JOIN md USING (fid) JOIN dv USING (fid) GROUP BY fid""")
def mad_whole(spark, sf):
    # one group holds every row of a factor: always the split path
    tight = Settings(heavy_group_rows=20_000)
    d = long_panel(spark, sf).filter("x IS NOT NULL").select("fid", "x")
    b = write_out(xs.mad_bounds(d, ["fid"], "x", 5.0, None, tight), "bounds")
    j = d.join(b, "fid")
    return out(j.groupBy("fid").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.least(F.greatest("x", "lo"), "hi")).alias("mean_clipped"), F.max("median").alias("median"),
        F.max((F.col("hi") - F.col("median")) / (5 * xs.MAD_SCALE)).alias("mad")))


@C.add("neutralise_size", f"""WITH {NEUTRAL_SQL} SELECT fid, date, symbol, {R('x', 'x', 5)}, {R('ret', 'ret', 5)} FROM neutral""")
def fwl(spark, sf):
    return out(neutral_panel(spark, sf).select("fid", "date", "symbol", "x", "ret"), 5)


TWO_SQL = LONG_SQL + """, t AS (SELECT l.*, p.turn FROM long l JOIN (SELECT date, symbol, turn FROM panel) p USING (date, symbol)),
  m AS (SELECT fid, date, count(*) AS n, avg(x) AS mx, avg(ln_amt) AS m1, avg(turn) AS m2, var_pop(ln_amt) AS a,
    var_pop(turn) AS b, covar_pop(ln_amt, turn) AS c, covar_pop(x, ln_amt) AS p, covar_pop(x, turn) AS q FROM t GROUP BY fid, date)"""


@C.add("neutralise_size_turn", f"""WITH {TWO_SQL} SELECT fid, date, symbol,
   {R('CASE WHEN n >= 30 THEN x - mx - (p * b - q * c) / (a * b - c * c) * (ln_amt - m1) - (q * a - p * c) / (a * b - c * c) * (turn - m2) ELSE x END', 'x', 4)}
   FROM t JOIN m USING (fid, date)""")
def fwl2(spark, sf):
    p = panel(spark, sf).withColumn("ln_amt", xs.log_size(F.col("amount")))
    d = xs.melt(p, FACTORS, ["date", "symbol", "ln_amt", "turn"])
    return out(xs.neutralise(d, ["x"], ["ln_amt", "turn"]).select("fid", "date", "symbol", "x"), 4)


@C.add("rank_ic_daily", f"WITH {LONG_SQL} SELECT fid, date, n, {R('ic', 'ic')} FROM {rank_ic_sql('long')}")
def ric(spark, sf):
    return out(xs.rank_ic(long_panel(spark, sf), heavy=heavy(spark, sf)))


@C.add("ic_summary", f"""WITH {NEUTRAL_SQL} SELECT fid, {R('avg(ic)', 'ic_mean')}, {R('avg(ic) / stddev_samp(ic)', 'icir')},
   count(ic) AS n_days FROM {rank_ic_sql('neutral')} WHERE ic IS NOT NULL GROUP BY fid""")
def ics(spark, sf):
    return out(xs.ic_summary(neutral_ic(spark, sf, 31)).select(
        "fid", "ic_mean", "icir", "n_days"))


@C.add("icir_fitness", f"""WITH {LONG_SQL}, d AS (SELECT fid, date, {fin('corr(rx, ry)')} AS ic FROM (
   SELECT fid, date, row_number() OVER ({K} ORDER BY x, symbol) AS rx, row_number() OVER ({K} ORDER BY ret, symbol) AS ry
   FROM long) GROUP BY fid, date HAVING count(*) >= 30)
   SELECT fid, {R('CASE WHEN count(ic) >= 10 THEN avg(ic) / stddev_samp(ic) ELSE -1 END', 'fitness')} FROM d GROUP BY fid""")
def fitness(spark, sf):
    ic = xs.ordinal_ic(long_panel(spark, sf), min_rows=30, heavy=heavy(spark, sf))
    s = xs.ic_summary(ic)
    return out(s.select("fid", F.when(F.col("n_days") >= 10, F.col("icir")).otherwise(-1.0).alias("fitness")))


QCUT_SQL = f"""
  eg AS (SELECT fid, date, min(x) AS lo, list_distinct(list_transform(quantile_cont(x, [0.2, 0.4, 0.6, 0.8]), lambda v: v + 0.0)) AS e FROM long GROUP BY fid, date),
  bk AS (SELECT fid, date, symbol, ret, x, CAST(len(list_filter(e, lambda v: v > lo AND v < x)) AS BIGINT) AS bucket
         FROM long JOIN eg USING (fid, date))"""


@C.add("quantile_buckets", f"WITH {LONG_SQL}, {QCUT_SQL} SELECT fid, date, symbol, bucket FROM bk")
def qcut(spark, sf):
    d = long_panel(spark, sf).select("fid", "date", "symbol", "x")
    return out(xs.quantile_bucket(d, heavy=heavy(spark, sf)).drop("x"))


@C.add("position_buckets", f"""WITH {LONG_SQL} SELECT fid, date, symbol,
   CAST(greatest(1, ceil((rn - 1) * 5.0 / nullif(n - 1, 0))) AS BIGINT) AS bucket FROM (SELECT fid, date, symbol,
   row_number() OVER ({K} ORDER BY x, symbol) AS rn, count(*) OVER ({K}) AS n FROM long)""")
def pcut(spark, sf):
    d = long_panel(spark, sf).select("fid", "date", "symbol", "x")
    return out(xs.position_bucket(d, heavy=heavy(spark, sf)).drop("x"))


@C.add("bucket_returns", f"""WITH {LONG_SQL}, {QCUT_SQL} SELECT fid, bucket, {R('avg(ret)', 'mean_ret')}, count(ret) AS n
   FROM bk GROUP BY fid, bucket""")
def bret(spark, sf):
    return out(xs.bucket_returns(xs.quantile_bucket(long_panel(spark, sf), heavy=heavy(spark, sf))))


@C.add("bucket_spread", f"""WITH {LONG_SQL}, {QCUT_SQL}, br AS (SELECT fid, bucket, avg(ret) AS m FROM bk GROUP BY fid, bucket)
   SELECT fid, {R('arg_max(m, bucket) - arg_min(m, bucket)', 'ls_spread')}, count(*) AS n_buckets FROM br GROUP BY fid""")
def bspread(spark, sf):
    b = xs.bucket_returns(xs.quantile_bucket(long_panel(spark, sf), heavy=heavy(spark, sf)))
    return out(xs.bucket_spread(b))


LS_SQL = """
  rk AS (SELECT fid, date, ret, row_number() OVER (PARTITION BY fid, date ORDER BY x, symbol) AS rn,
         count(*) OVER (PARTITION BY fid, date) AS n FROM {src}),
  ls AS (SELECT fid, date, avg(ret) FILTER (WHERE rn > n - greatest(floor(n * 0.2), 1))
         - avg(ret) FILTER (WHERE rn <= greatest(floor(n * 0.2), 1)) AS ls, max(n) AS n FROM rk WHERE n >= 30 GROUP BY fid, date)"""


@C.add("long_short_by_count", f"WITH {NEUTRAL_SQL}, {LS_SQL.format(src='neutral')} SELECT fid, date, {R('ls', 'ls')}, n FROM ls")
def lsc(spark, sf):
    return out(neutral_spread(spark, sf))


@C.add("long_short_by_quantile", f"""WITH {LONG_SQL},
  q AS (SELECT fid, date, quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.8) AS b FROM long GROUP BY fid, date),
  d AS (SELECT fid, date, avg(ret) FILTER (WHERE x >= b) - avg(ret) FILTER (WHERE x <= a) AS ls
        FROM long JOIN q USING (fid, date) GROUP BY fid, date HAVING count(*) >= 30)
  SELECT fid, {R('avg(ls)', 'ls_mean')}, {R('stddev_samp(ls) / sqrt(count(ls))', 'ls_se')}, count(ls) AS n_days FROM d GROUP BY fid""")
def lsq(spark, sf):
    return out(xs.long_short_summary(xs.long_short_by_quantile(long_panel(spark, sf), heavy=heavy(spark, sf))))


STATE_SQL = """
  dd AS (SELECT date, quantile_cont(vol_20d, 0.5) FILTER (WHERE vol_20d IS NOT NULL) AS v, avg(ret_20d) AS t,
         stddev_samp(ret_20d) AS s FROM panel GROUP BY date HAVING count(vol_20d) > 0),
  cc AS (SELECT quantile_cont(v, 0.5) AS cv, quantile_cont(s, 0.5) AS cs FROM dd),
  ss AS (SELECT date, v, t, s, CASE WHEN v >= cv THEN 'high_vol' ELSE 'low_vol' END AS vol_state,
         CASE WHEN t >= 0 THEN 'up_trend' ELSE 'down_trend' END AS trend_state,
         CASE WHEN s >= cs THEN 'high_disp' ELSE 'low_disp' END AS disp_state FROM dd, cc)"""


@C.add("market_states", f"""WITH {PANEL_SQL}, {STATE_SQL} SELECT date, {R('v', 'vol_level')}, {R('t', 'trend')},
   {R('s', 'dispersion')}, vol_state, trend_state, disp_state FROM ss""")
def states(spark, sf):
    return out(xs.market_state(panel(spark, sf), heavy=heavy(spark, sf)))


STATE_IC_SQL = f"""
  ic AS (SELECT * FROM {rank_ic_sql('long', min_rows=30)}),
  st AS (SELECT date, 'vol_state' AS dimension, vol_state AS state FROM ss UNION ALL SELECT date, 'trend_state', trend_state FROM ss
         UNION ALL SELECT date, 'disp_state', disp_state FROM ss),
  per AS (SELECT dimension, state, fid, avg(ic) AS ic_mean, count(ic) AS n_days, avg(ic) / stddev_samp(ic) AS icir
          FROM ic JOIN st USING (date) WHERE ic IS NOT NULL GROUP BY dimension, state, fid)"""


def _state_ic(spark, sf):
    ic = xs.rank_ic(long_panel(spark, sf), min_rows=30, heavy=heavy(spark, sf))
    s = xs.market_state(panel(spark, sf), heavy=heavy(spark, sf))
    return xs.ic_summary(xs.by_state(ic, s), ("dimension", "state", "fid"))


@C.add("state_ic", f"""WITH {LONG_SQL}, {STATE_SQL}, {STATE_IC_SQL} SELECT dimension, state, fid,
   {R('ic_mean', 'ic_mean')}, {R('icir', 'icir')}, n_days FROM per""")
def state_ic(spark, sf):
    return out(_state_ic(spark, sf).select("dimension", "state", "fid", "ic_mean", "icir", "n_days"))


@C.add("state_extremes", f"""WITH {LONG_SQL}, {STATE_SQL}, {STATE_IC_SQL} SELECT fid,
   arg_max(dimension || ':' || state, icir) AS best_state, {R('max(icir)', 'best')},
   arg_min(dimension || ':' || state, icir) AS worst_state, {R('min(icir)', 'worst')} FROM per GROUP BY fid""")
def state_ext(spark, sf):
    return out(xs.state_extremes(_state_ic(spark, sf)))


@C.add("best_factor_per_state", f"""WITH {LONG_SQL}, {STATE_SQL}, {STATE_IC_SQL} SELECT dimension, state,
   arg_max(fid, icir) AS best_fid, {R('max(icir)', 'best')} FROM per GROUP BY dimension, state""")
def state_best(spark, sf):
    return out(xs.best_per_state(_state_ic(spark, sf)))


@C.add("state_long_short", f"""WITH {LONG_SQL}, {STATE_SQL},
  q AS (SELECT fid, date, quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.8) AS b FROM long GROUP BY fid, date),
  d AS (SELECT fid, date, avg(ret) FILTER (WHERE x >= b) - avg(ret) FILTER (WHERE x <= a) AS ls
        FROM long JOIN q USING (fid, date) GROUP BY fid, date HAVING count(*) >= 30),
  st AS (SELECT date, 'vol_state' AS dimension, vol_state AS state FROM ss UNION ALL SELECT date, 'trend_state', trend_state FROM ss
         UNION ALL SELECT date, 'disp_state', disp_state FROM ss)
  SELECT dimension, state, fid, {R('avg(ls)', 'ls_mean')}, {R('stddev_samp(ls) / sqrt(count(ls))', 'ls_se')}, count(ls) AS n_days
  FROM d JOIN st USING (date) GROUP BY dimension, state, fid""")
def state_ls(spark, sf):
    ls = xs.long_short_by_quantile(long_panel(spark, sf), heavy=heavy(spark, sf))
    s = xs.market_state(panel(spark, sf), heavy=heavy(spark, sf))
    return out(xs.long_short_summary(xs.by_state(ls, s), ("dimension", "state", "fid")))


@C.add("illiquidity_index", f"""WITH {BARS_SQL} SELECT date, {R('avg(abs(ret) / nullif(ln(greatest(volume, 1)), 0))', 'illiq')},
   count(abs(ret) / nullif(ln(greatest(volume, 1)), 0)) AS n FROM bars GROUP BY date
   HAVING count(abs(ret) / nullif(ln(greatest(volume, 1)), 0)) >= 30""")
def illiq(spark, sf):
    return out(xs.illiquidity_index(fx.plain_bars(spark, sf)))


# ---- pool selection -------------------------------------------------------------------
@C.add("quality_gate", f"WITH {PANEL_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'avg(({c} IS NULL)::INT)', 'null_share')}, {R(f'var_pop({c})', 'variance', 4)},"
    f" avg(({c} IS NULL)::INT) <= 0.05 AND var_pop({c}) >= 1e-6 AS keep FROM panel" for c in FACTORS))
def gate(spark, sf):
    q = pool.quality_gate(panel(spark, sf), FACTORS, max_null=0.05)
    return q.select("feature", (F.round("null_share", 6) + F.lit(0.0)).alias("null_share"),
                    (F.round("variance", 4) + F.lit(0.0)).alias("variance"), "keep")


def pair_rho_sql(a: str, b: str, by: str = "", src: str = "panel") -> str:
    """Rank correlation of two columns over the rows where both exist, ranked among those rows."""
    k = by or "1"
    return (f"(SELECT {f'{by}, ' if by else ''}{fin('corr(ra, rb)')} AS rho FROM (SELECT {f'{by}, ' if by else ''}{avg_rank(k, a)} AS ra, {avg_rank(k, b)} AS rb FROM {src}"
            f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL){f' GROUP BY {by}' if by else ''})")


POOLED_SQL = PANEL_SQL + f""",
  pr AS MATERIALIZED ({' UNION ALL '.join(f"SELECT '{a}' AS f1, '{b}' AS f2, rho FROM {pair_rho_sql(a, b)}" for a, b in combinations(FACTORS, 2))})"""


@C.add("pooled_spearman", f"WITH {POOLED_SQL} SELECT f1, f2, {R('rho', 'rho')} FROM pr")
def pooled(spark, sf):
    return out(pool.pooled_spearman(panel(spark, sf), FACTORS))


@C.add("pooled_spearman_split_ranks", f"WITH {POOLED_SQL} SELECT f1, f2, {R('rho', 'rho')} FROM pr")
def pooled_split(spark, sf):
    return out(pool.pooled_spearman(panel(spark, sf), FACTORS, settings=Settings(heavy_group_rows=5_000)))


@C.add("daily_mean_spearman", f"""WITH {PANEL_SQL}, full_days AS (SELECT * FROM panel WHERE date IN (SELECT date FROM panel GROUP BY date HAVING count(*) >= 30)) """
       + " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, {R('avg(rho)', 'rho')} FROM {pair_rho_sql(a, b, 'date', 'full_days')}"
                            for a, b in combinations(FACTORS, 2)))
def daily_rho(spark, sf):
    return out(pool.daily_mean_spearman(panel(spark, sf), FACTORS, heavy=heavy(spark, sf)))


SCORE_SQL = f"""
  sc AS (SELECT feature, coalesce(ic, 0) AS ic FROM (SELECT DISTINCT fid AS feature FROM long) LEFT JOIN
         (SELECT fid AS feature, ic FROM {rank_ic_sql('long', 'fid', 2)}) USING (feature))"""


def _with_return(spark, sf):
    """Rank correlations of the factors and the return, from one ranking of all of them."""
    return fx.stored(spark, ("pooled_rho", sf), lambda: pool.pooled_spearman(panel(spark, sf), [*FACTORS, "ret"]))


def _scores(spark, sf):
    return pool.scores_among(_with_return(spark, sf))


def _pooled_rho(spark, sf):
    return _with_return(spark, sf).filter("f2 <> 'ret'")


@C.add("near_duplicates", f"""WITH RECURSIVE {POOLED_SQL}, long AS (UNPIVOT (SELECT date, symbol, ret, {', '.join(FACTORS)} FROM panel)
   ON {', '.join(FACTORS)} INTO NAME fid VALUE x), {SCORE_SQL},
  e AS (SELECT f1 AS a, f2 AS b FROM pr WHERE rho > 0.3 UNION SELECT f2, f1 FROM pr WHERE rho > 0.3),
  walk AS (SELECT feature, feature AS seen FROM sc UNION SELECT w.feature, e.b FROM walk w JOIN e ON e.a = w.seen),
  g AS (SELECT feature, min(seen) AS grp FROM walk GROUP BY feature)
  SELECT feature, grp, {R('ic', 'ic')}, row_number() OVER (PARTITION BY grp ORDER BY abs(ic) DESC, feature) = 1 AS keep
  FROM g JOIN sc USING (feature)""")
def near(spark, sf):
    d = pool.near_duplicates(_pooled_rho(spark, sf), _scores(spark, sf), threshold=0.3)
    return out(d.select("feature", "grp", "ic", "keep"))


# The twin merges one pair of clusters at a time, the closest by their farthest members, and cuts at the height of the last merge needed.
@C.add("cluster_pick", f"""WITH RECURSIVE {POOLED_SQL}, long AS (UNPIVOT (SELECT date, symbol, ret, {', '.join(FACTORS)} FROM panel)
   ON {', '.join(FACTORS)} INTO NAME fid VALUE x), {SCORE_SQL},
  far AS MATERIALIZED (SELECT f1 AS a, f2 AS b, 1 - abs(coalesce(rho, 0)) AS d FROM pr UNION ALL SELECT f2, f1, 1 - abs(coalesce(rho, 0)) FROM pr),
  walk AS (SELECT 0 AS i, list(feature ORDER BY feature) AS feats, list(feature ORDER BY feature) AS labs, CAST(-1 AS DOUBLE) AS height FROM sc
    UNION ALL
    SELECT i + 1, feats, list_transform(labs, lambda l: CASE WHEN l = m.b THEN m.a ELSE l END), m.h FROM (
      SELECT w.i, w.feats, w.labs, (SELECT min(struct_pack(h := h, a := a, b := b)) FROM (
        SELECT labs[x.range] AS a, labs[y.range] AS b, max(f.d) AS h FROM range(1, {len(FACTORS) + 1}) x, range(1, {len(FACTORS) + 1}) y, far f
        WHERE f.a = feats[x.range] AND f.b = feats[y.range] AND labs[x.range] < labs[y.range] GROUP BY 1, 2)) AS m FROM walk w) WHERE m IS NOT NULL),
  cut AS (SELECT max(height) AS h FROM walk WHERE i <= {len(FACTORS)} - 4),
  lab AS (SELECT unnest(feats) AS feature, unnest(labs) AS cluster FROM (SELECT * FROM walk, cut WHERE height <= h ORDER BY i DESC LIMIT 1))
  SELECT feature, cluster, {R('ic', 'ic')}, row_number() OVER (PARTITION BY cluster ORDER BY abs(ic) DESC, feature) = 1 AS keep FROM lab JOIN sc USING (feature)""")
def clusters(spark, sf):
    return out(pool.cluster_pick(_pooled_rho(spark, sf), _scores(spark, sf), target=4).select("feature", "cluster", "ic", "keep"))


@C.add("univariate_screen", f"""WITH {LONG_SQL}, s AS (SELECT fid, avg(ic) AS m, count(ic) AS n_days, avg(ic) / stddev_samp(ic) AS icir
   FROM {rank_ic_sql('long', min_rows=30)} WHERE ic IS NOT NULL GROUP BY fid)
   SELECT fid, {R('m', 'ic_mean')}, n_days, {R('icir', 'icir')} FROM s ORDER BY abs(m) DESC, fid LIMIT 5""")
def screen(spark, sf):
    return out(pool.univariate_screen(long_panel(spark, sf), 5, heavy=heavy(spark, sf)))


@C.add("icir_screen", f"""WITH {LONG_SQL},
  m AS (SELECT fid, date, count(*) AS n, avg(x) AS mx, avg(ln_amt) AS mz, covar_pop(x, ln_amt) / nullif(var_pop(ln_amt), 0) AS b FROM long GROUP BY fid, date),
  nx AS (SELECT fid, date, ret, CASE WHEN n >= 30 THEN x - mx - coalesce(b, 0) * (ln_amt - mz) ELSE x END AS x FROM long JOIN m USING (fid, date)),
  r AS (SELECT fid, avg(ic) / (stddev_pop(ic) + 1e-8) AS raw_icir FROM {rank_ic_sql('long', min_rows=21)} WHERE ic IS NOT NULL GROUP BY fid),
  t AS (SELECT fid, avg(ic) / (stddev_pop(ic) + 1e-8) AS neutral_icir FROM {rank_ic_sql('nx', min_rows=30)} WHERE ic IS NOT NULL GROUP BY fid)
  SELECT fid, {R('raw_icir', 'raw_icir', 5)}, {R('coalesce(neutral_icir, 0)', 'neutral_icir', 5)}, coalesce(neutral_icir, 0) > 0.15 AS passed
  FROM r LEFT JOIN t USING (fid)""")
def screener(spark, sf):
    return out(pool.icir_screen(long_panel(spark, sf), heavy=heavy(spark, sf)), 5)


@C.add("feature_metadata", f"""WITH {LONG_SQL},
  pl AS (SELECT fid, ic * 10 AS ic10 FROM {rank_ic_sql('long', 'fid', 2)}),
  dl AS (SELECT fid, avg(ic) / (stddev_samp(ic) + 1e-8) AS icir FROM {rank_ic_sql('long', min_rows=30)} WHERE ic IS NOT NULL GROUP BY fid),
  sz AS (SELECT fid, tanh(avg(abs(x))) AS level FROM long GROUP BY fid),
  pc AS ({' UNION ALL '.join(f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS rho FROM panel" for a, b in combinations(FACTORS, 2))}),
  og AS (SELECT fid, 1 - avg(abs(rho)) AS orthogonality FROM (SELECT f1 AS fid, rho FROM pc UNION ALL SELECT f2, rho FROM pc) GROUP BY fid),
  al AS (SELECT * FROM pl JOIN dl USING (fid) JOIN sz USING (fid) JOIN og USING (fid))
  SELECT fid, {', '.join(R(f'({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () < 1e-8 THEN 1 ELSE stddev_pop({c}) OVER () END)', c, 4)
                         for c in ('ic10', 'icir', 'level', 'orthogonality'))}, 0.0 AS constant FROM al""".replace("0.0 AS constant", "CAST(0 AS DOUBLE) AS constant"))
def metadata(spark, sf):
    pairs = pool.pair_table(panel(spark, sf).select(*FACTORS), FACTORS)
    pooled = _scores(spark, sf).withColumnRenamed("feature", "fid")
    ics = None if heavy(spark, sf) else daily.ics(daily.sections(sized_panel(spark, sf), FACTORS), 30)
    return out(pool.feature_metadata(long_panel(spark, sf), pairs, heavy=None, pooled=pooled, ics=ics), 4)


# ---- splits ---------------------------------------------------------------------------
DAYS_SQL = PANEL_SQL + """, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n,
  min(date) OVER () AS d0 FROM (SELECT DISTINCT date FROM panel))"""


def _days(spark, sf):
    return panel(spark, sf).select("date")


@C.add("split_ratio", f"""WITH {DAYS_SQL} SELECT date, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.8) THEN 'val'
   ELSE 'test' END AS split FROM days""")
def sratio(spark, sf):
    return splits.ratio_days(_days(spark, sf))


MONTHS_SQL = DAYS_SQL + """, an AS (SELECT date, CASE WHEN month(d0) = 7 AND day(d0) <= 10 THEN make_date(year(d0), 6, 30) ELSE d0 END AS a FROM days)"""


@C.add("split_month", f"""WITH {MONTHS_SQL} SELECT date, CASE WHEN date <= a + INTERVAL 36 MONTH THEN 'train' WHEN date <= a + INTERVAL 48 MONTH
   THEN 'val' WHEN date <= a + INTERVAL 60 MONTH THEN 'test' END AS split FROM an""")
def smonth(spark, sf):
    return splits.month_days(_days(spark, sf))


@C.add("split_july", f"""WITH {DAYS_SQL}, o AS (SELECT date, year(date) * 12 + month(date) - 1
   - ((year(d0) + CASE WHEN month(d0) > 7 THEN 1 ELSE 0 END) * 12 + 6) AS m FROM days)
   SELECT date, CASE WHEN m < 0 THEN NULL WHEN m < 36 THEN 'train' WHEN m < 48 THEN 'val' WHEN m < 60 THEN 'test' END AS split FROM o""")
def sjuly(spark, sf):
    return splits.july_days(_days(spark, sf))


@C.add("split_warmup", f"""WITH {MONTHS_SQL}, w AS (SELECT date, CAST(a + INTERVAL 12 MONTH AS DATE) AS s FROM an)
   SELECT date, CASE WHEN date < s THEN 'warmup' WHEN date <= s + INTERVAL 36 MONTH THEN 'train'
   WHEN date <= s + INTERVAL 48 MONTH THEN 'val' WHEN date <= s + INTERVAL 60 MONTH THEN 'test' END AS split FROM w""")
def swarm(spark, sf):
    return splits.warmup_days(_days(spark, sf))


WF_SQL = DAYS_SQL + """,
  mo AS (SELECT date, year(date) * 12 + month(date) - (year(d0) * 12 + month(d0)) AS m FROM days),
  wn AS (SELECT w."window", date, m - 12 * w."window" AS o FROM mo, (SELECT unnest(range(0, 10)) AS "window") w),
  sp AS (SELECT "window", date, CASE WHEN o < 36 THEN 'train' WHEN o < 48 THEN 'val' ELSE 'test' END AS split FROM wn
         WHERE o >= 0 AND o < 60),
  rn AS (SELECT *, row_number() OVER (PARTITION BY "window", split ORDER BY date) AS i,
         row_number() OVER (PARTITION BY "window", split ORDER BY date DESC) AS j,
         count(*) OVER (PARTITION BY "window", split) AS n FROM sp),
  kp AS (SELECT "window", date, split FROM rn WHERE NOT ((split = 'train' AND j <= 1)
         OR (split = 'val' AND ((n >= 2 AND i <= 2) OR (n >= 3 AND j <= 1))) OR (split = 'test' AND n >= 2 AND i <= 2))),
  tc AS (SELECT "window", count(*) FILTER (WHERE split = 'test') AS t FROM kp GROUP BY "window"),
  wf AS (SELECT * FROM kp WHERE "window" < coalesce((SELECT min("window") FROM tc WHERE t < 30), 1000))"""


def _windows(spark, sf):
    return splits.walk_forward(_days(spark, sf), train=36, val=12, test=12)


@C.add("walk_forward", f'WITH {WF_SQL} SELECT CAST("window" AS BIGINT) AS "window", date, split FROM wf')
def wf(spark, sf):
    return out(_windows(spark, sf))


@C.add("window_listing", f'''WITH {WF_SQL} SELECT CAST("window" AS BIGINT) AS "window", split, min(date) AS first_day, max(date) AS last_day,
   count(*) AS n_days FROM wf GROUP BY "window", split''')
def wlist(spark, sf):
    return out(splits.list_windows(_windows(spark, sf)))


STDF = ["vol_20d", "body_ratio", "illiq_spread"]


@C.add("standardise_train", f"""WITH {DAYS_SQL}, sp AS (SELECT date, CASE WHEN i <= floor(n * 0.6) THEN 'train' WHEN i <= floor(n * 0.8) THEN 'val'
   ELSE 'test' END AS split FROM days), p AS (SELECT * FROM panel JOIN sp USING (date)),
  t AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in STDF)}, quantile_cont(ret, 0.01) AS lo,
        quantile_cont(ret, 0.99) AS hi FROM p WHERE split = 'train')
  SELECT date, symbol, split, {R('least(greatest(ret, lo), hi)', 'ret')},
  {', '.join(R(f'({c} - m_{c}) / (CASE WHEN s_{c} < 1e-8 THEN 1 ELSE s_{c} END)', c, 5) for c in STDF)} FROM p, t""")
def standard(spark, sf):
    d = splits.with_split(panel(spark, sf).select("date", "symbol", "ret", *STDF), splits.ratio_days(_days(spark, sf)))
    s = splits.standardise(d, STDF, "ret")
    return s.select("date", "symbol", "split", (F.round("ret", 6) + F.lit(0.0)).alias("ret"),
                    *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in STDF])


@C.add("sub_periods", f"""WITH {DAYS_SQL} SELECT date, CAST(least(2, floor((i * 3 + 2) / n)) AS BIGINT) AS part FROM days""")
def parts(spark, sf):
    return out(splits.equal_parts(_days(spark, sf), 3))


@C.add("rolling_month_windows", f"""WITH {DAYS_SQL}, mo AS (SELECT date, year(date) * 12 + month(date) - (year(d0) * 12 + month(d0)) AS m FROM days)
   SELECT date, CAST(k AS BIGINT) AS "window" FROM mo, (SELECT unnest(range(0, 200)) AS k) w
   WHERE m >= 2 * k AND m < 2 * k + 4 AND 2 * k + 3 <= (SELECT max(m) FROM mo)""")
def rmw(spark, sf):
    return out(splits.rolling_month_windows(_days(spark, sf)))


@C.add("edge_variants", f"""WITH {DAYS_SQL}, k AS (SELECT *, least(5, greatest(1, n // 2)) AS k FROM days)
   SELECT date, 'head' AS variant FROM k WHERE i >= k UNION ALL SELECT date, 'tail' FROM k WHERE i < n - k""")
def edges(spark, sf):
    return splits.edge_variants(_days(spark, sf))
