"""Rolling primitives and feature families, every row of the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.catalog.base import (BARS_SQL, WS, W, Catalog, R, avg_rank, chg, fin, heavy, lag, mean, out, pair,
                                    roll, std)
from quantloom.functions.framed import Frame, add_frames
from quantloom.functions.rolling import Rolling, growing, with_exprs
from quantloom.operators import models
from quantloom.plans import bars158, series, timing
from quantloom.sources import fixtures as fx

C = Catalog()


def cols(spec: dict[str, str], digits: int = 6) -> str:
    return ", ".join(R(e, n, digits) for n, e in spec.items())


# ---- kernel ---------------------------------------------------------------------------
KERNEL = {
    "lag3": lag("close", 3), "change5": chg("close", 5), "delta5": f"coalesce(close - {lag('close', 5)}, 0)",
    "mean10": mean("close", 10), "sum10": roll("sum", "volume", 10), "std10": std("close", 10),
    "var5": roll("var_samp", "ret", 5), "max14": roll("max", "high", 14), "min14": roll("min", "low", 14),
    "skew20": fin(roll("skewness", "turn", 20)), "kurt20": fin(roll("kurtosis", "turn", 20)),
    "corr10": fin(pair("corr", "close", "volume", 10)), "cov10": pair("covar_samp", "close", "turn", 10),
    "mean10_any": mean("close", 10, 1), "cnt_up20": f"avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) OVER {W(20)}",
    "cum": f"sum(turn) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "xmean": f"CASE WHEN count(turn) OVER {WS} >= 20 THEN avg(turn) OVER {WS} END",
    "xstd": f"CASE WHEN count(turn) OVER {WS} >= 20 THEN stddev_samp(turn) OVER {WS} END",
}


# values taken over unchanged keep all their decimals
EXACT = {k: e for k, e in KERNEL.items() if k in ("lag3", "delta5", "max14", "min14", "change5")}
INEXACT = {k: e for k, e in KERNEL.items() if k not in EXACT}


@C.add("rolling_kernel", f"WITH {BARS_SQL} SELECT date, symbol, {cols(EXACT, 8)}, {cols(INEXACT, 4)} FROM bars")
def kernel(spark, sf):
    r = Rolling()
    df = growing(with_exprs(fx.bars(spark, sf), {"_up": "CASE WHEN ret > 0 THEN 1D ELSE 0D END"}), "turn")
    df = r.add(df, {
        "lag3": r.lag("close", 3), "change5": r.change("close", 5), "delta5": r.ts_delta("close", 5),
        "mean10": r.mean("close", 10), "sum10": r.total("volume", 10), "std10": r.std("close", 10),
        "var5": r.var("ret", 5), "max14": r.top("high", 14), "min14": r.bottom("low", 14),
        "skew20": r.skew("turn", 20), "kurt20": r.kurt("turn", 20), "corr10": r.corr("close", "volume", 10),
        "cov10": r.cov("close", "turn", 10), "mean10_any": r.mean("close", 10, 1),
        "cnt_up20": r.mean("_up", 20, 1), "cum": "turn_sum",
        "xmean": "CASE WHEN turn_n >= 20 THEN turn_mean END", "xstd": "CASE WHEN turn_n >= 20 THEN turn_std END",
    })
    df = df.filter("NOT halo")
    return df.select("date", "symbol", *[(F.round(c, 8 if c in EXACT else 4) + F.lit(0.0)).alias(c) for c in KERNEL])


def _full(x, n, e):
    return f"(CASE WHEN count({x}) OVER {W(n)} >= {n} THEN {e} END)"


TREND = {
    "slope10": _full("close", 10, f"regr_slope(close, pos) OVER {W(10)}"),
    "r2_20": fin(_full("close", 20, f"power(corr(close, pos) OVER {W(20)}, 2)")),
    "resid20": _full("close", 20, f"close - (regr_intercept(close, pos) OVER {W(20)} + regr_slope(close, pos) OVER {W(20)} * pos)"),
    "strength20": _full("close", 20, f"regr_slope(close, pos) OVER {W(20)} / (stddev_pop(close) OVER {W(20)} + 1e-8)"),
    "beta20": _full("volume", 20, f"regr_slope(close, volume) OVER {W(20)}"),
    "alpha20": _full("volume", 20, f"regr_intercept(close, volume) OVER {W(20)}"),
    "autocorr20": fin(f"(CASE WHEN count(turn + pturn) OVER {W(19)} >= 19 THEN corr(turn, pturn) OVER {W(19)} END)"),
}


@C.add("rolling_regressions", f"""WITH {BARS_SQL}, p AS (SELECT *, row_number() OVER {WS} AS pos,
   {lag('turn')} AS pturn FROM bars) SELECT date, symbol, {cols(TREND, 4)} FROM p""")
def regressions(spark, sf):
    r = Rolling()
    df = r.add(fx.bars(spark, sf), {"_pos": r.position(), "turn_prev": r.lag("turn")})
    df = r.add(df, {
        "slope10": r.slope("close", "_pos", 10), "r2_20": r.r2("close", "_pos", 20),
        "resid20": r.residual("close", "_pos", 20), "strength20": r.trend_strength("close", "_pos", 20),
        "beta20": r.slope("close", "volume", 20), "alpha20": r.intercept("close", "volume", 20),
        "autocorr20": r.autocorr("turn", 20)})
    return out(df.filter("NOT halo").select("date", "symbol", *TREND), 4)


def _list(x, n):
    return f"list({x}) OVER {W(n)}"


NUDGE = 3.7e-9  # mean deviations of two-decimal prices often end in a half, which either engine's last bit would round


def framed_sql(n: int, k: int) -> dict[str, str]:
    """Twins of the framed statistics over whole lists, on the columns that :func:`framed_from` adds."""
    return {
        f"q80_{n}": f"quantile_cont(close, 0.8) OVER {W(n)}",
        f"rank_{n}": "(len(list_filter(lc, lambda v: v < close)) + (len(list_filter(lc, lambda v: v = close)) + 1) / 2.0) / len(lc)",
        f"argmax_{n}": f"CASE WHEN len(lh) >= {n} THEN list_position(lh, list_max(lh)) * 1.0 END",
        f"argmin_{n}": f"CASE WHEN len(lh) >= {n} THEN list_position(lh, list_min(lh)) * 1.0 END",
        f"top_{n}": f"CASE WHEN len(la) >= {n} THEN list_sum(list_reverse_sort(la)[1:{k}]) / nullif(list_sum(la), 0) END",
        f"mad_{n}": "list_avg(list_transform(lc, lambda v: abs(v - m)))",
        f"cvar_{n}": "list_avg(list_filter(lc, lambda v: v <= q05))",
    }


def framed_cols(n: int, k: int) -> str:
    return ", ".join(R(f"{e} + {NUDGE}", c, 6) if c == f"mad_{n}" else R(e, c, 8) for c, e in framed_sql(n, k).items())


def framed_from(n: int) -> str:
    return f"""p AS (SELECT *, {_list('close', n)} AS lc, {_list('high', n)} AS lh, {_list('amount', n)} AS la, avg(close) OVER {W(n)} AS m,
   quantile_cont(close, 0.05) OVER {W(n)} AS q05 FROM bars)"""


def framed_query(spark, sf, n: int, k: int):
    names = list(framed_sql(n, k))
    d = add_frames(fx.bars(spark, sf), dict(zip(names, (
        Frame("quantile", "close", n, 0.8), Frame("rank", "close", n), Frame("argmax", "high", n), Frame("argmin", "high", n),
        Frame("top_share", "amount", n, k), Frame("mean_abs_dev", "close", n), Frame("tail_mean", "close", n, 0.05)))))
    r = Rolling()
    full = lambda x, c: f"CASE WHEN {r.count(x, n)} >= {n} THEN {c} END"
    d = r.add(d, {f"argmax_{n}": full("high", f"argmax_{n}"), f"argmin_{n}": full("high", f"argmin_{n}"), f"top_{n}": full("amount", f"top_{n}")})
    return out(d.filter("NOT halo").select("date", "symbol", *[F.round(F.col(c) + NUDGE, 6).alias(c) if c == f"mad_{n}" else F.col(c) for c in names]), 8)


@C.add("rolling_arrays", f"WITH {BARS_SQL}, {framed_from(20)} SELECT date, symbol, {framed_cols(20, 5)} FROM p")
def arrays(spark, sf):
    return framed_query(spark, sf, 20, 5)


@C.add("rolling_arrays_250", f"WITH {BARS_SQL}, {framed_from(250)} SELECT date, symbol, {framed_cols(250, 25)} FROM p")
def arrays_250(spark, sf):
    return framed_query(spark, sf, 250, 25)


def ewm_sql(x: str, span: int, adjust: bool = True) -> str:
    d = 1 - 2 / (span + 1)
    s = (f"sum({x} * power({1 / d!r}, pos - 1)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"
         f" * power({d!r}, pos - 1)")
    if adjust:
        return f"({s}) * {1 - d!r} / (1 - power({d!r}, pos))"
    return (f"({s}) * {1 - d!r} + {d!r} * power({d!r}, pos - 1) * first_value({x}) OVER {WS}")


@C.add("rolling_ewm", f"""WITH {BARS_SQL}, p AS (SELECT *, row_number() OVER {WS} AS pos FROM bars)
   SELECT date, symbol, {R(ewm_sql('close', 12), 'adj12', 5)}, {R(ewm_sql('close', 26), 'adj26', 5)},
   {R(ewm_sql('close', 9, False), 'plain9', 5)} FROM p""")
def ewm(spark, sf):
    r = Rolling()
    df = r.add(fx.weekly_bars(spark, sf), {"_pos": r.position()})
    df = r.ewm(r.by_cells(df, "_pos", 26), {"adj12": ("close", 12), "adj26": ("close", 26)}, "_pos")
    df = r.ewm(df, {"plain9": ("close", 9)}, "_pos", adjust=False)
    return out(df.filter("NOT halo").select("date", "symbol", "adj12", "adj26", "plain9"), 5)


# ---- daily family ---------------------------------------------------------------------
def mx(x, lo):
    return f"(CASE WHEN {x} < {lo} THEN {lo} ELSE {x} END)"


def mn(x, hi):
    return f"(CASE WHEN {x} > {hi} THEN {hi} ELSE {x} END)"


S_BASE = BARS_SQL + f""",
s0 AS (SELECT *, {lag('close')} AS pc, row_number() OVER {WS} AS pos, {mean('volume', 20)} AS v20,
  {mean('volume', 60)} AS v60, {lag('turn')} AS pturn, {lag('volume')} AS pv FROM bars),
s1 AS (SELECT *, ln(close / nullif(pc, 0)) AS lr, close / nullif(pc, 0) - 1 AS r1, close - pc AS dc,
  greatest(high - low, 1e-8) AS hl, power(ln(high / low), 2) AS lnhl2, amount / greatest(volume, 1) AS vwap,
  volume / {mx('v60', 1)} AS vb, ln(greatest(volume, 1)) AS lnv, amount / greatest(close, 1) AS aperc,
  volume / {mx('v20', 1)} AS shock, (2 * close - high - low) / greatest(high - low, 1e-8) AS clv,
  (high + low + open + close) / 4 AS typ, (close - amount / greatest(volume, 1)) / close AS dev FROM s0),
s2 AS (SELECT *, abs(lr) / amount AS ill, {mx('dc', 0)} AS gain, -{mn('dc', 0)} AS loss, {mn('lr', 0)} AS lrd,
  {mx('lr', 0)} AS lru, power({mn('r1', 0)}, 2) AS rdn2, clv * volume AS flow,
  sum(sign(dc) * volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv,
  lr - {mean('lr', 20)} AS xlr, {fin(pair('corr', 'close', 'volume', 10))} AS cvc FROM s1),
s3 AS (SELECT *, {ewm_sql('close', 12)} - {ewm_sql('close', 26)} AS macd FROM s2)"""

YEAR = "sqrt(252)"
VOL20, VOL60 = f"({std('lr', 20)} * {YEAR})", f"({std('lr', 60)} * {YEAR})"
BAND = f"(4 * {std('close', 20)})"
DAILY = {f"ret_{d}d": chg("close", d) for d in series.RETURN_SPANS}
DAILY |= {f"rev_{d}d": f"-{chg('close', d)}" for d in series.RETURN_SPANS}
DAILY |= {
    "mom_smooth_20d": f"{chg('close', 20)} / ({std('lr', 20)} * sqrt(20) + 1e-8)",
    "info_discrete_20d": f"{mean('lr', 20)} / ({std('lr', 20)} + 1e-8)",
    **{f"vol_{d}d": f"{std('lr', d)} * {YEAR}" for d in series.VOL_SPANS},
    "skew_20d": fin(roll("skewness", "lr", 20)), "kurt_20d": fin(roll("kurtosis", "lr", 20)),
    "vol_skew_ratio": f"({std('lrd', 20)} * {YEAR}) / ({std('lru', 20)} * {YEAR} + 1e-8)",
    "max_ret_20d": roll("max", "lr", 20), "min_ret_20d": roll("min", "lr", 20),
    "extreme_vol_20d": f"{roll('max', 'lr', 20)} - {roll('min', 'lr', 20)}",
    "parkinson_vol_20d": f"sqrt({mean('lnhl2', 20)} / (4 * ln(2))) * {YEAR}",
    "ivol_20d": f"{std('xlr', 20)} * {YEAR}", "resid_vol_20d": f"{std('xlr', 20)} * {YEAR}",
    "amihud_5d": f"{mean('ill', 5)} * 1e4", "amihud_20d": f"{mean('ill', 20)} * 1e4",
    **{f"turnover_{d}d": mean("vb", d) for d in series.TURNOVER_SPANS},
    "turnover_std_20d": std("vb", 20), "illiq_spread": "(high - low) / close", "volume_shock_5d": "shock",
    "amount_shock_5d": f"amount / {mx(mean('amount', 20), 1)}", "liquidity_var": std("aperc", 20),
    "clv": "clv", "upper_shadow": "(high - greatest(close, open)) / hl",
    "lower_shadow": "(least(close, open) - low) / hl", "body_ratio": "abs(close - open) / hl",
    "gap": "(open - pc) / pc", "smart_money_10d": roll("sum", "dev", 10), "smart_money_20d": roll("sum", "dev", 20),
    "vwap_dev_5d": mean("dev", 5), "vwap_dev_20d": mean("dev", 20), "intraday_mom": "(close - typ) / typ",
    "price_accel": f"r1 - {lag('r1')}",
    **{f"pv_corr_{d}d": fin(pair("corr", "close", "volume", d)) for d in series.CORR_SPANS},
    **{f"logpv_corr_{d}d": fin(pair("corr", "lr", "lnv", d)) for d in series.CORR_SPANS},
    "obv_slope_10d": _full("obv", 10, f"regr_slope(obv, pos) OVER {W(10)}"),
    "money_flow_10d": roll("sum", "flow", 10), "money_flow_20d": roll("sum", "flow", 20),
    "pv_divergence": f"{chg('close', 10)} - {chg('volume', 10)}",
    **{f"bias_{d}d": f"(close - {mean('close', d)}) / {mean('close', d)}" for d in series.BIAS_SPANS},
    **{f"ma_cross_{d}d": f"close / {mean('close', d)} - 1" for d in series.BIAS_SPANS},
    **{f"rsi_{d}": f"100 - 100 / (1 + {mean('gain', d)} / {mx(mean('loss', d), 1e-8)})" for d in series.RSI_SPANS},
    "macd_hist": "macd", "macd_signal": ewm_sql("macd", 9),
    "boll_width_20d": f"2 * {std('close', 20)} / {mean('close', 20)}",
    "turnover_std_5d": std("turn", 5),
    "turnover_decay_20d": fin(f"(CASE WHEN count(turn + pturn) OVER {W(19)} >= 19 THEN corr(turn, pturn) OVER {W(19)} END)"),
    "turnover_skew_20d": fin(roll("skewness", "turn", 20)),
    "turnover_ma_ratio_5_60": f"{mean('turn', 5)} / {mx(mean('turn', 60), 1e-8)}",
    "turnover_illuminated_20d": f"{mean('turn', 20)} * {std('lr', 20)}",
    "amt_turn_corr_20d": fin(pair("corr", "amount", "turn", 20)), "volume_std_5d": std("shock", 5),
    "close_volume_corr_change_10d": f"cvc - {lag('cvc', 5)}", "volume_skew_20d": fin(roll("skewness", "volume", 20)),
    "ret_volume_corr_10d": fin(pair("corr", "r1", "volume", 10)),
    "high_low_volume_corr_10d": fin(pair("corr", "hl", "volume", 10)),
    "vol_stability_20d": f"({std('lr', 5)} * {YEAR}) / {mx(VOL20, 1e-8)}",
    "downside_vol_20d": mean("rdn2", 20),
    "vol_expansion_20d": f"({std('lr', 20)} * {YEAR}) / {mx(VOL60, 1e-8)} - 1",
}
assert set(DAILY) == set(series.daily_columns())
# columns of large size are compared with fewer decimals
DAILY_DIGITS = {c: 2 for c in ("liquidity_var", "obv_slope_10d", "money_flow_10d", "money_flow_20d",
                               "macd_hist", "macd_signal")}


def digits(name: str) -> int:
    return DAILY_DIGITS.get(name, 4)


@C.add("daily_features", f"WITH {S_BASE} SELECT date, symbol, "
       + ", ".join(R(DAILY[n], n, digits(n)) for n in series.daily_columns()) + " FROM s3")
def daily(spark, sf):
    d = series.daily_features(fx.weekly_bars(spark, sf))
    scaled = {"amihud_5d": F.col("amihud_5d") * 1e4, "amihud_20d": F.col("amihud_20d") * 1e4}
    return d.select("date", "symbol", *[
        (F.round(scaled.get(n, F.col(n)), digits(n)) + F.lit(0.0)).alias(n) for n in series.daily_columns()])


RANK13 = ", ".join(R(f"CASE WHEN {c} IS NOT NULL THEN ({avg_rank(f'date, {c} IS NULL', c)} / count({c}) OVER (PARTITION BY date) - 0.5) / 0.5 END",
                     f"rank_{c}") for c in series.RANKED)


@C.add("rank_features", f"""WITH {S_BASE}, f AS (SELECT date, symbol,
   {', '.join(f'{DAILY[c]} AS {c}' for c in dict.fromkeys((*series.RANKED, 'vol_5d')))} FROM s3)
   SELECT date, symbol, {R('vol_5d / (vol_20d + 1e-8)', 'vol_cone_5_20', 4)},
   {R(f"pv_divergence - {lag('pv_divergence', 5)}", 'pv_div_accel', 4)},
   {R(f"body_ratio - {lag('body_ratio', 5)}", 'body_ratio_mom', 4)},
   {R(f"sum(CASE WHEN ret_1d > 0.05 THEN 1.0 ELSE 0.0 END) OVER {W(5)} / 5", 'extreme_up_days_5d', 4)},
   {R(f"sum(CASE WHEN ret_1d < -0.05 THEN 1.0 ELSE 0.0 END) OVER {W(5)} / 5", 'extreme_down_days_5d', 4)},
   {RANK13} FROM f""")
def ranks(spark, sf):
    d = series.rank_features(fx.bars(spark, sf), heavy(spark, sf))
    four = ["vol_cone_5_20", "pv_div_accel", "body_ratio_mom", "extreme_up_days_5d", "extreme_down_days_5d"]
    return d.select("date", "symbol", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in four],
                    *[(F.round(f"rank_{c}", 6) + F.lit(0.0)).alias(f"rank_{c}") for c in series.RANKED])


# ---- 158 bar features -----------------------------------------------------------------
def fam158(d: int) -> dict[str, str]:
    e = 1e-12
    any_ = lambda fn, x: f"{fn}({x}) OVER {W(d)}"
    full = lambda x: f"CASE WHEN count(close) OVER {W(d)} >= {d} THEN {x} END"
    pos = f"(len(l{d}) - 1 + 0)"
    hi, lo = any_("max", "high"), any_("min", "low")
    sd = lambda x: f"(CASE WHEN count({x}) OVER {W(d)} >= 2 THEN {any_('stddev_samp', x)} END)"
    cor = lambda x, y: f"coalesce({fin(f'corr({x}, {y}) OVER {W(d)}')}, 0)"
    return {
        f"ROC{d}": f"{lag('close', d)} / close", f"MA{d}": f"{any_('avg', 'close')} / close", f"STD{d}": f"{sd('close')} / close",
        f"BETA{d}": full(f"regr_slope(close, pos) OVER {W(d)} / close"),
        f"RSQR{d}": fin(full(f"power(corr(close, pos) OVER {W(d)}, 2)")),
        f"RESI{d}": full(f"(close - (regr_intercept(close, pos) OVER {W(d)} + regr_slope(close, pos) OVER {W(d)} * pos)) / close"),
        f"MAX{d}": f"{hi} / close", f"MIN{d}": f"{lo} / close",
        f"QTLU{d}": f"quantile_cont(close, 0.8) OVER {W(d)} / close", f"QTLD{d}": f"quantile_cont(close, 0.2) OVER {W(d)} / close",
        f"RANK{d}": f"(len(list_filter(l{d}, lambda v: v < close)) + (len(list_filter(l{d}, lambda v: v = close)) + 1) / 2.0) / len(l{d})",
        f"RSV{d}": f"(close - {lo}) / ({hi} - {lo} + {e})",
        f"IMAX{d}": f"CASE WHEN len(l{d}) >= {d} THEN list_position(h{d}, list_max(h{d})) / {d}.0 END",
        f"IMIN{d}": f"CASE WHEN len(l{d}) >= {d} THEN list_position(o{d}, list_min(o{d})) / {d}.0 END",
        f"IMXD{d}": f"CASE WHEN len(l{d}) >= {d} THEN (list_position(h{d}, list_max(h{d})) / {d}.0 - list_position(o{d}, list_min(o{d})) / {d}.0) / {d} END",
        f"CORR{d}": cor("close", "lv"), f"CORD{d}": cor("close", "lvc"),
        f"CNTP{d}": any_("avg", "isup"), f"CNTN{d}": any_("avg", "isdn"), f"CNTD{d}": f"{any_('avg', 'isup')} - {any_('avg', 'isdn')}",
        f"SUMP{d}": f"{any_('sum', 'up')} / ({any_('sum', 'ab')} + {e})", f"SUMN{d}": f"{any_('sum', 'dn')} / ({any_('sum', 'ab')} + {e})",
        f"SUMD{d}": f"{any_('sum', 'up')} / ({any_('sum', 'ab')} + {e}) - {any_('sum', 'dn')} / ({any_('sum', 'ab')} + {e})",
        f"VMA{d}": f"{any_('avg', 'volume')} / (volume + {e})", f"VSTD{d}": f"{sd('volume')} / (volume + {e})",
        f"WVMA{d}": f"{sd('wv')} / ({any_('avg', 'wv')} + {e})",
        f"VSUMP{d}": f"{any_('sum', 'vup')} / ({any_('sum', 'vab')} + {e})", f"VSUMN{d}": f"{any_('sum', 'vdn')} / ({any_('sum', 'vab')} + {e})",
        f"VSUMD{d}": f"{any_('sum', 'vup')} / ({any_('sum', 'vab')} + {e}) - {any_('sum', 'vdn')} / ({any_('sum', 'vab')} + {e})",
    }


ALL158 = {
    "KMID": "(2 * close - high - low) / open", "KLEN": "(high - low) / open", "KMID2": "(close - open) / rg",
    "KUP": "(high - greatest(open, close)) / open", "KUP2": "(high - greatest(open, close)) / rg",
    "KLOW": "(least(open, close) - low) / open", "KLOW2": "(least(open, close) - low) / rg",
    "KSFT": "(2 * close - high - low) / open", "KSFT2": "(2 * close - high - low) / rg",
    "OPEN0": "open / close", "HIGH0": "high / close", "LOW0": "low / close", "VWAP0": "amount / volume / close",
}
for _d in bars158.SPANS:
    ALL158 |= fam158(_d)
SQL158 = BARS_SQL + f""",
t0 AS (SELECT *, row_number() OVER {WS} AS pos, close - {lag('close')} AS dc, volume - {lag('volume')} AS dv,
  high - low + 1e-12 AS rg, ln(volume + 1) AS lv, ln(volume / {lag('volume')} + 1) AS lvc,
  abs(close / {lag('close')} - 1) * volume AS wv,
  {', '.join(f'list(close) OVER {W(d)} AS l{d}, list(high) OVER {W(d)} AS h{d}, list(low) OVER {W(d)} AS o{d}' for d in bars158.SPANS)}
  FROM bars),
t1 AS (SELECT *, greatest(dc, 0 * dc) AS up, greatest(-dc, 0 * dc) AS dn, abs(dc) AS ab, greatest(dv, 0 * dv) AS vup,
  greatest(-dv, 0 * dv) AS vdn, abs(dv) AS vab, CASE WHEN dc > 0 THEN 1.0 ELSE 0.0 END AS isup,
  CASE WHEN dc < 0 THEN 1.0 ELSE 0.0 END AS isdn FROM t0)"""


@C.add("bar_features_158", f"WITH {SQL158} SELECT date, symbol, "
       + ", ".join(R(f"(CASE WHEN ({ALL158[n]}) > 1000 THEN 1000 WHEN ({ALL158[n]}) < -1000 THEN -1000 ELSE ({ALL158[n]}) END)", n, 4)
                   for n in bars158.columns()) + " FROM t1")
def a158(spark, sf):
    return out(bars158.features158(fx.bars(spark, sf)).select("date", "symbol", *bars158.columns()), 4)


# ---- large-cap family -----------------------------------------------------------------
S_LARGE = S_BASE + f""",
mk AS (SELECT date, quantile_cont(r1, 0.5) AS mkt FROM s3 WHERE r1 IS NOT NULL GROUP BY date),
l0 AS (SELECT s3.*, mkt, (high + low + close) / 3 AS tp, {mx('r1', 0)} AS rup, -{mn('r1', 0)} AS rdn,
  open / pc - 1 AS ovr, close / open - 1 AS intra, (close - vwap) / vwap AS cvw, (close - open) / open AS eff
  FROM s3 LEFT JOIN mk USING (date)),
l1 AS (SELECT *, tp - {lag('tp')} AS dtp, close / {roll('max', 'close', 60)} - 1 AS dd,
  sum(coalesce(sign(dc), 0) * volume) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv0,
  {pair('covar_samp', 'r1', 'mkt', 60)} / {mx(roll('var_samp', 'mkt', 60), 1e-8)} AS beta60,
  {', '.join(f'(CASE WHEN count(r1 + mkt) OVER {W(d)} >= {d} THEN regr_intercept(r1, mkt) OVER {W(d)} END) AS alpha{d}' for d in (60, 120, 250))},
  (CASE WHEN count(r1 + mkt) OVER {W(120)} >= 120 THEN regr_slope(r1, mkt) OVER {W(120)} END) AS beta120,
  list(amount) OVER {W(20)} AS a20 FROM l0),
l2 AS (SELECT *, r1 - (beta60 * mkt + alpha60) AS res60, CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END AS mfp,
  CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END AS mfn FROM l1)"""
LARGE_ONLY = {
    "amt_concentration_20d": "CASE WHEN len(a20) >= 20 THEN list_sum(list_reverse_sort(a20)[1:5]) / list_sum(a20) END",
    "amihud_ratio_5_20": f"{mean('ill', 5)} / {mx(mean('ill', 20), 1e-8)}",
    "vol_lead_corr_10d": fin(pair("corr", "pv", "r1", 10)),
    "boll_pctb_20d": f"(close - ({mean('close', 20)} - 2 * {std('close', 20)})) / {mx(BAND, 1e-8)}",
    "cci_20d": f"(tp - {mean('tp', 20)}) / (0.015 * {std('tp', 20)})",
    "williams_r_14d": f"({roll('max', 'high', 14)} - close) / ({roll('max', 'high', 14)} - {roll('min', 'low', 14)}) * -100",
    **{f"excess_ret_{d}d": f"exp({roll('sum', 'lr', d)}) - exp({roll('sum', 'mkt', d)})" for d in (5, 20, 60)},
    "relative_strength_20d": f"(exp({roll('sum', 'lr', 20)}) - 1) / (exp({roll('sum', 'mkt', 20)}) - 1 + 1e-8)",
    "market_beta_60d": "beta60", "market_beta_120d": "beta120", "sharpe_60d": f"{mean('r1', 60)} / {std('r1', 60)}",
    "max_drawdown_60d": roll("min", "dd", 60), "gain_loss_60d": f"{roll('sum', 'rup', 60)} / {roll('sum', 'rdn', 60)}",
    **{f"rolling_alpha_{d}d": f"alpha{d}" for d in (60, 120, 250)},
    "beta_stability_60d": f"beta60 / {mx('beta120', 1e-8)} * 1e-6", "ivol_60d": f"{std('res60', 60)} * {YEAR}",
    "rsrs_20d": _full("high", 20, f"regr_slope(high, low) OVER {W(20)} * power(corr(high, low) OVER {W(20)}, 2)"),
    "obv_trend_20d": _full("obv0", 20, f"regr_slope(obv0, pos) OVER {W(20)} / (stddev_pop(obv0) OVER {W(20)} + 1e-8)"),
    "mfi_14d": f"100 - 100 / (1 + sum(mfp) OVER {W(14)} / {mx(f'sum(mfn) OVER {W(14)}', 1e-8)})",
    "overnight_ret_20d": mean("ovr", 20), "intraday_ret_20d": mean("intra", 20), "close_vwap_dev_20d": mean("cvw", 20),
    "open_efficiency_20d": std("eff", 20),
    "idio_ret_20d": f"(CASE WHEN count(r1 + mkt) OVER {W(20)} >= 20 THEN r1 - (regr_intercept(r1, mkt) OVER {W(20)} + regr_slope(r1, mkt) OVER {W(20)} * mkt) END)",
    "amt_mom_20d": f"{mean('amount', 20)} / {mean('amount', 60)}", "pv_cov_20d": pair("covar_samp", "r1", "lnv", 20),
    "var_95_20d": roll("quantile_cont", "lr", 20).replace("quantile_cont(lr)", "quantile_cont(lr, 0.05)"),
    "turnover_mom_20d": f"turn / {mx(lag('turn', 20), 1e-8)} - 1",
    "turnover_vol_20d": f"{std('turn', 20)} / {mean('turn', 20)}",
}


@C.add("large_cap_raw", f"WITH {S_LARGE} SELECT date, symbol, {cols(LARGE_ONLY, 3)} FROM l2")
def large_raw(spark, sf):
    d = series.large_cap_raw(fx.bars(spark, sf), heavy=heavy(spark, sf), only=list(LARGE_ONLY))
    d = d.withColumn("beta_stability_60d", F.col("beta_stability_60d") * 1e-6)
    return out(d.drop("forward_ret"), 3)


STD_COLS = ["ret_1d", "vol_20d", "rsi_14", "pv_corr_10d", "bias_20d", "turnover_20d"]
_med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in STD_COLS)
_fill = ", ".join(f"coalesce({c}, m_{c}) AS {c}, m_{c}" for c in STD_COLS)
_mad = ", ".join(f"quantile_cont(abs({c} - m_{c}), 0.5) AS d_{c}" for c in STD_COLS)
_clip = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, m_{c} - 3 * 1.4826 * d_{c}), m_{c} + 3 * 1.4826 * d_{c}) END AS {c}"
                  for c in STD_COLS)
_z = ", ".join(R(f"({c} - avg({c}) OVER d) / {mx(f'stddev_samp({c}) OVER d', 1e-8)}", c, 5) for c in STD_COLS)


@C.add("fill_clip_zscore", f"""WITH {S_BASE}, f AS (SELECT date, symbol, {', '.join(f'{DAILY[c]} AS {c}' for c in STD_COLS)} FROM s3),
  med AS (SELECT date, {_med} FROM f GROUP BY date), fl AS (SELECT date, symbol, {_fill} FROM f JOIN med USING (date)),
  mad AS (SELECT date, {_mad} FROM fl GROUP BY date), cl AS (SELECT date, symbol, {_clip} FROM fl JOIN mad USING (date))
  SELECT date, symbol, {_z} FROM cl WINDOW d AS (PARTITION BY date)""")
def fill_clip(spark, sf):
    from quantloom.operators import xsection as xs
    d = series.daily_features(fx.bars(spark, sf), only=STD_COLS).drop("forward_ret")
    return out(xs.fill_clip_zscore_wide(d, STD_COLS, heavy=heavy(spark, sf)).select("date", "symbol", *STD_COLS), 5)


LARGE_ALL = {c: LARGE_ONLY.get(c, DAILY.get(c)) for c in series.large_cap_columns()}
LARGE_ALL |= {"illiq_spread": "hl / close", "amihud_5d": mean("ill", 5), "amihud_20d": mean("ill", 20),
              "vol_skew_ratio": f"{std('lrd', 20)} / ({std('lru', 20)} + 1e-8)",
              "beta_stability_60d": f"beta60 / {mx('beta120', 1e-8)}"}


def std3(names: list[str], src: str) -> str:
    """CTEs ending in zs: fill with the date median, clip at 3 MAD, z-score per date."""
    return f"""
  med AS (SELECT date, {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in names)} FROM {src} GROUP BY date),
  fl AS (SELECT date, symbol, {', '.join(f'coalesce({c}, m_{c}) AS {c}, m_{c}' for c in names)} FROM {src} JOIN med USING (date)),
  mad AS (SELECT date, {', '.join(f'quantile_cont(abs({c} - m_{c}), 0.5) AS d_{c}' for c in names)} FROM fl GROUP BY date),
  cl AS (SELECT date, symbol, {', '.join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, m_{c} - 3 * 1.4826 * d_{c}), m_{c} + 3 * 1.4826 * d_{c}) END AS {c}" for c in names)}
         FROM fl JOIN mad USING (date)),
  zs AS (SELECT date, symbol, {', '.join(f"({c} - avg({c}) OVER d) / {mx(f'stddev_samp({c}) OVER d', 1e-8)} AS {c}" for c in names)} FROM cl
         WINDOW d AS (PARTITION BY date))"""


@C.add("large_cap_features", f"""WITH {S_LARGE}, raw AS (SELECT date, symbol, {', '.join(f'{fin(LARGE_ALL[c])} AS {c}' for c in series.large_cap_columns())} FROM l2),
  {std3(series.large_cap_columns(), 'raw')} SELECT date, symbol, {', '.join(R(c, c, 3) for c in series.large_cap_columns())} FROM zs""")
def large(spark, sf):
    d = series.large_cap_features(fx.bars(spark, sf), heavy=heavy(spark, sf))
    return out(d.select("date", "symbol", *series.large_cap_columns()), 3)


# ---- market series --------------------------------------------------------------------
@C.add("equal_weight_index", f"""WITH {BARS_SQL} SELECT date, {', '.join(R(f'avg({c})', c, 7) for c in
   ('open', 'high', 'low', 'close', 'volume', 'amount'))} FROM bars GROUP BY date""")
def index(spark, sf):
    return out(series.equal_weight_index(fx.bars(spark, sf)), 7)


@C.add("market_return", f"""WITH {BARS_SQL}, r AS (SELECT date, {chg('close', 1)} AS r1 FROM bars)
   SELECT date, {R('quantile_cont(r1, 0.5)', 'market_ret')} FROM r WHERE r1 IS NOT NULL GROUP BY date""")
def market(spark, sf):
    return out(series.market_return(fx.bars(spark, sf), heavy(spark, sf)))


def wi(n):
    return f"(ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def iroll(fn, x, n, need=None):
    k = n if need is None else need
    return f"(CASE WHEN count({x}) OVER {wi(n)} >= {k} THEN {fn}({x}) OVER {wi(n)} END)"


TIMING = {
    "ret_5d": "close / lag(close, 5) OVER (ORDER BY date) - 1", "vol_20d": iroll("stddev_samp", "r1", 20, 10),
    "vol_ratio_5_20": f"{iroll('stddev_samp', 'r1', 5)} / {iroll('stddev_samp', 'r1', 20)}",
    "bias_60d": f"(close - {iroll('avg', 'close', 60, 30)}) / {iroll('avg', 'close', 60, 30)}",
    "parkinson_vol_20d": f"sqrt({iroll('sum', 'hl2', 20, 10)} / (20 * ln(2)))",
    "sharpe_60d": f"{iroll('avg', 'r1', 60)} / {iroll('stddev_samp', 'r1', 60)}",
    "volume_ratio_5_20": f"{iroll('avg', 'volume', 5, 2)} / {iroll('avg', 'volume', 20, 10)}",
    "trend_slope_20d": f"CASE WHEN count(close) OVER {wi(20)} >= 20 THEN regr_slope(close, pos) OVER {wi(20)} / (stddev_pop(close) OVER {wi(20)} + 1e-8) END",
    "amt_mom_20d": "amount / lag(amount, 20) OVER (ORDER BY date) - 1",
    "williams_r_14d": f"({iroll('max', 'high', 14)} - close) / ({iroll('max', 'high', 14)} - {iroll('min', 'low', 14)}) * -100",
    "aroon_osc_25d": f"CASE WHEN len(h25) >= 25 THEN (list_position(h25, list_max(h25)) - list_position(l25, list_min(l25))) / 24.0 END",
    "cvar_20d": f"CASE WHEN count(r1) OVER {wi(20)} >= 20 THEN list_avg(list_filter(r20, lambda v: v <= q20)) END",
    "candle_body_20d": iroll("avg", "body", 20, 10), "skew_20d": iroll("skewness", "r1", 20, 10),
}


@C.add("timing_series", f"""WITH {BARS_SQL}, i0 AS (SELECT date, avg(open) AS open, avg(high) AS high, avg(low) AS low,
   avg(close) AS close, avg(volume) AS volume, avg(amount) AS amount FROM bars GROUP BY date),
  i1 AS (SELECT *, row_number() OVER (ORDER BY date) AS pos, close / lag(close) OVER (ORDER BY date) - 1 AS r1,
   power(ln(high / low), 2) AS hl2, abs(close - open) / greatest(high - low, 1e-8) AS body FROM i0),
  i2 AS (SELECT *, list(high) OVER {wi(25)} AS h25, list(low) OVER {wi(25)} AS l25,
   list(r1) FILTER (WHERE r1 IS NOT NULL) OVER {wi(20)} AS r20, quantile_cont(r1, 0.05) OVER {wi(20)} AS q20 FROM i1)
  SELECT date, {cols(TIMING, 4)} FROM i2""")
def timing_series(spark, sf):
    i = series.equal_weight_index(fx.bars(spark, sf)).withColumn("series", F.lit("index"))
    return out(timing.index_features(i).select("date", *TIMING), 4)


PAIR_SQL = f"""
  st AS (SELECT symbol, date, turn, {chg('close', 5)} AS r5, {chg('close', 20)} AS r20,
    row_number() OVER {WS} AS pos, coalesce(ln(close / nullif({lag('close')}, 0)), 0) AS lr0, {chg('close', 1)} AS r1 FROM bars),
  sv AS (SELECT *, {std('lr0', 20)} AS vol, list(r1) FILTER (WHERE r1 IS NOT NULL) OVER {W(60)} AS last60 FROM st),
  s AS (SELECT * FROM sv WHERE pos >= 21),
  z AS (SELECT date, unnest(list_transform(last60, lambda v: (v - list_avg(last60)) / list_stddev_pop(last60))) AS v,
    unnest(range(1, 61)) AS k FROM s WHERE len(last60) >= 60),
  zs AS (SELECT date, k, sum(v) AS sz, count(*) AS n FROM z GROUP BY date, k),
  pc AS (SELECT date, CASE WHEN max(n) >= 10 THEN (avg(sz * sz) - max(n)) / (max(n) * (max(n) - 1.0)) END AS pcorr FROM zs GROUP BY date),
  rk AS (SELECT date, r20, row_number() OVER (PARTITION BY date ORDER BY r20, symbol) AS rn,
    count(*) OVER (PARTITION BY date) AS n FROM s WHERE r20 IS NOT NULL),
  ed AS (SELECT date, stddev_pop(r20) FILTER (WHERE rn > n - 50) AS big, stddev_pop(r20) FILTER (WHERE rn <= 50) AS small,
    avg(r20) FILTER (WHERE rn > n - 50) - avg(r20) FILTER (WHERE rn <= 50) AS diff FROM rk WHERE n >= 100 GROUP BY date),
  ag AS (SELECT date, count(r5) AS n5, count(r20) AS n20, count(vol) AS nv, count(turn) AS nt,
    stddev_pop(r5) AS d5, stddev_pop(r20) AS d20, stddev_pop(vol) AS dv, stddev_pop(turn) AS dt,
    avg(CASE WHEN r5 > 0 THEN 1.0 WHEN r5 IS NOT NULL THEN 0 END) AS u5, avg(CASE WHEN r20 > 0 THEN 1.0 WHEN r20 IS NOT NULL THEN 0 END) AS u20,
    avg(CASE WHEN r5 < 0 THEN 1.0 WHEN r5 IS NOT NULL THEN 0 END) AS w5, avg(CASE WHEN r20 < 0 THEN 1.0 WHEN r20 IS NOT NULL THEN 0 END) AS w20,
    skewness(r20) AS sk, kurtosis(r20) AS ku FROM s GROUP BY date)"""


@C.add("market_breadth", f"""WITH {BARS_SQL}, {PAIR_SQL}
  SELECT d.date, {R('CASE WHEN n5 > 2 THEN d5 ELSE 0 END', 'cross_ret_disp_5d', 5)}, {R('CASE WHEN n20 > 2 THEN d20 ELSE 0 END', 'cross_ret_disp_20d', 5)},
   {R('CASE WHEN nv > 2 THEN dv ELSE 0 END', 'cross_vol_disp_20d', 5)}, {R('coalesce(u5, 0.5)', 'up_ratio_5d', 5)},
   {R('coalesce(u20, 0.5)', 'up_ratio_20d', 5)}, {R('coalesce(w5, 0.5)', 'down_ratio_5d', 5)}, {R('coalesce(w20, 0.5)', 'down_ratio_20d', 5)},
   {R('CASE WHEN n20 > 5 THEN sk ELSE 0 END', 'cross_skew_20d', 5)}, {R('CASE WHEN n20 > 5 THEN ku ELSE 0 END', 'cross_kurt_20d', 5)},
   {R('coalesce(big, 0)', 'large_ret_disp_20d', 5)}, {R('coalesce(small, 0)', 'small_ret_disp_20d', 5)}, {R('coalesce(diff, 0)', 'big_small_ret_diff_20d', 5)},
   {R('CASE WHEN nt > 2 THEN dt ELSE 0 END', 'cross_turnover_disp_20d', 5)}, {R('coalesce(pcorr, 0)', 'high_low_corr_20d', 5)}
  FROM (SELECT DISTINCT date FROM bars) d LEFT JOIN ag USING (date) LEFT JOIN ed USING (date) LEFT JOIN pc USING (date)""")
def breadth(spark, sf):
    return out(timing.breadth_features(fx.bars(spark, sf), heavy(spark, sf)), 5)


TZ = [*TIMING, *timing.BREADTH]
_ts = C.sql["timing_series"]
TS_CTES = _ts[len(f"WITH {BARS_SQL}, "):_ts.rindex("SELECT date")].rstrip()
_mb = C.sql["market_breadth"]
MB_SELECT = _mb[_mb.rindex("SELECT d.date"):]


@C.add("timing_zscores", f"""WITH {BARS_SQL}, {TS_CTES}, {PAIR_SQL.strip()},
  br AS ({MB_SELECT.replace(', 5) + 0.0', ', 15) + 0.0')}),
  al AS (SELECT br.*, {', '.join(f'{e} AS {n}' for n, e in TIMING.items())} FROM i2 JOIN br USING (date))
  SELECT date, {', '.join(R(f"CASE WHEN count({c}) OVER u >= 20 THEN ({c} - avg({c}) OVER u) / greatest(stddev_samp({c}) OVER u, 1e-8) END", c, 3) for c in TZ)}
  FROM al WINDOW u AS (ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def timing_z(spark, sf):
    return out(timing.timing_features(fx.bars(spark, sf), heavy(spark, sf)).select("date", *TZ), 3)


@C.add("timing_features")
def timing_all(spark, sf):
    return timing.timing_features(fx.bars(spark, sf), heavy(spark, sf))


# ---- sequences and tensors ------------------------------------------------------------
SEQ = "list_concat(list_transform(range(20 - len(s)), lambda i: s[1]), s)"


@C.add("sequence_windows", f"""WITH {BARS_SQL}, q AS (SELECT date, symbol, list(close) OVER {W(20)} AS s FROM bars)
   SELECT date, symbol, CAST(len({SEQ}) AS BIGINT) AS steps, {R(f'({SEQ})[1]', 'oldest', 8)}, {R(f'({SEQ})[20]', 'newest', 8)},
   {R(f'list_sum({SEQ})', 'total', 4)} FROM q""")
def seqs(spark, sf):
    d = models.sequences(fx.bars(spark, sf), ["close", "volume"]).filter("NOT halo")
    d = d.select("date", "symbol", F.size("sequence").cast("bigint").alias("steps"),
                 F.col("sequence")[0]["close"].alias("oldest"), F.col("sequence")[19]["close"].alias("newest"),
                 F.round(F.aggregate("sequence", F.lit(0.0), lambda a, s: a + s["close"]), 4).alias("total"))
    return out(d, 8)


@C.add("tensor_pivot", f"""WITH {BARS_SQL}, k AS (SELECT DISTINCT date FROM bars WHERE symbol IN ('1','2','3','5'))
   SELECT date, {', '.join(R(f"max(CASE WHEN symbol = '{s}' THEN {e} END)", f'"{s}_{c}"', 8)
                           for s in ('1', '2', '3', '5') for c, e in (('open', 'open'), ('high', 'high'), ('low', 'low'),
                           ('close', 'close'), ('volume', 'volume'), ('vwap', 'amount / greatest(volume, 1)')))}
   FROM bars WHERE date IN (SELECT date FROM k) GROUP BY date""")
def tensor(spark, sf):
    b = fx.plain_bars(spark, sf)
    names = ["1", "2", "3", "5"]
    days = b.filter(F.col("symbol").isin(names)).select("date").distinct()
    return out(models.tensor(b.join(days, "date", "left_semi"), names), 8)


@C.add("tensor_to_panel", f"""WITH {BARS_SQL}
   SELECT date, symbol, {R("CASE WHEN symbol IN ('1','2','3','5') THEN close END", 'x', 8)} FROM bars""")
def from_wide(spark, sf):
    b = fx.plain_bars(spark, sf)
    wide = b.groupBy("date").pivot("symbol", ["1", "2", "3", "5"]).agg(F.first("close"))
    return out(models.from_wide(wide, b), 8)
