"""Per-symbol feature families over blocked bars.

All frames share the key (symbol, blk) and the order (date): one exchange and one sort
feed every window of a plan; later stages only add Window operators. Stages are split
by family to keep generated code small. Names starting with ``_`` are intermediate.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quantloom.functions.rolling import (ANNUAL, Rolling, at_least, at_most, div, lit, over,
                                         sorted_quantile, top_share, with_exprs)
from quantloom.operators import xsection as xs
from quantloom.operators.layout import time_blocks, write_out
from quantloom.settings import DEFAULTS, Settings

YEAR = lit(ANNUAL)

# Window lengths of the families.
RETURN_SPANS = (1, 2, 3, 5, 10, 20, 60)
VOL_SPANS = (5, 10, 20, 60)
BIAS_SPANS = (5, 10, 20, 60)
RSI_SPANS = (6, 14, 24)
CORR_SPANS = (5, 10, 20)
TURNOVER_SPANS = (5, 20, 60)
# Columns that get a cross-sectional rank twin.
RANKED = ("ret_1d", "ret_5d", "ret_20d", "vol_20d", "turnover_20d", "body_ratio",
          "pv_divergence", "amihud_20d")


def _base(df: DataFrame, r: Rolling, horizon: int) -> DataFrame:
    """Shared inputs: label, previous close, log and simple returns, ranges, scaled volume."""
    df = r.add(df, {"forward_ret": label(r, horizon), "_pc": r.lag("close"), "_pos": r.position(),
                    "_v20": r.mean("volume", 20), "_v60": r.mean("volume", 60)})
    df = with_exprs(df, {
        "_lr": f"ln({div(at_least('close', 1e-8), at_least('_pc', 1e-8))})",
        "_ret": f"{div('close', '_pc')} - 1",
        "_dc": "close - _pc",
        "_hl": at_least("(high - low)", 1e-8),
        "_lnhl2": f"pow(ln({div(at_least('high', 1e-8), at_least('low', 1e-8))}), 2D)",
        "_vwap": over("amount", "volume", 1.0),
        "_vb": over("volume", "_v60", 1.0),
        "_lnv": f"ln({at_least('volume', 1.0)})",
        "_aperc": over("amount", "close", 1.0),
        "volume_shock_5d": over("volume", "_v20", 1.0),
    })
    return with_exprs(df, {
        "_lr_dn": at_most("_lr", 0), "_lr_up": at_least("_lr", 0),
        "_ill": over("abs(_lr)", "amount"),
        "_gain": at_least("_dc", 0), "_loss": f"-{at_most('_dc', 0)}",
        "_ret_dn2": f"pow({at_most('_ret', 0)}, 2D)",
    })


def _momentum(r: Rolling) -> dict[str, str]:
    out = {f"ret_{d}d": r.change("close", d) for d in RETURN_SPANS}
    out |= {f"rev_{d}d": f"-{r.change('close', d)}" for d in RETURN_SPANS}
    m, s = r.mean("_lr", 20), r.std("_lr", 20)
    out["mom_smooth_20d"] = f"{r.change('close', 20)} / ({s} * {lit(math.sqrt(20))} + 1e-8D)"
    out["info_discrete_20d"] = f"{m} / ({s} + 1e-8D)"
    return out


def _risk(r: Rolling) -> dict[str, str]:
    out = {f"vol_{d}d": f"{r.std('_lr', d)} * {YEAR}" for d in VOL_SPANS}
    return out | {
        "skew_20d": r.skew("_lr", 20), "kurt_20d": r.kurt("_lr", 20),
        "max_ret_20d": r.top("_lr", 20), "min_ret_20d": r.bottom("_lr", 20),
        "parkinson_vol_20d": f"sqrt({r.mean('_lnhl2', 20)} / {lit(4 * math.log(2))}) * {YEAR}",
        "downside_vol_20d": r.mean("_ret_dn2", 20),
    }


def _risk_ratios() -> dict[str, str]:
    return {"vol_stability_20d": over("vol_5d", "vol_20d"),
            "vol_expansion_20d": over("vol_20d", "vol_60d") + " - 1"}


def _liquidity(r: Rolling) -> dict[str, str]:
    out = {f"amihud_{d}d": r.mean("_ill", d) for d in (5, 20)}
    out |= {f"turnover_{d}d": r.mean("_vb", d) for d in TURNOVER_SPANS}
    return out | {
        "turnover_std_20d": r.std("_vb", 20),
        "amount_shock_5d": over("amount", r.mean("amount", 20), 1.0),
        "liquidity_var": r.std("_aperc", 20),
        "turnover_ma_ratio_5_60": over(r.mean("turn", 5), r.mean("turn", 60)),
        "turnover_illuminated_20d": f"{r.mean('turn', 20)} * {r.std('_lr', 20)}",
        "amt_turn_corr_20d": r.corr("amount", "turn", 20),
    }


def _technical(r: Rolling) -> dict[str, str]:
    out = {f"pv_corr_{d}d": r.corr("close", "volume", d) for d in CORR_SPANS}
    out["ret_volume_corr_10d"] = r.corr("_ret", "volume", 10)
    out["high_low_volume_corr_10d"] = r.corr("_hl", "volume", 10)
    out["pv_divergence"] = f"{r.change('close', 10)} - {r.change('volume', 10)}"
    for d in BIAS_SPANS:
        ma = r.mean("close", d)
        out[f"bias_{d}d"] = over(f"(close - {ma})", ma)
        out[f"ma_cross_{d}d"] = over("close", ma) + " - 1"
    for d in RSI_SPANS:
        out[f"rsi_{d}"] = f"100 - 100 / (1 + {over(r.mean('_gain', d), r.mean('_loss', d))})"
    out["boll_width_20d"] = over(f"2 * {r.std('close', 20)}", r.mean("close", 20))
    return out


def _macd(df: DataFrame, r: Rolling) -> DataFrame:
    df = r.ewm(r.by_cells(df, "_pos", 26), {"_e12": ("close", 12), "_e26": ("close", 26)}, "_pos")
    df = with_exprs(df, {"macd_hist": "_e12 - _e26"})
    return r.ewm(df, {"macd_signal": ("macd_hist", 9)}, "_pos")


def label(r: Rolling, horizon: int = 1) -> str:
    """Forward return close[t+h] / close[t] - 1."""
    return f"try_divide({r.lead('close', horizon)}, close) - 1"


def _start(bars: DataFrame, r: Rolling, names: list[str], horizon: int) -> DataFrame:
    """Base columns; the exponential means come first, while rows are still narrow."""
    df = _base(bars, r, horizon)
    return _macd(df, r) if {"macd_hist", "macd_signal"} & set(names) else df


def finish(df: DataFrame, names: list[str], carry: tuple[str, ...]) -> DataFrame:
    """Drop halo rows and turn NaN and infinities into NULL."""
    return df.filter("NOT halo").selectExpr("date", "symbol", *carry, "forward_ret",
                         *[f"CASE WHEN abs({n}) < double('infinity') THEN {n} END AS {n}"
                           for n in names])


# Output order of the daily family (88 columns).
def daily_columns() -> list[str]:
    names = [f"ret_{d}d" for d in RETURN_SPANS] + [f"rev_{d}d" for d in RETURN_SPANS]
    names += ["mom_smooth_20d", "info_discrete_20d"] + [f"vol_{d}d" for d in VOL_SPANS]
    names += ["skew_20d", "kurt_20d", "vol_skew_ratio", "max_ret_20d", "min_ret_20d",
              "extreme_vol_20d", "parkinson_vol_20d", "ivol_20d", "amihud_5d", "amihud_20d"]
    names += [f"turnover_{d}d" for d in TURNOVER_SPANS]
    names += ["turnover_std_20d", "illiq_spread", "volume_shock_5d", "amount_shock_5d",
              "liquidity_var", "clv", "upper_shadow", "lower_shadow", "body_ratio", "gap",
              "smart_money_10d", "smart_money_20d", "vwap_dev_5d", "vwap_dev_20d",
              "intraday_mom", "price_accel"]
    names += [f"{p}_{d}d" for d in CORR_SPANS for p in ("pv_corr", "logpv_corr")]
    names += ["obv_slope_10d", "money_flow_10d", "money_flow_20d", "pv_divergence"]
    names += [f"{p}_{d}d" for d in BIAS_SPANS for p in ("bias", "ma_cross")]
    names += [f"rsi_{d}" for d in RSI_SPANS]
    names += ["macd_hist", "macd_signal", "boll_width_20d", "turnover_std_5d",
              "turnover_decay_20d", "turnover_skew_20d", "turnover_ma_ratio_5_60",
              "turnover_illuminated_20d", "amt_turn_corr_20d", "volume_std_5d",
              "close_volume_corr_change_10d", "volume_skew_20d", "ret_volume_corr_10d",
              "high_low_volume_corr_10d", "vol_stability_20d", "downside_vol_20d",
              "vol_expansion_20d", "resid_vol_20d"]
    return names


def daily_features(bars: DataFrame, carry: tuple[str, ...] = (), horizon: int = 1,
                   only: list[str] | None = None) -> DataFrame:
    """Blocked bars to the 88 daily features plus ``forward_ret``.

    ``only`` names the wanted features; Catalyst then prunes the other windows.
    """
    r = Rolling()
    names = daily_columns() if only is None else list(only)
    df = _start(bars, r, names, horizon)
    typical = "((high + low + open + close) / 4)"
    df = with_exprs(df, {
        "clv": div("2 * close - high - low", "_hl"),
        "upper_shadow": div("high - greatest(close, open)", "_hl"),
        "lower_shadow": div("least(close, open) - low", "_hl"),
        "body_ratio": div("abs(close - open)", "_hl"),
        "gap": over("(open - _pc)", "_pc"),
        "illiq_spread": div("high - low", "close"),
        "intraday_mom": over(f"(close - {typical})", typical),
        "_dev": over("(close - _vwap)", "close"),
        "_signed": "signum(_dc) * volume",
    })
    # inputs of second-level frames, while rows are narrow; then one wide pass for the rest
    df = r.add(with_exprs(df, {"_flow": "clv * volume"}), {
        "_obv": r.cumulative("_signed"), "_xlr": f"_lr - {r.mean('_lr', 20)}",
        "_cvc10": r.corr("close", "volume", 10), "turn_prev": r.lag("turn")})
    df = r.add(df, _momentum(r) | _risk(r) | _liquidity(r) | _technical(r) | {
        "vol_skew_ratio": f"({r.std('_lr_dn', 20)} * {YEAR}) / ({r.std('_lr_up', 20)} * {YEAR} + 1e-8D)",
        "turnover_std_5d": r.std("turn", 5),
        "turnover_skew_20d": r.skew("turn", 20),
        "volume_skew_20d": r.skew("volume", 20),
        **{f"logpv_corr_{d}d": r.corr("_lr", "_lnv", d) for d in CORR_SPANS},
        "money_flow_10d": r.total("_flow", 10), "money_flow_20d": r.total("_flow", 20),
        "smart_money_10d": r.total("_dev", 10), "smart_money_20d": r.total("_dev", 20),
        "vwap_dev_5d": r.mean("_dev", 5), "vwap_dev_20d": r.mean("_dev", 20),
        "price_accel": r.diff("_ret"),
        "volume_std_5d": r.std("volume_shock_5d", 5),
        "ivol_20d": f"{r.std('_xlr', 20)} * {YEAR}",
        "turnover_decay_20d": r.autocorr("turn", 20),
        "obv_slope_10d": r.slope("_obv", "_pos", 10),
        "close_volume_corr_change_10d": r.diff("_cvc10", 5),
    })
    df = with_exprs(df, _risk_ratios() | {"resid_vol_20d": "ivol_20d",
                                          "extreme_vol_20d": "max_ret_20d - min_ret_20d"})
    return finish(df, names, carry)


def rank_features(bars: DataFrame, heavy: bool | None = None,
                  settings: Settings = DEFAULTS) -> DataFrame:
    """The 13 optional columns: centred per-date ranks and interaction terms."""
    need = [*RANKED, "vol_5d"]
    feats = daily_features(bars, only=need).drop("forward_ret")
    r = Rolling()
    df = with_exprs(time_blocks(feats, settings), {"_up5": "CASE WHEN ret_1d > 0.05D THEN 1D ELSE 0D END",
                            "_down5": "CASE WHEN ret_1d < -0.05D THEN 1D ELSE 0D END"})
    df = r.add(df, {
        "vol_cone_5_20": "vol_5d / (vol_20d + 1e-8D)",
        "pv_div_accel": r.diff("pv_divergence", 5),
        "body_ratio_mom": r.diff("body_ratio", 5),
        "extreme_up_days_5d": f"{r.total('_up5', 5, 1)} / 5",
        "extreme_down_days_5d": f"{r.total('_down5', 5, 1)} / 5",
    })
    df = df.filter("NOT halo").select([c for c in df.columns if not c.startswith("_") and c not in ("blk", "halo")])
    return xs.percent_rank(df, RANKED, "rank_", ("date",), centred=True, heavy=heavy,
                           settings=settings).drop(*need)


def market_return(bars: DataFrame, heavy: bool | None = None,
                  settings: Settings = DEFAULTS) -> DataFrame:
    """Median simple return per date."""
    r = Rolling()
    rets = r.add(bars, {"_ret": r.change("close", 1)}).filter("NOT halo").select("date", "_ret")
    return xs.quantiles(rets, ["date"], "_ret", [0.5], "_q", heavy, settings).select(
        "date", F.col("_q")[0].alias("market_ret"))


def equal_weight_index(bars: DataFrame) -> DataFrame:
    """Index bars: per-date mean of every price and volume column."""
    return (bars.filter("NOT halo").groupBy("date")
            .agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")]))


def large_cap_columns() -> list[str]:
    names = [f"ret_{d}d" for d in RETURN_SPANS] + [f"rev_{d}d" for d in RETURN_SPANS]
    names += ["body_ratio"] + [f"vol_{d}d" for d in VOL_SPANS]
    names += ["parkinson_vol_20d", "vol_skew_ratio", "vol_stability_20d", "vol_expansion_20d",
              "downside_vol_20d", "skew_20d", "kurt_20d", "max_ret_20d", "min_ret_20d",
              "amihud_5d", "amihud_20d"]
    names += [f"turnover_{d}d" for d in TURNOVER_SPANS]
    names += ["turnover_std_20d", "turnover_ma_ratio_5_60", "turnover_illuminated_20d",
              "amt_turn_corr_20d", "illiq_spread", "volume_shock_5d", "amount_shock_5d",
              "liquidity_var", "volume_std_5d", "amt_concentration_20d", "amihud_ratio_5_20"]
    names += [f"pv_corr_{d}d" for d in CORR_SPANS]
    names += ["ret_volume_corr_10d", "high_low_volume_corr_10d", "pv_divergence", "vol_lead_corr_10d"]
    names += [f"{p}_{d}d" for d in BIAS_SPANS for p in ("bias", "ma_cross")]
    names += [f"rsi_{d}" for d in RSI_SPANS]
    names += ["macd_hist", "macd_signal", "boll_width_20d", "boll_pctb_20d", "cci_20d",
              "williams_r_14d", "excess_ret_5d", "excess_ret_20d", "excess_ret_60d",
              "relative_strength_20d", "market_beta_60d", "info_discrete_20d", "mom_smooth_20d",
              "sharpe_60d", "max_drawdown_60d", "gain_loss_60d", "rolling_alpha_60d",
              "rolling_alpha_120d", "rolling_alpha_250d", "market_beta_120d",
              "beta_stability_60d", "ivol_60d", "rsrs_20d", "obv_trend_20d", "mfi_14d",
              "overnight_ret_20d", "intraday_ret_20d", "close_vwap_dev_20d",
              "open_efficiency_20d", "idio_ret_20d", "amt_mom_20d", "pv_cov_20d", "var_95_20d",
              "turnover_mom_20d", "turnover_vol_20d"]
    return names


def large_cap_raw(bars: DataFrame, carry: tuple[str, ...] = (), horizon: int = 1,
                  heavy: bool | None = None, settings: Settings = DEFAULTS,
                  only: list[str] | None = None, market: DataFrame | None = None) -> DataFrame:
    """Blocked bars to the 97 large-cap features before the per-date standardisation; ``market``: :func:`market_return`, if written."""
    r = Rolling()
    names = large_cap_columns() if only is None else list(only)
    # one market value per date: bounded by the calendar, broadcast only if Spark finds it small
    market = market_return(bars, heavy, settings) if market is None else market
    df = _start(bars.join(market, "date", "left"), r, names, horizon)
    df = with_exprs(df, {
        "body_ratio": div("abs(close - open)", "_hl"),
        "illiq_spread": over("_hl", "close"),
        "_tp": "(high + low + close) / 3",
        "_signed": "coalesce(signum(_dc), 0D) * volume",
        "_ret_up": at_least("_ret", 0), "_ret_dn": f"-{at_most('_ret', 0)}",
        "_over": over("open", "_pc") + " - 1", "_intra": over("close", "open") + " - 1",
        "_cvw": over("(close - _vwap)", "_vwap"), "_eff": over("(close - open)", "open"),
    })
    # inputs of second-level frames, while rows are narrow; then one wide pass for the rest
    df = r.add(df, {
        "_pv": r.lag("volume"), "_top60": r.top("close", 60), "_obv": r.cumulative("_signed"),
        "_dtp": r.diff("_tp"), "_mf": "_tp * volume",
        "market_beta_60d": over(r.cov("_ret", "market_ret", 60), r.var("market_ret", 60)),
        "rolling_alpha_60d": r.intercept("_ret", "market_ret", 60)})
    df = with_exprs(df, {
        "_dd": div("close", "_top60") + " - 1",
        "_res60": "_ret - (market_beta_60d * market_ret + rolling_alpha_60d)",
        "_mfp": "CASE WHEN _dtp > 0 THEN _mf ELSE 0D END",
        "_mfn": "CASE WHEN _dtp < 0 THEN _mf ELSE 0D END",
    })
    h14, l14 = r.top("high", 14), r.bottom("low", 14)
    df = r.add(df, _momentum(r) | _risk(r) | _liquidity(r) | _technical(r) | {
        "vol_skew_ratio": f"{r.std('_lr_dn', 20)} / ({r.std('_lr_up', 20)} + 1e-8D)",
        "_mid": r.mean("close", 20), "_sd": r.std("close", 20), "_h14": h14, "_l14": l14,
        "_amounts": f"CASE WHEN {r.count('amount', 20)} >= 20 THEN sort_array({r.values('amount', 20)}, false) END",
        "_lrs": f"CASE WHEN {r.count('_lr', 20)} >= 20 THEN sort_array({r.values('_lr', 20)}) END",
        "market_beta_120d": r.slope("_ret", "market_ret", 120),
        **{f"rolling_alpha_{d}d": r.intercept("_ret", "market_ret", d) for d in (120, 250)},
        "cci_20d": f"(_tp - {r.mean('_tp', 20)}) / (0.015D * {at_least(r.std('_tp', 20), 1e-8)})",
        "sharpe_60d": over(r.mean("_ret", 60), r.std("_ret", 60)),
        "gain_loss_60d": over(r.total("_ret_up", 60), r.total("_ret_dn", 60)),
        "rsrs_20d": f"{r.slope('high', 'low', 20)} * coalesce({r.r2('high', 'low', 20)}, 0D)",
        "overnight_ret_20d": r.mean("_over", 20), "intraday_ret_20d": r.mean("_intra", 20),
        "close_vwap_dev_20d": r.mean("_cvw", 20), "open_efficiency_20d": r.std("_eff", 20),
        "idio_ret_20d": r.residual("_ret", "market_ret", 20),
        "amt_mom_20d": over(r.mean("amount", 20), r.mean("amount", 60)),
        "pv_cov_20d": r.cov("_ret", "_lnv", 20),
        "turnover_mom_20d": over("turn", r.lag("turn", 20)) + " - 1",
        "turnover_vol_20d": over(r.std("turn", 20), r.mean("turn", 20)),
        **{f"_g{d}": f"exp({r.total('_lr', d)})" for d in (5, 20, 60)},
        **{f"_k{d}": f"exp({r.total('market_ret', d)})" for d in (5, 20, 60)},
        "volume_std_5d": r.std("volume_shock_5d", 5),
        "vol_lead_corr_10d": r.corr("_pv", "_ret", 10),
        "max_drawdown_60d": r.bottom("_dd", 60),
        "ivol_60d": f"{r.std('_res60', 60)} * {YEAR}",
        "obv_trend_20d": r.trend_strength("_obv", "_pos", 20),
        "mfi_14d": f"100 - 100 / (1 + {over(r.total('_mfp', 14, 1), r.total('_mfn', 14, 1))})",
    })
    df = with_exprs(df, {"_band": at_least("(4 * _sd)", 1e-8)})
    df = with_exprs(df, _risk_ratios() | {
        "amt_concentration_20d": top_share("_amounts", 5),
        "amihud_ratio_5_20": over("amihud_5d", "amihud_20d"),
        "boll_pctb_20d": "(close - (_mid - 2 * _sd)) / _band",
        "williams_r_14d": over("(_h14 - close)", "(_h14 - _l14)") + " * -100",
        **{f"excess_ret_{d}d": f"_g{d} - _k{d}" for d in (5, 20, 60)},
        "relative_strength_20d": div("_g20 - 1", f"{at_least('_k20', 1e-8)} - 1 + 1e-8D"),
        "beta_stability_60d": over("market_beta_60d", "market_beta_120d"),
        "var_95_20d": sorted_quantile("_lrs", 0.05),
    })
    return finish(df, names, carry)


def large_cap_features(bars: DataFrame, carry: tuple[str, ...] = (), horizon: int = 1,
                       heavy: bool | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """The 97 large-cap features, filled, clipped and z-scored per date.

    Dates of ordinary size read the raw panel once, behind the exchange, or compute it again for each pass over some of its
    columns if there is much of it; the way of larger dates writes it where it starts.
    """
    market = None
    if 8 * len(large_cap_columns()) * bars.count() > settings.wide_bytes:
        # several passes over the features: they share the market's values, and bars need not go to a table seen to be small
        market = write_out(market_return(bars, heavy, settings), "market")
    raw = large_cap_raw(bars, carry, horizon, heavy, settings, market=market)
    return xs.fill_clip_zscore_wide(raw, large_cap_columns(), ("date",), 3.0, heavy, settings)
