"""The 158-column bar feature set: candle shape, price ratios and 29 rolling families."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quantloom.functions.framed import Frame, add_frames
from quantloom.functions.rolling import Rolling, at_least, at_most, div, lit, over, with_exprs
from quantloom.plans.series import finish, label

EPS = 1e-12
SPANS = (5, 10, 20, 30, 60)  # fixed values
BOUND = 1e3

# Names of the families, in output order.
CANDLE = ("KMID", "KLEN", "KMID2", "KUP", "KUP2", "KLOW", "KLOW2", "KSFT", "KSFT2")
PRICE = ("OPEN0", "HIGH0", "LOW0", "VWAP0")
FAMILIES = ("ROC", "MA", "STD", "BETA", "RSQR", "RESI", "MAX", "MIN", "QTLU", "QTLD", "RANK",
            "RSV", "IMAX", "IMIN", "IMXD", "CORR", "CORD", "CNTP", "CNTN", "CNTD", "SUMP",
            "SUMN", "SUMD", "VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD")


def columns() -> list[str]:
    return [*CANDLE, *PRICE, *[f"{f}{d}" for d in SPANS for f in FAMILIES]]


def features158(bars: DataFrame, carry: tuple[str, ...] = (), horizon: int = 1,
                only: list[str] | None = None) -> DataFrame:
    """Blocked bars to the 158 features plus ``forward_ret``; frames need one value."""
    r = Rolling()
    # before the windows, while rows are narrow
    bars = add_frames(bars, {n: f for d in SPANS for n, f in {
        f"_hi{d}": Frame("max", "high", d), f"_lo{d}": Frame("min", "low", d), f"_ah{d}": Frame("argmax", "high", d),
        f"_al{d}": Frame("argmin", "low", d), f"_qu{d}": Frame("quantile", "close", d, 0.8), f"_qd{d}": Frame("quantile", "close", d, 0.2),
        f"_rk{d}": Frame("rank", "close", d)}.items()})
    df = r.add(bars, {
        "forward_ret": label(r, horizon), "_pc": r.lag("close"), "_pv": r.lag("volume"), "_pos": r.position(),
        "_fc": at_least("close", EPS), "_fo": at_least("open", EPS),
    })
    df = with_exprs(df, {
        "_dc": "close - _pc", "_dv": "volume - _pv",
        "_lv": f"ln({at_least('volume', EPS)} + 1)",
        "_lvc": f"ln({over('volume', '_pv', EPS)} + 1)",
        "_wv": f"abs({over('close', '_pc', EPS)} - 1) * volume",
        "_range": f"(high - low + {lit(EPS)})",
    })
    df = with_exprs(df, {
        "_up": at_least("_dc", 0), "_dn": f"-{at_most('_dc', 0)}", "_ab": "abs(_dc)",
        "_vup": at_least("_dv", 0), "_vdn": f"-{at_most('_dv', 0)}", "_vab": "abs(_dv)",
        "_isup": "CASE WHEN _dc > 0 THEN 1D ELSE 0D END",
        "_isdn": "CASE WHEN _dc < 0 THEN 1D ELSE 0D END",
        "_cx": "CASE WHEN _lvc IS NOT NULL THEN close END",
        "KMID": div("2 * close - high - low", "_fo"), "KLEN": div("high - low", "_fo"),
        "KMID2": div("close - open", "_range"), "KUP": div("high - greatest(open, close)", "_fo"),
        "KUP2": div("high - greatest(open, close)", "_range"),
        "KLOW": div("least(open, close) - low", "_fo"),
        "KLOW2": div("least(open, close) - low", "_range"),
        "KSFT": div("2 * close - high - low", "_fo"),
        "KSFT2": div("2 * close - high - low", "_range"),
        "OPEN0": div("open", "_fc"), "HIGH0": div("high", "_fc"), "LOW0": div("low", "_fc"),
        "VWAP0": div(over("amount", "volume", EPS), "_fc"),
    })
    families = {}
    for d in SPANS:
        families |= _family(r, d)
    df = r.add(df, families)
    df = with_exprs(df, {n: e for d in SPANS for n, e in {
        f"IMXD{d}": f"(IMAX{d} - IMIN{d}) / {d}", f"CNTD{d}": f"CNTP{d} - CNTN{d}",
        f"SUMD{d}": f"SUMP{d} - SUMN{d}", f"VSUMD{d}": f"VSUMP{d} - VSUMN{d}"}.items()})
    names = columns() if only is None else list(only)
    out = finish(df, names, carry)
    fixed = [c for c in out.columns if c not in names]
    return out.selectExpr(*fixed, *[f"{at_most(at_least(n, -BOUND), BOUND)} AS {n}" for n in names])


def _family(r: Rolling, d: int) -> dict[str, str]:
    eps = lit(EPS)
    hi, lo = f"_hi{d}", f"_lo{d}"
    full = f"{r.count('close', max(SPANS))} >= {d}"
    return {
        f"ROC{d}": div(r.lag("close", d), "_fc"),
        f"MA{d}": div(r.mean("close", d, 1), "_fc"),
        f"STD{d}": div(r.std("close", d, 1), "_fc"),
        f"BETA{d}": div(r.slope("close", "_pos", d), "close"),
        f"RSQR{d}": r.r2("close", "_pos", d),
        f"RESI{d}": div(r.residual("close", "_pos", d), "close"),
        f"MAX{d}": div(hi, "_fc"), f"MIN{d}": div(lo, "_fc"),
        f"QTLU{d}": div(f"_qu{d}", "_fc"),
        f"QTLD{d}": div(f"_qd{d}", "_fc"),
        f"RANK{d}": f"_rk{d}",
        f"RSV{d}": div(f"close - {lo}", f"{hi} - {lo} + {eps}"),
        f"IMAX{d}": f"CASE WHEN {full} THEN _ah{d} END / {d}",
        f"IMIN{d}": f"CASE WHEN {full} THEN _al{d} END / {d}",
        f"CORR{d}": f"coalesce({r.corr_any('close', '_lv', d)}, 0D)",
        f"CORD{d}": f"coalesce({r.corr_any('_cx', '_lvc', d)}, 0D)",
        f"CNTP{d}": r.mean("_isup", d, 1), f"CNTN{d}": r.mean("_isdn", d, 1),
        f"SUMP{d}": div(r.total("_up", d, 1), f"{r.total('_ab', d, 1)} + {eps}"),
        f"SUMN{d}": div(r.total("_dn", d, 1), f"{r.total('_ab', d, 1)} + {eps}"),
        f"VMA{d}": div(r.mean("volume", d, 1), f"volume + {eps}"),
        f"VSTD{d}": div(r.std("volume", d, 1), f"volume + {eps}"),
        f"WVMA{d}": div(r.std("_wv", d, 1), f"{r.mean('_wv', d, 1)} + {eps}"),
        f"VSUMP{d}": div(r.total("_vup", d, 1), f"{r.total('_vab', d, 1)} + {eps}"),
        f"VSUMN{d}": div(r.total("_vdn", d, 1), f"{r.total('_vab', d, 1)} + {eps}"),
    }
