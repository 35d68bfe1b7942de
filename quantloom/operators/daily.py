"""Cross sections of many factors at once.

Long rows, one per factor, would cross the network once per row and factor for every ranking. Here the wide rows of
a date cross it once, and each date's factors are ranked, regressed and cut into buckets where they lie; one row per
(factor, date) leaves. It is meant for dates of at most ``heavy_group_rows`` rows, which callers check by a count; the
operators on long panels split larger ones.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

N_GROUPS = 5  # fixed value: buckets of the research protocol


def centred_ranks(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Average-tie ranks less their mean; ``order`` sorts ``x``, NaN last and equal to itself."""
    s = x[order]
    same = (s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1]))
    start = np.flatnonzero(np.r_[True, ~same])
    end = np.r_[start[1:], len(s)]
    out = np.empty(len(x))
    out[order] = np.repeat((start + end - len(s)) / 2, end - start)
    return out


def residual(y: np.ndarray, z: np.ndarray | None, min_rows: int) -> np.ndarray:
    """``y`` less its regression on a constant and ``z``; as it is without ``z`` or below ``min_rows`` rows."""
    if z is None or len(y) < min_rows:
        return y
    dz, dy = z - z.mean(), y - y.mean()
    v = dz @ dz
    return dy - (dz @ dy / v if v > 0 else 0.0) * dz


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, which are not NULL); a NaN is a value."""
    c = table.column(name)
    return c.to_numpy().astype(float), c.is_valid().to_numpy()


def _buckets(x: np.ndarray, ordered: np.ndarray, y: np.ndarray):
    at = (len(x) - 1) * np.array([i / N_GROUPS for i in range(N_GROUPS)])
    lo, hi = ordered[np.floor(at).astype(int)], ordered[np.ceil(at).astype(int)]
    edges = np.where(lo == hi, lo, lo + (hi - lo) * (at - np.floor(at)))
    bucket = np.searchsorted(np.unique(edges[edges > edges[0]]), x, side="left")
    n, total = np.bincount(bucket), np.bincount(bucket, weights=y)
    return [{"bucket": int(b), "n": int(n[b]), "total": float(total[b])} for b in np.flatnonzero(n)]


_SECTION = pa.schema([
    ("fid", pa.string()), ("n", pa.int64()), ("mx", pa.float64()), ("vx", pa.float64()), ("vy", pa.float64()), ("c", pa.float64()),
    ("ic", pa.float64()), ("ls", pa.float64()),
    ("buckets", pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64()), ("total", pa.float64())])))])
_SECTION_DDL = ("fid string, n long, mx double, vx double, vy double, c double, ic double, ls double, "
                "buckets array<struct<bucket:int,n:long,total:double>>")


def _section(fid: str, x: np.ndarray, y: np.ndarray, q: float) -> dict:
    """One factor on one date; rows come in the order of symbols, which breaks ties of the long and the short side."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    rx, ry = centred_ranks(x, order), centred_ranks(y, np.argsort(y, kind="stable"))
    spread = np.sqrt((rx @ rx) * (ry @ ry))
    cut = max(int(np.floor(n * q)), 1)
    dx, dy = x - x.mean(), y - y.mean()
    return {"fid": fid, "n": n, "mx": float(x.mean()), "vx": float(dx @ dx / n), "vy": float(dy @ dy / n), "c": float(dx @ dy / n),
            "ic": float(rx @ ry / spread) if spread > 0 else None,
            "ls": float(y[order[n - cut:]].mean() - y[order[:cut]].mean()), "buckets": _buckets(x, x[order], y)}


def sections(df: DataFrame, factors: Sequence[str], ret: str = "ret", size: str | None = None,
             min_neutral: int = 30, q: float = 0.2) -> DataFrame:
    """(date, fid, n, mx, vx, vy, c, ic, ls, buckets) of the rows where factor and return (and size) exist.

    ``mx``, ``vx``, ``vy``, ``c``: mean, variances and covariance; ``ic``: correlation of average ranks, NULL for a flat
    side; ``ls``: mean return of the top share ``q`` less that of the bottom; ``buckets``: returns by quantile bucket.
    With ``size``, factor and return are residuals on it. ``df`` has date, symbol and these columns.
    """
    factors, rest = list(factors), [c for c in (ret, size) if c]
    kind = dict(df.dtypes)["date"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("symbol")
        y, there = _column(table, ret)
        z = None
        if size:
            z, sized = _column(table, size)
            there = there & sized
        rows = []
        for f in factors:
            x, own = _column(table, f)
            own = own & there
            if own.any():
                c = z[own] if size else None
                with np.errstate(all="ignore"):
                    rows.append(_section(f, residual(x[own], c, min_neutral), residual(y[own], c, min_neutral), q))
        done = pa.Table.from_pylist(rows, _SECTION)
        day = pa.array([table.column("date")[0].as_py()] * len(rows), table.schema.field("date").type)
        return done.add_column(0, "date", day)
    return df.select("date", "symbol", *rest, *factors).groupBy("date").applyInArrow(run, f"date {kind}, {_SECTION_DDL}")


def scores(df: DataFrame, factors: Sequence[str], ret: str = "ret", size: str = "ln_amt", min_neutral: int = 30,
           eps: float = 1e-12) -> DataFrame:
    """(date, symbol, ret, factors): per-date z-scores of the factors' residuals on size; NULL where either is missing."""
    factors = list(factors)
    kinds = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        z, sized = _column(table, size)
        done = {c: table.column(c) for c in ("date", "symbol", ret)}
        for f in factors:
            x, own = _column(table, f)
            own = own & sized
            out = np.zeros(len(x))
            if own.any():
                r = residual(x[own], z[own], min_neutral)
                d = r - r.mean()
                out[own] = d / (np.sqrt(d @ d / len(d)) + eps)
            done[f] = pa.array(out, pa.float64(), mask=~own)
        return pa.table(done)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("date", "symbol", ret)] + [f"`{f}` double" for f in factors])
    return df.select("date", "symbol", ret, size, *factors).groupBy("date").applyInArrow(run, schema)


def ics(days: DataFrame, min_rows: int = 31) -> DataFrame:
    """(fid, date, n, ic) of :func:`sections`, as :func:`xsection.rank_ic` gives it."""
    return days.filter(F.col("n") >= min_rows).select("fid", "date", "n", "ic")


def long_short(days: DataFrame, min_rows: int = 30) -> DataFrame:
    """(fid, date, ls, n) of :func:`sections`, as :func:`xsection.long_short_by_count` gives it."""
    return days.filter(F.col("n") >= min_rows).select("fid", "date", "ls", "n")
