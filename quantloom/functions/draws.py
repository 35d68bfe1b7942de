"""Random draws as column expressions: a hash of (seed, resample, counter), so any engine, task or retry repeats them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX_52 = 13  # hex digits of a 52-bit number, which a double holds exactly


def digest(*parts) -> Column:
    """64 hex digits that depend on all parts, which are joined by colons."""
    return F.sha2(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def number(h: Column, start: int, digits: int) -> Column:
    return F.conv(F.substr(h, F.lit(start + 1), F.lit(digits)), 16, 10).cast("bigint")


def uniform(h: Column, at: int = 0) -> Column:
    """The ``at``-th of four numbers of [0, 1) in a digest."""
    return number(h, at * _HEX_52, _HEX_52) / F.lit(float(1 << 52))


def below(h: Column, n: Column, at: int = 0) -> Column:
    """The ``at``-th of eight integers of [0, n) in a digest; n below 2**31."""
    return F.shiftright(number(h, 8 * at, 8) * n.cast("bigint"), 32)
