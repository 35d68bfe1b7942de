import math
import random

import pytest

from quantloom.operators import xsection as xs
from quantloom.settings import Settings


def test_columns_in_passes_are_those_of_one_exchange(spark):
    """More values than may cross the network at once go by some columns a pass; before, all went at once."""
    rng = random.Random(3)
    rows = []
    for k in range(900):
        day = [None, 1, 2, 3][k % 4] if k else 9  # a null group, and one of a single row
        rows.append((day, f"s{k}", *[None if rng.random() < 0.1 else rng.lognormvariate(0, 2) for _ in range(4)], 2.5, None, math.nan if k % 9 else 1.0))
    cols = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame(rows, "day int, symbol string, " + ", ".join(f"{c} double" for c in cols))
    want = {(r.day, r.symbol): r for r in xs.fill_clip_zscore_wide(df, cols, ("day",), 3.0, False).collect()}
    small = Settings(wide_bytes=8 * 900 * 3)
    out = xs.fill_clip_zscore_wide(df, cols, ("day",), 3.0, False, small)
    assert out.columns == ["day", "symbol", *cols]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan  # rows stay where they are
    got = {(r.day, r.symbol): r for r in out.collect()}
    assert got.keys() == want.keys() and len(got) == 900
    for k in want:
        for a, b in zip(got[k], want[k]):
            assert a == b or a == pytest.approx(b, rel=1e-9, abs=1e-12), (k, got[k], want[k])
