"""Breadth of a market across symbols."""

import datetime as dt

import numpy as np
import pytest

from quantloom.plans import timing


def test_mean_pair_correlation_forms_no_row_per_return(spark):
    rng = np.random.default_rng(8)
    days = {dt.date(2020, 1, 1): 12, dt.date(2020, 1, 2): 30, dt.date(2020, 1, 3): 9}
    frames = {d: rng.normal(size=(n, 60)) + rng.normal(size=60) for d, n in days.items()}
    rows = [(d, v.tolist()) for d, m in frames.items() for v in m] + [(d, [0.1] * 60) for d in days] + [(d, [1.0] * 59) for d in days]
    rng.shuffle(rows)
    stocks = spark.createDataFrame(rows, "date date, _last array<double>").repartition(3)
    out = timing.mean_pair_correlation(stocks)
    got = {r.date: r.high_low_corr_20d for r in out.collect()}
    for d, m in frames.items():
        n = len(m)
        want = (np.corrcoef(m).sum() - n) / (n * (n - 1))
        assert got[d] == (pytest.approx(want) if n >= 10 else None)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert timing.mean_pair_correlation(stocks.limit(0)).count() == 0
