import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import combine, daily, inference, xsection as xs

NAMES = ["f", "g"]


@pytest.fixture(scope="module")
def panel(spark):
    """Dates of 60, 33 and 20 rows with ties, NULLs and a flat factor."""
    rng = random.Random(3)
    rows = [(f"2020-01-0{d + 1}", f"s{i:03d}", rng.gauss(0, 1), rng.gauss(5, 1), None if rng.random() < 0.1 else float(rng.randint(0, 9)),
             1.5 if d == 1 else rng.gauss(0, 1)) for d, n in enumerate((60, 33, 20)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "date string, symbol string, ret double, ln_amt double, f double, g double").withColumn("date", F.to_date("date"))


def values(df, keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def alike(a, b, keys):
    a, b = values(a, keys), values(b, keys)
    assert a.keys() == b.keys() and a
    for k, row in b.items():
        for c, want in row.items():
            got = a[k][c]
            assert got == want if want is None or isinstance(want, str) or c in keys else np.isclose(got, want, rtol=1e-9, atol=1e-11), (k, c, got, want)


@pytest.mark.parametrize("size", [None, "ln_amt"])
def test_sections_equal_the_operators_on_long_rows(spark, panel, size):
    long = xs.melt(panel, NAMES, ["date", "symbol", "ret", "ln_amt"])
    if size:
        long = xs.neutralise(long, ["x", "ret"], ["ln_amt"])
    days = daily.sections(panel, NAMES, size=size)
    if not size:  # residuals of a flat factor are rounding noise, whose ranks mean nothing
        alike(daily.ics(days, 20), xs.rank_ic(long, min_rows=20), ("fid", "date"))
        alike(daily.long_short(days, 20), xs.long_short_by_count(long, min_rows=20), ("fid", "date"))
    own = "fid = 'f'"
    alike(daily.ics(days, 20).filter(own), xs.rank_ic(long.filter(own), min_rows=20), ("fid", "date"))
    few = {"min_stocks": 2, "min_periods": 2}
    alike(inference.fama_macbeth_daily(days.filter(own), **few), inference.fama_macbeth(long.filter(own), **few), ("fid",))


def test_sections_move_a_row_once_for_all_factors(panel):
    plan = daily.sections(panel, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_scores_and_their_combination_equal_the_long_form(spark, panel):
    wide = combine.aligned_wide(daily.scores(panel, ["f"]), ["f"])
    long = combine.aligned(xs.neutralise(xs.melt(panel, ["f"], ["date", "symbol", "ret", "ln_amt"]), ["x"], ["ln_amt"]))
    alike(wide.filter("f IS NOT NULL").select("date", "symbol", F.col("f").alias("x")), long.select("date", "symbol", "x"), ("date", "symbol"))
    alike(combine.equal_weight_wide(wide, ["f"], "x").select("date", "symbol", "x"), combine.equal_weight(long).select("date", "symbol", "x"), ("date", "symbol"))


def test_candidates_are_formed_behind_the_exchange(panel):
    from quantloom.functions import formula
    near = panel.repartition("date").sortWithinPartitions("date")
    wide = formula.evaluate(near, {f"c{i}": f"f * {i}" for i in range(9)}, ["date", "symbol", "ret"])
    plan = daily.sections(wide, [f"c{i}" for i in range(9)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    assert plan.count("Sort [date") == 1
