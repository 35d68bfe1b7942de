"""What queries write and send on the way to their result."""

import numpy as np
import pytest

from quantloom.operators import xsection as xs
from quantloom.settings import Settings


@pytest.fixture()
def written(monkeypatch):
    """(name, rows) of every table that cross-section operators write."""
    found, write_out = [], xs.write_out

    def run(df, name="stage"):
        out = write_out(df, name)
        found.append((name, out.count()))
        return out
    monkeypatch.setattr(xs, "write_out", run)
    return found


def test_quantiles_of_heavy_groups_write_few_rows(spark, written):
    """Before, all rows were written twice, and again for the deviations."""
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.lognormal(0, 4, 6000), -rng.lognormal(0, 4, 6000)))
    rows = [("a", float(v)) for v in x] + [("b", float(v)) for v in rng.normal(1e6, 1, 50)] + [("c", None)] * 3 + [(None, 1.0)]
    df = spark.createDataFrame(rows, "fid string, x double").repartition(6)
    got = {r.fid: r for r in xs.mad_bounds(df, ["fid"], "x", 5.0, None, Settings(heavy_group_rows=1000)).collect()}
    assert set(got) == {"a", "b"}
    for k in "ab":
        v = np.array([b for a, b in rows if a == k])
        m = np.median(v)
        half = 5 * xs.MAD_SCALE * np.median(np.abs(v - m))
        assert (got[k].median, got[k].lo, got[k].hi) == pytest.approx((m, m - half, m + half), rel=1e-12)
    assert sum(n for _, n in written) < len(x), written


def test_equal_values_of_a_heavy_group(spark):
    df = spark.createDataFrame([("a", 2.5)] * 4000 + [("a", 0.0)], "fid string, x double")
    (r,) = xs.mad_bounds(df, ["fid"], "x", 5.0, None, Settings(heavy_group_rows=1000)).collect()
    assert (r.median, r.lo, r.hi) == (2.5, 2.5, 2.5)
