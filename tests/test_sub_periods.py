import pytest

from quantloom.catalog import base, studies
from quantloom.operators import inference


def test_sub_periods_need_no_neutral_panel(spark, monkeypatch):
    """Before, every factor's rows of the panel were made neutral, written and sent for each step."""
    sf = "/root/testdata/sf0.01"
    want = sorted(map(tuple, studies.fm_out(inference.segment_fm(base.neutral_panel(spark, sf), studies.segments(spark, sf), heavy=False), ("fid", "segment")).collect()))

    def none(*_):
        raise AssertionError("the neutral panel was built")
    monkeypatch.setattr(studies, "neutral_panel", none)
    got = sorted(map(tuple, studies.C.queries["sub_period_metrics"](spark, sf).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2:] == pytest.approx(b[2:], rel=1e-9, abs=2e-6)
