"""Inference, splits, backtest, formulas and resampling on small fixtures."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import formula
from quantloom.functions.exprs import normal_quantile, normal_tail, t_two_sided
from quantloom.operators import backtest, combine, gates, inference, models, splits, xsection as xs
from quantloom.settings import Settings


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    days = pd.bdate_range("2021-01-04", "2021-06-30")
    rows = []
    for i in range(60):
        c = 20 * np.exp(np.cumsum(rng.normal(0, 0.04, len(days))))
        o = c * (1 + rng.normal(0, 0.05, len(days)))
        x = np.round(rng.normal(0, 1, len(days)), 1)
        for j, d in enumerate(days):
            if rng.random() < 0.03:
                continue  # absent bar
            rows.append(("f", d.date(), f"s{i:02d}", x[j], float(rng.normal(0, 0.02) + 0.002 * x[j]), o[j], c[j]))
    pdf = pd.DataFrame(rows, columns=["fid", "date", "symbol", "x", "ret", "open", "close"])
    return pdf, spark.createDataFrame(pdf)


def hac(u, lags):
    s = np.sum(u * u)
    for k in range(1, lags + 1):
        s += 2 * (1 - k / (lags + 1)) * np.sum(u[k:] * u[:-k])
    return s


def test_fama_macbeth_against_numpy(panel):
    pdf, sdf = panel
    got = inference.fama_macbeth(sdf).head()
    b, r2, t = [], [], []
    for _, g in pdf.groupby("date"):
        a = np.column_stack([np.ones(len(g)), g.x])
        beta, *_ = np.linalg.lstsq(a, g.ret, rcond=None)
        e = g.ret - a @ beta
        s2 = (e @ e) / (len(g) - 2)
        b.append(beta[1])
        t.append(beta[1] / np.sqrt(s2 * np.linalg.inv(a.T @ a)[1, 1]))
        r2.append(1 - (e @ e) / ((g.ret - g.ret.mean()) ** 2).sum())
    b, n = np.array(b), len(b)
    se = np.sqrt(hac(b - b.mean(), 3) / n ** 2 * n / (n - 1))
    assert got.n_periods == n
    assert got.fm_coef == pytest.approx(b.mean()) and got.fm_se == pytest.approx(se)
    assert got.fm_t == pytest.approx(b.mean() / se) and got.fm_r2 == pytest.approx(np.mean(r2))
    assert got.sig_ratio == pytest.approx(np.mean(np.abs(t) > 1.96))
    ic = np.array([g.x.rank().corr(g.ret.rank()) for _, g in pdf.groupby("date")])
    assert got.rank_ic == pytest.approx(ic.mean()) and got.icir == pytest.approx(ic.mean() / ic.std(ddof=1))


def test_too_few_dates_give_neutral_metrics(panel):
    _, sdf = panel
    got = inference.fama_macbeth(sdf.filter("date < '2021-02-01'")).head()
    assert got.fm_t == 0 and got.fm_p == 1 and got.rank_ic == 0


def test_constant_factor_dates_are_skipped(spark):
    d = spark.createDataFrame([("f", 1, float(i), float(i * i % 7)) for i in range(40)]
                              + [("f", 2, 0.1, float(i)) for i in range(40)], "fid string, date int, x double, ret double")
    assert [r.date for r in inference.daily_regressions(d).collect()] == [1]


def test_group_effects_match_dummies(panel):
    pdf, sdf = panel
    d = sdf.withColumn("g", F.substring("symbol", 3, 1))
    got = {r.date: r.beta for r in inference.group_effect_regressions(d, "g").collect()}
    day, g = next(iter(pdf.groupby("date")))
    a = np.column_stack([g.x, pd.get_dummies(g.symbol.str[2]).to_numpy(float)])
    assert got[day] == pytest.approx(np.linalg.lstsq(a, g.ret, rcond=None)[0][0])


def test_control_kind_depends_on_its_distinct_values(panel):
    pdf, sdf = panel
    d = sdf.withColumn("c", (F.substring("symbol", 2, 2).cast("int") % F.when(F.dayofmonth("date") < 15, 5).otherwise(25)).cast("double"))
    got = {r.date: r.beta for r in inference.controlled_regressions(d, "c").collect()}
    seen = set()
    for day, g in pdf.groupby("date"):
        c = g.symbol.str[1:].astype(int) % (5 if day.day < 15 else 25)
        many = c.nunique() > 20
        seen.add(many)
        cols = pd.get_dummies(c).to_numpy(float) if many else np.column_stack([np.ones(len(g)), c])
        assert got[day] == pytest.approx(np.linalg.lstsq(np.column_stack([g.x, cols]), g.ret, rcond=None)[0][0])
    assert seen == {True, False}


def test_style_regression_against_numpy(spark):
    rng = np.random.default_rng(5)
    n = 120
    f = rng.normal(0, 1, (n, 2))
    y = 0.01 + f @ [0.5, -0.2] + rng.normal(0, 0.1, n)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(n)]
    ls = spark.createDataFrame([("f", d, float(v)) for d, v in zip(days, y)], "fid string, date date, ls double")
    st = spark.createDataFrame([(d, float(a), float(b)) for d, (a, b) in zip(days, f)], "date date, A double, B double")
    got = inference.style_orthogonality(ls, st, ["A", "B"]).head()
    x = np.column_stack([np.ones(n), f])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    s = x * (y - x @ beta)[:, None]
    meat = s.T @ s
    for k in range(1, 6):
        meat += (1 - k / 6) * (s[k:].T @ s[:-k] + s[:-k].T @ s[k:])
    se = np.sqrt(np.diag(inv @ meat @ inv) * n / (n - 3))
    assert got.alpha == pytest.approx(beta[0]) and got.t_alpha == pytest.approx(beta[0] / se[0])
    assert got.beta_A == pytest.approx(beta[1]) and got.t_B == pytest.approx(beta[2] / se[2])


def test_normal_helpers(spark):
    d = spark.range(1).select(normal_quantile(F.lit(0.975)).alias("q"), normal_quantile(F.lit(0.001)).alias("l"),
                              normal_tail(F.lit(1.959964)).alias("p"), t_two_sided(F.lit(2.0), F.lit(20)).alias("t")).head()
    assert d.q == pytest.approx(1.959964, abs=1e-6) and d.l == pytest.approx(-3.090232, abs=1e-6)
    assert d.p == pytest.approx(0.05, abs=1e-6) and d.t == pytest.approx(0.0593, abs=2e-4)


def test_student_tails(spark):
    # two-sided table values: (t, degrees of freedom, probability)
    known = [(1.0, 1, 0.5), (2.228138851964939, 10, 0.05), (1.0, 10, 0.340893132302060), (2.0, 20, 0.0592655355), (0.0, 5, 1.0)]
    # a Cauchy variable's tail is an angle; with two degrees of freedom it is a root
    known += [(t, 1, 2 * np.arctan(1 / t) / np.pi) for t in (0.01, 3.0, 40.0)] + [(t, 2, 1 - t / np.sqrt(2 + t * t)) for t in (0.5, 2.0)]
    d = spark.createDataFrame([(t, n, p) for t, n, p in ((float(t), n, float(p)) for t, n, p in known)], "t double, n int, p double")
    for r in d.select("*", t_two_sided(F.col("t"), F.col("n")).alias("got"), t_two_sided(-F.col("t"), F.col("n")).alias("mirror")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-10) and r.mirror == r.got, r
    far = spark.range(1).select(*[t_two_sided(F.lit(40.0), F.lit(n)).alias(f"p{n}") for n in (4, 10, 100, 2500)]).head()
    # exact for four degrees of freedom, in fifty digits
    share = Decimal(4) / (4 + 40 * 40)
    exact = 1 - (1 - share).sqrt() * (1 + share / 2)
    assert far.p4 == pytest.approx(float(exact), rel=1e-10)
    assert 0 < far.p2500 < far.p100 < far.p10 < far.p4


# ---- splits ---------------------------------------------------------------------------
def days_df(spark, start, n, freq="D"):
    return spark.createDataFrame([(d.date(),) for d in pd.date_range(start, periods=n, freq=freq)], "date date")


def test_walk_forward_gaps_and_disjointness(spark):
    d = days_df(spark, "2019-01-01", 365 * 5)
    w = splits.walk_forward(d, train=24, val=6, test=3).toPandas()
    assert w.groupby(["window", "date"]).split.nunique().max() == 1
    for _, g in w.groupby("window"):
        last = g[g.split == "train"].date.max()
        first = g[g.split == "val"].date.min()
        assert (first - last).days == 4  # one purged train day, two embargoed days
        assert len(g[g.split == "test"]) >= 30


def test_early_july_anchor_and_order(spark):
    d = days_df(spark, "2019-07-01", 365 * 6)
    s = splits.month_days(d).toPandas().sort_values("date")
    assert s[s.split == "train"].date.max() == dt.date(2022, 6, 30)
    assert s[s.split == "test"].date.max() == dt.date(2024, 6, 30)
    j = splits.july_days(d).toPandas()
    assert j[j.split == "val"].date.min() == dt.date(2022, 7, 1)


@pytest.mark.parametrize("n", [30, 31, 32, 100])
def test_parts(spark, n):
    d = days_df(spark, "2020-01-01", n)
    got = splits.equal_parts(d, 3).orderBy("date").toPandas().part.tolist()
    cuts = [i * n // 3 for i in range(1, 3)]
    assert got == [sum(k >= c for c in cuts) for k in range(n)]
    even = splits.array_parts(d, 3).orderBy("date").toPandas().part.tolist()
    assert even == [i for i, a in enumerate(np.array_split(np.arange(n), 3)) for _ in a]


def test_window_selector():
    assert splits.parse_windows("1,3", 6) == [1, 3] and splits.parse_windows("2-4,9", 6) == [2, 3, 4]
    assert splits.parse_windows("", 3) == [1, 2, 3]


# ---- backtest -------------------------------------------------------------------------
def weighted_legs(pdf, cost, q=5, limit=0.1):
    """The daily legs as basket weights (month x symbol) times returns (day x symbol)."""
    wide = pdf.pivot(index="date", columns="symbol")
    close, opening = wide["close"], wide["open"]
    jump = opening / close.ffill().shift()
    month = np.array([(d.year, d.month) for d in close.index]) @ [12, 1]
    forming = np.append(True, month[1:] != month[:-1])
    entering = np.append(False, forming[:-1]) & ~forming
    scores = wide["x"][forming & np.append(entering[1:], False)]
    scores = scores[scores.count(axis=1) >= 50]
    # columns are in symbol order, so "first" breaks ties by symbol
    place = scores.rank(axis=1, method="first") - 1
    group = np.ceil((place * q).div(scores.count(axis=1) - 1, axis=0)).clip(lower=1)
    at_entry = jump.shift(-1).loc[scores.index]
    daily = (close / close.ffill().shift()).mask(pd.Series(entering, index=close.index), close / opening, axis=0).fillna(1.0) - 1
    months = pd.Series(month, index=close.index)
    held = ~forming & months.isin(months[scores.index]).to_numpy()
    legs = {}
    for name, basket, sign in (("long", (group == q) & (at_entry < 1 + limit), -1), ("short", (group == 1) & (at_entry > 1 - limit), 1)):
        weight = basket.div(basket.sum(axis=1), axis=0)
        fresh = 1 - (weight * basket.shift(fill_value=False)).sum(axis=1)
        by_month = weight.set_axis(months[weight.index], axis=0).reindex(month[held]).to_numpy()
        paid = fresh.set_axis(months[fresh.index]).reindex(month[held]).to_numpy() * entering[held] * cost / 1e4
        legs[name] = (by_month * daily[held].to_numpy()).sum(axis=1) + sign * paid
    return pd.DataFrame(legs, index=close.index[held])


@pytest.mark.parametrize("cost", [0.0, 40.0])
def test_backtest_against_matrix_products(panel, cost):
    pdf, sdf = panel
    run = backtest.Backtest(sdf, (cost,))
    got = run.daily.toPandas().set_index("date").sort_index()
    want = weighted_legs(pdf, cost)
    assert got.index.tolist() == want.index.tolist()
    np.testing.assert_allclose(got.long, want.long, atol=1e-12)
    np.testing.assert_allclose(got.short, want.short, atol=1e-12)
    s = run.summary().head()
    nav = (1 + want.long - want.short).cumprod()
    assert s.ls_day_max_dd == pytest.approx((nav / nav.cummax() - 1).min())
    assert s.ls_day_annual == pytest.approx(nav.iloc[-1] ** (252 / len(nav)) - 1)


def test_cost_only_hurts(panel):
    _, sdf = panel
    drag = backtest.cost_drag(backtest.Backtest(sdf, (0.0, 50.0)).monthly()).filter("cost_bps = 50").head()
    assert drag.drag_bps > 0


def test_close_execution_uses_forward_returns(panel):
    pdf, sdf = panel
    run = backtest.Backtest(sdf.drop("open", "close"), (0.0,), open_execution=False)
    first = run.daily.orderBy("date").first()
    day = pdf[pdf.date == pdf.date.min()].sort_values(["x", "symbol"])
    n = len(day)
    top = [max(1, -(-(i * 5) // (n - 1))) == 5 for i in range(n)]
    assert first.long == pytest.approx(day.ret[top].mean())


@pytest.mark.parametrize("open_execution", [True, False])
def test_wide_backtest_equals_the_long_one(spark, panel, open_execution):
    pdf, _ = panel
    pdf = pdf.drop(columns="fid").rename(columns={"x": "f"})
    rng = np.random.default_rng(5)
    pdf["g"] = rng.normal(size=len(pdf))
    rows = [tuple(None if isinstance(v, float) and rng.random() < p else v for v, p in zip(r, (0, 0, 0.02, 0.01, 0.01, 0.01, 0.05)))
            for r in pdf[["date", "symbol", "f", "ret", "open", "close", "g"]].itertuples(index=False)]
    wide = spark.createDataFrame(rows, "date date, symbol string, f double, ret double, open double, close double, g double").repartition(5)
    # g starts on the third day of a month and has a month of one day
    wide = wide.withColumn("g", F.when(~F.col("date").between("2021-01-01", "2021-01-05") & ~F.col("date").between("2021-03-02", "2021-03-31"), F.col("g")))
    opts = {"costs_bps": (0.0, 30.0), "open_execution": open_execution, "limit_pct": 0.05, "min_names": 40}
    a = backtest.Backtest(wide, factors=["f", "g"], **opts)
    b = backtest.Backtest(xs.melt(wide, ["f", "g"], ["date", "symbol", "ret", "open", "close"]), **opts)
    keys = ["fid", "month", "seq", "basket", "symbol", "entry_day"]
    assert sorted(map(tuple, a.members.select(keys).collect())) == sorted(map(tuple, b.members.select(keys).collect()))
    for name, keys in (("returns", ["fid", "month", "seq", "basket", "date", "is_entry"]), ("turnover", ["fid", "month", "seq", "basket"]),
                       ("daily", ["cost_bps", "fid", "month", "seq", "date"])):
        one, two = (getattr(x, name).toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b))
        assert len(one) and set(one.fid) == {"f", "g"} and one[keys].equals(two[keys])
        rest = [c for c in two.columns if c not in keys]
        np.testing.assert_allclose(one[rest], two[rest], atol=1e-12)
    plan = a.members._jdf.queryExecution().executedPlan().toString()
    assert "bt_run" in plan and not any(k in plan for k in ("bt_rows", "bt_signals"))


# ---- formulas -------------------------------------------------------------------------
def test_formula_values(spark):
    d = spark.createDataFrame([(1.0, -2.0), (0.0, 0.5), (None, 1.0)], "a double, b double")
    forms = {"p": "square(a*b) + 1", "q": "inv(a)", "r": "log1p(b)", "s": "a/b", "bad": "nope + 1", "t": "a ** 2 - -b"}
    rows = formula.evaluate(d, forms, ["b"]).collect()
    assert [r.p for r in rows] == [5.0, 1.0, None] and [r.q for r in rows] == [1.0, 0.0, None]
    assert rows[0].r == pytest.approx(np.log1p(-0.999)) and rows[1].s == 0.0
    assert all(r.bad is None for r in rows) and rows[0].t == -1.0
    signed = formula.evaluate(d, {"r": "log1p(b)"}, ["b"], "signed").head()
    assert signed.r == pytest.approx(-np.log1p(2.0))


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "a[0]", "lambda: 1", "open(a)", "a if b else a"])
def test_formula_whitelist(text):
    with pytest.raises(formula.FormulaError):
        formula.to_sql(text, ["a", "b"])


def test_structure_signature():
    same = {formula.structure(t) for t in ("square(a*(b*0.1))", "square((0.7*x)*y)", "square(y*x)")}
    assert len(same) == 1
    assert formula.structure("a+b*c") == formula.structure("z*y+x") != formula.structure("a-b*c")
    assert formula.structure("a +* b") == "a+*b"


def test_placeholders(spark):
    reg = spark.createDataFrame([("g", "add(X0, mul(X12, X1))")], "fid string, formula string")
    feats = spark.createDataFrame([(0, "open"), (1, "close"), (12, "turn")], "idx int, feature string")
    r = formula.decode_placeholders(reg, feats).head()
    assert r.decoded == "add(open, mul(turn, close))" and r.used == ["close", "open", "turn"]


# ---- gates ----------------------------------------------------------------------------
def test_verdicts(spark):
    d = spark.createDataFrame([("ok", 4.0, 0.05, 0.5), ("weak", 2.2, 0.05, 0.5), ("mixed", 4.0, -0.05, 0.5),
                               ("low", 1.0, 0.05, 0.5), ("flat", 3.0, 0.005, 0.5)],
                              "fid string, fm_t double, rank_ic double, icir double")
    got = {r.fid: (r.reason, r.gate_status) for r in gates.registration_verdict(d).collect()}
    assert got == {"ok": ("", "STRONG"), "weak": ("", "WEAK"), "mixed": ("sign", None), "low": ("t", None), "flat": ("ic", None)}


def test_rank_among(spark):
    m = spark.createDataFrame([("m", 2.0)], "fid string, sharpe double")
    b = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "fid string, sharpe double")
    assert gates.rank_among(m, b).head()["rank"] == 2


# ---- resampling and models ------------------------------------------------------------
def test_reality_check_is_seeded_and_partition_free(spark):
    rng = np.random.default_rng(2)
    rows = [(f"f{k}", dt.date(2020, 1, 1) + dt.timedelta(i), float(rng.normal(0.02 * k, 0.1))) for k in range(3) for i in range(80)]
    ic = spark.createDataFrame(rows, "fid string, date date, ic double")
    a = combine.reality_check(ic, 200).head()
    b = combine.reality_check(ic.repartition(7), 200).head()
    assert a.p_value == b.p_value and a.v == pytest.approx(b.v) and a.boot_max_mean == pytest.approx(b.boot_max_mean)
    assert 0 <= a.p_value <= 1 and a.n_days == 80
    s = combine.selection_interval(ic, "f2", 200).head()
    assert s.sel_low < s.mean < s.sel_high


def test_blocks_fill_every_resample(spark):
    rows = combine.stationary_blocks(spark, 300, 47, seed=7).collect()
    size = {}
    for r in rows:
        assert 0 <= r.start < 47 and 1 <= r.size <= 47
        size[r.boot] = size.get(r.boot, 0) + r.size
    assert size == {b: 47 for b in range(300)}
    assert 300 * 4 < len(rows) < 300 * 8  # about 47 / 10 blocks and a cut one, not a row per day
    assert len({r.start for r in rows}) == 47


def test_circular_blocks_are_differences_of_running_sums(spark):
    v = [0.5, -1.0, 2.0, 4.0, -8.0]
    d = spark.createDataFrame([("long", i, x) for i, x in enumerate(v)] + [("short", i, x) for i, x in enumerate(v[:3])], "fid string, pos int, c double")
    p = {(r.fid, r.pos): r for r in combine.circular_prefixes(d, 5, "c").collect()}
    for fid, own in (("long", v), ("short", v[:3])):
        for start in range(5):
            for size in range(1, 6):
                days = [own[i % 5] for i in range(start, start + size) if i % 5 < len(own)]
                a, b = p[fid, start], p[fid, start + size]
                assert (b.n - a.n, b.s1 - a.s1, b.s2 - a.s2) == (len(days), sum(days), sum(x * x for x in days))


def test_factors_too_short_to_test_count_as_zero(spark):
    rng = np.random.default_rng(3)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    rows = [("bad", day(i), float(rng.normal(-1, 0.1))) for i in range(60)]
    short = [("new", day(i), 5.0) for i in range(4)]
    alone = combine.reality_check(spark.createDataFrame(rows, "fid string, date date, ic double"), 200).head()
    both = combine.reality_check(spark.createDataFrame(rows + short, "fid string, date date, ic double"), 200).head()
    assert alone.v < 0 and both.v == 0 and both.n_factors == 2
    assert both.boot_max_mean > alone.boot_max_mean  # no resample's maximum is below zero any more
    flat = combine.reality_check(spark.createDataFrame([("c", day(i), 0.25) for i in range(40)], "fid string, date date, ic double"), 50).head()
    assert flat.v == 0 and flat.boot_max_mean == 0


def test_means_of_draws_against_digests(spark):
    import hashlib
    vals = {"a": [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0], "b": [0.0, 1.0, 0.0, 0.0, 0.0], "c": [9.0] * 4}
    rows = [(f, dt.date(2020, 1, 1) + dt.timedelta(i), x) for f, v in vals.items() for i, x in enumerate(v)]
    got = {(r.boot, r.fid): r.m for r in combine.resampled_means(spark.createDataFrame(rows, "fid string, date date, ic double"), 50, seed=5).collect()}
    assert set(got) == {(b, f) for b in range(50) for f in "ab"}
    for (b, f), m in got.items():
        v = vals[f]
        draws = [int(hashlib.sha256(f"5:day:{f}:{b}:{i // 8}".encode()).hexdigest()[i % 8 * 8:][:8], 16) * len(v) >> 32 for i in range(len(v))]
        assert m == pytest.approx(sum(v[i] for i in draws) / len(v))


def test_synergy_of_identical_factors_is_zero(spark):
    rng = np.random.default_rng(4)
    ls = spark.createDataFrame([("f", dt.date(2020, 1, 1) + dt.timedelta(i), float(rng.normal(0, 1))) for i in range(90)],
                               "fid string, date date, ls double")
    none = spark.createDataFrame([], "f1 string, f2 string, rho double")
    r = combine.synergy(ls, ls, none, n_boot=50).head()
    assert r.gain == pytest.approx(0) and r.max_abs_rho is None and r.verdict == "unsupported"
    assert combine.month_bootstrap(ls, ls, 50).head().mean_gain == pytest.approx(0, abs=1e-12)


def test_sequences_pad_left(spark):
    d = spark.createDataFrame([("a", 0, i, float(i)) for i in range(5)], "symbol string, blk int, date int, v double")
    r = models.sequences(d, ["v"], 4).orderBy("date").collect()
    assert [s.v for s in r[1].sequence] == [0.0, 0.0, 0.0, 1.0] and [s.v for s in r[4].sequence] == [1.0, 2.0, 3.0, 4.0]


def test_gbt_learns(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        a, b = rng.normal(size=2)
        rows.append((i, "s", float(a), float(b), float(3 * a + rng.normal(0, 0.1)), ("train", "val", "test")[i // 400 + (i >= 500)]))
    d = spark.createDataFrame(rows, "date int, symbol string, a double, b double, forward_ret double, split string")
    pred, imp = models.gbt_baseline(d, ["a", "b"], trees=5, depth=3)
    assert imp.first().feature == "a" and pred.stat.corr("x", "forward_ret") > 0.8
