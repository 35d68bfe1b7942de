"""Rolling-window kernel: every feature family is built from these SQL expressions.

Plans with hundreds of expressions are written as SQL text: one parse per column instead
of thousands of calls into the JVM to assemble ``Column`` objects.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from quantloom.operators.layout import SERIES
from quantloom.settings import DEFAULTS

ANNUAL = math.sqrt(252.0)
TINY = 1e-8


def lit(v: float) -> str:
    return f"{float(v)!r}D"


def div(a: str, b: str) -> str:
    """a / b with NULL for a zero divisor."""
    return f"try_divide({a}, {b})"


def at_least(x: str, lo: float) -> str:
    """Lower clip that keeps NULL."""
    return f"(CASE WHEN {x} < {lit(lo)} THEN {lit(lo)} ELSE {x} END)"


def at_most(x: str, hi: float) -> str:
    return f"(CASE WHEN {x} > {lit(hi)} THEN {lit(hi)} ELSE {x} END)"


def over(a: str, b: str, lo: float = TINY) -> str:
    """a / max(b, lo)."""
    return div(a, at_least(b, lo))


def when(cond: str, value: str) -> str:
    return f"(CASE WHEN {cond} THEN {value} END)"


def with_exprs(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.withColumns({n: F.expr(e) for n, e in exprs.items()}) if exprs else df


class Rolling:
    """Row frames over one series key, in constant work per row and frame.

    A sliding frame in Spark re-reads all its rows for every output row. Sums and moments
    are instead differences of running totals: one ``UNBOUNDED PRECEDING`` total per column
    serves every frame length, and a frame is the total now minus the total n rows ago.
    Second and higher moments use values centred on the block mean; blocks bound the
    length of a running total, so the difference keeps about 12 digits. A frame whose
    values are all equal is recognised exactly (by counting changes) and has variance 0.

    Methods take column names and return SQL over helper columns; the helpers are
    registered once per (function, column, frame) and computed by :meth:`add` in a fixed
    order of stages. Only extremes and value arrays use sliding frames.
    """

    N_STAGES = 6  # shifts and centres, products, running totals, shifted totals, frames, moments

    def __init__(self, keys: tuple[str, ...] = SERIES, order: str = "date", half: bool = False,
                 parent: "Rolling | None" = None,
                 halo: tuple[int, int] = (DEFAULTS.halo_back, DEFAULTS.halo_forward)):
        """``halo``: the rows that time_blocks() copied before and after a block."""
        self.keys, self.half, self.halo = keys, half, halo
        self.part = f"PARTITION BY {', '.join(keys)}"
        self.cells, self.rows = 0, order
        self._by(order)
        self.stages = parent.stages if parent else [{} for _ in range(self.N_STAGES)]
        self.done = parent.done if parent else set()

    def _by(self, order: str) -> None:
        self.order, self.w = order, f"{self.part} ORDER BY {order}"
        self.upto = f"({self.w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        self.before = f"({self.w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def relaxed(self) -> "Rolling":
        """The same series and helper columns; a frame needs half its rows."""
        return Rolling(self.keys, self.order, True, self, self.halo)

    def _reach(self, back: int = 0, ahead: int = 0) -> None:
        """Refuse a frame longer than the halo, which would be wrong in a cut series."""
        if "blk" in self.keys and (back > self.halo[0] or ahead > self.halo[1]):
            raise ValueError(f"a frame of {back} rows back and {ahead} ahead leaves the halo {self.halo}: "
                             "cut the series with a longer one and name it here")

    def frame(self, n: int) -> str:
        self._reach(back=n - 1)
        return f"({self.w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def _helper(self, stage: int, name: str, sql: str) -> str:
        name = f"_w_{name}"
        if name not in self.done:
            self.stages[stage].setdefault(name, sql)
        return name

    def add(self, df: DataFrame, exprs: dict[str, str]) -> DataFrame:
        """Compute the pending helper stages, then the expressions."""
        for stage in self.stages:
            df = with_exprs(df, stage)
            self.done |= set(stage)
            stage.clear()
        return with_exprs(df, exprs)

    def _need(self, n: int, need: int | None, least: int = 1) -> int:
        k = need if need is not None else (max(1, n // 2) if self.half else n)
        return max(k, least)

    # running totals and their frame differences
    def _total(self, tag: str, value: str, n: int) -> str:
        self._reach(back=n)
        now = self._helper(2, tag, f"coalesce(sum({value}) OVER {self.upto}, 0D)")
        ago = self._helper(3, f"{tag}_{n}ago", f"lag({now}, {n}, 0D) OVER ({self.w})")
        return self._helper(4, f"{tag}_{n}", f"{now} - {ago}")

    def count(self, x: str, n: int) -> str:
        return self._total(f"n_{x}", f"CASE WHEN {x} IS NOT NULL THEN 1D END", n)

    def _sum(self, x: str, n: int) -> str:
        return self._total(f"s_{x}", x, n)

    def _centred(self, x: str) -> str:
        mid = self._helper(0, f"mid_{x}", f"avg({x}) OVER ({self.part})")
        return self._helper(1, f"c_{x}", f"{x} - {mid}")

    def _power(self, x: str, k: int, n: int) -> str:
        c = self._centred(x)
        return self._total(f"p{k}_{x}", " * ".join([c] * k), n)

    def _varies(self, x: str, n: int) -> str:
        prev = self._helper(0, f"prev_{x}", f"last({x}, true) OVER {self.before}")
        return self._total(f"chg_{x}", f"CASE WHEN {x} != {prev} THEN 1D ELSE 0D END", n - 1) + " > 0"

    def _m2(self, x: str, n: int) -> str:
        """Sum of squared deviations in the frame, exactly 0 for equal values."""
        k, s1, s2 = self.count(x, n), self._power(x, 1, n), self._power(x, 2, n)
        return self._helper(5, f"m2_{x}_{n}",
                            f"CASE WHEN {self._varies(x, n)} THEN greatest({s2} - "
                            f"{div(f'{s1} * {s1}', k)}, 0D) ELSE 0D END")

    def _cross(self, x: str, y: str, n: int) -> str:
        """Sum of cross deviations; x and y must be present (or missing) together."""
        cx, cy = self._centred(x), self._centred(y)
        sxy = self._total(f"x_{x}_{y}", f"{cx} * {cy}", n)
        sx, sy, k = self._power(x, 1, n), self._power(y, 1, n), self.count(x, n)
        return self._helper(5, f"cr_{x}_{y}_{n}", f"{sxy} - {div(f'{sx} * {sy}', k)}")

    # shifts
    def lag(self, x: str, d: int = 1) -> str:
        self._reach(back=d)
        return self._helper(0, f"lag_{x}_{d}", f"lag({x}, {d}) OVER ({self.w})")

    def lead(self, x: str, d: int = 1) -> str:
        self._reach(ahead=d)
        return self._helper(0, f"lead_{x}_{d}", f"lead({x}, {d}) OVER ({self.w})")

    def diff(self, x: str, d: int = 1) -> str:
        return f"({x} - {self.lag(x, d)})"

    def change(self, x: str, d: int = 1) -> str:
        return f"(try_divide({x}, {self.lag(x, d)}) - 1)"

    def ts_delta(self, x: str, d: int = 5) -> str:
        return f"coalesce({self.diff(x, d)}, 0D)"

    def position(self) -> str:
        return self._helper(0, "pos", f"CAST(row_number() OVER ({self.w}) AS DOUBLE)")

    # sums and moments
    def total(self, x, n, need=None):
        return when(f"{self.count(x, n)} >= {self._need(n, need)}", self._sum(x, n))

    def mean(self, x, n, need=None):
        k = self.count(x, n)
        return when(f"{k} >= {self._need(n, need)}", f"{self._sum(x, n)} / {k}")

    def var(self, x, n, need=None):
        k = self.count(x, n)
        return when(f"{k} >= {self._need(n, need, 2)}", div(self._m2(x, n), f"{k} - 1"))

    def std(self, x, n, need=None):
        return f"sqrt({self.var(x, n, need)})"

    def std_pop(self, x, n, need=None):
        k = self.count(x, n)
        return when(f"{k} >= {self._need(n, need)}", f"sqrt({div(self._m2(x, n), k)})")

    def _raw_moments(self, x: str, n: int) -> list[str]:
        k = self.count(x, n)
        return [div(self._power(x, i, n), k) for i in (1, 2, 3, 4)]

    def skew(self, x, n, need=None):
        """Bias-corrected skewness: the population value times sqrt(k(k-1))/(k-2)."""
        k, m2 = self.count(x, n), self._m2(x, n)
        a1, a2, a3, _ = self._raw_moments(x, n)
        m3 = f"({a3} - 3 * {a1} * {a2} + 2 * pow({a1}, 3D))"
        return when(f"{k} >= {self._need(n, need, 3)}",
                    f"{div(m3, f'pow({m2} / {k}, 1.5D)')} * {div(f'sqrt({k} * ({k} - 1))', f'{k} - 2')}")

    def kurt(self, x, n, need=None):
        """Bias-corrected excess kurtosis."""
        k, m2 = self.count(x, n), self._m2(x, n)
        a1, a2, a3, a4 = self._raw_moments(x, n)
        m4 = f"({a4} - 4 * {a1} * {a3} + 6 * {a1} * {a1} * {a2} - 3 * pow({a1}, 4D))"
        excess = f"({div(m4, f'pow({m2} / {k}, 2D)')} - 3)"
        return when(f"{k} >= {self._need(n, need, 4)}",
                    f"{div(f'{k} - 1', f'({k} - 2) * ({k} - 3)')} * (({k} + 1) * {excess} + 6)")

    # pairs of columns
    def _complete(self, x: str, y: str, n: int) -> str:
        return f"{self.count(x, n)} >= {n} AND {self.count(y, n)} >= {n}"

    def _pearson(self, x: str, y: str, n: int) -> str:
        return div(self._cross(x, y, n), f"sqrt({self._m2(x, n)} * {self._m2(y, n)})")

    def corr(self, x, y, n):
        return when(self._complete(x, y, n), self._pearson(x, y, n))

    def corr_any(self, x, y, n):
        """Correlation of a possibly short frame; x and y must be missing together."""
        return when(f"{self.count(x, n)} >= 2", self._pearson(x, y, n))

    def cov(self, x, y, n):
        return when(self._complete(x, y, n), f"{self._cross(x, y, n)} / {n - 1}")

    def autocorr(self, x: str, n: int) -> str:
        """Lag-one autocorrelation of a frame; ``<x>_prev`` must hold the previous value."""
        return self.corr(x, f"{x}_prev", n - 1)

    # least squares of y on x in the frame
    def slope(self, y, x, n):
        """Slope of y on x; 0 when x does not vary, NULL unless the frame is complete."""
        return when(self._complete(y, x, n),
                    f"coalesce({div(self._cross(y, x, n), self._m2(x, n))}, 0D)")

    def intercept(self, y, x, n):
        return f"({self._sum(y, n)} / {n} - {self.slope(y, x, n)} * {self._sum(x, n)} / {n})"

    def residual(self, y, x, n):
        """Newest value minus the line fitted to the frame."""
        return (f"({y} - {self._sum(y, n)} / {n}"
                f" - {self.slope(y, x, n)} * ({x} - {self._sum(x, n)} / {n}))")

    def r2(self, y, x, n):
        """Squared correlation; NULL for a flat frame."""
        c = self._cross(y, x, n)
        return when(self._complete(y, x, n),
                    div(f"{c} * {c}", f"({self._m2(x, n)} * {self._m2(y, n)})"))

    def trend_strength(self, y, pos, n):
        """Slope on position divided by the population spread."""
        return f"{self.slope(y, pos, n)} / ({self.std_pop(y, n)} + {lit(TINY)})"

    # extremes and frame contents: true sliding frames
    def _slide(self, tag: str, call: str, x: str, n: int) -> str:
        return self._helper(2, f"{tag}_{x}_{n}", f"{call}({x}) OVER {self.frame(n)}")

    def top(self, x, n, need=None):
        return when(f"{self.count(x, n)} >= {self._need(n, need)}", self._slide("max", "max", x, n))

    def bottom(self, x, n, need=None):
        return when(f"{self.count(x, n)} >= {self._need(n, need)}", self._slide("min", "min", x, n))

    def values(self, x: str, n: int) -> str:
        """Non-null values of the frame, oldest first."""
        return self._slide("lst", "collect_list", x, n)

    # growing frames
    def cumulative(self, x: str) -> str:
        """Running total inside a block; use it only where a constant offset cancels (else growing())."""
        return self._helper(2, f"cum_{x}", f"sum({x}) OVER {self.upto}")

    # exponential means: per-bar weights (1-a)^age, summed cell by cell
    def by_cells(self, df: DataFrame, pos: str, span: int) -> DataFrame:
        """Cut each series into cells for exponential means up to ``span``; later windows order by cell and row.

        That is the same order, but one that Spark knows to serve windows within cells too: rows are sorted once
        for all of them. The two columns added must stay in the rows.
        """
        n = self.cells = self._cells(span)
        self._by(f"_cell{n}, {self.rows}")
        return with_exprs(df, {f"_cell{n}": f"floor(({pos} - 1) / {n})", f"_off{n}": f"({pos} - 1) % {n}"})

    @staticmethod
    def _cells(span: int) -> int:
        return max(64, math.ceil(41.5 / -math.log(1.0 - 2.0 / (span + 1.0))))

    def ewm(self, df: DataFrame, specs: dict[str, tuple[str, int]], pos: str,
            adjust: bool = True) -> DataFrame:
        """Exponentially weighted means of columns without gaps: {out: (column, span)}.

        ``sum(x * decay^age)`` written as one running total overflows, so the total runs
        inside cells of rows, and the closing total of the previous cell is carried. Cells
        are long enough for the longest span to fade by 1e-18 in one cell, so older cells
        do not matter. All means share two Window operators, and after by_cells() one sort.
        """
        decay = {out: 1.0 - 2.0 / (span + 1.0) for out, (_, span) in specs.items()}
        keep, longest = df.columns, max(span for _, span in specs.values())
        fit = self._cells(longest)
        # cells too short to fade in, or so long that weights overflow: cells of its own, and later windows keep their order
        if self.cells < fit or self.cells > fit and -math.log(min(decay.values())) * self.cells > 600:
            own = Rolling(self.keys, self.rows, self.half, self, self.halo)
            return own.ewm(own.by_cells(df, pos, longest), specs, pos, adjust).select(*keep, *specs)
        cells, cell, off = self.cells, f"_cell{self.cells}", f"_off{self.cells}"
        df = with_exprs(df, {f"_t_{o}": f"{x} * pow({lit(1 / decay[o])}, {off})" for o, (x, _) in specs.items()})
        df = with_exprs(df, {f"_i_{o}": f"sum(_t_{o}) OVER ({self.part}, {cell} ORDER BY {self.rows} "
                                        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for o in specs})
        df = with_exprs(df, {f"_p_{o}": f"_i_{o} * pow({lit(decay[o])}, {off})" for o in specs})
        closing = {o: f"CASE WHEN {off} = {cells - 1} THEN _p_{o} END" for o in specs}
        df = with_exprs(df, {f"_c_{o}": f"last({e}, true) OVER {self.before}" for o, e in closing.items()}
                        | {f"_f_{o}": f"first({x}) OVER {self.upto}" for o, (x, _) in specs.items()})
        out = {}
        for o in specs:
            d = lit(decay[o])
            total = f"(_p_{o} + coalesce(_c_{o}, 0D) * pow({d}, {off} + 1))"
            out[o] = (f"{total} * {lit(1 - decay[o])} / (1 - pow({d}, {pos}))" if adjust else
                      f"{lit(1 - decay[o])} * {total} + {d} * pow({d}, {pos} - 1) * _f_{o}")
        return with_exprs(df, out).select(*keep, *specs)


def growing(df: DataFrame, x: str, series: str = "symbol", order: str = "date") -> DataFrame:
    """Add ``<x>_n``, ``<x>_sum``, ``<x>_mean`` and ``<x>_std`` from a series' first row on.

    A block starts from what the blocks before it hold, a table of one row per block, so a
    cut series gives the same values. Those of halo rows mean nothing.
    """
    part = (df.filter("NOT halo").groupBy(series, "blk")
            .agg(F.expr(f"count({x})").alias("_n"), F.expr(f"coalesce(sum({x}), 0D)").alias("_s"),
                 F.expr(f"coalesce(var_pop({x}) * count({x}), 0D)").alias("_m")))
    before = f"OVER (PARTITION BY {series} ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    earlier = part.selectExpr(series, "blk", f"coalesce(sum(_n) {before}, 0L) AS _g_n0", f"coalesce(sum(_s) {before}, 0D) AS _g_s0",
                              f"coalesce(sum(_m + coalesce(try_divide(_s * _s, _n), 0D)) {before}, 0D) AS _g_q0")
    upto = f"OVER (PARTITION BY {series}, blk ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    out = with_exprs(df.join(earlier, [series, "blk"], "left"), {"_g_x": f"CASE WHEN NOT halo THEN {x} END"})
    out = with_exprs(out, {"_g_n1": f"count(_g_x) {upto}", "_g_s1": f"coalesce(sum(_g_x) {upto}, 0D)", "_g_v1": f"coalesce(var_pop(_g_x) {upto}, 0D)"})
    n, s = "(_g_n0 + _g_n1)", "(_g_s0 + _g_s1)"
    # squares of both parts around their own means, and of the distance between these means
    m = ("(greatest(_g_q0 - coalesce(try_divide(_g_s0 * _g_s0, _g_n0), 0D), 0D) + _g_v1 * _g_n1 + coalesce("
         f"try_divide(_g_n0 * _g_n1, {n}) * pow(try_divide(_g_s0, _g_n0) - try_divide(_g_s1, _g_n1), 2D), 0D))")
    out = with_exprs(out, {f"{x}_n": n, f"{x}_sum": when(f"{n} > 0", s), f"{x}_mean": div(s, n),
                           f"{x}_std": when(f"{n} > 1", f"sqrt({m} / ({n} - 1))")})
    return out.drop("_g_n0", "_g_s0", "_g_q0", "_g_x", "_g_n1", "_g_s1", "_g_v1")


# expressions on the (sorted) array of one frame
def sorted_quantile(values: str, q: float) -> str:
    """Linear-interpolation quantile of a sorted array column."""
    at = f"((size({values}) - 1) * {lit(q)})"
    low = f"CAST(floor({at}) AS INT)"
    a = f"get({values}, {low})"
    b = f"get({values}, least({low} + 1, size({values}) - 1))"
    return f"({a} + ({b} - {a}) * ({at} - floor({at})))"


def rank_of_last(ordered: str, last: str) -> str:
    """Average-tie rank of the newest value as a share of the frame size."""
    less = f"size(filter({ordered}, v -> v < {last}))"
    same = f"size(filter({ordered}, v -> v = {last}))"
    return f"({less} + ({same} + 1) / 2D) / size({ordered})"


def first_hit(values: str, target: str) -> str:
    """1-based position (oldest = 1) of the first occurrence."""
    return f"CAST(array_position({values}, {target}) AS DOUBLE)"


def array_sum(values: str) -> str:
    return f"aggregate({values}, 0D, (a, v) -> a + v)"


def mean_abs_dev(values: str, mean: str) -> str:
    return f"aggregate({values}, 0D, (a, v) -> a + abs(v - {mean})) / size({values})"


def tail_mean(values: str, cut: str) -> str:
    """Mean of the values at or below ``cut``."""
    return (f"aggregate(filter({values}, v -> v <= {cut}), 0D, (a, v) -> a + v)"
            f" / size(filter({values}, v -> v <= {cut}))")


def top_share(descending: str, k: int) -> str:
    """Sum of the k largest values over the sum of all, from a descending array."""
    return div(array_sum(f"slice({descending}, 1, {k})"), array_sum(descending))
