"""Null-safe scalar expressions. NULL is the only missing value in the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(x: Column) -> Column:
    """NaN and infinities become NULL (NaN sorts above infinity in Spark)."""
    return F.when(F.abs(x) < F.lit(INF), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b with NULL for a zero divisor."""
    return F.try_divide(a, b)


def floor_at(x: Column, lo: float) -> Column:
    """Lower clip that keeps NULL (``greatest`` alone would replace it by the bound)."""
    return F.when(x < lo, F.lit(float(lo))).otherwise(x)


def cap_at(x: Column, hi: float) -> Column:
    return F.when(x > hi, F.lit(float(hi))).otherwise(x)


def clip(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def ln_floor(x: Column, lo: float) -> Column:
    return F.log(floor_at(x, lo))


def pearson(x: Column, y: Column, over=lambda agg: agg) -> Column:
    """Pearson correlation of the complete pairs; NULL (never an error) for a flat side.

    ``over`` turns each aggregate into a window expression. Spark's own ``corr`` raises on
    zero variance under ANSI rules.
    """
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(over(F.covar_pop(a, b)), over(F.stddev_pop(a)) * over(F.stddev_pop(b)))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _horner(x: Column, coefs: tuple[float, ...]) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


# Published rational approximation of the normal quantile (P. Acklam).
_QA = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
       1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_QB = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
       6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
       -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
       3.754408661907416e+00, 1.0)
_Q_LOW = 0.02425


def normal_quantile(p: Column) -> Column:
    """Inverse normal CDF as one expression (absolute error below 2e-9)."""
    tail = F.when(p < 0.5, p).otherwise(1 - p)
    q = F.sqrt(-2 * F.log(tail))
    outer = _horner(q, _QC) / _horner(q, _QD)
    c = p - 0.5
    r = c * c
    centre = c * _horner(r, _QA) / _horner(r, _QB)
    return (F.when((p <= 0) | (p >= 1), None)
            .when(p < _Q_LOW, outer)
            .when(p > 1 - _Q_LOW, -outer)
            .otherwise(centre))


# Abramowitz-Stegun 7.1.26 error-function coefficients.
_ERF = (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)
_ERF_P = 0.3275911


def normal_tail(z: Column) -> Column:
    """P(|Z| >= |z|) for a standard normal, accurate to about 1e-7."""
    a = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(_ERF_P) * a)
    return _horner(t, _ERF) * t * F.exp(-a * a)


# Lanczos coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number."""
    z = x - 1
    series = reduce(lambda a, b: a + b, [F.lit(c) / (z + i) for i, c in enumerate(_LANCZOS[1:], 1)], F.lit(_LANCZOS[0]))
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(series)


def _beta_fraction(a: Column, b: Column, x: Column, steps: int = 600) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz), folded over its terms."""
    one, tiny = F.lit(1.0), F.lit(1e-300)
    solid = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def step(acc, j):
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        k = F.when(j % 2 == 0, even).otherwise(odd)
        d = one / solid(one + k * acc.d)
        c = solid(one + k / acc.c)
        return F.struct(c.alias("c"), d.alias("d"), (acc.h * c * d).alias("h"))

    start = F.struct(one.alias("c"), F.lit(0.0).alias("d"), one.alias("h"))
    return one / F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc.h)


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta function of x; ``rest`` is 1 - x, told apart so that neither loses digits."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(rest))
    inside = x < (a + 1) / (a + b + 2)
    return (F.when(x <= 0, 0.0).when(rest <= 0, 1.0)
            .when(inside, front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, rest) / b))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided Student-t tail, P(|T| >= |t|), to about 12 digits however small."""
    d, q = df.cast("double"), t * t
    return F.when(t.isNotNull() & (d > 0), incomplete_beta(d / 2, F.lit(0.5), d / (d + q), q / (d + q)))


def rounded(df, digits: int = 6, skip: tuple[str, ...] = ()):
    """Round every double column; -0.0 becomes 0.0 so value hashes agree."""
    return df.select([
        (F.round(F.col(n), digits) + F.lit(0.0)).alias(n)
        if t in ("double", "float") and n not in skip else F.col(n)
        for n, t in df.dtypes
    ])
