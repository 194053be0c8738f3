"""Two-sided tail probabilities as column expressions: Student's t, the normal law and the signed-rank statistic."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, functions as F

from tastegrid.functions.ratios import NAN

# The exact signed-rank law is used up to this many differences, as is usual.
EXACT_RANKS = 50
_SHIFT = 20


def _log_gamma_step(a: Column) -> Column:
    """ln gamma(a + 1/2) - ln gamma(a): its series in 1 / a at a + 20, and 20 steps of the recurrence back."""
    z = a + F.lit(float(_SHIFT))
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * F.pow(z, 3)) - 1 / (640 * F.pow(z, 5)) + F.lit(17 / 14336) / F.pow(z, 7)
    back = F.aggregate(F.sequence(F.lit(0), F.lit(_SHIFT - 1)), F.lit(0.0), lambda s, i: s + F.log1p(F.lit(0.5) / (a + i)))
    return series - back


def _half_beta(df: Column, t: Column) -> Column:
    """The regularised incomplete beta function at df / (df + t^2) with parameters df / 2 and 1 / 2.

    Its continued fraction is folded from the last term; it converges on one side of the mean only, so beyond it the
    fraction of the mirrored arguments is taken. Terms grow with the root of ``df``: 10^9 users need about 10^5."""
    half, square = df / 2, t * t
    x, y = df / (df + square), square / (df + square)
    flip = x > (half + 1) / (half + F.lit(2.5))
    a, b = F.when(flip, 0.5).otherwise(half), F.when(flip, half).otherwise(0.5)
    at, rest = F.when(flip, y).otherwise(x), F.when(flip, x).otherwise(y)

    def log_of(v: Column, other: Column) -> Column:
        return F.when(v > 0.5, F.log1p(-other)).otherwise(F.log(v))

    front = F.exp(_log_gamma_step(half) - F.lit(0.5) * F.log(F.lit(pi)) + a * log_of(at, rest) + b * log_of(rest, at)) / a

    def folded(s: Column, i: Column) -> Column:
        m = i.cast("double")
        odd = -(a + m) * (a + b + m) * at / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * at / ((a + 2 * m - 1) * (a + 2 * m))
        return 1 + even / (1 + odd / s)

    terms = (F.ceil(F.sqrt(df)) * 2 + 60).cast("int")
    tail = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), folded)
    value = front / (1 - (a + b) * at / (a + 1) / tail)
    return F.when(flip, 1 - value).otherwise(value)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; NaN without a statistic or a degree of freedom, 0 for an infinite one."""
    t, df = t.cast("double"), df.cast("double")
    none = t.isNull() | F.isnan(t) | df.isNull() | (df < 1)
    return F.when(none, NAN).when(F.abs(t) == float("inf"), 0.0).when(t == 0, 1.0).otherwise(_half_beta(df, t))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a normal deviate: a series of positive terms near 0, the continued fraction beyond."""
    x = F.abs(z.cast("double")) / F.lit(sqrt(2.0))

    def term(s: Column, i: Column) -> Column:  # the last term is carried along with the sum
        t = s["t"] * 2 * x * x / (2 * i + 1)
        return F.struct((s["sum"] + t).alias("sum"), t.alias("t"))

    start = F.struct(x.alias("sum"), x.alias("t"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, term)["sum"]
    near = 1 - series * F.exp(-x * x) * F.lit(2 / sqrt(pi))
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda s, i: x + i / 2 / s)
    far = F.exp(-x * x) / (fraction * F.lit(sqrt(pi)))
    return F.when(x < 2, near).otherwise(far)


def _exact_ranks(w: Column, n: Column) -> Column:
    """Share of the 2^n sign choices whose rank sum is at most ``w``, doubled: ways to make each sum, a rank at a time."""
    top = F.floor(w).cast("int") + 1

    def add(ways: Column, r: Column) -> Column:
        moved = F.slice(F.concat(F.array_repeat(F.lit(0.0), r), ways), F.lit(1), top)
        return F.zip_with(ways, moved, lambda p, q: p + q)

    first = F.slice(F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), top)), F.lit(1), top)
    ways = F.aggregate(F.sequence(F.lit(1), n), first, add)
    return F.least(F.lit(1.0), 2 * F.aggregate(ways, F.lit(0.0), lambda s, v: s + v) / F.pow(F.lit(2.0), n))


def signed_rank_two_sided(w: Column, n: Column, ties: Column) -> Column:
    """Two-sided p of the smaller signed-rank sum ``w`` of ``n`` differences: exact for few without ties, else normal.

    ``ties`` is the sum of m^3 - m over groups of m equal sizes. NaN without a difference."""
    size = n.cast("double")
    spread = F.sqrt((size * (size + 1) * (2 * size + 1) - ties / 2) / 24)
    wide = normal_two_sided((w - size * (size + 1) / 4) / spread)
    exact = (n <= EXACT_RANKS) & (ties == 0)
    return F.when(n.isNull() | (n == 0), NAN).when(exact, _exact_ranks(w, n.cast("int"))).when(spread > 0, wide).otherwise(NAN)
