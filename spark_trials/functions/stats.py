"""Closed-form statistics as Column expressions; nothing here leaves code generation.

Quantiles of the normal distribution depend on parameters only, so the driver makes them as literals.
"""

from __future__ import annotations

from math import pi, sqrt
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rational approximations of erf and erfc of W. J. Cody, Math. Comp. 23 (1969), by ranges of x.
ERF_NUM = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_DEN = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
MID_NUM = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02,
           1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
MID_DEN = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03,
           4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
FAR_NUM = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
FAR_DEN = (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(x: Column, num: tuple[float, ...], den: tuple[float, ...]) -> Column:
    """The rational form of the three ranges: both polynomials by Horner, the leading coefficient of ``num`` last in it."""
    top, bottom = F.lit(num[-1]) * x, x
    for a, b in zip(num[:-2], den[:-1], strict=True):
        top, bottom = (top + a) * x, (bottom + b) * x
    return (top + num[-2]) / (bottom + den[-1])


def erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, to about 1e-15 relative."""
    x2 = x * x
    near = F.lit(1.0) - x * _ratio(x2, ERF_NUM, ERF_DEN)
    mid = F.exp(-x2) * _ratio(x, MID_NUM, MID_DEN)
    inv = F.lit(1.0) / x2
    far = F.exp(-x2) / x * (F.lit(1 / sqrt(pi)) - inv * _ratio(inv, FAR_NUM, FAR_DEN))
    return F.when(x <= 0.46875, near).when(x <= 4.0, mid).otherwise(far)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal statistic, in [0, 1]."""
    return F.when(z.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), erfc(F.abs(z) / sqrt(2.0)))))


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def z_two_sided(confidence: float) -> float:
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must be between 0 and 1")
    return quantile(1.0 - (1.0 - confidence) / 2.0)


def wilson(successes: Column, total: Column, z: float) -> tuple[Column, Column]:
    """Wilson score limits, clipped to [0, 1]."""
    n, rate = total.cast("double"), successes / total
    scale = 1.0 + F.lit(z * z) / n
    centre = (rate + F.lit(z * z) / (2.0 * n)) / scale
    half = F.lit(z) * F.sqrt(rate * (1.0 - rate) / n + F.lit(z * z) / (4.0 * n * n)) / scale
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def wilson_around(successes: Column, total: Column, z: float) -> tuple[Column, Column]:
    """Wilson limits widened, where rounding needs it, to hold the rate itself."""
    low, high = wilson(successes, total, z)
    return F.least(successes / total, low), F.greatest(successes / total, high)


def pooled_z(ts: Column, tn: Column, cs: Column, cn: Column) -> Column:
    """Score statistic of two proportions; 0 where the pooled error is 0."""
    pooled = (ts + cs) / (tn + cn)
    error = F.sqrt(pooled * (1.0 - pooled) * (1.0 / tn.cast("double") + 1.0 / cn.cast("double")))
    return F.when(error == 0.0, F.lit(0.0)).otherwise((ts / tn - cs / cn) / error)


def newcombe(ts: Column, tn: Column, cs: Column, cn: Column, z: float) -> tuple[Column, Column]:
    """Hybrid interval of a risk difference, clipped to [-1, 1]."""
    t, c = ts / tn, cs / cn
    t_low, t_high = wilson(ts, tn, z)
    c_low, c_high = wilson(cs, cn, z)
    low = t - c - F.sqrt(F.pow(t - t_low, 2) + F.pow(c_high - c, 2))
    high = t - c + F.sqrt(F.pow(t_high - t, 2) + F.pow(c - c_low, 2))
    return F.greatest(F.lit(-1.0), low), F.least(F.lit(1.0), high)


def relative_risk(ts: Column, tn: Column, cs: Column, cn: Column, z: float) -> tuple[Column, Column, Column]:
    """Relative risk with its log interval; half a success is added where a success count is 0."""
    fix = (ts == 0) | (cs == 0)
    half, one = F.when(fix, F.lit(0.5)).otherwise(F.lit(0.0)), F.when(fix, F.lit(1.0)).otherwise(F.lit(0.0))
    a, n, b, m = ts + half, tn + one, cs + half, cn + one
    ratio = (a / n) / (b / m)
    error = F.sqrt(F.greatest(F.lit(0.0), 1.0 / a - 1.0 / n) + F.greatest(F.lit(0.0), 1.0 / b - 1.0 / m))
    return ratio, F.exp(F.log(ratio) - F.lit(z) * error), F.exp(F.log(ratio) + F.lit(z) * error)


def upper_bound(ts: Column, tn: Column, cs: Column, cn: Column, tail_alpha: float) -> Column:
    """One-sided upper bound of a risk difference from one-sided Wilson limits, at most 1."""
    z = quantile(1.0 - tail_alpha)
    t, c = ts / tn, cs / cn
    _, t_high = wilson(ts, tn, z)
    c_low, _ = wilson(cs, cn, z)
    return F.least(F.lit(1.0), t - c + F.sqrt(F.pow(t_high - t, 2) + F.pow(c - c_low, 2)))


def chi_square_tail(statistic: Column, df: int) -> Column:
    """Survival function of chi-square: a finite sum, which for an odd number of degrees of freedom starts from a normal tail."""
    if df <= 0 or int(df) != df:
        raise ValueError("degrees of freedom must be whole and positive")
    half, total = statistic / 2.0, F.lit(0.0)
    if df % 2:
        term = F.sqrt(half) * F.lit(2 / sqrt(pi))  # half ** (k - 1/2) / gamma(k + 1/2), from k = 1 on
        for k in range(1, df // 2 + 1):
            total, term = total + term, term * half / (k + 0.5)
        tail = erfc(F.sqrt(half)) + F.exp(-half) * total
    else:
        term = F.lit(1.0)
        for k in range(df // 2):
            total, term = total + term, term * half / float(k + 1)
        tail = F.exp(-half) * total
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))


def mde(baseline: Column, control_total: Column, treatment_total: Column, *, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Detectable lift of a two-sided test at the baseline's variance, at most 1 - baseline."""
    if not (0.0 < alpha < 1.0 and 0.0 < power < 1.0):
        raise ValueError("alpha and power must be between 0 and 1")
    error = F.sqrt(baseline * (1.0 - baseline) * (1.0 / control_total.cast("double") + 1.0 / treatment_total.cast("double")))
    return F.least(1.0 - baseline, F.lit(quantile(1.0 - alpha / 2.0) + quantile(power)) * error)


def with_holm(df: DataFrame, p: str, out: str, family: list[str], keys: list[str]) -> DataFrame:
    """Holm-adjusted p within a family, in column ``out``; ``keys`` settle ties. A family is one window partition."""
    window = Window.partitionBy(*family)
    order = window.orderBy(p, *keys)
    ranked = df.withColumn("_m", F.count(F.lit(1)).over(window)).withColumn("_k", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_k") + 1)).over(upto))).drop("_m", "_k")


def with_bh(df: DataFrame, p: str, out: str, family: list[str], keys: list[str]) -> DataFrame:
    """Benjamini-Hochberg: the least of p x m / rank over this and all larger p."""
    window = Window.partitionBy(*family)
    order = window.orderBy(p, *keys)
    ranked = df.withColumn("_m", F.count(F.lit(1)).over(window)).withColumn("_k", F.row_number().over(order))
    down = window.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_k")).over(down))).drop("_m", "_k")


def rounded(c: Column, digits: int = 9) -> Column:
    """For reports: rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
