"""Distribution functions: the normal cdf as a Column and as SQL, the Student t cdf for Arrow functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numerator and denominator of the rational approximation of the normal tail (highest power first).
TAIL_P = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_Q = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_tail_sql(z: str) -> str:
    """SQL for P(Z > z) with z >= 0; the same text runs in Spark and in DuckDB."""

    def horner(c: tuple[float, ...]) -> str:
        out = f"CAST({c[0]!r} AS DOUBLE)"
        for x in c[1:]:
            out = f"({out} * ({z}) + CAST({x!r} AS DOUBLE))"
        return out

    far = f"exp(-({z}) * ({z}) / 2) / 2.506628274631 / (({z}) + 1 / (({z}) + 2 / (({z}) + 3 / (({z}) + 4 / (({z}) + 0.65)))))"
    near = f"exp(-({z}) * ({z}) / 2) * {horner(TAIL_P)} / {horner(TAIL_Q)}"
    return f"CASE WHEN ({z}) > 37 THEN CAST(0 AS DOUBLE) WHEN ({z}) < 7.07106781186547 THEN {near} ELSE {far} END"


def two_sided_p(z: str) -> Column:
    """2 (1 - cdf(|z|)) of a column named z."""
    return F.expr(f"2 * ({normal_tail_sql(f'abs({z})')})")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t; NaN where it is undefined."""
    if df <= 0 or t != t:
        return math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))
