"""Realized measures of one series: every measure of a group comes from one window pass and one aggregation.

The partition of the window and of the aggregation is (symbol, day): one shuffle, whatever the number of
measures. n is the number of returns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.constants import TRIPOWER, mu_p
from tickloom.functions.returns import KEYS, lags, log_returns, median3, min2, product, series

PI, ROOT3 = math.pi, math.sqrt(3)
#: Terms of the sums, over a = |r| and its predecessors.
TERMS = {
    "r2": lambda r, a: r * r,
    "r3": lambda r, a: r * r * r,
    "r4": lambda r, a: r * r * r * r,
    "down": lambda r, a: F.when(r < 0, r * r),
    "up": lambda r, a: F.when(r > 0, r * r),
    "aa": lambda r, a: a[0] * a[1],
    "min2": lambda r, a: F.pow(min2(a[0], a[1]), 2),
    "min4": lambda r, a: F.pow(min2(a[0], a[1]), 4),
    "med2": lambda r, a: F.pow(median3(a[0], a[1], a[2]), 2),
    "med4": lambda r, a: F.pow(median3(a[0], a[1], a[2]), 4),
    "tri": lambda r, a: product([F.pow(x, F.lit(4 / 3)) for x in a[:3]]),
    "quad": lambda r, a: product(a[:4]),
}


def _guard(least: int, value: Column) -> Column:
    return F.when(F.col("n") < least, 0.0).otherwise(value)


def _ratio(k: int) -> Column:
    """n / (n - k), null where that is not defined."""
    return F.try_divide(F.col("n"), F.col("n") - k)


def _moment(power: float, name: str) -> Column:
    spread = F.try_divide(F.col("r2"), F.col("n"))
    return F.when(F.col("r2") < 1e-15, 0.0).otherwise(F.try_divide(F.try_divide(F.col(name), F.col("n")), F.pow(spread, power)))


#: Measure -> the sums that it needs and its value by them.
MEASURES: dict[str, tuple[tuple[str, ...], object]] = {
    "rrvar": (("r2",), lambda: F.col("r2")),
    "rbpvar": (("aa",), lambda: F.lit(PI / 2) * F.col("aa")),
    "rmedrvar": (("med2",), lambda: _guard(3, F.lit(PI / (6 - 4 * ROOT3 + PI)) * _ratio(2) * F.col("med2"))),
    "rminrvar": (("min2",), lambda: _guard(2, F.lit(PI / (PI - 2)) * _ratio(1) * F.col("min2"))),
    "rsvar_down": (("down",), lambda: F.col("down")),
    "rsvar_up": (("up",), lambda: F.col("up")),
    "rquar": (("r4",), lambda: (F.col("n") + 1) / 3 * F.col("r4")),
    "rtpquar": (("tri",), lambda: _guard(3, F.col("n") * _ratio(2) * F.lit(TRIPOWER**-3) * F.col("tri"))),
    "rmedrquar": (("med4",), lambda: _guard(3, F.lit(3 * PI / (9 * PI + 72 - 52 * ROOT3)) * F.col("n") * _ratio(2) * F.col("med4"))),
    "rminrquar": (("min4",), lambda: _guard(2, F.lit(PI / (3 * PI - 8)) * F.col("n") * _ratio(1) * F.col("min4"))),
    "rqpvar": (("quad",), lambda: _guard(4, F.col("n") * _ratio(3) * F.lit((PI / 2) ** 2) * F.col("quad"))),
    "rskew": (("r2", "r3"), lambda: _moment(1.5, "r3")),
    "rkurt": (("r2", "r4"), lambda: _moment(2, "r4")),
}


def realized_from_returns(returns: DataFrame, measures: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, n and the measures from rows with r (null at a series' start), ts and seq."""
    unknown = set(measures) - set(MEASURES)
    if unknown:
        raise ValueError(f"unknown measures {sorted(unknown)}; known: {sorted(MEASURES)}")
    sums = list(dict.fromkeys(t for m in measures for t in MEASURES[m][0]))
    a = [f"_a{i}" for i in range(4)]
    rows = returns.withColumns(dict(zip(a, lags(F.abs("r"), 4, series(*keys)))))
    aggregates = [F.coalesce(F.sum(TERMS[t](F.col("r"), [F.col(x) for x in a])), F.lit(0.0)).alias(t) for t in sums]
    out = rows.groupBy(*keys).agg(F.count("r").alias("n"), *aggregates)
    return out.select(*keys, "n", *[MEASURES[m][1]().alias(m) for m in measures])


def realized(ticks: DataFrame, measures: list[str]) -> DataFrame:
    """(symbol, day, n, measures) of ticks."""
    return realized_from_returns(log_returns(ticks), measures)


def multipower(ticks: DataFrame, m: int = 2, p: float = 2.0) -> DataFrame:
    """Multipower variation of m adjacent returns to a total power of p."""
    if m <= p / 2:
        raise ValueError("m must exceed p / 2")
    rows = log_returns(ticks)
    rows = rows.withColumn("_x", product(lags(F.pow(F.abs("r"), F.lit(p / m)), m, series())))
    out = rows.groupBy(*KEYS).agg(F.count("r").alias("n"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("s"))
    value = F.lit(mu_p(p / m) ** -m) * F.pow(F.col("n").cast("double"), F.lit(p / 2)) / (F.col("n") - m + 1) * F.col("s")
    return out.select(*KEYS, F.when(F.col("n") < m, 0.0).otherwise(value).alias("rmpvar"))
