"""Windows over a series: returns and rolling helpers, as DataFrame columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEYS = ("symbol", "day")


def series(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy("ts", "seq")


def log_returns(ticks: DataFrame) -> DataFrame:
    """Adds r; a series' first row has none. A table that has a column r already holds returns and stays
    as it is, so every operator on ticks takes returns (symbol, day, ts, seq, r) as well."""
    if "r" in ticks.columns:
        return ticks
    return ticks.withColumn("r", F.ln(F.col("price") / F.lag("price").over(series())))


def simple_returns(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("r", F.col("price") / F.lag("price").over(series()) - 1)


def min2(a: Column, b: Column) -> Column:
    """The smaller one, null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def median3(a: Column, b: Column, c: Column) -> Column:
    """The middle one, null if any is null."""
    middle = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), middle)


def product(columns: list[Column]) -> Column:
    return reduce(lambda x, y: x * y, columns)


def lags(x: Column, n: int, window: WindowSpec) -> list[Column]:
    """x and its n - 1 predecessors."""
    return [x, *[F.lag(x, k).over(window) for k in range(1, n)]]
