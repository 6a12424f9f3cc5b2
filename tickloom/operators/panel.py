"""Covariances of an aligned panel (day, idx, symbol, r), as long matrices (day, sym_i, sym_j, value) with
sym_i <= sym_j. Pairs come from one self-join on (day, idx); everything after it is partitioned by pair."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.noise import kernel_terms, kernel_value

PAIR = ("day", "sym_i", "sym_j")


def pair_rows(panel: DataFrame, *carry: str) -> DataFrame:
    """(day, idx, sym_i, sym_j, a, b): every pair of symbols of a place, a symbol with itself included."""
    i = panel.select("day", "idx", F.col("symbol").alias("sym_i"), F.col("r").alias("a"), *carry)
    j = panel.select("day", "idx", F.col("symbol").alias("sym_j"), F.col("r").alias("b"))
    return i.join(j, ["day", "idx"]).filter("sym_i <= sym_j")


def _along() -> Window:
    return Window.partitionBy(*PAIR).orderBy("idx")


def covariance(panel: DataFrame) -> DataFrame:
    return pair_rows(panel).groupBy(*PAIR).agg(F.sum(F.col("a") * F.col("b")).alias("rcov"))


def bipower_covariance(panel: DataFrame) -> DataFrame:
    plus, minus, w = F.abs(F.col("a") + F.col("b")), F.abs(F.col("a") - F.col("b")), _along()
    rows = pair_rows(panel).withColumn("_x", plus * F.lag(plus).over(w) - minus * F.lag(minus).over(w))
    return rows.groupBy(*PAIR).agg((F.lit(math.pi / 8) * F.coalesce(F.sum("_x"), F.lit(0.0))).alias("rbpcov"))


def semi_covariance(panel: DataFrame) -> DataFrame:
    pos, neg = (lambda c: F.greatest(F.col(c), F.lit(0.0))), (lambda c: F.least(F.col(c), F.lit(0.0)))
    sums = {"positive": pos("a") * pos("b"), "negative": neg("a") * neg("b"), "mixed": pos("a") * neg("b") + neg("a") * pos("b"), "concordant": pos("a") * pos("b") + neg("a") * neg("b"), "rcov": F.col("a") * F.col("b")}
    return pair_rows(panel).groupBy(*PAIR).agg(*[F.sum(x).alias(k) for k, x in sums.items()])


def kernel_covariance(panel: DataFrame, kernel: str = "parzen", n_lags: int = 1, dof_adj: bool = True) -> DataFrame:
    terms = kernel_terms(F.col("a"), F.col("b"), n_lags, _along())
    rows = pair_rows(panel).withColumns(terms)
    out = rows.groupBy(*PAIR).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in terms])
    return out.select(*PAIR, kernel_value(n_lags, kernel, dof_adj).alias("rkernelcov"))


def threshold_covariance(panel: DataFrame, threshold: float | None = None) -> DataFrame:
    """Products above the threshold drop out off the diagonal; the default threshold is three times the
    root of the day's mean realized variance."""
    if threshold is None:
        rv = panel.groupBy("day", "symbol").agg(F.sum(F.col("r") * F.col("r")).alias("rv"))
        limit = rv.groupBy("day").agg((3 * F.sqrt(F.avg("rv"))).alias("limit"))
        rows = pair_rows(panel.join(limit, "day"), "limit")
    else:
        rows = pair_rows(panel.withColumn("limit", F.lit(threshold)), "limit")
    kept = (F.col("sym_i") == F.col("sym_j")) | ((F.abs("a") <= F.col("limit")) & (F.abs("b") <= F.col("limit")))
    return rows.groupBy(*PAIR).agg(F.coalesce(F.sum(F.when(kept, F.col("a") * F.col("b"))), F.lit(0.0)).alias("rthresholdcov"))


def averaged_covariance(panel: DataFrame, delta: int = 1, variant: str = "faithful") -> DataFrame:
    """Covariance averaged over sub-grids of every delta-th place. A place is in one grid, so grids need no
    copies of rows. As coded, a grid differences returns, grid 0 is left out and the last one counts twice;
    variant="literature" sums returns between grid places over all grids."""
    if delta == 1:
        return covariance(panel).withColumnRenamed("rcov", "ravgcov")
    rows = pair_rows(panel).withColumn("place", F.col("idx") - 1).withColumn("grid", F.col("place") % delta)
    if variant == "literature":
        w = _along()
        back = w.rowsBetween(-(delta - 1), 0)
        rows = rows.withColumns({"_a": F.sum("a").over(back), "_b": F.sum("b").over(back)}).filter(F.col("place") >= delta - 1)
        return rows.groupBy(*PAIR).agg((F.sum(F.col("_a") * F.col("_b")) / delta).alias("ravgcov"))
    w = Window.partitionBy(*PAIR, "grid").orderBy("place")
    step = (F.col("a") - F.lag("a").over(w)) * (F.col("b") - F.lag("b").over(w))
    n = F.count("*").over(Window.partitionBy(*PAIR))
    rows = rows.withColumns({"_x": step, "_n": n})
    bins = lambda offset: F.floor((F.col("_n") - offset) / delta)
    weight = F.when(F.col("grid") == delta - 1, 1.0).otherwise(0.0) + F.when((F.col("grid") > 0) & (bins(F.col("grid")) > 0), F.try_divide(bins(F.lit(delta - 1)), bins(F.col("grid")))).otherwise(0.0)
    return rows.groupBy(*PAIR).agg((F.coalesce(F.sum(weight * F.col("_x")), F.lit(0.0)) / delta).alias("ravgcov"))


def weighted_covariance(panel: DataFrame) -> DataFrame:
    """Places far from the medians of their day weigh less; medians are exact."""
    med = panel.groupBy("day", "symbol").agg(F.median("r").alias("med"))
    rows = panel.join(med, ["day", "symbol"]).withColumn("dev", F.abs(F.col("r") - F.col("med")))
    mad = rows.groupBy("day", "symbol").agg((F.median("dev") * 1.4826).alias("mad"))
    rows = rows.join(mad, ["day", "symbol"])
    d = rows.groupBy("day", "idx").agg(F.sum(F.pow(F.col("dev") / (F.col("mad") + 1e-10), 2)).alias("d"))
    weight: Column = F.when(F.col("d") > 9, F.lit(9.0) / F.col("d")).otherwise(1.0)
    weighted = panel.join(d.select("day", "idx", weight.alias("w")), ["day", "idx"])
    out = pair_rows(weighted, "w").groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("a") * F.col("b")).alias("s"))
    return out.select(*PAIR, (F.col("s") / F.col("sw") * F.col("n")).alias("rowcov"))
