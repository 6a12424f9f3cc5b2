"""Spot volatility, spot drift and drift bursts over centred, truncated windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.constants import normal_quantile
from tickloom.functions.returns import KEYS, log_returns, series


def _near(window: int):
    return series().rowsBetween(-(window // 2), window // 2)


def _rows(ticks: DataFrame) -> DataFrame:
    rows = log_returns(ticks).filter("r IS NOT NULL")
    return rows.withColumn("idx", F.row_number().over(series()) - 1)


def spot_vol(ticks: DataFrame, window: int = 20) -> DataFrame:
    """The root of the window's sum of squares (not divided by its length)."""
    return _rows(ticks).withColumn("spotvol", F.sqrt(F.sum(F.col("r") * F.col("r")).over(_near(window)))).select(*KEYS, "idx", "spotvol")


def spot_drift(ticks: DataFrame, window: int = 20) -> DataFrame:
    return _rows(ticks).withColumn("spotdrift", F.avg("r").over(_near(window))).select(*KEYS, "idx", "spotdrift")


def drift_statistics(ticks: DataFrame, vol_window: int = 20, drift_window: int = 5) -> DataFrame:
    near = _near(drift_window)
    vol = F.sqrt(F.avg(F.col("r") * F.col("r")).over(_near(vol_window)))
    t = F.avg("r").over(near) * F.sqrt(F.count("*").over(near)) / F.col("vol")
    rows = _rows(ticks).withColumn("vol", vol)
    return rows.withColumn("tstat", F.when(F.col("vol") > 1e-10, t)).select(*KEYS, "idx", "tstat")


def drift_bursts(ticks: DataFrame, vol_window: int = 20, drift_window: int = 5, alpha: float = 0.99) -> DataFrame:
    rows = drift_statistics(ticks, vol_window, drift_window)
    burst = F.coalesce(F.abs("tstat") > normal_quantile(alpha), F.lit(False)).cast("int")
    return rows.groupBy(*KEYS).agg(F.sum(burst).alias("n_bursts"), F.max(F.abs("tstat")).alias("max_tstat"))
