"""Confidence bands for integrated variance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.constants import normal_quantile
from tickloom.functions.returns import KEYS
from tickloom.operators.jumps import IQ, IV
from tickloom.operators.realized import realized


def iv_inference(ticks: DataFrame, iv: str = "RV", iq: str = "rTPQuar", confidence: float = 0.95) -> DataFrame:
    """(symbol, day, iv, iq, se, lower, upper); the estimators are honoured, and the defaults are those
    that the coded form always uses."""
    rows = realized(ticks, list(dict.fromkeys([IV[iv], IQ[iq]])))
    v, q = F.col(IV[iv]), F.col(IQ[iq])
    se = F.when((q > 0) & (F.col("n") > 0), F.sqrt(F.try_divide(2 * q, F.col("n")))).otherwise(0.0)
    z = normal_quantile((1 + confidence) / 2)
    return rows.select(*KEYS, v.alias("iv"), q.alias("iq"), se.alias("se")).select(*KEYS, "iv", "iq", "se", F.greatest(F.lit(0.0), F.col("iv") - z * F.col("se")).alias("lower"), (F.col("iv") + z * F.col("se")).alias("upper"))
