"""Jump tests, from the fused realized measures of a group or from local windows within it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import THETA, mu_p, normal_quantile
from tickloom.functions.returns import KEYS, log_returns, series
from tickloom.functions.stats import two_sided_p
from tickloom.operators.realized import realized

IV = {"RV": "rrvar", "BV": "rbpvar", "rMedRVar": "rmedrvar", "rMinRVar": "rminrvar"}
IQ = {"rQuar": "rquar", "rTPQuar": "rtpquar", "rMedRQuar": "rmedrquar", "rMinRQuar": "rminrquar"}


def bns(ticks: DataFrame, iv: str = "BV", iq: str = "rTPQuar", test_type: str = "linear", log_transform: bool = False, alpha: float = 0.975, variant: str = "faithful") -> DataFrame:
    """(symbol, day, ztest, pvalue, critical_value, iv, iq). The linear log form is zero as coded;
    variant="literature" compares log RV with log IV."""
    if iv not in IV or iq not in IQ:
        raise ValueError(f"unknown estimator {iv!r} or {iq!r}")
    rows = realized(ticks, list(dict.fromkeys(["rrvar", IV[iv], IQ[iq]])))
    v, q, n, rv = F.col(IV[iv]), F.col(IQ[iq]), F.col("n"), F.col("rrvar")
    scale = F.lit(THETA[iv]) * q
    if test_type == "linear" and log_transform:
        top = F.log(rv) - F.log(v) if variant == "literature" else F.lit(0.0)
        z = F.when((v > 0) & (q > 0), F.try_divide(top, F.sqrt(scale / (n * v * v)))).otherwise(0.0)
    elif test_type == "linear":
        z = F.when((scale > 0) & (v > 0), F.try_divide(rv - v, F.sqrt(F.try_divide(scale, n)))).otherwise(0.0)
    else:
        z = F.when((v > 0) & (rv > 0), F.try_divide(F.try_divide(rv, v) - 1, F.sqrt(F.try_divide(scale, n * v * v)))).otherwise(0.0)
    out = rows.select(*KEYS, z.alias("ztest"), v.alias("iv"), q.alias("iq"))
    return out.select(*KEYS, "ztest", two_sided_p("ztest").alias("pvalue"), F.lit(normal_quantile(alpha)).alias("critical_value"), "iv", "iq")


def aj(ticks: DataFrame, p: float = 4.0, alpha: float = 0.975) -> DataFrame:
    rows = log_returns(ticks).groupBy(*KEYS).agg(F.count("r").alias("n"), F.coalesce(F.sum(F.pow(F.abs("r"), F.lit(p))), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.pow(F.abs("r"), F.lit(p / 2))), F.lit(0.0)).alias("b"))
    centre, spread = mu_p(p) / mu_p(p / 2) ** 2, mu_p(p) ** 2 / mu_p(p / 2) ** 4 - 1
    ok = F.col("b") > 1e-15
    ratio = F.when(ok, F.try_divide(F.col("a"), F.col("b") * F.col("b")))
    z = F.when(ok, (ratio - centre) / F.sqrt(F.try_divide(F.lit(spread), F.col("n")))).otherwise(0.0)
    out = rows.select(*KEYS, z.alias("ztest"), ratio.alias("ratio"))
    return out.select(*KEYS, "ztest", two_sided_p("ztest").alias("pvalue"), F.lit(normal_quantile(alpha)).alias("critical_value"), "ratio")


def local_jumps(rows: DataFrame, window: int, alpha: float, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Rows with r (none null) plus idx from 0, sigma, stat, critical_value, jump, jump_size."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near = w.rowsBetween(-(window // 2), window // 2)
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = rows.withColumn("idx", F.row_number().over(w) - 1).withColumn("_b", F.abs("r") * F.abs(F.lag("r").over(w)))
    rows = rows.withColumns({"n": n, "_local": F.coalesce(F.avg("_b").over(near), F.lit(0.0))})
    c = F.when(F.col("n") > 1, F.sqrt(2 * F.log(F.col("n").cast("double"))))
    s = c / F.sqrt(2 * F.log(c))
    rows = rows.withColumns({"sigma": F.sqrt(F.lit(math.pi / 2) * F.col("_local") * F.col("n") + 1e-15), "critical_value": c / s + F.lit(normal_quantile(alpha)) / s})
    rows = rows.withColumn("stat", F.abs("r") / F.col("sigma"))
    jump = F.coalesce((F.col("stat") > F.col("critical_value")) & (F.col("idx") > 0), F.lit(False))
    return rows.withColumn("jump", jump).withColumn("jump_size", F.when(jump, F.col("r")).otherwise(0.0)).drop("_b", "_local")


def intraday(ticks: DataFrame, window: int = 78, alpha: float = 0.999) -> DataFrame:
    rows = log_returns(ticks).filter("r IS NOT NULL")
    return local_jumps(rows, window, alpha, KEYS, ("ts", "seq")).select(*KEYS, "idx", "r", "sigma", "stat", "critical_value", "jump", "jump_size")


def panel_jumps(panel: DataFrame, window: int = 78, alpha: float = 0.999) -> DataFrame:
    return local_jumps(panel.withColumnRenamed("idx", "_place"), window, alpha, ("symbol", "day"), ("_place",))


def cojumps(panel: DataFrame, window: int = 78, alpha: float = 0.999) -> DataFrame:
    """(day, n_cojumps): places at which two symbols or more jump."""
    at = panel_jumps(panel, window, alpha).groupBy("day", "idx").agg(F.sum(F.col("jump").cast("int")).alias("k"))
    return at.groupBy("day").agg(F.sum((F.col("k") >= 2).cast("int")).alias("n_cojumps"))


def cojump_places(panel: DataFrame, window: int = 78, alpha: float = 0.999) -> DataFrame:
    """(day, idx, n_jumps, cojump): how many symbols jump at each place, and whether two or more do."""
    at = panel_jumps(panel, window, alpha).groupBy("day", "idx").agg(F.sum(F.col("jump").cast("int")).alias("n_jumps"))
    return at.select("day", "idx", "n_jumps", (F.col("n_jumps") >= 2).alias("cojump"))


def rank(value: Column, over: list[str]) -> Column:
    """Average ranks of ties."""
    w = Window.partitionBy(*over).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*over, value)) - 1) / 2


def rank_correlation(panel: DataFrame, window: int = 78, alpha: float = 0.999, least: int = 5) -> DataFrame:
    """(day, sym_i, sym_j, n, rho, tstat): Spearman's correlation of jump sizes where either jumps, null for
    ``least`` such places or fewer; the p-value follows from tstat with n - 2 degrees of freedom."""
    rows = panel_jumps(panel, window, alpha).select("day", "idx", "symbol", "jump_size")
    a, b = (rows.select("day", "idx", F.col("symbol").alias(f"sym_{s}"), F.col("jump_size").alias(s)) for s in "ij")
    pairs = a.join(b, ["day", "idx"]).filter("sym_i < sym_j")
    key = ["day", "sym_i", "sym_j"]
    hit = pairs.filter("i != 0 OR j != 0")
    hit = hit.withColumns({"ri": rank(F.col("i"), key), "rj": rank(F.col("j"), key)})
    rho = hit.groupBy(*key).agg(F.count("*").alias("n"), F.corr("ri", "rj").alias("rho"))
    out = pairs.select(*key).distinct().join(rho, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("rho", F.when(F.col("n") > least, F.when(~F.isnan("rho"), F.col("rho"))))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, (1 - F.col("rho")) * (1 + F.col("rho"))))
    return out.select(*key, "n", "rho", t.alias("tstat"))
