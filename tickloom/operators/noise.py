"""Estimators that are robust to market noise: two scales, kernels, pre-averaging, noise covariances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import gfunction, kernel_weight
from tickloom.functions.returns import KEYS, log_returns, series


def two_scale(ticks: DataFrame, k: int = 300, j: int = 1) -> DataFrame:
    """The grids of one scale tile all lags of that scale, so one lag column a scale is enough."""
    lp = F.ln("price")
    gap = lambda n: F.pow(lp - F.lag(lp, n).over(series()), 2)
    rows = ticks.withColumns({"_k": gap(k), "_j": gap(j)})
    out = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.coalesce(F.sum("_k"), F.lit(0.0)).alias("sk"), F.coalesce(F.sum("_j"), F.lit(0.0)).alias("sj"))
    bars = F.try_divide((F.col("n") - k) / k, (F.col("n") - j) / j)
    value = F.try_divide(F.col("sk") / k - bars * F.col("sj") / j, 1 - bars)
    return out.select(*KEYS, value.alias("rtsvar"))


def kernel_terms(a: Column, b: Column, n_lags: int, window) -> dict[str, Column]:
    """Cross products of a and b at lags 0 to n_lags, both ways for positive lags."""
    out = {"_c0": a * b}
    for h in range(1, n_lags + 1):
        out[f"_c{h}"] = F.lag(a, h).over(window) * b + a * F.lag(b, h).over(window)
    return out


def kernel_value(n_lags: int, kernel: str, dof_adj: bool) -> Column:
    total = F.col("_c0")
    for h in range(1, n_lags + 1):
        adj = F.coalesce(F.try_divide(F.col("n") + 1, F.col("n") + 1 - h), F.lit(0.0)) if dof_adj else F.lit(1.0)
        total = total + F.lit(kernel_weight((h - 1) / n_lags, kernel)) * adj * F.col(f"_c{h}")
    return total


def realized_kernel(ticks: DataFrame, kernel: str = "parzen", n_lags: int = 1, dof_adj: bool = True) -> DataFrame:
    rows = log_returns(ticks)
    terms = kernel_terms(F.col("r"), F.col("r"), n_lags, series())
    rows = rows.withColumns(terms)
    out = rows.groupBy(*KEYS).agg(F.count("r").alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in terms])
    return out.select(*KEYS, kernel_value(n_lags, kernel, dof_adj).alias("rkernelvar"))


def _remedi_term(kn: int, lag: int) -> Column:
    w, p = series(), F.col("price")
    ahead = p if lag == 0 else F.lead(p, lag).over(w)
    return (ahead - F.lead(p, lag + kn).over(w)) * (p - F.lag(p, 2 * kn).over(w))


def remedi(ticks: DataFrame, kn: int = 1, lags: tuple[int, ...] = (1,)) -> DataFrame:
    """(symbol, day, lag, remedi): noise autocovariances on raw prices."""
    rows = ticks.withColumns({f"_l{g}": _remedi_term(kn, g) for g in lags})
    out = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"_l{g}"), F.lit(0.0)).alias(f"_l{g}") for g in lags])
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("lag"), (F.col(f"_l{g}") / F.col("n")).alias("remedi")) for g in lags]))
    return out.select(*KEYS, pairs.alias("x")).select(*KEYS, "x.lag", "x.remedi")


def choose_kn(ticks: DataFrame, max_kn: int = 30, tol: float = 1e-10) -> DataFrame:
    """The first kn at which the noise autocovariances cancel, else max_kn; all candidates in one pass."""
    signs = {0: 1, 1: -1, 2: -1, 3: 1}
    rows = ticks.withColumns({f"_{kn}_{g}": _remedi_term(kn, g) for kn in range(1, max_kn + 1) for g in signs})
    sums = [F.coalesce(F.sum(f"_{kn}_{g}"), F.lit(0.0)).alias(f"_{kn}_{g}") for kn in range(1, max_kn + 1) for g in signs]
    out = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), *sums)
    hit = [F.when(F.pow(sum(s * F.col(f"_{kn}_{g}") / F.col("n") for g, s in signs.items()), 2) < tol, kn) for kn in range(1, max_kn + 1)]
    return out.select(*KEYS, F.coalesce(*hit, F.lit(max_kn)).alias("kn"))


def pre_average_window(n: Column, theta: float) -> Column:
    return F.greatest(F.lit(2), F.floor(F.lit(theta) * F.sqrt(n)).cast("int"))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def pre_averaged(upto: Column, kn: Column) -> Column:
    """Weighted means of every kn adjacent returns from running sums of log prices, none if there are fewer.
    The weights rise and fall by equal steps, so by summation by parts a mean is the difference of two sums of
    kn / 2 log prices: four lookups, whatever kn is."""
    half = F.floor(kn / 2).cast("int")
    at = lambda i: F.element_at(upto, i.cast("int"))
    mean = lambda i: (at(i + kn) - at(i + kn - half) - at(i + half) + at(i)) / F.floor(kn * kn / 4)
    return F.when(F.size(upto) > kn, F.transform(F.sequence(F.lit(1), F.size(upto) - kn), mean)).otherwise(F.array().cast("array<double>"))


def psi_columns(kn: Column) -> tuple[Column, Column]:
    """The constants of a window that is a column, in closed form."""
    half = F.floor(kn / 2)
    below = half - F.when(kn % 2 == 0, 1).otherwise(0)
    squares = below * (below + 1) * (2 * below + 1) / 3 + F.when(kn % 2 == 0, half * half).otherwise(0)
    return 2 * half / kn, squares / (kn.cast("double") * kn * kn)


def pre_average(ticks: DataFrame, kn: int) -> DataFrame:
    """(symbol, day, idx, pre_averaged): weighted means of kn adjacent returns, for a kn that is known
    beforehand; lead columns, no arrays."""
    weights = [gfunction(j / kn) for j in range(kn)]
    rows = log_returns(ticks).filter("r IS NOT NULL")
    w = series()
    ahead = sum((F.lead("r", j).over(w) if j else F.col("r")) * g for j, g in enumerate(weights))
    rows = rows.withColumns({"idx": F.row_number().over(w) - 1, "pre_averaged": ahead / sum(weights), "_last": F.lead("r", kn - 1).over(w) if kn > 1 else F.col("r")})
    return rows.filter("_last IS NOT NULL").select(*KEYS, "idx", "pre_averaged")


def modulated(ticks: DataFrame, theta: float = 0.8) -> DataFrame:
    """Pre-averaged realized variance with its noise correction."""
    upto = series().rowsBetween(Window.unboundedPreceding, 0)
    rows = log_returns(ticks)
    # Log prices from 0 at the start of a series, and their running sum; a table of returns lacks the first one.
    rows = rows.withColumn("_lp", F.sum(F.coalesce("r", F.lit(0.0))).over(upto)).withColumn("_up", F.sum("_lp").over(upto))
    out = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "_up"))).alias("s"), F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("rr"))
    sums = F.transform("s", lambda x: x["_up"])
    out = out.withColumn("upto", sums if "price" in rows.columns else F.concat(F.array(F.lit(0.0)), sums)).withColumn("n", F.size("upto"))
    out = out.filter("n > 1").withColumn("kn", pre_average_window(F.col("n"), theta))
    psi1, psi2 = psi_columns(F.col("kn"))
    out = out.withColumns({"pa": pre_averaged(F.col("upto"), F.col("kn")), "psi1": psi1, "psi2": psi2})
    square = total(F.transform("pa", lambda x: x * x))
    value = square / (F.sqrt("n") * theta * F.col("psi2")) - F.col("psi1") / (2 * theta**2 * F.col("psi2") * F.col("n")) * F.col("rr")
    return out.select(*KEYS, value.alias("rmrvar"))
