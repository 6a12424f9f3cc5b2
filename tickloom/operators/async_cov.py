"""Covariances of ticks that do not share a clock.

Ticks of a symbol at one time are one tick, the last by seq (then by price): the order of rows never counts.

Overlap sums telescope: the returns of one symbol that overlap an interval of the other add up to the
difference of two as-of prices, so windows over a union replace the interval join, O(n log n). Refresh
times are a sequential recurrence and run grouped by (day, pair)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.noise import modulated, pre_average_window, pre_averaged, total, two_scale
from tickloom.operators.panel import PAIR
from tickloom.operators.realized import realized
from tickloom.sources.tables import tick_hours


def last_ticks(ticks: DataFrame) -> DataFrame:
    """(day, symbol, t, seq, lp): one tick for each time of a symbol."""
    w = Window.partitionBy("symbol", "day").orderBy("ts", "seq", "price")
    rows = ticks.withColumn("_next", F.lead("ts").over(w)).filter("_next IS NULL OR _next != ts")
    return rows.select("day", "symbol", tick_hours("ts").alias("t"), "seq", F.ln("price").alias("lp"))


def pair_ticks(ticks: DataFrame) -> DataFrame:
    """(day, sym_i, sym_j, side, t, seq, lp): every tick once for each other symbol of its day; side is 1 for
    the first symbol of the pair. Symbols are few against ticks; the symbol list of a day is distinct."""
    rows = last_ticks(ticks)
    names = ticks.select("day", F.col("symbol").alias("other")).distinct()
    both = rows.join(names, "day").filter("symbol != other")
    return both.select("day", F.least("symbol", "other").alias("sym_i"), F.greatest("symbol", "other").alias("sym_j"), F.when(F.col("symbol") < F.col("other"), 1).otherwise(2).alias("side"), "t", "seq", "lp")


def overlap_sums(rows: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Sums of products of overlapping returns for rows (keys, side, t, lp); no pair of intervals is built."""
    part = Window.partitionBy(*keys)
    two = F.when(F.col("side") == 2, F.col("lp"))
    at_or_before = F.last(two, ignorenulls=True).over(part.orderBy("t").rangeBetween(Window.unboundedPreceding, 0))
    at_or_after = F.last(two, ignorenulls=True).over(part.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0))
    ends = F.when(F.col("side") == 2, F.struct("t", "lp"))
    rows = rows.withColumns({"_p": at_or_before, "_n": at_or_after, "_lo": F.min(ends).over(part)["lp"], "_hi": F.max(ends).over(part)["lp"]})
    one = rows.filter("side = 1").withColumns({"_p": F.coalesce("_p", "_lo"), "_n": F.coalesce("_n", "_hi")})
    w = part.orderBy("t")
    term = (F.col("lp") - F.lag("lp").over(w)) * (F.col("_n") - F.lag("_p").over(w))
    return one.withColumn("_x", term).groupBy(*keys).agg(F.coalesce(F.sum("_x"), F.lit(0.0)).alias(name))


def overlap_covariance(ticks: DataFrame) -> DataFrame:
    """Diagonal: realized variance; off it: overlap sums."""
    own = realized(ticks, ["rrvar"]).select("day", F.col("symbol").alias("sym_i"), F.col("symbol").alias("sym_j"), F.col("rrvar").alias("rhycov"))
    return own.unionByName(overlap_sums(pair_ticks(ticks), PAIR, "rhycov"))


def shifted_covariances(ticks: DataFrame, max_lag: int = 10) -> DataFrame:
    """(day, sym_i, sym_j, lag, covariance): overlap sums with the second clock shifted by each lag."""
    rows = pair_ticks(ticks).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    rows = rows.withColumn("t", F.when(F.col("side") == 2, F.col("t") + F.col("lag")).otherwise(F.col("t")))
    return overlap_sums(rows, (*PAIR, "lag"), "covariance")


def lead_lag(ticks: DataFrame, max_lag: int = 10) -> DataFrame:
    """The lag of the largest absolute covariance (the first wins ties) and its label as coded; note that a
    positive lag moves the second clock forward, so the second symbol moved earlier."""
    best = Window.partitionBy(*PAIR).orderBy(F.desc(F.abs("covariance")), "lag")
    out = shifted_covariances(ticks, max_lag).withColumn("_k", F.row_number().over(best)).filter("_k = 1")
    label = F.when(F.col("lag") > 0, F.concat(F.lit("Series 1 leads series 2 by "), F.col("lag"))).when(F.col("lag") < 0, F.concat(F.lit("Series 2 leads series 1 by "), F.abs("lag"))).otherwise("No lead-lag relationship")
    return out.select(*PAIR, "lag", "covariance", label.alias("interpretation"))


def refresh_times(*clocks: np.ndarray) -> np.ndarray:
    """The refresh times of increasing clocks: the first time at which all have ticked, then again from just
    after it."""
    if not clocks or not all(len(t) for t in clocks):
        return np.zeros(0)
    # For every tick of any clock, the first tick after it of the clock that is last to tick: a step of the walk.
    every = np.unique(np.concatenate(clocks))
    later = [np.append(t, np.inf)[np.searchsorted(t, every, "right")] for t in clocks]
    step = np.searchsorted(every, np.max(later, axis=0)).tolist()
    last, at, out = int(np.searchsorted(every, min(t[-1] for t in clocks))), int(np.searchsorted(every, max(t[0] for t in clocks))), []
    while at <= last:
        out.append(at)
        at = step[at]
    return every[out] if out else np.zeros(0)


def refresh_panel(ticks: DataFrame, variant: str = "faithful") -> DataFrame:
    """(day, m, t, symbols, lps) on the refresh times that all symbols of a day have in common; values as in
    refresh_sync, in the order of the symbols."""
    side = "right" if variant == "literature" else "left"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("t", "ascending"), ("seq", "ascending")])
        symbol = rows.column("symbol").to_numpy()
        t, lp = (rows.column(c).to_numpy() for c in ("t", "lp"))
        names = sorted(set(symbol))
        series = [(t[symbol == k], lp[symbol == k]) for k in names]
        grid = refresh_times(*(clock for clock, _ in series))
        values = np.stack([v[np.maximum(np.searchsorted(clock, grid, side) - 1, 0)] for clock, v in series], 1)
        head = {"day": pa.array([key[0].as_py()] * len(grid), pa.string()), "m": pa.array(np.arange(len(grid))), "t": grid}
        return pa.table({**head, "symbols": pa.array([names] * len(grid), pa.list_(pa.string())), "lps": pa.array(list(values), pa.list_(pa.float64()))})

    rows = last_ticks(ticks.filter("symbol IS NOT NULL")).withColumn("day", F.col("day").cast("string"))
    return rows.groupBy("day").applyInArrow(run, "day string, m long, t double, symbols array<string>, lps array<double>")


def refresh_sync(ticks: DataFrame, variant: str = "faithful") -> DataFrame:
    """(day, sym_i, sym_j, m, t, lp_i, lp_j) on the pair's refresh times. A value is the last one strictly
    before the time (the first one if none is); variant="literature" takes at-or-before."""
    side = "right" if variant == "literature" else "left"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("t", "ascending"), ("seq", "ascending")])
        which, t, lp = (rows.column(c).to_numpy() for c in ("side", "t", "lp"))
        series = [(t[which == k], lp[which == k]) for k in (1, 2)]
        grid = refresh_times(series[0][0], series[1][0])
        values = [v[np.maximum(np.searchsorted(clock, grid, side) - 1, 0)] for clock, v in series]
        head = {k: pa.array([x.as_py()] * len(grid), pa.string()) for k, x in zip(PAIR, key, strict=True)}
        return pa.table({**head, "m": pa.array(np.arange(len(grid))), "t": grid, "lp_i": values[0], "lp_j": values[1]})

    return pair_ticks(ticks).groupBy(*PAIR).applyInArrow(run, "day string, sym_i string, sym_j string, m long, t double, lp_i double, lp_j double")


def _all_pairs(ticks: DataFrame, out: DataFrame, name: str) -> DataFrame:
    """Pairs without enough refresh times have value 0."""
    names = ticks.select("day", "symbol").distinct()
    pairs = names.withColumnRenamed("symbol", "sym_i").join(names.withColumnRenamed("symbol", "sym_j"), "day").filter("sym_i < sym_j")
    return pairs.join(out, list(PAIR), "left").select(*PAIR, F.coalesce(name, F.lit(0.0)).alias(name))


def two_scale_covariance(ticks: DataFrame, k: int = 300, j: int = 1, name: str = "rtscov") -> DataFrame:
    """Diagonal: two-scale variance of the ticks; off it: two scales on the pair's refresh times, 0 for fewer
    than k + 1 of them."""
    own = two_scale(ticks, k, j).select("day", F.col("symbol").alias("sym_i"), F.col("symbol").alias("sym_j"), F.col("rtsvar").alias(name))
    w = Window.partitionBy(*PAIR).orderBy("m")
    gap = lambda n: (F.col("lp_i") - F.lag("lp_i", n).over(w)) * (F.col("lp_j") - F.lag("lp_j", n).over(w))
    rows = refresh_sync(ticks).withColumns({"_k": gap(k), "_j": gap(j)})
    out = rows.groupBy(*PAIR).agg(F.count("*").alias("n"), F.sum("_k").alias("sk"), F.sum("_j").alias("sj")).filter(F.col("n") >= k + 1)
    bar_k, bar_j = (F.col("n") - k) / k, (F.col("n") - j) / j
    value = F.col("n") / ((k - j) * bar_k) * (F.col("sk") / k - bar_k / bar_j * F.col("sj") / j)
    return own.unionByName(_all_pairs(ticks, out.select(*PAIR, value.alias(name)), name))


def robust_two_scale_covariance(ticks: DataFrame, k: int = 300, j: int = 1) -> DataFrame:
    """The robust form: its weights are all one as coded, so it equals the plain form."""
    return two_scale_covariance(ticks, k, j, "rrtscov")


def modulated_covariance(ticks: DataFrame, theta: float = 0.8) -> DataFrame:
    """Diagonal: pre-averaged variance; off it: products of pre-averaged returns on refresh times, 0 for fewer
    than four of them."""
    own = modulated(ticks, theta).select("day", F.col("symbol").alias("sym_i"), F.col("symbol").alias("sym_j"), F.col("rmrvar").alias("rmrcov"))
    w = Window.partitionBy(*PAIR).orderBy("m")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = refresh_sync(ticks).withColumns({c: F.col(c) - F.first(c).over(upto) for c in ("lp_i", "lp_j")})
    rows = rows.withColumns({c: F.sum(c).over(upto) for c in ("lp_i", "lp_j")})
    out = rows.groupBy(*PAIR).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("m", "lp_i", "lp_j"))).alias("s")).filter("n >= 4")
    out = out.withColumns({"kn": pre_average_window(F.col("n"), theta), "ui": F.transform("s", lambda x: x["lp_i"]), "uj": F.transform("s", lambda x: x["lp_j"])})
    out = out.withColumns({"pi": pre_averaged(F.col("ui"), F.col("kn")), "pj": pre_averaged(F.col("uj"), F.col("kn"))})
    value = F.col("n") / (F.col("n") - F.col("kn") + 2) * (F.lit(12.0) / F.col("kn")) * total(F.zip_with("pi", "pj", lambda x, y: x * y))
    return own.unionByName(_all_pairs(ticks, out.select(*PAIR, value.alias("rmrcov")), "rmrcov"))
