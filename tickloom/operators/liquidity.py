"""Spreads and trade direction; trades meet quotes by an as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_quotes(trades: DataFrame, quotes: DataFrame, keys: tuple[str, ...] = ("day",)) -> DataFrame:
    """Every trade with the last quote of its group at or before it (null if there is none): one union and
    one window, no range join. A quote at a trade's own time counts; of several at one time the last by seq
    does (by bid and ask where quotes have no seq, or the same)."""
    seq = F.col("seq").cast("long") if "seq" in quotes.columns else F.lit(None).cast("long")
    q = quotes.select(*keys, "ts", F.lit(0).alias("side"), seq.alias("seq"), F.lit(None).cast("double").alias("price"), F.struct("bid", "ask").alias("q"))
    t = trades.select(*keys, "ts", F.lit(1).alias("side"), "seq", "price", F.lit(None).cast("struct<bid:double,ask:double>").alias("q"))
    w = Window.partitionBy(*keys).orderBy("ts", "side", "seq", "q.bid", "q.ask").rowsBetween(Window.unboundedPreceding, 0)
    rows = q.unionByName(t).withColumn("q", F.last("q", ignorenulls=True).over(w)).filter("side = 1")
    return rows.select(*keys, "ts", "seq", "price", "q.bid", "q.ask")


def trade_direction(matched: DataFrame, keys: tuple[str, ...] = ("day",)) -> DataFrame:
    """Adds direction: the quote test, then the tick test, then the previous direction (0 at the start)."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    mid, before = (F.col("bid") + F.col("ask")) / 2, F.lag("price").over(w)
    own = F.when(F.col("price") > mid, 1).when(F.col("price") < mid, -1).when(before.isNull(), 0).when(F.col("price") > before, 1).when(F.col("price") < before, -1)
    return matched.withColumn("_own", own).withColumn("direction", F.last("_own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_own")


def direction_summary(directed: DataFrame, keys: tuple[str, ...] = ("day",)) -> DataFrame:
    count = lambda d: F.sum((F.col("direction") == d).cast("int"))
    out = directed.groupBy(*keys).agg(count(1).alias("n_buys"), count(-1).alias("n_sells"), count(0).alias("n_unknown"), F.count("*").alias("n"))
    sided = F.col("n_buys") + F.col("n_sells")
    return out.select(*keys, "n_buys", "n_sells", "n_unknown", F.coalesce(F.try_divide(F.col("n_buys") - F.col("n_sells"), sided), F.lit(0.0)).alias("order_imbalance"), (F.col("n_buys") / F.col("n")).alias("buy_ratio"))


def liquidity_measures(quotes: DataFrame, keys: tuple[str, ...], price: str | None = None) -> DataFrame:
    """Eight spread and mid-price measures a group; effective spreads need the matched trade price column."""
    mid, spread = (F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid")
    pct = F.when(mid > 0, F.try_divide(spread, mid)).otherwise(0.0)
    aggs = [F.avg(spread).alias("quoted_spread_abs"), F.avg(pct).alias("quoted_spread_pct"), F.stddev_pop(spread).alias("quoted_spread_abs_std"), F.stddev_pop(pct).alias("quoted_spread_pct_std"), F.avg(mid).alias("mid_price_mean"), F.stddev_pop(mid).alias("mid_price_std")]
    if price:
        effective = 2 * F.abs(F.col(price) - mid)
        aggs += [F.avg(effective).alias("effective_spread_abs"), F.avg(F.try_divide(effective, mid)).alias("effective_spread_pct")]
    return quotes.groupBy(*keys).agg(*aggs)
