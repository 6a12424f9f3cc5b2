"""Canonical tables and adapters.

``ticks(symbol, day, ts, seq, price)`` is the table that most operators take; ``panel`` aligns symbols by
position within a day, ``daily`` holds one row of measures a day, ``quotes`` and ``trades`` feed the
liquidity operators. Adapters read Parquet with the filters and columns that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICKS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("day", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("seq", T.LongType()), T.StructField("price", T.DoubleType())])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_ticks(df: DataFrame, symbol: str, ts: str, seq: str, price: str) -> DataFrame:
    """Any table with these columns as ticks: prices that are null, NaN or not positive go, and the day
    is the timestamp's date."""
    keep = F.col(price).isNotNull() & (F.col(price) > 0) & ~F.isnan(price)
    return df.filter(keep).select(F.col(symbol).alias("symbol"), F.to_date(ts).cast("string").alias("day"), F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.col(price).alias("price"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(read(spark, sf_dir, "events"), "event_type", "ts", "event_id", "value")


def tick_hours(ts: str) -> Column:
    """A timestamp without time zone as hours since the epoch, for numeric clocks."""
    return F.unix_micros(F.col(ts).cast("timestamp")).cast("double") / F.lit(3.6e9)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, idx, symbol, r): the idx-th return of each symbol, up to the shortest symbol of the day."""
    w = Window.partitionBy("symbol", "day").orderBy("ts", "seq")
    r = F.ln(F.col("price") / F.lag("price").over(w))
    rows = ticks(spark, sf_dir).select("symbol", "day", (F.row_number().over(w) - 1).alias("idx"), r.alias("r")).filter("idx > 0")
    lengths = rows.groupBy("symbol", "day").agg(F.count("*").alias("n")).groupBy("day").agg(F.min("n").alias("n"))
    return rows.join(lengths, "day").filter("idx <= n").select("day", "idx", "symbol", "r")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events as quotes of one book: one per cent to each side of the value."""
    v = read(spark, sf_dir, "events").filter((F.col("event_type") == "view") & (F.col("value") > 0))
    return v.select("ts", F.col("event_id").alias("seq"), (F.col("value") * 0.99).alias("bid"), (F.col("value") * 1.01).alias("ask"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "events").filter((F.col("event_type") == "purchase") & (F.col("value") > 0))
    return p.select("ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ticks of one series: price is the total, the order key gives the sequence in a day."""
    o = read(spark, sf_dir, "orders").filter("o_totalprice > 0")
    return o.select(F.lit("orders").alias("symbol"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
