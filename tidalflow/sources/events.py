"""Adapters from the event table to trades, order-book messages, futures metrics and two venues.

They make the engine's operators testable on a general event stream; they don't claim that events are market data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Assets are a user's id modulo this.
ASSETS = 7


def read(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, with the named columns only; filters on it are pushed to the scan by Catalyst."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def _asset():
    return F.concat(F.lit("A"), (F.col("user_id") % ASSETS).cast("string"))


def _k():
    return F.from_json("props", "k double")["k"]


def trades(events: DataFrame) -> DataFrame:
    """symbol, trade_id, side, price, size, ts."""
    return events.select(_asset().alias("symbol"), F.col("event_id").alias("trade_id"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), (_k() + 1).alias("price"), F.col("value").alias("size"), "ts")


def book_messages(events: DataFrame) -> DataFrame:
    """symbol, seq, ts, action, side, price, size: one level a message."""
    even = F.col("event_id") % 2 == 0
    return events.select(_asset().alias("symbol"), F.struct("ts", "event_id").alias("seq"), "ts", F.when(F.col("event_type") == "signup", "snapshot").otherwise("update").alias("action"), F.when(even, "bid").otherwise("ask").alias("side"), (_k() + F.when(even, 1).otherwise(101)).alias("price"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("size"))


def futures_metrics(events: DataFrame) -> DataFrame:
    """symbol, ts, open_interest, taker_ratio: open interest is missing for errors."""
    return events.select(_asset().alias("symbol"), "ts", F.col("event_id").alias("row_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("open_interest"), ((_k() + 1) / 50).alias("taker_ratio"))


def venue_trades(events: DataFrame) -> DataFrame:
    """trades with a venue: every third event is the second venue's."""
    return trades(events).withColumn("venue", F.when(F.col("trade_id") % 3 == 0, "second").otherwise("first"))
