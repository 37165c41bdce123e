"""Time spines, made in Spark from their bounds, or from those of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spine(spark: SparkSession, start: str, end: str, step: str, name: str = "bucket_start") -> DataFrame:
    """Left-closed, right-open grid from ``start`` to ``end`` by ``step`` (as '6 hours')."""
    bounds = F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") - F.expr(f"INTERVAL {step}"), F.expr(f"INTERVAL {step}"))
    return spark.range(1).select(F.explode(bounds).alias(name))


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """First days of the months that [start, end) touches."""
    first, last = F.date_trunc("month", F.lit(start).cast("timestamp")).cast("date"), F.date_sub(F.lit(end).cast("date"), 1)
    return spark.range(1).select(F.explode(F.sequence(first, F.date_trunc("month", last).cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("month"))


def jobs(spark: SparkSession, start: str, end: str, symbols: list[str]) -> DataFrame:
    """date, symbol of every collection job: each day of [start, end) with each symbol; the symbols are a short list of the configuration."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("date"))
    return days.select("date", F.explode(F.array(*map(F.lit, symbols))).alias("symbol"))


def _days(df: DataFrame, ts: str) -> DataFrame:
    """One row: the first and the last day of a column; none for an empty table."""
    return df.agg(F.min(F.to_date(ts)).alias("_first"), F.max(F.to_date(ts)).alias("_last")).where("_first IS NOT NULL")


def spine_of(df: DataFrame, ts: str, step: str, name: str = "bucket_start") -> DataFrame:
    """The grid by ``step`` of the days from the first to the last of a column."""
    end = F.date_add("_last", 1).cast("timestamp_ntz") - F.expr(f"INTERVAL {step}")
    return _days(df, ts).select(F.explode(F.sequence(F.col("_first").cast("timestamp_ntz"), end, F.expr(f"INTERVAL {step}"))).alias(name))


def months_of(df: DataFrame, ts: str) -> DataFrame:
    """First days of the months from the first to the last of a column."""
    first, last = (F.trunc(c, "month") for c in ("_first", "_last"))
    return _days(df, ts).select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))).alias("month"))


def jobs_of(df: DataFrame, ts: str, symbol: str = "symbol") -> DataFrame:
    """date, symbol: each day from the first to the last of a column with each symbol of the table; its symbols are a short list, gathered as one row."""
    names = df.select(symbol).distinct().agg(F.collect_list(symbol).alias("_names"))
    days = _days(df, ts).select(F.explode(F.sequence("_first", "_last")).alias("date"))
    return days.crossJoin(F.broadcast(names)).select("date", F.explode("_names").alias("symbol"))
