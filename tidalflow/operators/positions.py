"""Places of rows in a total order, and rows so many places away, without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str | Column], name: str = "position", parts: int | None = None) -> DataFrame:
    """``df`` with each row's place by ``order``, from 0.

    Rows are dealt by ranges of the order and sorted within them; a range's rows are numbered as they come, from the sum of the sizes of
    those before it: one row a range. Rows equal in ``order`` are numbered one after the other, in no stated order.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id's upper bits are the range's number, the lower ones count its rows
    dealt = dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.shiftleft(F.col("_range"), 33)
    return dealt.join(F.broadcast(offsets), "_range").withColumn(name, place).drop("_at", "_range", "_before")


def behind(placed: DataFrame, value: str, name: str, by: int = 1, position: str = "position") -> DataFrame:
    """``placed`` with the ``value`` of the row ``by`` places earlier (later, if negative); null where there is none: a join on places."""
    other = placed.select((F.col(position) + by).alias(position), F.col(value).alias(name))
    return placed.join(other, position, "left")
