"""From trades to bucket panels: aggregation, features, coverage and checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trade_buckets(trades: DataFrame, interval: str, *keys: str) -> DataFrame:
    """Tumbling buckets by symbol (and ``keys``): first and last price by (ts, trade_id), counts, sums, return, imbalance. One shuffle, with partial aggregates before it."""
    quote = F.col("price") * F.col("size")
    order = F.struct("ts", "trade_id")
    buy = F.col("side") == "buy"
    by = [F.window("ts", interval).start.alias("bucket_start"), "symbol", *keys]
    sums = trades.groupBy(*by).agg(
        F.min("ts").alias("first_timestamp"),
        F.max("ts").alias("last_timestamp"),
        F.min_by("price", order).alias("first_price"),
        F.max_by("price", order).alias("last_price"),
        F.count("*").alias("transaction_count"),
        F.sum("size").alias("total_quantity"),
        F.sum(quote).alias("total_quote_quantity"),
        F.sum(F.when(buy, quote).otherwise(0.0)).alias("buy_quote_quantity"),
        F.sum(F.when(~buy, quote).otherwise(0.0)).alias("sell_quote_quantity"),
    )
    signed = F.col("buy_quote_quantity") - F.col("sell_quote_quantity")
    return sums.withColumns({"bucket_return": F.try_divide("last_price", "first_price") - 1, "aggressor_imbalance": F.try_divide(signed, F.col("total_quote_quantity"))})


def bucket_parts(trades: DataFrame, interval: str, *keys: str, sums: list[str] | None = None) -> DataFrame:
    """Buckets by symbol (and ``keys``) as sums that can be merged with those of other trades, and the totals of the columns ``sums``."""
    quote, end = F.col("price") * F.col("size"), F.struct("ts", "trade_id", "price")
    buy = F.col("side") == "buy"
    return trades.groupBy(F.window("ts", interval).start.alias("bucket_start"), "symbol", *keys).agg(
        F.min(end).alias("opened"),
        F.max(end).alias("closed"),
        F.count("*").alias("transaction_count"),
        F.sum("size").alias("total_quantity"),
        F.sum(quote).alias("total_quote_quantity"),
        F.sum(F.when(buy, quote).otherwise(0.0)).alias("buy_quote_quantity"),
        F.sum(F.when(~buy, quote).otherwise(0.0)).alias("sell_quote_quantity"),
        *(F.sum(c).alias(c) for c in sums or []),
    )


def merged_buckets(parts: DataFrame) -> DataFrame:
    """What ``trade_buckets`` gives of all trades together, from the parts of several sets of them."""
    total = ("transaction_count", "total_quantity", "total_quote_quantity", "buy_quote_quantity", "sell_quote_quantity")
    whole = parts.groupBy("bucket_start", "symbol").agg(F.min("opened").alias("_o"), F.max("closed").alias("_c"), *(F.sum(c).alias(c) for c in total))
    signed = F.col("buy_quote_quantity") - F.col("sell_quote_quantity")
    ends = [F.col(f"{side}.{c}").alias(name) for c, names in (("ts", ("first_timestamp", "last_timestamp")), ("price", ("first_price", "last_price"))) for side, name in zip(("_o", "_c"), names, strict=True)]
    return whole.select("bucket_start", "symbol", *ends, *total, (F.try_divide("_c.price", "_o.price") - 1).alias("bucket_return"), F.try_divide(signed, F.col("total_quote_quantity")).alias("aggressor_imbalance"))


def sample_split(ts: Column, development: tuple[str, str], oos: tuple[str, str]) -> Column:
    inside = lambda b: (ts >= F.lit(b[0]).cast("timestamp_ntz")) & (ts < F.lit(b[1]).cast("timestamp_ntz"))
    return F.when(inside(development), "development").when(inside(oos), "oos").otherwise("excluded")


def leave_one_out(panel: DataFrame, value: str, name: str, assets: int) -> DataFrame:
    """Mean of the other assets' values in the same bucket: a window by bucket instead of a pivot and a join."""
    total = F.sum(value).over(Window.partitionBy("bucket_start"))
    return panel.withColumn(name, (total - F.col(value)) / (assets - 1))


def spot_features(panel: DataFrame, assets: int, development: tuple[str, str], oos: tuple[str, str]) -> DataFrame:
    """The nine computed columns of the residual model's design, and the split."""
    hour = F.hour("bucket_start") + F.minute("bucket_start") / 60
    angle = 2 * math.pi * hour / 24
    return leave_one_out(panel, "bucket_return", "loo_market_return", assets).withColumns(
        {
            "own_return": F.col("bucket_return"),
            "abs_own_return": F.abs("bucket_return"),
            "abs_loo_market_return": F.abs("loo_market_return"),
            "log_quote_volume": F.log1p(F.greatest("total_quote_quantity", F.lit(0.0))),
            "log_transaction_count": F.log1p(F.greatest(F.col("transaction_count").cast("double"), F.lit(0.0))),
            "hour_sin": F.sin(angle),
            "hour_cos": F.cos(angle),
            "weekday": F.weekday("bucket_start"),
            "sample_split": sample_split(F.col("bucket_start"), development, oos),
        }
    )


#: The residual model's terms, in order; Monday is the base of the weekdays.
DESIGN = ["own_return", "loo_market_return", "abs_own_return", "abs_loo_market_return", "log_quote_volume", "log_transaction_count", "hour_sin", "hour_cos"]


def design(features: DataFrame) -> list[Column]:
    return [F.lit(1.0), *(F.col(c).cast("double") for c in DESIGN), *((F.col("weekday") == d).cast("double") for d in range(1, 7))]


def coverage(panel: DataFrame) -> DataFrame:
    """One row of exact coverage figures."""
    return panel.agg(
        F.count("*").alias("rows"),
        F.count_distinct("bucket_start", "symbol").alias("unique_keys"),
        F.count_distinct("bucket_start").alias("timestamps"),
        F.count_distinct("symbol").alias("symbols"),
        F.min("bucket_start").alias("first_bucket"),
        F.max("bucket_start").alias("last_bucket"),
        F.coalesce(F.bool_and(F.abs("aggressor_imbalance") <= 1 + 1e-12), F.lit(True)).alias("imbalance_in_bounds"),
        F.count_if(F.col("bucket_return").isNull()).alias("missing_returns"),
    )


def violations(panel: DataFrame, grid: DataFrame, symbols: list[str]) -> DataFrame:
    """check, violations: counts for a panel on a grid; a runner decides whether to stop."""
    expected = grid.select("bucket_start", F.explode(F.array(*map(F.lit, symbols))).alias("symbol"))
    keys = panel.groupBy("bucket_start", "symbol").agg(F.count("*").alias("n"))
    gaps = expected.join(keys, ["bucket_start", "symbol"], "left_anti").agg(F.lit("missing_cells").alias("check"), F.count("*").alias("violations"))
    twice = keys.agg(F.lit("duplicate_keys").alias("check"), F.count_if(F.col("n") > 1).alias("violations"))
    foreign = panel.agg(F.lit("unknown_symbols").alias("check"), F.count_if(~F.col("symbol").isin(symbols)).alias("violations"))
    values = F.col("aggressor_imbalance")
    wrong = panel.agg(F.lit("imbalance_out_of_bounds").alias("check"), F.count_if(values.isNull() | F.isnan(values) | (F.abs(values) > 1 + 1e-12)).alias("violations"))
    return gaps.unionByName(twice).unionByName(foreign).unionByName(wrong)


def grid_gaps(panel: DataFrame, grid: DataFrame, symbols: list[str]) -> DataFrame:
    """bucket_start, symbol of the grid's cells that the panel lacks."""
    expected = grid.select("bucket_start", F.explode(F.array(*map(F.lit, symbols))).alias("symbol"))
    return expected.join(panel.select("bucket_start", "symbol"), ["bucket_start", "symbol"], "left_anti")


def complete_buckets(panel: DataFrame, assets: int) -> DataFrame:
    """Buckets in which every asset has a row."""
    return panel.groupBy("bucket_start").agg(F.count_distinct("symbol").alias("n")).where(F.col("n") == assets).select("bucket_start")


def log_change(df: DataFrame, value: str, name: str, sign: int = 1) -> DataFrame:
    """Row-to-row difference of logs by symbol; values that aren't positive are missing. Gaps in time are bridged."""
    logged = F.log(F.when(F.col(value) > 0, F.col(value)))
    return df.withColumn(name, sign * (logged - F.lag(logged).over(Window.partitionBy("symbol").orderBy("bucket_start"))))


def futures_buckets(metrics: DataFrame, interval: str, taker: str = "mean") -> DataFrame:
    """Open interest's last known value, the mean or last taker direction (r - 1) / (r + 1), and rows, by bucket."""
    if taker not in ("mean", "last"):
        raise ValueError("taker aggregation must be mean or last")
    ratio = F.greatest("taker_ratio", F.lit(0.0))
    direction = (ratio - 1) / (ratio + 1)
    order = F.struct("ts", "row_id")
    known = lambda c, x: F.max_by(x, F.when(F.col(c).isNotNull(), order))
    out = F.avg(direction) if taker == "mean" else known("taker_ratio", direction)
    return metrics.groupBy(F.window("ts", interval).start.alias("bucket_start"), "symbol").agg(out.alias("taker_direction"), known("open_interest", F.col("open_interest")).alias("open_interest"), F.count("*").alias("source_rows"))
