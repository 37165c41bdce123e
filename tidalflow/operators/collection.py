"""State of a restartable collection: pending jobs, upserts, roll-up. Jobs and progress are keyed by (date, symbol)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import panel

TERMINAL = ("complete", "unavailable")


def pending(jobs: DataFrame, progress: DataFrame, valid_caches: DataFrame | None = None) -> DataFrame:
    """Jobs without a terminal row; with ``valid_caches``, complete ones whose cache isn't valid too. A day that failed its quality check is complete, with quality_passed false."""
    done = progress.where(F.col("status").isin(*TERMINAL)).select("date", "symbol", "status")
    if valid_caches is not None:
        valid = valid_caches.select("date", "symbol").distinct().withColumn("_valid", F.lit(True))
        done = done.join(valid, ["date", "symbol"], "left").where((F.col("status") != "complete") | F.col("_valid"))
    return jobs.join(done.select("date", "symbol"), ["date", "symbol"], "left_anti")


def upserted(progress: DataFrame, rows: DataFrame) -> DataFrame:
    """``progress`` with its rows of the keys in ``rows`` replaced."""
    return progress.join(rows.select("date", "symbol"), ["date", "symbol"], "left_anti").unionByName(rows)


def state(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """One row: completed, total, passing, failing and unavailable files and the last one completed. Unavailable files count as failing."""
    terminal = progress.where(F.col("status").isin(*TERMINAL))
    last = F.struct("completed_at", "date", "symbol")
    got = terminal.agg(
        F.count("*").alias("completed_files"),
        F.count_if("quality_passed").alias("quality_passing_files"),
        F.count_if(~F.coalesce("quality_passed", F.lit(False))).alias("quality_failing_files"),
        F.count_if(F.col("status") == "unavailable").alias("unavailable_files"),
        F.max_by("date", last).alias("last_completed_date"),
        F.max_by("symbol", last).alias("last_completed_symbol"),
    )
    total = jobs.agg(F.count("*").alias("total_files"))
    return got.crossJoin(F.broadcast(total)).select("completed_files", "total_files", F.try_divide(F.col("completed_files"), F.col("total_files")).alias("progress_share"), "quality_passing_files", "quality_failing_files", "unavailable_files", "last_completed_date", "last_completed_symbol")


def next_files(jobs: DataFrame, catalog: DataFrame, most: int | None = None) -> DataFrame:
    """The catalogue's available files of ``jobs`` by date, small ones first, at most ``most``: early results and short resumptions."""
    found = jobs.join(catalog.where("available"), ["date", "symbol"]).orderBy("date", "size_mb", "symbol")
    return found if most is None else found.limit(most)


def unavailable(jobs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Progress rows for jobs that the catalogue lists without a file."""
    return jobs.join(catalog.where("NOT available").select("date", "symbol"), ["date", "symbol"], "left_semi").select("date", "symbol", F.lit("unavailable").alias("status"), F.lit(False).alias("quality_passed"), F.current_timestamp().alias("completed_at"))


def valid_caches(rows: DataFrame, digests: DataFrame, metadata: DataFrame, buckets: int = 96) -> DataFrame:
    """date, symbol of caches that are whole: so many buckets, all of their own symbol and day, and the digest that their metadata name.

    ``rows``: date, symbol (those of the cache's path), own_symbol, bucket_start. ``digests``: date, symbol, sha256.
    ``metadata``: date, symbol, cache_sha256.
    """
    fits = (F.col("own_symbol") == F.col("symbol")) & (F.to_date("bucket_start") == F.col("date"))
    whole = rows.groupBy("date", "symbol").agg(F.count("*").alias("n"), F.count_if(fits).alias("ok")).where((F.col("n") == buckets) & (F.col("ok") == buckets))
    same = digests.join(metadata, ["date", "symbol"]).where(F.col("sha256") == F.col("cache_sha256"))
    return whole.select("date", "symbol").join(same, ["date", "symbol"], "left_semi")


def recovered(progress: DataFrame, caches: DataFrame) -> DataFrame:
    """``progress`` with complete rows for valid caches (progress's columns) that it doesn't list as complete: a run that died between cache and progress."""
    known = progress.where("status = 'complete'").select("date", "symbol")
    return upserted(progress, caches.join(known, ["date", "symbol"], "left_anti").withColumn("status", F.lit("complete")).select(progress.columns))


def valid_day_share(jobs: DataFrame, days: DataFrame) -> float:
    """The least share, over the symbols of ``jobs``, of its days that passed their quality checks."""
    asked = jobs.groupBy("symbol").agg(F.count_distinct("date").alias("asked"))
    good = days.where("quality_passed").join(jobs, ["date", "symbol"], "left_semi").groupBy("symbol").agg(F.count_distinct("date").alias("good"))
    return asked.join(good, "symbol", "left").agg(F.min(F.coalesce("good", F.lit(0)) / F.col("asked"))).first()[0] or 0.0


def feature_panel(features: DataFrame, days: DataFrame, jobs: DataFrame, least_share: float) -> DataFrame:
    """Features of the days that passed, with the depletion of depth along each symbol. Raises where some symbol has too few such days."""
    share = valid_day_share(jobs, days)
    if share < least_share:
        raise ValueError(f"only {share:.4f} of a symbol's days are valid, asked for {least_share}")
    good = days.where("quality_passed").select("symbol", F.col("date").cast("date").alias("_date"))
    kept = features.withColumn("_date", F.to_date("bucket_start")).join(good, ["symbol", "_date"], "left_semi").drop("_date")
    return panel.log_change(kept, "top10_depth_quote", "depth_depletion", -1)


# Fixed names of the designs whose needs are estimated.
_DESIGNS = ("sampled_catalog_day", "bounded_confirmatory_window", "full_two_year_window", "sampled_catalog_day_median")


def resources(catalog: DataFrame, window_days: int, full_days: int) -> DataFrame:
    """design, days, estimated_compressed_gb, from the daily sums of the catalogue's available files with a known size; no rows where there are none."""
    daily = catalog.where(F.col("available") & F.col("size_mb").isNotNull()).groupBy("date").agg(F.sum("size_mb").alias("mb"))
    found = daily.agg(F.avg("mb").alias("mean"), F.median("mb").alias("median")).where("mean IS NOT NULL")
    rows = zip(_DESIGNS, (1, window_days, full_days, 1), ("mean", "mean", "mean", "median"), strict=True)
    made = F.explode(F.array(*(F.struct(F.lit(d).alias("design"), F.lit(n).alias("days"), (F.col(of) * n / 1000).alias("estimated_compressed_gb")) for d, n, of in rows)))
    return found.select(made.alias("_d")).select("_d.*")
