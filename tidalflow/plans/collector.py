"""A collection of daily archives that can be killed anywhere and run again.

Three tables, each partitioned by symbol and date, are all that a run leaves behind: the features of a day (its cache), facts about
its archive and the cache's digest, and its progress. A write replaces the partitions that it has rows for and no others, so
doing a day again gives the same tables. Steps are ordered so that a later one rests on what an earlier one wrote: archive, features,
facts, check of the features as they were read back, progress, removal of the archive, state. At the start whatever a killed run
left between two of them is settled: a day with a whole cache and matching facts is complete, whatever progress says of it; a
complete day whose cache isn't whole is collected anew.

Archives are fetched, hashed and read by tasks. The driver holds the list of jobs, which the configuration bounds, and a batch's paths.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import sha256_file
from ..operators import book, collection, gates
from ..sources import archives, calendar, catalog
from . import sinks

LOG = logging.getLogger(__name__)
KEY = ["symbol", "date"]
# Fixed names of the features' columns.
FEATURES = "bucket_start timestamp_ntz, spread_bps double, top10_depth_quote double, book_imbalance_10 double, abs_book_imbalance_10 double, observed_minutes long, symbol string, date date"
# Fixed names of what is kept of each day's archive.
COUNTS = ("snapshots", "updates", "parse_errors", "out_of_order_rows", "start_delay_ms", "end_early_ms", "sample_count")
FACTS = f"quality_passed boolean, quality_failures string, archive_filename string, archive_size_bytes long, archive_sha256 string, raw_rows long, {', '.join(f'{c} long' for c in COUNTS)}, bucket_rows long, cache_sha256 string, completed_at timestamp, symbol string, date date"
PROGRESS = "status string, quality_passed boolean, quality_failures string, completed_at timestamp, symbol string, date date"
JOB = "date string, symbol string, url string, size_mb double, path string"


class Places(NamedTuple):
    """Where a collection's files lie."""

    out: str
    raw: str

    def table(self, name: str) -> str:
        return f"{self.out}/intermediate/{name}"

    @property
    def state(self) -> str:
        return f"{self.out}/collection_state.json"


def places(research: Mapping, settings: Mapping, base: str) -> Places:
    return Places(os.path.join(base, research["output"]["base_dir"]), os.path.join(base, settings["source"]["raw_data_dir"]))


def validated(research: Mapping, settings: Mapping) -> None:
    """Raises where a configuration departs from what the study's protocol fixes."""
    wanted = {
        "archives are deleted after a verified cache": settings["source"].get("delete_archive_after_cache") is True,
        "books are sampled each minute": int(settings["collection"]["sample_interval_seconds"]) == 60,
        "0.95 of a symbol's days are valid": float(settings["collection"]["minimum_valid_day_share"]) == 0.95,
        "buckets have 15 minutes": int(research["data"]["bucket_minutes"]) == 15,
    }
    broken = [k for k, ok in wanted.items() if not ok]
    if broken:
        raise ValueError(f"the protocol asks that {'; '.join(broken)}")


def jobs(spark: SparkSession, research: Mapping) -> DataFrame:
    """date, symbol: each day that the study's span begins in or covers, with each of its symbols."""
    d = research["data"]
    return calendar.jobs(spark, str(d["start_inclusive"])[:10], str(d["end_exclusive"])[:10], list(d["symbols"]))


def read(spark: SparkSession, path: str, schema: str, placed: bool = False) -> DataFrame:
    """A table of the collection; no rows where nothing was written yet. ``placed`` adds each row's file and place in it, _file and _row."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema + ", _file string, _row long" * placed)
    table = spark.read.schema(schema).parquet(path)
    return table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")) if placed else table


def replace(rows: DataFrame, path: str, key: list[str] = KEY, *order: str) -> None:
    """Writes ``rows`` in place of what the table has for their keys; other partitions stay. Each partition is one file, in ``order``."""
    rows.repartition(*key).sortWithinPartitions(*key, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)


def digests(features: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``key``, bucket_rows and the digest of a partition's buckets by their content, however they lie in files."""
    shown = F.sha2(F.to_json(F.struct(*[c for c in features.columns if c not in key])), 256)
    return features.groupBy(*key).agg(F.count("*").alias("bucket_rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(shown)), ","), 256).alias("cache_sha256"))


def whole(spark: SparkSession, at: Places, asked: DataFrame, buckets: int) -> DataFrame:
    """date, symbol of ``asked`` whose features are whole and have the digest that their facts name."""
    features = read(spark, at.table("features"), FEATURES).join(F.broadcast(asked), KEY, "left_semi")
    facts = read(spark, at.table("facts"), FACTS)
    return collection.valid_caches(features.select(*KEY, F.col("symbol").alias("own_symbol"), "bucket_start"), digests(features).withColumnRenamed("cache_sha256", "sha256"), facts.select(*KEY, "cache_sha256"), buckets)


def settled(spark: SparkSession, at: Places, asked: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The progress, after complete days that it lacks were added from their caches, and the valid caches."""
    valid = whole(spark, at, asked, buckets).persist()  # a row a day and symbol
    progress = read(spark, at.table("progress"), PROGRESS)
    facts = read(spark, at.table("facts"), FACTS).join(valid, KEY, "left_semi")
    columns = ["status", "quality_passed", "quality_failures", "completed_at", *KEY]
    found = facts.withColumn("status", F.lit("complete")).select(columns)
    lost = collection.recovered(progress.select(columns), found).join(progress.where("status = 'complete'").select(*KEY), KEY, "left_anti").where("status = 'complete'").persist()
    if not lost.isEmpty():
        replace(lost, at.table("progress"))
    lost.unpersist()
    return read(spark, at.table("progress"), PROGRESS), valid


def fetched(files: DataFrame, timeout: int) -> DataFrame:
    """date, symbol, path, size and digest of archives, each fetched by a task unless it is there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for job in batch.to_pylist():
                catalog.download(job["url"], job["path"], job["size_mb"], timeout=timeout)
                out.append({"date": job["date"], "symbol": job["symbol"], "path": job["path"], "archive_size_bytes": os.path.getsize(job["path"]), "archive_sha256": sha256_file(job["path"])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(n, pa.int64() if n == "archive_size_bytes" else pa.string()) for n in ("date", "symbol", "path", "archive_size_bytes", "archive_sha256")]))

    return files.mapInArrow(run, "date string, symbol string, path string, archive_size_bytes long, archive_sha256 string")


def archive_figures(spark: SparkSession, files: list[tuple[str, str, str]], seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, a row of figures a file, and sampled books of archives given as (path, symbol, date)."""
    named = spark.createDataFrame([(os.path.basename(p), s, day) for p, s, day in files], "name string, symbol string, date string")
    messages = archives.book_messages(archives.tarred_lines(spark, *(p for p, _, _ in files))).persist()
    jobs = messages.select("file").distinct().withColumn("name", F.element_at(F.split("file", "/"), -1)).join(F.broadcast(named), "name").drop("name")
    minutes = book.archive_minutes(messages, seconds).persist()
    return messages, book.archive_days(messages, jobs, minutes), minutes


def day_features(minutes: DataFrame, named: DataFrame, interval: str) -> DataFrame:
    """The features of each file's books under the symbol and date that ``named`` (file, symbol, date) gives it, whatever its own times say."""
    by_file = book.liquidity(minutes.drop("symbol").withColumnRenamed("file", "symbol"), interval).withColumnRenamed("symbol", "file")
    return by_file.join(F.broadcast(named), "file").select("bucket_start", "spread_bps", "top10_depth_quote", "book_imbalance_10", "abs_book_imbalance_10", F.col("observed_minutes").cast("long").alias("observed_minutes"), *KEY)


def batch(spark: SparkSession, at: Places, files: list[dict], settings: Mapping, minutes: int, reached: Callable[[str], None]) -> None:
    """Collects archives (date, symbol, filename, size_mb, url), at most a few dozen; raises at the end if a cache isn't what was written."""
    c, s = settings["collection"], settings["source"]
    rows = [(f["date"], f["symbol"], f["url"], f["size_mb"], f"{at.raw}/{f['symbol']}/{f['filename']}") for f in files]
    got = fetched(spark.createDataFrame(rows, JOB).repartition(len(rows), "date", "symbol"), int(s.get("timeout_seconds", 300))).collect()
    reached("archives")
    messages, days, books = archive_figures(spark, [(r["path"], r["symbol"], r["date"]) for r in got], int(c["sample_interval_seconds"]))
    named = days.select("file", "symbol", F.col("date").cast("date").alias("date"))
    features = day_features(books, named, f"{minutes} minutes").persist()
    replace(features, at.table("features"))
    reached("features")
    checked = gates.day_quality(days, c, 86_400 // int(c["sample_interval_seconds"]))
    archive = spark.createDataFrame([(r["date"], r["symbol"], os.path.basename(r["path"]), r["archive_size_bytes"], r["archive_sha256"]) for r in got], "date string, symbol string, archive_filename string, archive_size_bytes long, archive_sha256 string")
    facts = checked.withColumn("date", F.col("date").cast("date")).join(F.broadcast(archive.withColumn("date", F.col("date").cast("date"))), KEY).join(digests(features), KEY, "left")
    facts = facts.select(F.col("passed").alias("quality_passed"), F.col("failures").alias("quality_failures"), "archive_filename", "archive_size_bytes", "archive_sha256", F.col("rows").alias("raw_rows"), *(F.col(n).cast("long").alias(n) for n in COUNTS), F.coalesce("bucket_rows", F.lit(0)).cast("long").alias("bucket_rows"), "cache_sha256", F.current_timestamp().alias("completed_at"), *KEY)
    replace(facts, at.table("facts"))
    reached("facts")
    # what was read back decides; a day without any bucket has nothing that could differ
    keys = spark.createDataFrame([(r["symbol"], r["date"]) for r in got], "symbol string, date string").withColumn("date", F.col("date").cast("date"))
    back = digests(read(spark, at.table("features"), FEATURES).join(F.broadcast(keys), KEY, "left_semi")).select(*KEY, F.col("cache_sha256").alias("_found"))
    told = read(spark, at.table("facts"), FACTS).join(F.broadcast(keys), KEY, "left_semi").join(back, KEY, "left").withColumn("_sound", F.col("cache_sha256").eqNullSafe(F.col("_found"))).persist()
    replace(told.where("_sound").select(F.lit("complete").alias("status"), "quality_passed", "quality_failures", "completed_at", *KEY), at.table("progress"))
    reached("progress")
    sound = {(r.symbol, str(r.date)) for r in told.where("_sound").select(*KEY).collect()}  # a batch's keys
    for table in (messages, books, features, told):
        table.unpersist()
    for r in got:
        if (r["symbol"], r["date"]) in sound and s["delete_archive_after_cache"]:
            os.unlink(r["path"])
            reached("removal")
    lost = sorted(f"{r['symbol']} {r['date']}" for r in got if (r["symbol"], r["date"]) not in sound)
    if lost:
        raise OSError(f"features read back differ from what was written: {', '.join(lost)}; their archives are kept")


def cleaned(spark: SparkSession, at: Places, valid: DataFrame, progress: DataFrame) -> None:
    """Removes archives that a killed run left behind though their days are complete and their caches whole."""
    done = progress.where("status = 'complete'").select(*KEY)
    for r in read(spark, at.table("facts"), FACTS).join(valid, KEY, "left_semi").join(done, KEY, "left_semi").select("symbol", "archive_filename").collect():
        path = f"{at.raw}/{r.symbol}/{r.archive_filename}"
        if os.path.isfile(path):
            os.unlink(path)


def state(spark: SparkSession, asked: DataFrame, at: Places, status: str, said: Callable[[dict], None] | None = None) -> dict:
    """Writes what is done, as a state file and a CSV of the progress, and tells ``said``."""
    progress = read(spark, at.table("progress"), PROGRESS)
    got = {"status": status, **collection.state(asked, progress).first().asDict()}
    got["last_completed_date"] = got["last_completed_date"] and str(got["last_completed_date"])
    sinks.document(progress.select("date", "symbol", "status", "quality_passed", "quality_failures", "completed_at").orderBy("date", "symbol").toPandas().to_csv(index=False), f"{at.out}/collection_progress.csv")
    sinks.document(got, at.state)
    if said:
        said(got)
    return got


def status(spark: SparkSession, research: Mapping, base: str = ".") -> dict:
    """The state that the last commit wrote; without one, what the progress's CSV says, if there is one."""
    out = os.path.join(base, research["output"]["base_dir"])
    if os.path.isfile(f"{out}/collection_state.json"):
        with open(f"{out}/collection_state.json", encoding="utf-8") as f:
            return json.load(f)
    listed = f"{out}/collection_progress.csv"
    progress = archives.progress(spark, listed) if os.path.isfile(listed) else spark.createDataFrame([], PROGRESS)
    return {"status": "not_started", **collection.state(jobs(spark, research), progress).first().asDict()}


def collect(
    spark: SparkSession,
    research: Mapping,
    settings: Mapping,
    base: str = ".",
    most: int | None = None,
    said: Callable[[dict], None] | None = None,
    listed: Callable[[list[str], str], DataFrame] | None = None,
    at_once: int = 16,
    reached: Callable[[str], None] = lambda step: None,
) -> dict:
    """Collects what is pending, by date and small files first, at most ``most`` files; then the panel of all valid days. Returns the state.

    ``listed`` gives the catalogue's files of (symbols, date) in place of asking for them. ``said`` hears every state, ``reached``
    the name of each step that was done.
    """
    d, c = research["data"], settings["collection"]
    at, minutes = places(research, settings, base), int(d["bucket_minutes"])
    buckets, asked = 1440 // minutes, jobs(spark, research).persist()
    ask = listed or (lambda symbols, day: catalog.fetch(spark, symbols, [day], settings["source"]["catalog_endpoint"], str(d["l2_module"]), str(d["instrument_type"]), int(settings["source"]["timeout_seconds"])))
    progress, valid = settled(spark, at, asked, buckets)
    cleaned(spark, at, valid, progress)
    todo: dict[str, list[str]] = {}
    for r in collection.pending(asked, progress, valid).orderBy("date", "symbol").collect():  # as many as there are jobs at most
        todo.setdefault(str(r.date), []).append(r.symbol)
    valid.unpersist()
    now, left = [], most

    def flush() -> None:
        nonlocal now
        if now:
            batch(spark, at, now, settings, minutes, reached)
            now = []
            state(spark, asked, at, "running", said)
            reached("state")

    for day, symbols in todo.items():
        found = ask(symbols, day).select(F.col("date").cast("date").alias("date"), "symbol", "available", "filename", "size_mb", "url").persist()
        wanted = asked.where(F.col("date") == F.lit(day).cast("date")).where(F.col("symbol").isin(symbols))
        gone = collection.unavailable(wanted, found)
        if not gone.isEmpty():
            replace(gone.select("status", "quality_passed", F.lit("archive_unavailable").alias("quality_failures"), "completed_at", *KEY), at.table("progress"))
            reached("unavailable")
        files = [r.asDict() | {"date": day} for r in collection.next_files(wanted, found, left).collect()]
        short = left is not None and found.where("available").join(wanted, KEY, "left_semi").count() > len(files)
        found.unpersist()
        left = None if left is None else left - len(files)
        for f in files:
            now.append(f)
            if len(now) >= at_once:
                flush()
        if short:
            flush()
            return state(spark, asked, at, "paused", said)
    flush()
    facts = read(spark, at.table("facts"), FACTS).join(F.broadcast(asked), KEY, "left_semi")
    features = read(spark, at.table("features"), FEATURES)
    whole_panel = collection.feature_panel(features.drop("date"), facts, asked, float(c["minimum_valid_day_share"]))
    sinks.table(whole_panel, at.table("l2_feature_panel_15m.parquet"), overwrite=True)
    reached("panel")
    sinks.document(facts.orderBy("date", "symbol").toPandas().to_csv(index=False), f"{at.out}/l2_feature_coverage.csv")  # a row a day and symbol
    done = state(spark, asked, at, "complete", said)
    asked.unpersist()
    return done


def planned(spark: SparkSession, research: Mapping) -> dict:
    """What a run would do, without doing it."""
    asked = jobs(spark, research)
    got = asked.agg(F.count("*").alias("files"), F.count_distinct("date").alias("days"), F.count_distinct("symbol").alias("symbols")).first()
    return {"status": "dry_run", **got.asDict(), "raw_archives_deleted_after_verified_cache": True}
