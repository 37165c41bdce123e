"""Monthly archives of ticks to buckets: fetched by tasks, a few at a time, aggregated month by month, resumed where a run ended.

A month's cache holds what its ticks add up to in each bucket, in a form that can be merged: a bucket that two archives share (the
source cuts months by its own clock) is whole again in the panel. Caches and facts are tables partitioned by symbol and month;
a write replaces whole months. A month is done once its cache has no violation, has as many trades as its facts say that
the archive has rows, and has the digest that they name.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import sha256_file
from ..operators import gates, panel
from ..sources import archives, catalog
from . import collector, sinks

KEY = ["symbol", "month"]
_END = "struct<ts: timestamp_ntz, trade_id: bigint, price: double>"
CACHE = f"bucket_start timestamp_ntz, opened {_END}, closed {_END}, transaction_count long, total_quantity double, total_quote_quantity double, buy_quote_quantity double, sell_quote_quantity double, symbol string, month string"
# Fixed names of the manifest's columns.
FACTS = "source_used string, archive_path string, archive_size_bytes long, archive_sha256 string, raw_rows long, bucket_rows long, bucket_start string, bucket_end string, cache_path string, cache_sha256 string, symbol string, month string"
FETCHED = "symbol string, month string, path string, source_used string, archive_size_bytes long, archive_sha256 string"
PROBLEMS = ["wrong_side", "not_increasing", "non_finite", "wrong_symbol"]


def months(start: str, end: str) -> list[str]:
    """Months that [start, end) touches, as yyyy-mm."""
    last = pd.Timestamp(end) - pd.Timedelta(microseconds=1)
    return [str(m) for m in pd.period_range(pd.Timestamp(start), last, freq="M")]


def archive_of(source: Mapping, base: str, symbol: str, month: str) -> tuple[str, str | None]:
    """Where a month's archive lies, and its address if the source has one."""
    path = os.path.join(base, source["local_data_dir"], symbol, f"{symbol}-trades-{month}.zip")
    root = source.get("base_url")
    return path, root and f"{root.rstrip('/')}/{month.replace('-', '')}/{symbol}-trades-{month}.zip"


def fetched(spark: SparkSession, jobs: list[tuple[str, str]], source: Mapping, base: str, at_once: int) -> DataFrame:
    """The archives of ``jobs``, fetched by at most ``at_once`` tasks where they aren't there and whole."""
    rows = [(s, m, *archive_of(source, base, s, m)) for s, m in jobs]
    attempts, timeout = int(source.get("retries", 5)), int(source.get("timeout_seconds", 300))
    names = [x.split()[0] for x in FETCHED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for job in batch.to_pylist():
                path = job["path"]
                if archives.readable_zip(path):
                    used = "archive"
                elif job["url"]:
                    used = catalog.download(job["url"], path, None, attempts, timeout, archives.readable_zip)
                else:
                    raise FileNotFoundError(path)
                out.append(dict(zip(names, (job["symbol"], job["month"], path, used, os.path.getsize(path), sha256_file(path)), strict=True)))
            yield pa.RecordBatch.from_pylist(out, pa.schema([(n, pa.int64() if n == "archive_size_bytes" else pa.string()) for n in names]))

    return spark.createDataFrame(rows, "symbol string, month string, path string, url string").repartition(min(at_once, len(rows)), *KEY).mapInArrow(run, FETCHED)


def parts(ticks: DataFrame, named: DataFrame, interval: str) -> DataFrame:
    """A month's mergeable buckets, and how many of their ticks have each fault. ``named``: name, symbol, month of the archives."""
    rows = ticks.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(F.broadcast(named), "name")
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    faults = (~F.lower("side").isin("buy", "sell"), F.col("trade_id") <= F.col("id_before"), odd("price") | odd("size"), F.col("instrument_name") != F.col("symbol"))
    trades = archives.trades(rows.withColumns({n: F.coalesce(f, F.lit(False)).cast("int") for n, f in zip(PROBLEMS, faults, strict=True)}), *KEY, *PROBLEMS)
    return panel.bucket_parts(trades, interval, "month", sums=PROBLEMS)


def done(spark: SparkSession, out: str, zone: str) -> DataFrame:
    """symbol, month of sound caches."""
    placed = collector.read(spark, f"{out}/monthly_cache", CACHE, placed=True)
    cache, facts = placed.drop("_file", "_row"), collector.read(spark, f"{out}/monthly_facts", FACTS)
    sums = cache.groupBy(*KEY).agg(F.sum("transaction_count").alias("_trades"))
    found = collector.digests(cache, KEY).withColumnsRenamed({"cache_sha256": "_found"}).select(*KEY, "_found")
    broken = gates.month_caches(placed, zone).where("violations > 0")
    sound = facts.select(*KEY, "raw_rows", "cache_sha256").join(found, KEY).join(sums, KEY).where("_found = cache_sha256 AND _trades = raw_rows")
    return sound.select(*KEY).join(broken, KEY, "left_anti")


def batch(spark: SparkSession, jobs: list[tuple[str, str]], config: Mapping, base: str, out: str, at_once: int, reached: Callable[[str], None]) -> None:
    """Fetches and aggregates the archives of ``jobs`` in one pass over their ticks."""
    got = fetched(spark, jobs, config["source"], base, at_once).collect()  # a row a job of the batch
    reached("archives")
    named = spark.createDataFrame([(os.path.basename(r.path), r.symbol, r.month) for r in got], "name string, symbol string, month string")
    made = parts(archives.zipped_ticks(spark, *(r.path for r in got)), named, f"{int(config['data']['expected_interval_minutes'])} minutes").persist()
    seen = {(r.symbol, r.month): r for r in made.groupBy(*KEY).agg(F.sum("transaction_count").alias("rows"), *(F.sum(p).alias(p) for p in PROBLEMS)).collect()}
    bad = [f"{s} {m}: " + ("no trades" if (s, m) not in seen else ", ".join(f"{seen[s, m][p]} {p}" for p in PROBLEMS if seen[s, m][p])) for s, m in jobs if (s, m) not in seen or any(seen[s, m][p] for p in PROBLEMS)]
    if bad:
        raise ValueError(f"invalid ticks: {'; '.join(bad)}")
    collector.replace(made.drop(*PROBLEMS).select(*(x.split()[0] for x in _columns(CACHE))), f"{out}/monthly_cache", KEY, "bucket_start")
    made.unpersist()
    reached("cache")
    mine = F.broadcast(named.select(*KEY))
    placed = collector.read(spark, f"{out}/monthly_cache", CACHE, placed=True).join(mine, KEY, "left_semi")
    stored = placed.drop("_file", "_row")
    broken = gates.month_caches(placed, str(config["source"].get("source_archive_timezone", "UTC"))).where("violations > 0").collect()
    if broken:
        raise ValueError("invalid months: " + "; ".join(str(r.asDict()) for r in broken))
    figures = stored.groupBy(*KEY).agg(F.min("bucket_start").cast("string").alias("bucket_start"), F.max("bucket_start").cast("string").alias("bucket_end"))
    told = spark.createDataFrame([(r.symbol, r.month, r.source_used, r.path, r.archive_size_bytes, r.archive_sha256, int(seen[r.symbol, r.month].rows)) for r in got], "symbol string, month string, source_used string, archive_path string, archive_size_bytes long, archive_sha256 string, raw_rows long")
    facts = told.join(collector.digests(stored, KEY), KEY).join(figures, KEY).withColumn("cache_path", F.concat(F.lit(f"{out}/monthly_cache/symbol="), "symbol", F.lit("/month="), "month"))
    collector.replace(facts.select(*(x.split()[0] for x in _columns(FACTS))), f"{out}/monthly_facts", KEY)
    reached("facts")


def _columns(schema: str) -> list[str]:
    import re

    return re.split(r", (?![^<]*>)", schema)


def collect(spark: SparkSession, config: Mapping, base: str, out: str, said: Callable[[dict], None] | None = None, reached: Callable[[str], None] = lambda step: None, batches: int = 4) -> tuple[DataFrame, pd.DataFrame]:
    """The panel of whole buckets of all months, and the archives' manifest. ``download.max_workers`` archives are fetched at once, ``batches`` times as many are read at once."""
    source, d = config["source"], config["data"]
    start, end = (str(d[k]).replace("Z", "").replace("T", " ") for k in ("expected_start", "expected_end_exclusive"))
    asked = [(s, m) for s in d["symbols"] for m in months(start, end)]
    at_once = max(1, int(config.get("download", {}).get("max_workers", 1)))
    sound = {(r.symbol, r.month) for r in done(spark, out, str(source.get("source_archive_timezone", "UTC"))).collect()}  # a row a job
    there = [job for job in asked if job in sound and os.path.isfile(archive_of(source, base, *job)[0])]
    todo, finished = [job for job in asked if job not in set(there)], list(there)

    def state(status: str, **more) -> None:
        facts = collector.read(spark, f"{out}/monthly_facts", FACTS).toPandas().sort_values(["symbol", "month"])
        facts.loc[[(s, m) in set(there) for s, m in zip(facts["symbol"], facts["month"], strict=True)], "source_used"] = "cache"
        sinks.document(facts.to_csv(index=False), f"{out}/collection_progress.csv")
        last = finished[-1] if finished else (None, None)
        got = {"status": status, "completed_jobs": len(finished), "total_jobs": len(asked), "progress_share": len(finished) / len(asked), "last_completed_symbol": last[0], "last_completed_month": last[1], **more}
        sinks.document(got, f"{out}/collection_state.json")
        if said:
            said(got)

    for k in range(0, len(todo), at_once * batches):
        now = todo[k : k + at_once * batches]
        batch(spark, now, config, base, out, at_once, reached)
        finished += now
        state("running")
        reached("state")
    wanted = spark.createDataFrame(asked, "symbol string, month string")
    whole = panel.merged_buckets(collector.read(spark, f"{out}/monthly_cache", CACHE).join(F.broadcast(wanted), KEY, "left_semi"))
    inside = whole.where((F.col("bucket_start") >= F.lit(start).cast("timestamp_ntz")) & (F.col("bucket_start") < F.lit(end).cast("timestamp_ntz")))
    state("complete", panel_rows=inside.count())
    manifest = collector.read(spark, f"{out}/monthly_facts", FACTS).join(F.broadcast(wanted), KEY, "left_semi").toPandas().sort_values(["symbol", "month"], ignore_index=True)
    manifest.loc[[(s, m) in set(there) for s, m in zip(manifest["symbol"], manifest["month"], strict=True)], "source_used"] = "cache"
    return inside, manifest[["symbol", "month", *(x.split()[0] for x in _columns(FACTS) if x.split()[0] not in KEY)]]
