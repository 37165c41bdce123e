"""Archives as DataFrames: zipped CSV ticks and metrics, tarred JSON lines. Spark lists and deals out the files; a task streams what is in them."""

from __future__ import annotations

import json
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task passes on at a time.
CHUNK = 50_000
TICK = "file string, seq long, id_before long, instrument_name string, trade_id long, side string, price double, size double, created_time long"
BOOK = "instId string, action string, ts string, asks array<array<string>>, bids array<array<string>>"


def only_csv(archive: zipfile.ZipFile) -> str:
    names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
    if len(names) != 1:
        raise ValueError(f"expected one CSV member, found {len(names)}")
    return names[0]


def readable_zip(path: str) -> bool:
    try:
        with zipfile.ZipFile(path) as z, z.open(only_csv(z)) as f:
            return bool(f.read(32))
    except (OSError, ValueError, zipfile.BadZipFile, KeyError):
        return False


def _listed(spark: SparkSession, paths) -> DataFrame:
    """The files' paths; their content isn't read here, so that none need fit in a row."""
    return spark.read.format("binaryFile").load(list(paths)).select("path")


def _opened(path: str):
    """A file as a stream that can seek, on whatever file system its address names."""
    where, name = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return where.open_input_file(name)


def _csv_batches(path: str, types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The named columns of a zip's only CSV file, block by block; a value of another type is an error."""
    options = pa.csv.ConvertOptions(column_types=types, include_columns=list(types), null_values=[""], strings_can_be_null=True)
    with _opened(path) as raw, zipfile.ZipFile(raw) as z, z.open(only_csv(z)) as member:
        yield from pa.csv.open_csv(member, read_options=pa.csv.ReadOptions(block_size=4 << 20), convert_options=options)


def _numbered(path: str, types: dict[str, pa.DataType], whole: bool) -> Iterator[pa.RecordBatch]:
    """Those batches behind file and seq. With ``whole``, a missing value is an error."""
    at = 0
    for batch in _csv_batches(path, types):
        lacking = [n for n in batch.schema.names if batch.column(n).null_count] if whole else []
        if lacking:
            raise ValueError(f"{path}: rows from {at} on lack {', '.join(lacking)}")
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.array(range(at, at + n), pa.int64()), *batch.columns], names=["file", "seq", *batch.schema.names])
        at += n


def zipped_ticks(spark: SparkSession, *paths: str) -> DataFrame:
    """Ticks of zipped CSV files, with their file, place in it and the id before theirs. Values that are missing or don't parse are an error of the task."""
    types = {"instrument_name": pa.string(), "trade_id": pa.int64(), "side": pa.string(), "price": pa.float64(), "size": pa.float64(), "created_time": pa.int64()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                last = None
                for got in _numbered(path, types, whole=True):
                    ids = got.column("trade_id")
                    before = pa.concat_arrays([pa.array([last], pa.int64()), ids.slice(0, len(ids) - 1)]) if len(ids) else ids
                    last = ids[-1].as_py() if len(ids) else last
                    yield pa.RecordBatch.from_arrays([*got.columns[:2], before, *got.columns[2:]], names=["file", "seq", "id_before", *got.schema.names[2:]])

    return _listed(spark, paths).mapInArrow(run, TICK)


# Fixed names of the metrics files' columns; all but the first two are numbers.
METRICS = ["create_time", "symbol", "sum_open_interest", "count_toptrader_long_short_ratio", "sum_toptrader_long_short_ratio", "count_long_short_ratio", "sum_taker_long_short_vol_ratio"]


def zipped_metrics(spark: SparkSession, *paths: str) -> DataFrame:
    """file, seq, ts, symbol and figures of zipped futures metrics; other columns aren't read. Figures that don't parse are null, a time that doesn't is an error."""
    types = {c: pa.string() for c in METRICS}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield from _numbered(path, types, whole=False)

    raw = _listed(spark, paths).mapInArrow(run, "file string, seq long, " + ", ".join(f"{c} string" for c in METRICS))
    return raw.select("file", "seq", F.col("create_time").cast("timestamp_ntz").alias("ts"), "symbol", *(F.col(c).try_cast("double").alias(c) for c in METRICS[2:]))


def futures_metrics(metrics: DataFrame, start: str, end: str) -> DataFrame:
    """symbol, ts, row_id, open_interest, taker_ratio and the other ratios in [start, end), as the futures buckets take them. Raises where one of the first two figures is missing."""
    rows = metrics.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    out = rows.select("symbol", "ts", F.struct("file", "seq").alias("row_id"), F.col("sum_open_interest").alias("open_interest"), F.col("sum_taker_long_short_vol_ratio").alias("taker_ratio"), *METRICS[3:6])
    missing = out.agg(F.count_if(F.col("open_interest").isNull() | F.col("taker_ratio").isNull())).first()[0]
    if missing:
        raise ValueError(f"{missing} rows lack open interest or the taker ratio")
    return out


def metrics_inventory(metrics: DataFrame) -> DataFrame:
    """file, symbol, rows, and how many rows lack each figure."""
    return metrics.groupBy("file", "symbol").agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in METRICS[2:]))


def tick_problems(ticks: DataFrame) -> DataFrame:
    """file, wrong_side, not_increasing, non_finite, symbols: counts of a tick file's faults, ids in the order of the file."""
    from pyspark.sql import Window

    before = F.lag("trade_id").over(Window.partitionBy("file").orderBy("seq"))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return ticks.withColumn("_b", before).groupBy("file").agg(F.count_if(~F.lower("side").isin("buy", "sell")).alias("wrong_side"), F.count_if(F.col("trade_id") <= F.col("_b")).alias("not_increasing"), F.count_if(bad("price") | bad("size")).alias("non_finite"), F.count_distinct("instrument_name").alias("symbols"))


def trades(ticks: DataFrame, *keep: str) -> DataFrame:
    """symbol, trade_id, side, price, size, ts (UTC) of ticks, and the columns ``keep``; a symbol among them is taken in place of the ticks' own."""
    own = [] if "symbol" in keep else [F.col("instrument_name").alias("symbol")]
    return ticks.select(*own, *keep, "trade_id", F.lower("side").alias("side"), "price", "size", F.timestamp_millis("created_time").cast("timestamp_ntz").alias("ts"))


def _lines(path: str) -> Iterator[bytes]:
    """The lines of a tar.gz file's only data member, in one pass; a second member is an error once it is met."""
    with _opened(path) as raw, tarfile.open(fileobj=raw, mode="r|gz") as bundle:
        found = 0
        for member in bundle:
            if member.isfile():
                found += 1
                if found == 1:
                    yield from bundle.extractfile(member)
        if found != 1:
            raise ValueError(f"{path}: expected one data member, found {found}")


def tarred_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file, seq, line of tar.gz files with one member each; lines are streamed out of the archive."""

    def batch_of(path: str, at: int, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(path, len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "seq", "line"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                lines, at = [], 0
                for line in _lines(path):
                    lines.append(line.decode("utf-8", "replace").rstrip("\n"))
                    if len(lines) == CHUNK:
                        yield batch_of(path, at, lines)
                        lines, at = [], at + len(lines)
                yield batch_of(path, at, lines)

    return _listed(spark, paths).mapInArrow(run, "file string, seq long, line string")


def book_messages(lines: DataFrame) -> DataFrame:
    """Messages of JSON lines: symbol, seq, ts, action, asks, bids, parse_error. A line without a readable ts or action is a counted error."""
    got = lines.withColumn("m", F.from_json("line", BOOK, {"mode": "PERMISSIVE"}))
    ms = F.expr("try_cast(m.ts AS bigint)")
    return got.select("file", "seq", F.col("m.instId").alias("symbol"), F.timestamp_millis(ms).cast("timestamp_ntz").alias("ts"), F.col("m.action").alias("action"), F.coalesce("m.asks", F.array().cast("array<array<string>>")).alias("asks"), F.coalesce("m.bids", F.array().cast("array<array<string>>")).alias("bids"), (ms.isNull() | F.col("m.action").isNull()).alias("parse_error"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """A progress CSV, its columns taken by name; its flags may be written in any case, and a completion's time may be missing."""
    raw = spark.read.csv(path, header=True)
    at = next((c for c in ("completed_at", "completed_at_utc") if c in raw.columns), None)
    done = F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")
    return raw.select(F.col("date").cast("date").alias("date"), "symbol", "status", (F.lower(F.trim("quality_passed")) == "true").alias("quality_passed"), done.alias("completed_at"))


def residuals(spark: SparkSession, venues: dict[str, str]) -> DataFrame:
    """bucket_start, symbol, venue, flow, sample_split of venues' stored residual panels (name: path); symbols are written alike, without hyphens."""
    out = None
    for venue, path in venues.items():
        one = spark.read.parquet(path).select(F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), F.replace("symbol", F.lit("-"), F.lit("")).alias("symbol"), F.lit(venue).alias("venue"), F.col("aggressor_residual_z").alias("flow"), "sample_split")
        out = one if out is None else out.unionByName(one)
    return out


def stored(path: str):
    """A summary table that a study left behind: one CSV file of a few rows, as pandas reads it."""
    import pandas as pd

    return pd.read_csv(path)


def daily_files(paths: list[str], start: str, end: str) -> list[str]:
    """Paths whose name holds a date of [start, end), compared as text: pruning before anything is opened."""
    import re

    return sorted(p for p in paths if (m := re.search(r"(\d{4}-\d{2}-\d{2})[^/]*$", p)) and start <= m[1] < end)


def config(path: str) -> dict:
    """A YAML or JSON configuration."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)
