"""Results to files: tables by Spark's writers, small documents by the driver, by rename."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import sha256_file


def table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; refuses to replace results unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def partitioned(df: DataFrame, path: str) -> None:
    """Panels by symbol and month, so that later scans are pruned."""
    df.withColumn("month", F.date_format("bucket_start", "yyyy-MM")).repartition("symbol", "month").write.mode("errorifexists").partitionBy("symbol", "month").parquet(path)


def small_csv(df: DataFrame | pd.DataFrame, path: str) -> None:
    """One CSV file of a summary table."""
    if isinstance(df, DataFrame):
        df.coalesce(1).write.mode("errorifexists").csv(path, header=True)
    else:
        document(df.to_csv(index=False), path)


def document(content: str | dict, path: str) -> None:
    """Text or JSON, written beside its place and renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=2, default=str))
    os.replace(f"{path}.part", path)


def snapshot(config: dict, path: str) -> None:
    """A configuration as YAML, in its own order; as JSON, which YAML readers take too, where no YAML writer is installed."""
    try:
        import yaml
    except ImportError:
        document(dict(config), path)
    else:
        document(yaml.safe_dump(dict(config), sort_keys=False, allow_unicode=True), path)


def manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """path, size, sha256 of input files, read where they lie."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def provenance(config: dict, inputs: Iterable[str], **facts) -> dict:
    """What a result came from: commit, digests of configuration and inputs, seed, bounds of the splits."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        commit = "unavailable"
    import hashlib

    return {"git_commit": commit, "config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest(), "inputs": {p: sha256_file(p) for p in inputs}, "generated_at_utc": datetime.now(timezone.utc).isoformat(), **facts}


def report(title: str, tables: dict[str, pd.DataFrame], notes: Iterable[str] = ()) -> str:
    """Markdown of small tables."""

    def grid(t: pd.DataFrame) -> str:
        cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
        lines = [" | ".join(t.columns), " | ".join("---" for _ in t.columns), *(" | ".join(map(cell, row)) for row in t.itertuples(index=False))]
        return "\n".join(f"| {x} |" for x in lines)

    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{grid(t)}" for name, t in tables.items()), *(f"- {n}" for n in notes)]) + "\n"


def plot_bins(df: DataFrame, x: str, y: str, bins: int = 40) -> DataFrame:
    """x_bin, y_bin, n: the counts of a two-dimensional histogram, for whatever draws it."""
    edges = df.agg(*(f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))))
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(edges)).groupBy(at(x).alias("x_bin"), at(y).alias("y_bin")).agg(F.count("*").alias("n"))
