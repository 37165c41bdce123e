"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to one Python step at a time, in bytes; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a new temporary one if all runs on this machine."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, and survives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        if at := getattr(df, "stored_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Recent:
    """What a task has worked out for keys that it may meet again: a new part, and an old one that goes when the new one has grown.

    Sizes are those of the objects. Between steps it holds at most ``limit`` bytes; keys of over LONG characters only until the next step.
    """

    LONG = 256
    #: Bytes of an entry in a dictionary, about.
    ENTRY = 80

    def __init__(self, limit: int):
        self.new, self.old, self.long, self.size, self.limit = {}, {}, [], 0, limit

    def lacking(self, keys: set) -> list:
        """Those of ``keys`` without a value; the others are in ``new`` from now on."""
        self.trim()
        return self.recalled([x for x in keys if x not in self.new])

    def recalled(self, keys: list) -> list:
        """Of ``keys``, which ``new`` doesn't have, those that ``old`` doesn't have either; the others are in ``new`` from now on."""
        if not self.old:
            return keys
        values = list(map(self.old.get, keys))
        again = [(k, v) for k, v in zip(keys, values, strict=True) if v is not None]
        if again:
            self.put([k for k, _ in again], [v for _, v in again])
        return [k for k, v in zip(keys, values, strict=True) if v is None]

    def put(self, keys: list, values: list) -> None:
        self.long += [k for k in keys if len(k) > self.LONG]
        self.size += self._held(keys, values)
        self.new.update(zip(keys, values, strict=True))

    def _held(self, keys: list, values: list) -> int:
        return sum(map(getsizeof, keys)) + sum(map(getsizeof, values)) + self.ENTRY * len(keys)

    def trim(self) -> None:
        """Forgets long keys, and the old part once the new one has three eighths of the limit; a new part of over half of it goes too."""
        if self.long:
            self.size -= self._held(self.long, [self.new.pop(k) for k in self.long])
            self.long = []
        if self.size > 3 * self.limit // 8:
            self.old, self.new, self.size = self.new if self.size <= self.limit // 2 else {}, {}, 0


def salted(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16) -> DataFrame:
    """``left`` joined to the much smaller ``right``, each key dealt over ``salts`` tasks."""
    deal = left.withColumn("_salt", F.pmod(F.xxhash64(*(c for c, kind in left.dtypes if not kind.startswith(("array", "map")))), F.lit(salts)))
    return deal.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [*on, "_salt"]).drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """The id and the text as UTF-8 bytes (null: empty) of ``docs``; whatever other columns it has are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *extra)


def give_back() -> None:
    """Hands memory that is free, but held by Arrow's pool or the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which a task maps batches by, and then give_back(): the worker process stays, idle or for the tasks of later stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", *others: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches where their texts exceed ``size`` bytes (STEP_BYTES), so that Python's share of memory is bounded."""
    most = size or STEP_BYTES
    for batch in batches:
        start = taken = 0
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        for more in others:
            sizes = [(a or 0) + (b or 0) for a, b in zip(sizes, pa.compute.binary_length(batch.column(more)).to_pylist(), strict=True)]
        for i, n in enumerate(sizes):
            if taken and taken + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, taken = i, 0
            taken += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def per_text(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str, keep: str = "doc_id", size: int | None = None) -> DataFrame:
    """One output row for each row of ``texts(...)``: ``make()`` runs once a task and returns a function of lists (ids, texts; ``size`` bytes at a time) giving the columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    types = df.sparkSession.createDataFrame([], f"{keep} long, {schema}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches):
        f = make()
        for part in steps(batches, size=size):
            got = f(part.column(keep).to_pylist(), part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(keep)] + [pa.array(got[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.select(keep, "text").mapInArrow(lean(run), types)


def filtered(docs: DataFrame, make: Callable[[], Callable[[list], list]], column: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, for which the function that ``make()`` gives (list of UTF-8 texts to list of booleans) says so."""

    def run(batches):
        keep = make()
        for part in steps(batches, column):
            got = keep([x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()])
            yield part.filter(pa.array(got, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
