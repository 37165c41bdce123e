"""Token counts with a digest cache.

A text's count is looked up by (digest of its content, digest of the tokenizer's file and library version). Only the
distinct contents without a stored count are encoded; their counts are appended to the cache, a Parquet table.

What is counted is what the tokenizer sees: the tokenizer has no normaliser, so the content is taken as it is, with null
read as empty. Within the encoder a second, bounded table remembers the counts of white-space-delimited pieces, as
byte-level pre-tokens never cross from one such piece to the next; texts with white space on which Unicode tables differ
go through the library whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows each get a row and are encoded once; an empty
table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, shared_dir, steps, texts

LIMIT = 512
#: A content is frequent that so many rows have, and one in SHARE of all rows: at most SHARE contents are.
FREQUENT, SHARE = 100, 1000
#: Bytes in which a worker remembers the counts of pieces.
REMEMBERED = 128 << 20
_PIECE = re.compile(r" ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+")
_ODD = re.compile("[^\\S \\n]|[\\x1c-\\x1f\\x85]|<\\|endoftext\\|>")


def version(path: str) -> str:
    """Digest of a tokenizer's file and its library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()[:32]


class Counter:
    """Counts the tokens of texts as the library does for a byte-level BPE file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Recent(REMEMBERED)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        odd = [i for i, x in enumerate(texts) if _ODD.search(x)]
        plain = {i: _PIECE.findall(x) for i, x in enumerate(texts) if i not in set(odd)}
        new = self.known.lacking(set().union(*plain.values()))
        self.known.put(new, self.encode(new))
        out, known = [0] * len(texts), self.known.new
        for i, x in plain.items():
            out[i] = sum(map(known.__getitem__, x))
        self.known.trim()
        for i, n in zip(odd, self.encode([texts[i] for i in odd]), strict=True):
            out[i] = n
        return out


@functools.lru_cache(1)
def counter(path: str) -> Counter:
    """The counter that a worker process keeps for its next tasks, with the pieces that it remembers."""
    return Counter(path)


def counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``; new counts are appended to the Parquet table ``cache`` (none: a new one in the shared folder)."""
    spark, tag = docs.sparkSession, version(tokenizer)
    cache = cache or f"{shared_dir(spark)}/token-counts-{tag}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    schema = "digest binary, tokenizer string, n_tokens long"
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    there = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        have = spark.read.schema(schema).parquet(cache)
    else:
        have = spark.createDataFrame([], schema)
    # copies within a map task are combined before the shuffle, so a group of copies sends at most one text a task
    distinct = texts(docs).groupBy(digest).agg(F.first("text").alias("text"))
    missing = distinct.join(have.where(F.col("tokenizer") == tag).select("digest"), "digest", "left_anti")

    def encode(batches):
        count = counter(tokenizer)
        for part in steps(batches):
            n = count([x.decode() for x in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([tag] * len(n)), pa.array(n, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    missing.mapInArrow(encode, schema).write.mode("append").parquet(cache)
    # two runs that append at once can store a digest twice, with the same count
    stored_counts = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer") == tag).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    asked = texts(docs).select("doc_id", digest, F.octet_length("text").cast("long").alias("n_bytes"))
    # the counts of contents that very many rows have are sent to these rows: at most SHARE of them, by the threshold
    often = asked.groupBy("digest").agg(F.count("*").alias("n"))
    total = F.broadcast(often.agg(F.sum("n").alias("total")))
    hot = F.broadcast(often.join(total).where((F.col("n") >= FREQUENT) & (F.col("n") * SHARE >= F.col("total"))).select("digest").join(stored_counts, "digest").withColumnRenamed("n_tokens", "known"))
    asked = asked.join(hot, "digest", "left")
    found = asked.where("known IS NULL").select("doc_id", "n_bytes", "digest").join(stored_counts, "digest").select("doc_id", "n_bytes", "n_tokens")
    found = asked.where("known IS NOT NULL").select("doc_id", "n_bytes", F.col("known").alias("n_tokens")).union(found)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
