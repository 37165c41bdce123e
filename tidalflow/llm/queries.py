"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Folder of the public tokenizer files, in place of the installed package's.
TOKENIZERS = os.environ.get("TOKENIZER_DIR")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op2_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_cache import counts

    return counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import hits

    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op5_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


def op6_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import formatted

    return formatted(table(spark, sf_dir, "conversations"))


def op7_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_main import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    pieces = packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Makes the end of one document in ten periodic, as the contract says; ids that are null are left alone."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import collapsed, summary

    return summary(collapsed(table(spark, sf_dir, "documents"), _planted))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .manifest import documents

    found = documents(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
