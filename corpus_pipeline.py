"""Corpus pipeline: each stage's result is written as Parquet and read again as the next one's input.

Defined cases, besides those of the operators: a stage takes any table with the columns of ``documents``, and others, which
it passes on (the last stage doesn't); an empty table gives an empty one; rows with a null id stay unless a stage rejects
their text, and null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidalflow.llm import queries as q
from tidalflow.llm.common import forget, stored, table

#: Session setting with the key of the pseudonyms; without it, that of the tests is used.
KEY = "spark.tidalflow.pseudonym.key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose lines the conditional random field finds good; trained on the labelled rows of ``docs`` itself that aren't held out."""
    from tidalflow.llm.quality import good

    return good(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8): that of the smallest id; empty texts and null ids stay."""
    from tidalflow.llm.near_dup import deduplicated

    return deduplicated(docs, k=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which benchmark windows cover a twentieth of the words or more."""
    from tidalflow.llm.decontaminate import clean

    return clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers, dates and addresses of people replaced by pseudonyms within the text, by the key that the session's setting KEY names."""
    from tidalflow.llm.pii import KEY as test_key
    from tidalflow.llm.pii import pseudonymised

    return pseudonymised(docs, spark.conf.get(KEY, test_key))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids' and the decoded text's digests of every document that is left."""
    from tidalflow.llm.bpe import encoded

    return encoded(docs, q.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("pseudonyms", pseudonymised),
    ("BPE encoding", encoded),
]
#: SQL can't express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
            forget(before)
            before = docs
    return docs
