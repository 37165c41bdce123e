"""Connected components of a table of edges, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the smallest node that it is connected with) of every node that has an edge; ``edges`` has columns a and b.

    Large-star and small-star steps in turn: every node's neighbours are hung on the smallest of them, until nothing
    changes. No step's output is larger than its input, and a node's neighbours are never gathered: their minimum is
    aggregated before the shuffle and joined back.

    A graph takes several steps, of small tables mostly, and the driver pays for each job: so joins are merges, which send
    nothing through the driver, and whether a step changed anything is counted while its result is written.
    """
    now, state = _counted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while state != before:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # small star: each node with its smaller neighbours only
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low.hint("merge"), "b").select("m", F.explode(F.array("b", "a")).alias("b"))
        small = small.select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        last, before = now, state
        now, state = _counted(small, name)
        forget(last)
    out = now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a")).distinct()
    out.stored_at = now.stored_at  # for ``forget``
    return out


def _counted(edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """``edges`` (a, b) stored, and by what two sets of edges are told apart: their number and the sum of their hashes."""
    seen = Observation()
    out = stored(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")), name)
    return out, seen.get
