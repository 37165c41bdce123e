"""Merkle manifest of a dataset, with contiguous digest matrices.

Each group's leaves, in order, are hashed ``fanout`` at a time, level by level, down to the group's subroot; the subroots,
in the order of their groups, likewise give the root. Digests are 64 bytes of lowercase hex and are concatenated as such.

Leaves are cut into aligned blocks of a power of the fanout. A block is one row, and its leaves one matrix of 64 columns: reshaped by
the fanout, its rows are hashed to the next level's matrix, and every sibling is found by index arithmetic. A block's top is a leaf
of the next, shorter table, which is treated likewise until each group has one node. Going back down, each block gets the
siblings of its top from the block above. So a task holds one block, however large a group is, and the number of
passes is the logarithm of the rows to the base of a block's size. Order comes from one range partition of the leaves' short rows.

Defined cases: a group that is null is one of its own, before the others; repeated keys are ordered by leaf, and rows alike in
everything are leaves of their own; a lone leaf is its group's subroot, and a lone subroot the root, without siblings; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

#: Leaves of a block, at most.
BLOCK = 1024


def field(x: str | Column) -> Column:
    """``-`` for null, else the value's length in bytes, ``:`` and the value."""
    x = (F.col(x) if isinstance(x, str) else x).cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*fields), 256)


def hashed(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The level above ``nodes``, a contiguous matrix of 64 bytes a row."""
    whole = len(nodes) // fanout
    rows = list(nodes[: whole * fanout].reshape(whole, 64 * fanout))
    if whole * fanout < len(nodes):
        rows.append(nodes[whole * fanout :].ravel())
    return np.frombuffer("".join([hashlib.sha256(x).hexdigest() for x in rows]).encode(), np.uint8).reshape(-1, 64)


def levels(nodes: np.ndarray, fanout: int, up: int | None) -> list[np.ndarray]:
    """``nodes`` and the levels above: ``up`` of them, or as many as lead to one node."""
    out = [nodes]
    while len(out) <= up if up is not None else len(out[-1]) > 1:
        out.append(hashed(out[-1], fanout))
    return out


def siblings(tree: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each leaf and level, left to right: the fanout - 1 siblings' digests, whether they are there, and the own place in the run."""
    n, up = len(tree[0]), len(tree) - 1
    found = np.zeros((n, up, fanout - 1, 64), np.uint8)
    there, own = np.zeros((n, up, fanout - 1), bool), np.zeros((n, up), np.int64)
    at = np.arange(n)
    for level, nodes in enumerate(tree[:-1]):
        own[:, level] = at % fanout
        for k in range(fanout - 1):
            other = at - own[:, level] + k + (k >= own[:, level])
            there[:, level, k] = other < len(nodes)
            found[:, level, k] = nodes[np.minimum(other, len(nodes) - 1)]
        at = at // fanout
    return found, there, own


def folded(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The top that ``node`` leads to with the siblings of ``path``: of each level, the own place in the run and the others' digests."""
    for own, others in path:
        node = hashlib.sha256(others[: 64 * own] + node + others[64 * own :]).hexdigest().encode()
    return node


def written(path: list[tuple[int, bytes]]) -> str:
    return "".join(f"{own},{others.decode()};" for own, others in path)


def read(path: str) -> list[tuple[int, bytes]]:
    return [(int(own), others.encode()) for own, _, others in (x.partition(",") for x in path.split(";")[:-1])]


def ordered(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Stored ``rows`` with their place in their group by ``keys``, from 0, and the group's size: columns place, size. Rows alike may be of any number."""
    # rows that are alike would all fall into one range
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("group", *keys, "_row").sortWithinPartitions("group", *keys, "_row")
    at = stored(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ordered")
    parts = at.groupBy("group", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("group")
    parts = parts.select("group", "_part", (F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("_first")).alias("_before"), F.sum("_n").over(whole).alias("size"))
    return at.join(parts, ["group", "_part"]).withColumn("place", F.col("_at") + F.col("_before")).drop("_at", "_part", "_before")


def blocks(nodes: DataFrame, block: int, *others: str) -> DataFrame:
    """One row a block of ``nodes`` (group, place, size, node): group, place, size, nodes in order, and ``others`` as lists."""
    rows = nodes.groupBy("group", F.floor(F.col("place") / block).alias("place"), "size").agg(F.sort_array(F.collect_list(F.struct("place", "node", *others))).alias("_rows"))
    return rows.select("group", "place", "size", F.array_join("_rows.node", "").cast("binary").alias("nodes"), *(F.col(f"_rows.{x}").alias(x) for x in others))


def per_block(rows: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """One task step a block: ``f`` gives the columns of its rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    types = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(types)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                got = f(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(got[x.name], x.type) for x in arrow], schema=arrow)

    return rows.mapInArrow(run, types)


def _tree(row: dict, fanout: int, block: int, depth: int) -> list[np.ndarray]:
    return levels(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 64), fanout, depth if row["size"] > block else None)


def proved(leaves: DataFrame, keys: list[str], fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """``leaves`` (group string, ``keys``, leaf, given) with subroot, root, proof and folded.

    ``given`` is the leaf as it is found now, null if it is as before. ``proof`` is all siblings' digests, left to right and level by level,
    to the root; ``folded`` is what the given leaf leads to with them. A group's order is that of ``keys``, then of the leaf.
    """
    if fanout < 2 or block < fanout:
        raise ValueError("a run has 2 nodes or more, and a block a run")
    depth, size = 0, 1
    while size * fanout <= block:
        depth, size = depth + 1, size * fanout
    first = stored(ordered(leaves.withColumnRenamed("leaf", "node"), [F.col(x).asc_nulls_first() for x in (*keys, "node", "given")]), "leaves")
    bottom = stored(blocks(first, size, *keys, "given"), "blocks")
    forget(first)
    made, tables = [bottom], [bottom]

    def top(row: dict) -> dict:
        return {"group": [row["group"]], "place": [row["place"]], "size": [-(-row["size"] // size)], "node": [_tree(row, fanout, size, depth)[-1].tobytes().decode()]}

    def upwards(rows: DataFrame) -> DataFrame:
        """The tops of ``rows``' blocks, until they are their groups' own; blocks on the way are kept in ``tables``."""
        while True:
            tops = stored(per_block(rows, top, "group string, place long, size long, node string"), "tops")
            made.append(tops)
            # one number; a group that is done has one node, which stays as it is
            if (tops.agg(F.max("size")).first()[0] or 0) <= 1:
                return tops
            rows = stored(blocks(tops, size), "blocks")
            made.append(rows)
            tables.append(rows)

    subroots = upwards(bottom)
    above = len(tables)
    groups = ordered(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "node"), [F.col("name")])
    named = stored(blocks(groups, size, "name"), "blocks")
    made += [groups, named]
    tables.append(named)
    root = upwards(named).select(F.col("node").alias("root"))

    def child(row: dict) -> dict:
        tree = _tree(row, fanout, size, depth)
        found, there, own = siblings(tree, fanout)
        n = len(tree[0])
        paths = [written([(int(own[i, k]), found[i, k][there[i, k]].tobytes()) for k in range(len(tree) - 1)]) + row["path"] for i in range(n)]
        # of groups, the nodes are subroots
        subroot = [x.tobytes().decode() for x in tree[0]] if "name" in row else [row.get("subroot")] * n
        return {"group": row.get("name") or [row["group"]] * n, "place": [0 if "name" in row else row["place"] * size + i for i in range(n)], "path": paths, "subroot": subroot, "root": [row["root"]] * n}

    def downwards(path: DataFrame, rows: list[DataFrame]) -> DataFrame:
        """The paths of all nodes of the lowest of ``rows``, from those of the tops of the highest."""
        for x in reversed(rows):
            path = stored(per_block(x.join(path, ["group", "place"]), child, "group string, place long, path string, subroot string, root string"), "paths")
            made.append(path)
        return path

    start = root.select(F.lit("").alias("group"), F.lit(0).cast("long").alias("place"), F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), "root")
    path = downwards(downwards(start, tables[above:]), tables[1:above])

    def leaf(row: dict) -> dict:
        tree = _tree(row, fanout, size, depth)
        found, there, own = siblings(tree, fanout)
        rest, n = read(row["path"]), len(tree[0])
        beyond = b"".join(x for _, x in rest)
        proofs, ends = [], []
        for i in range(n):
            steps = [(int(own[i, k]), found[i, k][there[i, k]].tobytes()) for k in range(len(tree) - 1)]
            proofs.append((b"".join([x for _, x in steps]) + beyond).decode())
            given = row["given"][i]
            ends.append(folded(given.encode() if given else tree[0][i].tobytes(), steps + rest).decode())
        same = {x: [row[x]] * n for x in ("group", "subroot", "root")}
        return {k: row[k] for k in keys} | same | {"leaf": [x.tobytes().decode() for x in tree[0]], "proof": proofs, "folded": ends}

    types = dict(leaves.dtypes)
    schema = f"group string, {', '.join(f'{k} {types[k]}' for k in keys)}, leaf string, subroot string, root string, proof string, folded string"
    out = per_block(bottom.join(path, ["group", "place"]), leaf, schema)
    forget(*(x for x in made if x is not bottom and x is not path))
    return out


def documents(docs: DataFrame, given: Column | None = None, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """The manifest of ``docs`` by language: doc_id, leaf, subroot, root, proof, folded. Where ``given`` holds, n_chars is taken to have grown by 1."""
    leaf = lambda n: digest(*map(field, ("doc_id", "source", "lang", n, "text")))
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("group"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf("n_chars").alias("leaf"),
        F.when(given, leaf(more)).alias("given") if given is not None else F.lit(None).cast("string").alias("given"),
    )
    leaves = stored(rows, "leaves")
    out = proved(leaves, ["doc_id"], fanout, block)
    forget(leaves)
    return out
