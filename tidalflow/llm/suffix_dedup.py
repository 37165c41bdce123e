"""Removal of repeated passages with suffix arrays, built by the difference-cover algorithm.

A byte goes when it lies in a string of LENGTH bytes that also starts earlier (in a document of smaller id, or earlier in
the same one). Every string of LENGTH bytes is anchored at the least hash among its grams of GRAM bytes; equal strings
have equal anchors, so only anchors that occur more than once can hold repeated strings. Spark deals these out:

1. Each text's anchors, the starts that each one owns, and a digest of the stretch that these starts' strings cover. An
   anchor of a stretch that occurs before is repeated with all its starts; no bytes need to travel. A task does this
   with the texts that it meets, so copies send about one row a task.
2. What is left are the edges of repeats: anchors with a gram that has several different stretches. Those stretches are
   sent to the gram's longer forms (38 bytes more, to the right for near starts, to the left for the far ones).
3. There, the suffixes of the stretches are sorted by the difference-cover algorithm: triples at places 1 and 2 (mod 3) are
   sorted and named, the names are sorted by recursion, and the suffixes at places 0 are merged in. Adjacent suffixes
   with a common prefix of LENGTH bytes form groups, of which all but the earliest are repeated.
   A group above SORTED bytes doesn't fit a task: the digests of its strings are compared by Spark's aggregation instead.
4. Each document's repeated starts become spans, which are cut out.

Defined cases: null text is empty, and has no spans; texts under LENGTH bytes stay; ids are taken to be unique: of rows
that repeat an id, spans found in any are applied to all; a null id's text is neither compared nor cut; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import steps, stored, texts

LENGTH, GRAM, MORE = 100, 24, 38
#: Bytes of stretches whose suffixes are sorted together, and the largest group that is sorted at all.
SORTED = 1 << 20
#: Stretches that a task remembers; bits in which the shape of an anchor fits (starts x 128 + place, both at most LENGTH).
SEEN, SHAPE = 1 << 20, 14
_BITS = 23
_MASK = np.uint64((1 << _BITS) - 1)
_TABLE = np.random.default_rng(20240307).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[:-k] = x[k:]
    return out


def grams(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    h, k = {1: _TABLE[text]}, 1
    while k < 16:
        h[2 * k] = _mix(h[k] + _ahead(h[k], k) * np.uint64(0x9E3779B97F4A7C15 + 2 * k))
        k *= 2
    return _mix(h[16] + _ahead(h[8], 16) * np.uint64(0xC2B2AE3D27D4EB4F))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, gram hash, first and last start owned, of each anchor of a text."""
    n = len(text)
    if n < LENGTH:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = []
    span = (1 << _BITS) - 2 * LENGTH
    for base in range(0, n - LENGTH + 1, span):  # a very long text in pieces; each start belongs to one
        piece = np.frombuffer(text[base : base + span + LENGTH - 1], np.uint8)
        g = grams(piece)
        low = g & ~_MASK | _MASK - np.arange(len(piece), dtype=np.uint64)  # of equal grams the last
        wide, k = LENGTH - GRAM + 1, 1
        while 2 * k <= wide:
            low[:-k] = np.minimum(low[:-k], low[k:])
            k *= 2
        if wide > k:
            low[: -(wide - k)] = np.minimum(low[: -(wide - k)], low[wide - k :])
        at = (_MASK - (low[: len(piece) - LENGTH + 1] & _MASK)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        out.append((at[first] + base, g[at[first]], first + base, last + base))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def difference_cover(s: np.ndarray, enough: int, covered: int = 1) -> np.ndarray:
    """The suffix array of positive symbols; the order of suffixes that agree in ``enough`` symbols is left open.

    Triples at places 1 and 2 (mod 3) are sorted and named; names stand for 3 x ``covered`` of the first symbols. Their
    order comes by recursion if names repeat. Suffixes at places 0 are sorted by a symbol and the rank behind it, and merged.
    """
    n = len(s)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    base = int(t.max()) + 1
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    if base < 1 << 21:
        triple = (t[sample] * base + t[sample + 1]) * base + t[np.minimum(sample + 2, n + 2)]
    else:  # a pair's name first
        pair = np.unique(t[sample] * base + t[sample + 1], return_inverse=True)[1]
        triple = pair * base + t[np.minimum(sample + 2, n + 2)]
    distinct, name = np.unique(triple, return_inverse=True)
    if len(distinct) == len(sample):
        order = np.argsort(name)
    elif 3 * covered >= enough:
        order = np.argsort(name, kind="stable")
    else:
        order = difference_cover(name + 1, enough, 3 * covered)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    wide = np.int64(len(sample) + 2)
    key0 = t[zero] * wide + rank[zero + 1]
    zero = zero[np.argsort(key0, kind="stable")]
    # places 1 compare by a symbol and a rank, places 2 by two symbols and a rank
    is_one = sorted_sample % 3 == 1
    ones, twos = sorted_sample[is_one], sorted_sample[~is_one]
    a0, a1 = t[zero] * wide + rank[zero + 1], t[ones] * wide + rank[ones + 1]
    pairs = np.unique(np.concatenate([t[zero] * base + t[zero + 1], t[twos] * base + t[twos + 1]]), return_inverse=True)[1]
    b0, b2 = pairs[: len(zero)] * wide + rank[zero + 2], pairs[len(zero) :] * wide + rank[twos + 2]
    before0 = np.searchsorted(a1, a0, "left") + np.searchsorted(b2, b0, "left")
    out = np.empty(len(zero) + len(sorted_sample), np.int64)
    at0 = np.arange(len(zero)) + before0
    out[at0] = zero
    rest = np.ones(len(out), bool)
    rest[at0] = False
    out[rest] = sorted_sample
    return out


def repeated_starts(members: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int]]:
    """(doc, start) of the strings of LENGTH bytes that start earlier in another of ``members`` (doc, first start, starts, bytes) too."""
    sizes = np.array([len(m[3]) for m in members])
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.frombuffer(b"".join(m[3] + b"\x00" for m in members), np.uint8)
    symbols = text.astype(np.int64) + len(members) + 1
    symbols[begin + sizes] = np.arange(1, len(members) + 1)  # an end of its own for each
    order = difference_cover(symbols, LENGTH)
    owner = np.repeat(np.arange(len(members)), sizes + 1)
    offset = np.arange(len(text)) - begin[owner]
    valid = offset < np.array([m[2] for m in members])[owner]
    order = order[valid[order]]
    strings = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    same = np.zeros(len(order), bool)
    for i in range(1, len(order), 1 << 18):
        j = min(len(order), i + (1 << 18))
        same[i:j] = (strings[order[i:j]] == strings[order[i - 1 : j - 1]]).all(1)
    doc, start = np.array([m[0] for m in members])[owner[order]], np.array([m[1] for m in members])[owner[order]] + offset[order]
    group = np.cumsum(~same)
    earliest = np.lexsort((start, doc, group))
    first = np.append(True, np.diff(group[earliest]) > 0)
    # overlapping stretches hold the same start of a document twice; that isn't another start
    again = earliest[~first]
    head = earliest[np.flatnonzero(first)][group[again] - 1]
    again = again[(doc[again] != doc[head]) | (start[again] != start[head])]
    return list(zip(doc[again].tolist(), start[again].tolist(), strict=True))


def _runs(found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(doc, first, last) of consecutive starts."""
    out: list[tuple[int, int, int]] = []
    for d, s in sorted(set(found)):
        if out and out[-1][0] == d and out[-1][2] + 1 == s:
            out[-1] = (d, out[-1][1], s)
        else:
            out.append((d, s, s))
    return out


_RUNS = "doc_id long, first long, last long"


def _anchored(docs: DataFrame) -> DataFrame:
    """gram, stretch, doc_id, at, again of every anchor; ``again`` where the task has met an earlier equal stretch.

    ``at`` has the first start owned, the number of starts and the anchor's place in one number. Beside the texts of a step,
    a table of SEEN slots remembers the task's stretches, so a passage sends about one row a task, however many texts have it.
    """
    names = ("gram", "stretch", "doc_id", "at", "again")

    def run(batches):
        slots = np.zeros((3, SEEN), np.int64)  # stretch, doc, first start of it
        filled = np.zeros(SEEN, bool)
        for part in steps(batches):
            cols = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                place, gram, first, last = anchors(text)
                if len(place):
                    of = [int.from_bytes(hashlib.blake2b(text[a : b + LENGTH] + bytes([p - a]), digest_size=8).digest(), "big", signed=True) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
                    cols.append((np.full(len(place), doc), first, (last - first) * 128 + place - first, gram.view(np.int64), np.array(of)))
            if not cols:
                continue
            doc, first, shape, gram, stretch = (np.concatenate(x) for x in zip(*cols, strict=True))
            order = np.lexsort((first, doc, stretch))
            again = np.zeros(len(doc), bool)
            again[order[1:]] = stretch[order[1:]] == stretch[order[:-1]]
            slot = stretch & (SEEN - 1)
            known, known_doc, known_first = slots[:, slot]
            same = filled[slot] & (known == stretch)
            earlier = (known_doc < doc) | (known_doc == doc) & (known_first < first)
            again |= same & earlier
            new = ~again
            slots[:, slot[new]] = stretch[new], doc[new], first[new]
            filled[slot[new]] = True
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, stretch, doc, first << SHAPE | shape, again)], names=list(names))

    return texts(docs).where("doc_id IS NOT NULL").mapInArrow(run, "gram long, stretch long, doc_id long, at long, again boolean")


def _edges(docs: DataFrame, edges: DataFrame, many: bool) -> DataFrame:
    """key, doc_id, first, starts, bytes of the stretches to compare: near starts by the gram and what follows, far ones by what is before.

    ``many`` chooses those of grams that have many stretches, or the others.
    """
    arrow = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("starts", pa.int64()), ("bytes", pa.binary())])
    per_doc = edges.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "place", "many")).alias("edges"))

    def run(batches):
        for part in steps(batches):
            rows = []
            for doc, text, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "edges")), strict=True):
                for e in (x for x in found if x["many"] == many):
                    a, b, p = e["first"], e["last"], e["place"]
                    split = max(a, min(b + 1, p - MORE))  # the first near start
                    for side, x, y in ((b"n", split, b), (b"f", a, split - 1)):
                        if x <= y:
                            shared = text[p : p + GRAM + MORE] if side == b"n" else text[p - MORE : p + GRAM]
                            key = int.from_bytes(hashlib.blake2b(side + shared, digest_size=8).digest(), "big", signed=True)
                            rows.append((key, doc, x, y - x + 1, text[x : y + LENGTH]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    chosen = texts(docs).join(per_doc, "doc_id").where(F.exists("edges", lambda e: e["many"] == many))
    return chosen.select("doc_id", "text", "edges").mapInArrow(run, "key long, doc_id long, first long, starts long, bytes binary")


def _later(group: DataFrame) -> DataFrame:
    """doc_id, first, last: runs of starts that aren't the earliest of their string, for rows of ``_edges`` of any number to a key."""
    at = group.select("doc_id", "first", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("starts") - 1)).alias("i"))
    strings = at.select(F.unhex(F.md5(F.expr(f"substring(bytes, CAST(i AS INT) + 1, {LENGTH})"))).alias("string"), "doc_id", (F.col("first") + F.col("i")).alias("first"))
    earliest = strings.groupBy("string").agg(F.min(F.struct("doc_id", "first")).alias("head"))
    again = strings.join(earliest, "string").where((F.col("doc_id") != F.col("head.doc_id")) | (F.col("first") != F.col("head.first")))
    # consecutive starts have one difference to their rank
    run = again.select("doc_id", "first", (F.col("first") - F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first"))).alias("run"))
    return run.groupBy("doc_id", "run").agg(F.min("first").alias("first"), F.max("first").alias("last")).select("doc_id", "first", "last")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, first, last: runs of starts whose strings of LENGTH bytes start earlier too."""
    # what is known to be repeated goes anywhere
    dealt = _anchored(docs).withColumn("gram", F.when(F.col("again"), F.xxhash64("doc_id", "at")).otherwise(F.col("gram"))).repartition("gram")
    by_gram, by_stretch = Window.partitionBy("gram"), Window.partitionBy("gram", "stretch").orderBy("doc_id", "at")
    seen = dealt.withColumn("nth", F.row_number().over(by_stretch)).withColumn("mixed", F.min("stretch").over(by_gram) != F.max("stretch").over(by_gram))
    # a stretch has under 2 x LENGTH bytes, so the groups of other grams surely fit
    seen = seen.withColumn("many", F.count(F.when(F.col("nth") == 1, 1)).over(by_gram) > SORTED // (2 * LENGTH))
    first, shape = F.shiftright("at", SHAPE), F.col("at").bitwiseAND(F.lit((1 << SHAPE) - 1))
    again = (F.col("again") | (F.col("nth") > 1)).alias("again")
    seen = seen.where("again OR nth > 1 OR mixed").select("doc_id", first.alias("first"), (first + F.shiftright(shape, 7)).alias("last"), (first + shape % 128).alias("place"), again, "many")
    seen = stored(seen, "repeats")
    open_ = seen.where("NOT again")
    edges, large = _edges(docs, open_, False), None
    if not open_.where("many").isEmpty():
        wide = _edges(docs, open_, True)
        # one row for each SORTED bytes of stretches at most
        above = F.broadcast(wide.groupBy("key").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > SORTED).select("key"))
        edges, large = edges.union(wide.join(above, "key", "left_anti")), wide.join(above, "key", "left_semi")
    arrow = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches):
        key, group, todo, size = None, [], [], 0

        def out():
            runs = _runs(repeated_starts(todo)) if todo else []
            cols = list(zip(*runs, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=arrow)

        for part in steps(batches, "bytes"):
            for k, doc, first, starts, data in zip(*(part.column(c).to_pylist() for c in ("key", "doc_id", "first", "starts", "bytes")), strict=True):
                if k != key:
                    if len(group) > 1:
                        todo, size = todo + group, size + sum(len(m[3]) for m in group)
                    key, group = k, []
                    if size > SORTED:
                        yield out()
                        todo, size = [], 0
                group.append((doc, first, starts, data))
        todo += group if len(group) > 1 else []
        yield out()

    local = edges.repartition("key").sortWithinPartitions("key").mapInArrow(run, _RUNS)
    known = seen.where("again").select("doc_id", "first", "last")
    return known.union(local) if large is None else known.union(local).union(_later(large))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    return _cut(docs, lambda text, kept, removed, spans: (len(text), removed, spans, hashlib.sha256(kept).hexdigest()), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text (what is left, as UTF-8; a character cut in two becomes U+FFFD), n_removed of every row of ``docs``."""
    return _cut(docs, lambda text, kept, removed, spans: (kept.decode(errors="replace"), removed), "text string, n_removed long")


def _cut(docs: DataFrame, result, schema: str) -> DataFrame:
    runs = repeated_runs(docs).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]

    def run(batches):
        for part in steps(batches):
            rows = []
            for text, found in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                kept, at, removed, spans, end = [], 0, 0, 0, -1
                for a, b in sorted((r["first"], r["last"] + LENGTH) for r in found or ()):
                    if a > end:
                        kept.append(text[at:a])
                        spans += 1
                    removed += max(0, b - max(a, at))
                    at = end = max(end, b)
                kept.append(text[at:])
                rows.append(result(text, b"".join(kept), removed, spans))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", *names])

    return texts(docs).join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(run, f"doc_id long, {schema}")
