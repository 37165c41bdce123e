"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes the set of its distinct word shingles (WORDS words each), a digest of the set, a MinHash signature,
   and BANDS band keys. Texts of one set are one class, represented by its smallest id; copies go no further.
2. Classes that share a band key are candidates. Their sets (sorted 64-bit shingle hashes) are stored once; nothing else
   of a text travels again.
3. LEADERS rounds with one leader a bucket: each class is compared with the leader that most of its buckets have, so there
   is one comparison a class and round. Links join classes to components.
4. Then, in every bucket, all pairs across components: what is outside a bucket's most frequent component is compared with
   all of that component, and among itself. Classes are dealt out in blocks of BLOCK bytes, and blocks meet in tasks: no
   pairs are emitted, only links, of which a task gives no more than it takes to join its components. Two classes of one
   component need no comparison, for their link could not change the result.
5. Every comparison is the same: sizes first, then the signatures batch by batch. A candidate goes as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold falls under MISS. Survivors are verified on the
   full sets.
6. Links form components (large-star, small-star).

At similarity 0.8, a pair shares a band key with probability 1 - (1 - 0.8^ROWS)^BANDS, over 0.99999.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text with fewer words than a shingle takes, but not none, has one
shingle, of all of them.

Defined cases: null, empty and blank texts have an empty set, no links, and their own id as component; ids are taken to be
unique: rows that repeat an id and its text agree, and rows of one id with different texts count as one document for links;
a null id keeps null as its component and is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, steps, stored, texts
from .components import components

WORDS, PERCENT = 2, 80
BANDS, ROWS = 64, 8
#: Entries of the signature (8 bits of each) that the sequential test reads, in batches; its miss probability.
LANES, BATCH, MISS = 256, 32, 1e-7
#: Bytes of sets that a block of classes has, about; a task holds two blocks.
BLOCK = 4 << 20
SEED = 20240229
#: Rounds with one leader a bucket before all that is left is compared.
LEADERS = 2


_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.where(_BLANK, 0, np.random.default_rng(SEED + 1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: its bytes' numbers times powers of an odd one, summed and mixed."""
    x = np.frombuffer(text.lower(), np.uint8)  # in bytes, lower() changes A-Z only
    word = ~_BLANK[x]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64)
    longest = int(np.diff(starts, append=len(x)).max())
    powers = np.cumprod(np.full(longest, 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(starts[0], len(x)) - np.repeat(starts, np.diff(starts, append=len(x)))
    h = np.add.reduceat(_BYTE[x[starts[0] :]] * powers[place], starts - starts[0])
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def lanes(signature: np.ndarray) -> bytes:
    """8 bits of each of the first LANES entries. A minimum of a large set is small, so it is mixed: unlike sets agree in 1 of 256 lanes, whatever their sizes."""
    x = signature[:LANES]
    x = (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (x >> np.uint32(24)).astype(np.uint8).tobytes()


class Sketcher:
    """Set size, digest, band keys and 8-bit signature of texts."""

    def __init__(self, k: int = WORDS, bands: int = BANDS, rows: int = ROWS):
        rng = np.random.default_rng(SEED)
        n = bands * rows
        self.k, self.bands, self.rows = k, bands, rows
        self.a, self.b = rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)
        self.mix = rng.integers(0, 1 << 63, max(k, 2), np.uint64) | np.uint64(1)
        self.work = [np.empty((128, n), np.uint32) for _ in range(2)]  # what fits a processor's cache
        self.fold = rng.integers(0, 1 << 63, (bands, rows), np.uint64) | np.uint64(1)

    def hashes(self, text: bytes) -> np.ndarray:
        """64-bit hashes of the distinct shingles, sorted."""
        h = word_hashes(text)
        if not len(h):
            return h
        k = min(self.k, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * self.mix[i]
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def signature(self, h: np.ndarray) -> np.ndarray:
        """The least of each of the permutations' values over a set, on 32 bits, which bear candidates but no verdicts."""
        x = (h ^ h >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(x), len(self.work[0])):
            some = x[i : i + len(self.work[0]), None]
            part, other = (w[: len(some)] for w in self.work)
            np.multiply(some, self.a, out=part)
            part += self.b
            part ^= np.right_shift(part, 15, out=other)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(out, part.min(0), out=out)
        return out

    def __call__(self, text: bytes) -> tuple[int, bytes, list[int], bytes]:
        h = self.hashes(text)
        if not len(h):
            return 0, b"", [], b""
        s = self.signature(h)
        keys = (s.reshape(self.bands, self.rows).astype(np.uint64) * self.fold).sum(1)
        keys = (keys ^ keys >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)  # each band has multipliers of its own
        return len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), keys.view(np.int64).tolist(), lanes(s)


def least_matches(n: int, threshold: float, miss: float = MISS) -> int:
    """The fewest matches among n 8-bit signature entries at which P(similarity >= threshold | matches) is at least ``miss``."""
    j = np.linspace(0, 1, 4001)
    p = j + (1 - j) / 256
    over = j >= threshold - 1e-9
    for m in range(n + 1):
        log = m * np.log(np.maximum(p, 1e-300)) + (n - m) * np.log(np.maximum(1 - p, 1e-300))
        density = np.exp(log - log.max())
        if density[over].sum() / density.sum() >= miss:
            return m
    return n


def sketches(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, digest, bands, lanes of every row."""
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, lanes binary"

    def run(batches):
        sketch = Sketcher(k)
        for part in steps(batches):
            done: dict[bytes, tuple] = {}
            rows = []
            for t in part.column("text").to_pylist():
                if t in done:
                    rows.append((*done[t][:2], None, None))  # a copy in the same step needs no second signature
                else:
                    rows.append(done.setdefault(t, sketch(t)))
            n, digest, bands, lanes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(lanes, pa.binary())], names=["doc_id", "n_shingles", "digest", "bands", "lanes"])

    return texts(docs).mapInArrow(lean(run), schema)


class Block:
    """Classes side by side: ids, components, set sizes, signatures, sets, and the buckets in which they are to be compared."""

    def __init__(self, rows: list[tuple]):
        ids, roots, sizes, signatures, sets, self.keys = zip(*rows, strict=True)
        self.ids, self.roots, self.sizes = np.array(ids), np.array(roots), np.array(sizes)
        self.lanes = np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, LANES)
        self.sets = [np.frombuffer(x, np.uint64) for x in sets]

    def __len__(self) -> int:
        return len(self.ids)


def links(x: Block, y: Block, percent: int, least: list[int], key: int | None = None) -> list[tuple[int, int]]:
    """Pairs of ids, one of each block, whose sets reach the similarity: as many as join the components that have such pairs.

    With ``key`` only pairs are compared that share no smaller one of their buckets, as others are compared there; x may be y.
    """
    if len(x) > len(y):
        x, y = y, x
    up: dict[int, int] = {}

    def find(r: int) -> int:
        while r in up:
            r = up[r]
        return r

    out = []
    for i in range(len(x)):
        n = x.sizes[i]
        live = np.flatnonzero((y.roots != x.roots[i]) & (100 * np.minimum(y.sizes, n) >= percent * np.maximum(y.sizes, n)))
        if x is y:
            live = live[live > i]
        matches = np.zeros(len(live), np.int64)
        for k, m in enumerate(least):  # the sequential test
            if not len(live):
                break
            matches += (y.lanes[live, k * BATCH : (k + 1) * BATCH] == x.lanes[i, k * BATCH : (k + 1) * BATCH]).sum(1)
            live, matches = live[matches >= m], matches[matches >= m]
        for j in live[np.argsort(-matches, kind="stable")].tolist():
            a, b = find(int(x.roots[i])), find(int(y.roots[j]))
            if a == b or key is not None and min(set(x.keys[i]) & set(y.keys[j])) != key:
                continue
            small, large = sorted((x.sets[i], y.sets[j]), key=len)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            common = int((large[at] == small).sum())
            if 100 * common >= percent * (len(small) + len(large) - common):
                up[max(a, b)] = min(a, b)
                out.append((int(x.ids[i]), int(y.ids[j])))
    return out


def compared(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the classes that meet in a group.

    ``groups``: group, part (which name a group), side (0, 1, or 2 for both), id, root, keys. Sides 0 and 1 are compared with
    each other, side 2 with itself.
    """
    least = [least_matches(n, percent / 100) for n in range(BATCH, LANES + 1, BATCH)]
    names = ("group", "part", "side", "id", "root", "n_shingles", "lanes", "set", "keys")
    work = groups.join(sets.hint("merge"), "id").select(*names).repartition("group", "part").sortWithinPartitions("group", "part", "side")

    def run(batches):
        at, sides, out = None, {}, []

        def done():
            if 2 in sides:
                own = Block(sides[2])
                out.extend(links(own, own, percent, least, at[0]))
            if 0 in sides and 1 in sides:
                out.extend(links(Block(sides[0]), Block(sides[1]), percent, least, at[0] if sides[0][0][-1] is not None else None))

        for part in steps(batches, "set"):
            for group, p, side, *row in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if (group, p) != at:
                    done()
                    at, sides = (group, p), {}
                sides.setdefault(side, []).append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out.clear()
        done()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return work.mapInArrow(lean(run), "a long, b long").where("a <> b").distinct()


def _parts(of: DataFrame, by: str, sets: DataFrame) -> DataFrame:
    """``by``, of: into how many blocks the classes of each ``by`` are cut."""
    return of.join(sets.select("id", "n_shingles"), "id").groupBy(by).agg(F.ceil(F.sum(8 * F.col("n_shingles") + 400) / BLOCK).cast("long").alias("of"))


def _each(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _block(of: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(7)), of)


def with_leaders(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of ``pairs`` (id, root, lead, lead_root)."""
    none = F.lit(None).cast("array<long>").alias("keys")
    sizes = _parts(pairs, "lead", sets)
    pairs = pairs.join(sizes, "lead")
    members = pairs.select(F.col("lead").alias("group"), _block(F.col("of")).alias("part"), F.lit(1).alias("side"), "id", "root", none)
    leads = pairs.groupBy("lead").agg(F.min("lead_root").alias("root"), F.max("of").alias("of")).select(F.col("lead").alias("group"), _each(F.col("of")).alias("part"), F.lit(0).alias("side"), F.col("lead").alias("id"), "root", none)
    return compared(members.unionByName(leads), sets, percent)


def with_components(guests: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of ``guests`` (id, root, main) with the members of the component ``main``: both are cut into blocks, and each pair of blocks meets in a step of its own."""
    none = F.lit(None).cast("array<long>").alias("keys")
    wanted = guests.select("main").distinct()
    alone = wanted.join(roots, wanted["main"] == roots["node"], "left_anti").select(F.col("main").alias("id"), "main")
    inside = roots.join(wanted, roots["root"] == wanted["main"]).select(F.col("node").alias("id"), "main").union(alone)
    sizes = _parts(inside, "main", sets).join(_parts(guests, "main", sets).withColumnRenamed("of", "of_guests"), "main")
    part = F.col("block") * F.col("of_guests") + F.col("guest_block")
    members = inside.join(sizes, "main").withColumn("block", _block(F.col("of"))).withColumn("guest_block", _each(F.col("of_guests")))
    met = guests.join(sizes, "main").withColumn("guest_block", _block(F.col("of_guests"))).withColumn("block", _each(F.col("of")))
    members = members.select(F.col("main").alias("group"), part.alias("part"), F.lit(0).alias("side"), "id", F.col("main").alias("root"), none)
    met = met.select(F.col("main").alias("group"), part.alias("part"), F.lit(1).alias("side"), "id", "root", none)
    return compared(members.unionByName(met), sets, percent)


def among(outside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of ``outside`` (key, id, root) within each key, by pairs of blocks."""
    several = outside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rows = outside.join(several, "key")
    keys = rows.groupBy("id").agg(F.collect_set("key").alias("keys"))  # at most one a band
    rows = rows.join(_parts(rows, "key", sets), "key").join(keys, "id").withColumn("own", _block(F.col("of")))
    met = rows.withColumn("other", _each(F.col("of")))
    part = F.least("own", "other") * F.col("of") + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return compared(met.select(F.col("key").alias("group"), part.alias("part"), side.alias("side"), "id", "root", "keys"), sets, percent)


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (id, digest, n_shingles, bands, lanes) of ``rows``, and the buckets (key, id) that several of them share."""
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands", ignorenulls=True).alias("bands"), F.first("lanes", ignorenulls=True).alias("lanes"))
    classes = stored(classes, "classes")
    buckets = classes.select(F.explode("bands").alias("key"), "id")
    shared = buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    return classes, stored(buckets.join(shared.hint("merge"), "key").distinct(), "buckets")


def _sets(docs: DataFrame, classes: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """id, n_shingles, lanes, set (sorted hashes) of the classes that have candidates."""
    wanted = classes.join(buckets.select("id").distinct(), "id").select(F.col("id").alias("doc_id"), "lanes")

    def run(batches):
        sketch = Sketcher(k)
        for part in steps(batches):
            sets = [sketch.hashes(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), part.column("lanes"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "n_shingles", "lanes", "set"])

    # a merge at every size, so that what is shuffled grows with the input
    return stored(texts(docs).hint("merge").join(wanted, "doc_id").select("doc_id", "text", "lanes").mapInArrow(lean(run), "id long, n_shingles long, lanes binary, set binary").where("n_shingles > 0"), "sets")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    rows = stored(sketches(docs, k), "sketches")
    classes, buckets = _shared(rows)
    sets = _sets(docs, classes, buckets, k)
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    used: list[DataFrame] = []
    tested, roots = none, none.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        return components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(links))

    def rooted() -> DataFrame:
        return buckets.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))

    for turn in range(LEADERS):
        now = rooted()
        order = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
        mixed = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("id", "root"), order).alias("lead")).where("low <> high").select("key", "lead")
        found = now.join(mixed, "key").where("root <> lead.root").groupBy("id", "root", "lead").agg(F.count("*").alias("n"))
        found = found.select("id", "root", F.col("lead.id").alias("lead"), F.col("lead.root").alias("lead_root"), "n").join(tested, (F.col("id") == F.col("a")) & (F.col("lead") == F.col("b")), "left_anti")
        best = found.groupBy("id", "root").agg(F.max_by(F.struct("lead", "lead_root"), F.struct("n", -F.col("lead"))).alias("lead")).select("id", "root", "lead.lead", "lead.lead_root")
        best = stored(best, "candidates")
        links_ = stored(with_leaders(best, sets, percent), "links")
        if links_.isEmpty():
            break
        tested = tested.union(best.select("id", "lead")).union(best.select("lead", "id"))
        roots, last = joined(roots, links_), roots
        used += [best, links_]
        forget(last)
    # what is left: in each bucket, everything outside its most frequent component, with that component and among itself
    now = rooted()
    main = now.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")
    outside = stored(now.join(main, "key").where("root <> main"), "outside")
    guests = stored(outside.select("id", "root", "main").distinct(), "guests")
    # two small plans rather than one of their union, all of which would be told anew as each of its shuffles ends
    inside, apart = stored(with_components(guests, roots, sets, percent), "links"), stored(among(outside.select("key", "id", "root"), sets, percent), "links")
    found = inside.union(apart)
    if not found.isEmpty():
        roots, last = joined(roots, found), roots
        forget(last)
    forget(*used, outside, guests, inside, apart, buckets, sets)
    named = rows.select("doc_id", "n_shingles", "digest")
    own = classes.select("digest", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("digest", F.coalesce("root", "id").alias("id"))
    out = named.join(own, "digest", "left").withColumn("component_id", F.coalesce("id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, k: int = 5) -> DataFrame:
    """One document of each component: the rows of its smallest id, one a text that is repeated under it; null ids stay."""
    keep = near_duplicates(docs, percent, k).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    # the join leaves rows dealt by id, so the second step needs no shuffle of its own
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))
