"""I-Match fingerprints with randomised lexicons.

The lexicon is the set of terms whose document frequency, as a share of all documents, lies in a band (that is, a band of
inverse document frequency). A text keeps its lexicon terms, distinct and sorted; their hash is its classic fingerprint.
Beside it, each of several random subsets of the lexicon gives one more hash, of the set of terms that are also in the subset.
Subsets come in sizes from a half of the lexicon down by halves, so that texts of any length have some subset that an
edit leaves as it was. The likeness of two fingerprints is the share of equal hashes among the places at which at least
one of them has terms, at the size of subsets where it is highest.

Document frequencies are counted over all documents. A lexicon has at most (mean number of distinct terms) / (lower edge
of the band) terms, whatever the number of documents. It is sent to the executors in blocks of about BLOCK_BYTES. Where one
block holds it, a single pass over the texts does all; else each block has a pass of its own that writes which of its
terms every text keeps, and these are put together and hashed at the end. Both ways give the same fingerprints.

A term is a run of bytes that aren't ASCII space or punctuation, after lower-casing A-Z. Text without any lexicon term is
fingerprinted by all its terms, and text without terms by its bytes, so that unlike texts stay unlike.

Defined cases: null and empty texts are alike; repeated rows each get a row, ids that repeat are ordered by their text; a
null id comes last; a single row's next document is itself; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, stored, texts

#: The band of document frequency, as shares of all documents.
LOW, HIGH = 0.0005, 0.05
SCALES, EACH = 12, 12
#: Bytes of the part of the lexicon that a task holds, and those that a term takes besides its own.
BLOCK_BYTES, TERM_BYTES = 160 << 20, 160
#: Partial counts that a task holds before it passes them on.
TERMS = 250_000
#: Documents that a bucket of neighbouring ids has, about; and how many buckets there are at most, for the driver holds an id of each.
BUCKET, BUCKETS = 4000, 50_000
_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> set[bytes]:
    return set(text.translate(_SPLIT).split())


def places(h: np.ndarray) -> np.ndarray:
    """Which subsets the terms of these hashes are in, a row of booleans each: EACH subsets of each scale, of parts 1/2, 1/4, ... of the lexicon."""
    out = np.empty((len(h), SCALES * EACH), bool)
    for k in range(SCALES * EACH):
        draw = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        draw = (draw ^ draw >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        out[:, k] = draw < np.uint64(1 << 63 - k // EACH)
    return out


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, n: in how many rows of ``docs`` a term occurs."""

    def run(batches):
        seen: Counter = Counter()
        for part in steps(batches):
            for x in part.column("text").to_pylist():
                seen.update(terms(x))
                if len(seen) > TERMS:
                    yield from flush(seen)
                    seen = Counter()
        yield from flush(seen)

    def flush(seen):
        for i in range(0, len(seen), 50_000):
            keys = list(seen)[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([seen[k] for k in keys], pa.int64())], names=["term", "n"])

    return texts(docs).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, limit: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, term) of the terms in the band, and the number of blocks, of about ``limit`` bytes at most."""
    total = docs.count()
    band = stored(document_frequencies(docs).where((F.col("n") >= max(2, low * total)) & (F.col("n") <= max(2, high * total))).select("term"), "lexicon")
    size = band.agg(F.sum(F.octet_length("term") + TERM_BYTES)).first()[0] or 0
    n = max(1, -(-size // limit))
    return band.select(F.pmod(F.xxhash64("term"), F.lit(n)).alias("block"), "term"), n


def hashed(kept: list[bytes]) -> tuple[str, ...]:
    """The fingerprint of sorted terms: the hash over all of them, and that of each subset ("" where it has none)."""
    import xxhash

    h = np.array([xxhash.xxh3_64_intdigest(t) for t in kept], np.uint64)
    return _summed(kept, h, np.ascontiguousarray(places(h).T))


def _summed(kept: list[bytes], h: np.ndarray, member: np.ndarray) -> tuple[str, ...]:
    import xxhash

    # a sum of mixed hashes is the same for any order of the terms
    place, term = np.nonzero(member)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    sums, some = np.zeros(SCALES * EACH, np.uint64), np.zeros(SCALES * EACH, bool)
    if len(starts):
        mixed = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        sums[place[starts]], some[place[starts]] = np.add.reduceat(mixed[term], starts), True
    sums = (sums ^ sums >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
    return (f"{xxhash.xxh3_64_intdigest(b' '.join(kept)):016x}", *[f"{x:04x}" if n else "" for x, n in zip(sums.tolist(), some.tolist(), strict=True)])


def without_lexicon(text: bytes) -> list[bytes]:
    """What stands for a text of which the lexicon has no term."""
    return sorted(terms(text)) or [b"\x00" + text]


class Fingerprinter:
    """Fingerprints of texts by a whole lexicon."""

    def __init__(self, words: list[bytes]):
        import xxhash

        self.index = {t: i for i, t in enumerate(words)}
        self.hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in words], np.uint64)
        self.places = np.packbits(places(self.hashes), axis=1)

    def __call__(self, text: bytes) -> tuple[str, ...]:
        index = self.index
        kept = sorted([t for t in terms(text) if t in index])
        if not kept:
            return hashed(without_lexicon(text))
        at = np.array([index[t] for t in kept])
        return _summed(kept, self.hashes[at], np.ascontiguousarray(np.unpackbits(self.places[at], axis=1, count=SCALES * EACH).T).view(bool))


def likeness(x: tuple[str, ...], y: tuple[str, ...]) -> float:
    if x == y:
        return 1.0
    shares, equal, informative = [], 0, 0
    for s in range(1, len(x), EACH):
        pairs = [(a, b) for a, b in zip(x[s : s + EACH], y[s : s + EACH], strict=True) if a or b]
        same = sum(a == b for a, b in pairs)
        equal, informative = equal + same, informative + len(pairs)
        if len(pairs) >= EACH // 3:
            shares.append(same / len(pairs))
    return max(shares, default=equal / informative if informative else 0.0)


def neighbourly(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """texts(docs) in order of descending id within buckets of neighbouring ids: columns bucket, ahead, doc_id, text.

    Each bucket's last row is followed by a copy (ahead) of the first row of the next one, and the last bucket's by the
    very first row. What the driver holds is one id a bucket.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    total = ids.count()
    parts = max(1, min(-(-total // bucket), BUCKETS))
    cuts = sorted(set(ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []))
    spark = docs.sparkSession
    if cuts:
        # a range of ids is a bucket; the array is looked up by binary search in each task
        sent = spark.sparkContext.broadcast(cuts)

        def place(batches):
            from bisect import bisect_left

            for part in batches:
                at = [-bisect_left(sent.value, i) if i is not None else 1 for i in part.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *part.columns], names=["bucket", *part.schema.names])

        def put(rows):
            return rows.mapInArrow(place, ", ".join(["bucket long", *(" ".join(x) for x in rows.dtypes)]).replace("bigint", "long"))
    else:

        def put(rows):
            return rows.select(F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long").alias("bucket"), *rows.columns)

    placed = put(texts(docs))
    # descending ids are ascending buckets; each bucket's first row by (id descending, text)
    heads = put(ids).groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect()
    order = sorted(heads, key=lambda r: r.bucket)
    if not order:
        return placed.select("bucket", F.lit(0).alias("ahead"), "doc_id", "text")
    before = {order[i].bucket: order[i - 1].bucket for i in range(len(order))}
    first = spark.createDataFrame([(r.bucket, r.doc_id, before[r.bucket]) for r in order], "bucket long, doc_id long, to long")
    # of rows that share a bucket's first id, the one of the smallest text
    same = texts(docs).alias("p").join(F.broadcast(first).alias("f"), F.col("p.doc_id").eqNullSafe(F.col("f.doc_id")))  # an id has one bucket
    ahead = same.groupBy("f.to").agg(F.min(F.struct("p.text", "p.doc_id")).alias("x")).select(F.col("to").alias("bucket"), F.lit(1).alias("ahead"), "x.doc_id", "x.text")
    return placed.select("bucket", F.lit(0).alias("ahead"), "doc_id", "text").unionByName(ahead)


_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, n_chars: int, sha: str, own: tuple, other: tuple, following: tuple) -> dict:
    return dict(zip(_NAMES, (doc_id, n_chars, sha, "-".join(own), "-".join(other), likeness(own, other), likeness(own, following)), strict=True))


def _followed(part: pa.RecordBatch, before: tuple | None, values: tuple[str, ...]):
    """(row, its next row or None) for the rows of a step of ``neighbourly``: (bucket, ahead, *values). The last row waits in what comes last, (waiting row, None)."""
    for now in zip(*(part.column(c).to_pylist() for c in ("bucket", "ahead", *values)), strict=True):
        if before and before[0] == now[0] and not before[1]:
            yield before, now
        before = now
    yield before, None


def _at_once(ordered: DataFrame, words: list[bytes]) -> DataFrame:
    """Fingerprints by a lexicon of one block, in one pass."""
    sent = ordered.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        mark = Fingerprinter(sent.value)
        before = own = None
        for part in steps(batches):
            rows = []
            for now, after in _followed(part, before, ("doc_id", "text")):
                if after is None:
                    before = now
                    continue
                text, following = now[3].decode(), after[3].decode()
                data = _edited(text, following).encode()
                mine = own[1] if own and own[0] is now else mark(now[3])
                own = (after, mark(after[3]))
                rows.append(_row(now[2], len(text), hashlib.sha256(data).hexdigest(), mine, mark(data), own[1]))
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return ordered.mapInArrow(run, _SCHEMA)


def _by_blocks(ordered: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """Fingerprints by a lexicon of ``n`` blocks: a pass for each, of which only the block's own terms are in memory."""
    spark = ordered.sparkSession
    schema = "bucket long, pos long, ahead int, doc_id long, n_chars long, sha string, own array<binary>, other array<binary>, bare_own string, bare_other string"
    of = pa.list_(pa.binary())
    arrow = pa.schema([("bucket", pa.int64()), ("pos", pa.int64()), ("ahead", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.string()), ("own", of), ("other", of), ("bare_own", pa.string()), ("bare_other", pa.string())])
    found = []
    for block in range(n):
        sent = spark.sparkContext.broadcast({bytes(r.term) for r in words.where(F.col("block") == block).select("term").toLocalIterator()})

        def run(batches, sent=sent, first=block == 0):
            index, before, pos, at = sent.value, None, 0, None

            def row(now, after):
                nonlocal pos, at
                pos, at = (pos + 1 if now[0] == at else 0), now[0]
                text = now[3].decode()
                # the copy of another bucket's row is there to be compared with; it has no edited text of its own
                data = _edited(text, after[3].decode()).encode() if after else b""
                bare = ("-".join(hashed(without_lexicon(x))) if first else None for x in (now[3], data))
                return dict(zip(arrow.names, (now[0], pos, now[1], now[2], len(text), hashlib.sha256(data).hexdigest(), [t for t in terms(now[3]) if t in index], [t for t in terms(data) if t in index], *bare), strict=True))

            for part in steps(batches):
                rows = []
                for now, after in _followed(part, before, ("doc_id", "text")):
                    if after is None:
                        before = now
                        continue
                    rows.append(row(now, after))
                    if after[1]:
                        rows.append(row(after, None))
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        found.append(stored(ordered.mapInArrow(run, schema), f"kept{block}"))
        sent.destroy()
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    # positions in a bucket are those of its sorted rows, the same in every pass, but for equal rows, which are alike
    whole = every.groupBy("bucket", "pos").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("ahead", "doc_id", "n_chars", "sha", "bare_own", "bare_other")), *(F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("own", "other")))
    whole = whole.repartition("bucket").sortWithinPartitions("bucket", "pos")

    def mark(batches):
        before = None

        def prints(row):
            return tuple(hashed(row[i]) if row[i] else tuple(row[i + 2].split("-")) for i in (5, 6))

        for part in batches:
            rows = []
            for now, after in _followed(part, before, ("doc_id", "n_chars", "sha", "own", "other", "bare_own", "bare_other")):
                if after is None:
                    before = now
                    continue
                own, other = prints(now)
                rows.append(_row(now[2], now[3], now[4], own, other, prints(after)[0]))
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return whole.mapInArrow(mark, _SCHEMA)


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, limit: int = BLOCK_BYTES, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``.

    The edited text has its last half (floor of its code points) replaced by as many first ones, or all, of the next
    document by descending id; the first one follows the last.
    """
    words, n = lexicon(docs, low, high, limit)
    ordered = neighbourly(docs, bucket).repartition("bucket").sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), "text")
    if n == 1:
        return _at_once(ordered, [bytes(r.term) for r in words.select("term").collect()])
    return _by_blocks(ordered, words, n)
