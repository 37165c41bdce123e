"""Benchmark decontamination with training suffix arrays.

Every Arrow batch of documents is one shard. A shard's suffix array holds, in word order, the suffixes at which a
benchmark window could begin; each test suffix is found in it by binary search, which gives its longest verbatim match
and all its places. Documents stay where they are: the only thing that travels is the test set, in blocks of bounded size,
one after another: the driver and each worker hold one block, and what a block finds is kept with the documents in the
shared folder before the next one is fetched.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A window is WINDOW consecutive words of an item;
an item of fewer words, but not none, is one window.

Defined cases: null or empty text has no words, no hits, and isn't contaminated; a null item id counts as the string
"null"; items that repeat an id count once; repeated document rows each get a row; an empty benchmark hits nothing.
Columns of the inputs other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, steps, stored, texts

WINDOW = 13
#: Test text that one pass over the documents takes: what is sent to each executor has this bound.
BLOCK_BYTES = 2 << 20
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text; all their separators are ASCII, so bytes can be split without decoding."""
    return text.translate(_WORD).split()


class TestSet:
    """The windows of one block of the benchmark as numbers, and what finds them in a shard."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        self.items, self.owner = [], []
        for name, text in items:
            if w := words(text):
                self.items.append(np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.int64))
                self.owner.append(at[name])
        self.depth = max((len(x) for x in self.items), default=0)
        #: item, start, words of each window
        size = np.array([len(x) for x in self.items], np.int64)
        each = np.maximum(1, size - window + 1)
        self.item = np.repeat(np.arange(len(size)), each)
        self.start = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        self.n = np.minimum(window, size)[self.item]
        flat = np.concatenate([*self.items, np.zeros(window, np.int64)])
        at = (np.cumsum(size) - size)[self.item] + self.start
        inside = np.arange(window) < self.n[:, None]
        words_of = flat[at[:, None] + np.arange(window)]
        key = lambda fill: np.ascontiguousarray(np.where(inside, words_of, fill).astype(">u4")).view(f"S{4 * window}").ravel()
        self.low, self.high = key(0), key(0xFFFFFFFF)
        first = words_of[:, 0] << 32 | np.where(self.n > 1, words_of[:, 1], 0)
        self.pairs = np.unique(np.where(self.n > 1, first, 0))
        self.shortest = int(self.n.min()) if len(self.n) else window
        self.singles = np.unique(words_of[self.n == 1, 0])
        self.short_pairs = np.unique(np.append(first[(self.n < window) & (self.n > 1)], 0))

    def starts(self, w: np.ndarray) -> np.ndarray:
        """Where a window could begin: a first pair of words that begins a window, and enough known words after it."""
        if not len(w):
            return np.zeros(0, np.int64)
        cut = np.flatnonzero(w == 0)
        after = np.append(cut, len(w))
        known = after[np.searchsorted(cut, np.arange(len(w)), "left")] - np.arange(len(w))  # known words from here on
        pair = w.copy() << 32
        pair[:-1] |= w[1:]
        ok = (known >= self.window) & np.isin(pair, self.pairs)
        if self.shortest < self.window:
            ok |= (known >= 2) & np.isin(pair, self.short_pairs) | np.isin(w, self.singles)
        return np.flatnonzero(ok & (w > 0))

    def find(self, w: np.ndarray, matches: bool = False):
        """(start, words, item) of every window's occurrences in a shard; with ``matches``, of each test suffix's longest match of at least a window."""
        starts = self.starts(w)
        if not len(starts):
            return []
        padded = np.append(w, np.zeros(self.depth + self.window, np.int64))
        # the suffix array: each start's next words, most significant byte first, so that byte order is word order
        keys = np.ascontiguousarray(np.stack([padded[starts + d] for d in range(self.window)], 1).astype(">u4")).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        keys, order = keys[order], starts[order]
        lows, highs = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        found = []
        for i in np.flatnonzero(lows < highs):
            k, s, n, lo, hi = int(self.item[i]), int(self.start[i]), int(self.n[i]), lows[i], highs[i]
            x = self.items[k]
            if lo < hi:
                at = order[lo:hi]
                if matches:
                    length, live = np.full(len(at), n), np.arange(len(at))
                    for d in range(n, len(x) - s):
                        live = live[padded[at[live] + d] == x[s + d]]
                        if not len(live):
                            break
                        length[live] += 1
                    found.append((at, length, k, s))
                else:
                    found.append((at, n, self.owner[k], s))
        return found


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The items in blocks of at most ``limit`` bytes (or one item), fetched block by block; and whether a block is the last."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row.text) > limit:
            yield block, False
            block, size = [], 0
        block.append((row.item, bytes(row.text)))
        size += len(row.text)
    yield block, True


def _shard(test: TestSet, docs: list[bytes]):
    """Of a shard: the words of each document, where they begin, the hit flags, and the items found in each document."""
    split = [words(x) for x in docs]
    begin = np.cumsum([0] + [len(x) + 1 for x in split])  # one unknown word between documents
    hit, items = np.zeros(begin[-1] + 1, np.int64), [set() for _ in docs]
    w, get = np.zeros(begin[-1], np.int64), test.ids.get
    for b, x in zip(begin, split, strict=False):
        w[b : b + len(x)] = [get(y, 0) for y in x]
    # a test suffix's longest match covers the windows that lie in it
    for at, n, k, _ in test.find(w, matches=True):
        np.add.at(hit, at, 1)
        np.add.at(hit, at + n, -1)
        for d in np.unique(np.searchsorted(begin, at, "right") - 1):
            items[d].add(test.names[test.owner[k]])
    return split, begin, np.cumsum(hit) > 0, items


_FOUND = {"__words": pa.int64(), "__spans": pa.list_(pa.int64()), "__items": pa.list_(pa.string())}
_TYPES = "__words long, __spans array<long>, __items array<string>"


def _spans(test: TestSet, texts: list[bytes]) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Of each text: its number of words, the runs of hit words, and the items found."""
    split, begin, hit, items = _shard(test, texts)
    spans = []
    for b, x in zip(begin, split, strict=False):
        flags = np.zeros(len(x) + 2, np.int8)
        flags[1:-1] = hit[b : b + len(x)]
        spans.append(np.flatnonzero(np.diff(flags)).tolist())
    return [len(x) for x in split], spans, [sorted(x) for x in items]


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """``docs`` with __words, __spans (first and end of each run of hit words, one after the other) and __items.

    A benchmark of one block needs one pass and no shuffle. With several, the rows are stored once under numbers, each block's pass
    stores what it found in the rows where it found something, and what all blocks found is joined to the rows at the end.
    """
    context, base, stores = docs.sparkSession.sparkContext, None, []
    for block, last in _blocks(benchmark, block_bytes):
        sent = context.broadcast(TestSet(block, window))

        def run(batches, sent=sent, every=not stores, whole=last and not stores):
            for part in steps(batches):
                columns = _spans(sent.value, [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()])
                new = [pa.array(c, t) for c, t in zip(columns, _FOUND.values(), strict=True)]
                names = part.schema.names if whole else ["__row"]
                out = pa.RecordBatch.from_arrays([part.column(n) for n in names] + new, names=[*names, *_FOUND])
                yield out if every else out.filter(pa.array([bool(x) for x in columns[1]], pa.bool_()))

        if last and base is None:
            return docs.mapInArrow(lean(run), docs.selectExpr("*", "0L AS __words", "CAST(array() AS array<bigint>) AS __spans", "CAST(array() AS array<string>) AS __items").schema)
        if base is None:
            base = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        stores.append(stored(base.select("__row", "text").mapInArrow(lean(run), f"__row long, {_TYPES}"), "spans"))
        sent.destroy()
    pieces = reduce(DataFrame.union, stores)
    gathered = pieces.groupBy("__row").agg(F.max("__words").alias("__words"), F.collect_list("__spans").alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))

    def joined(batches):
        for part in batches:
            spans = [_union(x) for x in part.column("__spans").to_pylist()]
            yield part.set_column(part.schema.get_field_index("__spans"), "__spans", pa.array(spans, _FOUND["__spans"]))

    return base.join(gathered.mapInArrow(joined, f"__row long, {_TYPES}"), "__row").drop("__row")


def _union(spans: list[list[int]]) -> list[int]:
    """The runs that several lists of runs cover together."""
    out: list[int] = []
    for first, end in sorted((x[i], x[i + 1]) for x in spans for i in range(0, len(x), 2)):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def _hit() -> Column:
    """The summed lengths of the spans."""
    return F.aggregate("__spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda s, x: F.struct((s["sum"] + s["sign"] * x).alias("sum"), (-s["sign"]).alias("sign")), lambda s: s["sum"])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256, contaminated of every row of ``docs``."""
    found = _found(texts(docs), benchmark, window, block_bytes).select("doc_id", "__words", _hit().alias("n_hit"), "__items")
    return found.select("doc_id", F.col("__words").alias("n_words"), "n_hit", F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("__words"))).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, item_start, doc_start, n_words: the longest verbatim match of every test suffix at each of its places, in words, of at least a window."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id string, item_start long, doc_start long, n_words long")
    for block, _ in _blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(TestSet(block, window))
        out = out.union(stored(_longest(docs, sent), "matches"))
        sent.destroy()
    return out


def _longest(docs: DataFrame, sent) -> DataFrame:
    def run(batches):
        for part in steps(batches):
            ids, split = part.column("doc_id").to_pylist(), [words(x) for x in part.column("text").to_pylist()]
            begin = np.cumsum([0] + [len(x) + 1 for x in split])
            rows = []
            for t in (sent.value,):
                w = np.zeros(begin[-1], np.int64)
                for b, x in zip(begin, split, strict=False):
                    w[b : b + len(x)] = [t.ids.get(y, 0) for y in x]
                for at, length, k, s in t.find(w, matches=True):
                    d = np.searchsorted(begin, at, "right") - 1
                    rows += [(ids[i], t.names[t.owner[k]], s, int(a - begin[i]), int(n)) for i, a, n in zip(d, at, length, strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "item_id", "item_start", "doc_start", "n_words"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())]))

    return texts(docs).mapInArrow(lean(run), "doc_id long, item_id string, item_start long, doc_start long, n_words long")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated rows; every other row, and every column, is as it was."""
    return _found(docs, benchmark, window, block_bytes).withColumn("n_hit_", _hit()).where((F.col("n_hit_") == 0) | (20 * F.col("n_hit_") < F.col("__words"))).select(docs.columns)
