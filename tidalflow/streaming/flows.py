"""Structured Streaming forms of the bucket and book operators. They give what the batch operators give on the same rows.

Late data: rows later than the watermark are dropped by Spark, and only there; the batch operators drop nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def read(spark: SparkSession, path: str, schema, files_a_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def trade_buckets(trades: DataFrame, interval: str, late: str = "0 seconds") -> DataFrame:
    """Tumbling buckets of a stream of trades (ts a timestamp), emitted when the watermark has passed them."""
    quote, order, buy = F.col("price") * F.col("size"), F.struct("ts", "trade_id"), F.col("side") == "buy"
    sums = trades.withWatermark("ts", late).groupBy(F.window("ts", interval), "symbol").agg(
        F.min_by("price", order).alias("first_price"),
        F.max_by("price", order).alias("last_price"),
        F.count("*").alias("transaction_count"),
        F.sum(quote).alias("total_quote_quantity"),
        F.sum(F.when(buy, quote).otherwise(-quote)).alias("signed_quote_quantity"),
    )
    return sums.select(F.col("window.start").alias("bucket_start"), "symbol", "transaction_count", "total_quote_quantity", (F.try_divide("last_price", "first_price") - 1).alias("bucket_return"), F.try_divide("signed_quote_quantity", "total_quote_quantity").alias("aggressor_imbalance"))


DEPTHS = (1, 5, 10)
COUNTERS = ["rows", "snapshots", "updates", "unknown_actions", "out_of_order_rows", "duplicate_timestamps", "zero_size_deletions", "gaps_over_100ms", "gaps_over_1s", "gaps_over_5s", "max_gap_ms", "late_messages"]


class Ladder:
    """One side of a book: prices best first, and their sizes. ``way`` is 1 for asks, -1 for bids."""

    def __init__(self, way: int, prices: np.ndarray | None = None, sizes: np.ndarray | None = None):
        self.way = way
        self.keys = np.empty(0) if prices is None else way * prices
        self.sizes = np.empty(0) if sizes is None else sizes
        order = np.argsort(self.keys)
        self.keys, self.sizes = self.keys[order], self.sizes[order]

    @property
    def prices(self) -> np.ndarray:
        return self.way * self.keys

    def apply(self, prices: np.ndarray, sizes: np.ndarray) -> None:
        """Sets levels, in the order given; a size of 0 removes one."""
        keys, last = np.unique((self.way * prices)[::-1], return_index=True)
        sizes = sizes[::-1][last]
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        self.sizes[at[known]] = sizes[known]
        new = ~known & (sizes != 0)
        self.keys, self.sizes = np.insert(self.keys, at[new], keys[new]), np.insert(self.sizes, at[new], sizes[new])
        if (sizes[known] == 0).any():
            stays = self.sizes != 0
            self.keys, self.sizes = self.keys[stays], self.sizes[stays]

    def quote(self, k: int) -> float:
        """The quote depth of the best ``k`` levels."""
        return float((self.prices[:k] * self.sizes[:k]).sum())


class Books(StatefulProcessor):
    """A symbol's book as state: a map from (side, price) to size, of which a batch writes only what it changed, and a row of counters.

    A batch's rows are worked on as arrays, from sample to sample: what a stretch sets last at each price is merged into the sorted
    ladders, whose first levels are the best. Rows with one seq are one message.
    """

    def __init__(self, seconds: int, depths: tuple[int, ...], audit: bool):
        self.seconds, self.depths, self.audit = seconds, depths, audit

    def init(self, handle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.past = handle.getValueState("past", ", ".join(f"{c} long" for c in (*COUNTERS, "last_ms", "slot", "last_seq")))

    def close(self) -> None:
        pass

    def _book(self) -> dict[str, Ladder]:
        found = [(side, price, size) for (side, price), (size,) in self.levels.iterator()] if self.levels.exists() else []
        of = lambda name: np.array([x[1:] for x in found if x[0] == name], float).reshape(-1, 2).T
        return {"ask": Ladder(1, *of("ask")), "bid": Ladder(-1, *of("bid"))}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        m = pd.concat(list(rows)).sort_values(["seq", "pos"], kind="stable", ignore_index=True)
        seq, first = np.unique(m["seq"].to_numpy(), return_index=True)
        ends = np.append(first[1:], len(m))
        ms, action = m["ms"].to_numpy(np.int64)[first], m["action"].to_numpy(object)[first]
        counts, (last_ms, slot, last_seq) = dict.fromkeys(COUNTERS, 0), (None, None, None)
        if self.past.exists():
            *had, last_ms, slot, last_seq = self.past.get()
            counts = dict(zip(COUNTERS, had, strict=True))
        opens, known = action == "snapshot", (action == "snapshot") | (action == "update")
        self._count(counts, m, ms, opens, known, ends, last_ms, seq, last_seq)
        slots = np.where(known, ms // (1000 * self.seconds), np.iinfo(np.int64).min)
        before = np.maximum.accumulate(np.append(np.iinfo(np.int64).min if slot is None else slot, slots))
        sampled = np.flatnonzero(known & (slots > before[:-1]))
        books, cleared, touched, out, at = self._book(), False, {"ask": [], "bid": []}, [], 0
        side, price, size = m["side"].to_numpy(object), m["price"].to_numpy(float), m["size"].to_numpy(float)
        valid = np.repeat(known, ends - first) & ~np.isnan(price) & ~np.isnan(size)
        for stop in [*(sampled + 1).tolist(), len(seq)]:
            if at == stop:
                continue
            reset = np.flatnonzero(opens[at:stop])
            begin = at + (int(reset[-1]) if len(reset) else 0)
            if len(reset):
                books, cleared = {"ask": Ladder(1), "bid": Ladder(-1)}, True
            part = slice(first[begin], ends[stop - 1])
            for name, ladder in books.items():
                here = valid[part] & (side[part] == name)
                ladder.apply(price[part][here], size[part][here])
                touched[name].append(price[part][here])
            if stop <= len(seq) and stop - 1 in sampled:
                out.append((key[0], int(ms[stop - 1]), *self._figures(books)))
            at = stop
        self._keep(books, cleared, touched)
        # a batch without a known message leaves the slot as it was
        reached = int(before[-1]) if before[-1] > np.iinfo(np.int64).min else None
        self.past.update((*counts.values(), int(ms[-1]), reached, int(seq[-1]) if last_seq is None else max(int(seq[-1]), last_seq)))
        if self.audit:
            yield pd.DataFrame([(key[0], *counts.values())], columns=["symbol", *COUNTERS])
        elif out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in sample_schema(self.depths).split(", ")])

    def _count(self, counts, m, ms, opens, known, ends, last_ms, seq, last_seq) -> None:
        gap = np.diff(ms) if last_ms is None else np.diff(np.append(last_ms, ms))
        zeros = (m["size"].to_numpy(float) == 0) & np.repeat(known, np.diff(np.append(0, ends)))
        more = [len(ms), opens.sum(), (known & ~opens).sum(), (~known).sum(), (gap < 0).sum(), (gap == 0).sum(), zeros.sum(), (gap > 100).sum(), (gap > 1000).sum(), (gap > 5000).sum(), 0, 0 if last_seq is None else (seq <= last_seq).sum()]
        for name, n in zip(COUNTERS, more, strict=True):
            counts[name] += int(n)
        counts["max_gap_ms"] = max(counts["max_gap_ms"], int(gap.max(initial=0)))

    def _figures(self, books: dict[str, Ladder]) -> tuple:
        asks, bids = books["ask"], books["bid"]
        best_ask, best_bid = (float(x.prices[0]) if len(x.keys) else None for x in (asks, bids))
        empty = not len(asks.keys) or not len(bids.keys)
        mid = None if empty else (best_ask + best_bid) / 2
        out = [empty, not empty and best_bid >= best_ask, best_bid, best_ask, len(asks.keys), len(bids.keys), None if empty or not mid else (best_ask - best_bid) / mid * 10_000]
        for k in self.depths:
            a, b = asks.quote(k), bids.quote(k)
            out += [None] * 4 if empty else [a, b, a + b, (b - a) / (a + b) if a + b else None]
        return tuple(out)

    def _keep(self, books: dict[str, Ladder], cleared: bool, touched: dict[str, list]) -> None:
        """Writes the levels that the batch changed."""
        if cleared:
            self.levels.clear()
        for name, ladder in books.items():
            sizes = dict(zip(ladder.prices.tolist(), ladder.sizes.tolist(), strict=True))
            changed = sizes if cleared else np.unique(np.concatenate(touched[name])).tolist() if touched[name] else []
            for price in changed:
                if price in sizes:
                    self.levels.updateValue((name, price), (sizes[price],))
                elif not cleared:
                    self.levels.removeKey((name, price))


def sample_schema(depths: tuple[int, ...]) -> str:
    more = [f"{c}_{k} double" for k in depths for c in ("ask_depth", "bid_depth", "depth", "imbalance")]
    return ", ".join(["symbol string", "sample_ms long", "empty boolean", "crossed boolean", "best_bid double", "best_ask double", "ask_levels long", "bid_levels long", "spread_bps double", *more])


def _levels(column: str, side: str):
    """Structs of side, price and size of a nested message's levels; those of fewer than two fields are left out."""
    given = F.coalesce(F.col(column), F.array().cast("array<array<string>>"))
    return F.transform(F.filter(given, lambda x: F.size(x) >= 2), lambda x: F.struct(F.lit(side).alias("side"), x[0].cast("double").alias("price"), x[1].cast("double").alias("size")))


def _stated(messages: DataFrame, processor: Books, schema: str) -> DataFrame:
    spark = messages.sparkSession
    # this kind of state lives in RocksDB only, whatever the session's other streams use
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if "asks" in messages.columns:
        ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
        sides = F.concat(_levels("asks", "ask"), _levels("bids", "bid"))
        # a message without levels stays: a snapshot clears the book even so
        messages = messages.select("symbol", "seq", ms.alias("ms"), "action", F.posexplode_outer(sides).alias("pos", "_l")).select("symbol", "seq", "ms", "action", F.coalesce("pos", F.lit(0)).alias("pos"), "_l.side", "_l.price", "_l.size")
    elif "pos" not in messages.columns:
        messages = messages.withColumn("pos", F.lit(0))
    rows = messages.select("symbol", "seq", "ms", "action", "pos", "side", "price", "size")
    return rows.groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", "None")


def book_samples(messages: DataFrame, seconds: int = 60, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """What ``book.top`` gives of the sampled books, from books kept as state by symbol.

    ``messages`` are nested (symbol, seq, ts, action, asks, bids) or a row a level (symbol, seq, ms, action, side, price, size).
    Batches may be cut anywhere between messages. Within a batch order is that of seq; times that go back change nothing but the
    counters. A message that comes after a batch with a later seq is counted as late and applied when it comes.
    """
    return _stated(messages, Books(seconds, depths, False), sample_schema(depths))


def book_audit(messages: DataFrame) -> DataFrame:
    """The running counters of each symbol, a row for each batch that it has rows in: the row with the most ``rows`` is the latest."""
    return _stated(messages, Books(60, DEPTHS, True), "symbol string, " + ", ".join(f"{c} long" for c in COUNTERS))


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there into a table in memory; for tests and small back-fills."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
