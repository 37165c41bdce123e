"""Order books from messages, as joins and windows: epochs between snapshots, samples, levels as of a sample, top levels.

Order is that of ``seq`` (any orderable column), never of time; rows that are out of time order are counted and applied.
``key`` names the book: a symbol, or the file of an archive that holds one day of it. A book with a long history is cut by
``part``, a column that never falls as seq rises (a day): windows run within a part, and what earlier parts leave behind
(snapshots so far, the latest slot, the last time) comes from a table of one row a part. Without it a book is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _within(key: str, part: Column | None):
    return Window.partitionBy(key, *([] if part is None else ["_part"])).orderBy("seq")


def _carried(messages: DataFrame, key: str, part: Column | None, figure: Column, before: Column, name: str) -> DataFrame:
    """``messages`` with _part and ``name``: what the parts before a row's own leave behind. ``figure`` sums up a part; ``before`` is a window expression over ``_figure``."""
    if part is None:
        return messages.withColumn(name, F.lit(None).cast("long"))
    cut = messages.withColumn("_part", part)
    parts = cut.groupBy(key, "_part").agg(figure.cast("long").alias("_figure")).withColumn(name, before).drop("_figure")  # a row a part
    return cut.join(parts, [key, "_part"])


def _earlier(key: str):
    return Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def levels(messages: DataFrame) -> DataFrame:
    """side, price, size, pos of nested messages (arrays ``asks`` and ``bids`` of [price, size, ...] strings). Levels of fewer than two fields are skipped."""
    sides = F.array(F.struct(F.lit("ask").alias("side"), F.col("asks").alias("of")), F.struct(F.lit("bid").alias("side"), F.col("bids").alias("of")))
    rest = [c for c in messages.columns if c not in ("asks", "bids")]
    one = messages.select(*rest, F.explode(sides).alias("_s")).select(*rest, "_s.side", F.posexplode("_s.of").alias("pos", "_l")).where(F.size("_l") >= 2)
    return one.select(*rest, "side", "pos", F.col("_l")[0].cast("double").alias("price"), F.col("_l")[1].cast("double").alias("size"))


def epochs(messages: DataFrame, part: Column | None = None, key: str = "symbol") -> DataFrame:
    """epoch: the number of snapshots so far; a snapshot clears the book."""
    opens = (F.col("action") == "snapshot").cast("long")
    cut = _carried(messages, key, part, F.sum(opens), F.sum("_figure").over(_earlier(key)), "_before")
    here = F.sum(opens).over(_within(key, part).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("epoch", here + F.coalesce("_before", F.lit(0))).drop("_before", "_part")


def samples(messages: DataFrame, seconds: int, part: Column | None = None, key: str = "symbol") -> DataFrame:
    """The first known message, and each first one that reaches an interval later than all before it."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    known = messages.where(F.col("action").isin("snapshot", "update")).withColumn("_slot", slot)
    cut = _carried(known, key, part, F.max("_slot"), F.max("_figure").over(_earlier(key)), "_before")
    here = F.max("_slot").over(_within(key, part).rowsBetween(Window.unboundedPreceding, -1))
    # only a message that opens a slot can be sampled, so the running maximum need not be exact in between
    return cut.withColumn("_before", F.greatest(here, "_before")).where(F.col("_before").isNull() | (F.col("_slot") > F.col("_before"))).drop("_slot", "_before", "_part")


def opened(level_rows: DataFrame, sampled: DataFrame, part: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """``level_rows`` and ``sampled`` with an epoch of their own in each part, every part's rows behind the levels that it opens with.

    A segmented prefix scan: a part sums up to its last size at each price; a size lives on into later parts, up to the first one that
    writes its price again or has a snapshot. No step puts more than a part's rows in one place: carries are sorted by
    price, one row a part, and a part opens with as many rows as its book has levels.
    """
    last_epoch, first_epoch = F.max("epoch").alias("_last"), F.min("epoch").alias("_first")
    both = level_rows.withColumn("_part", part).select(key, "_part", "epoch").unionByName(sampled.withColumn("_part", part).select(key, "_part", "epoch"))
    parts = both.groupBy(key, "_part").agg(last_epoch, first_epoch)  # a row a part
    in_order = Window.partitionBy(key).orderBy("_part")
    parts = parts.withColumn("_at", F.row_number().over(in_order)).withColumn("_opens", F.lag("_last").over(in_order))
    numbered = lambda df: df.withColumn("_part", part).join(parts.select(key, "_part", "_at", "_last"), [key, "_part"]).drop("_part")
    rows, marks = numbered(level_rows), numbered(sampled)
    written = rows.groupBy(key, "_at", "_last", "side", "price").agg(F.max_by(F.struct("epoch", "size"), F.struct("seq", "pos")).alias("_w"))
    again = F.lead("_at").over(Window.partitionBy(key, "side", "price").orderBy("_at"))
    left = written.withColumn("_again", again).where((F.col("_w.epoch") == F.col("_last")) & (F.col("_w.size") != 0))
    # the parts that open in an epoch: the last of them is that with the next snapshot, or the end
    upto = parts.where("_opens IS NOT NULL").groupBy(key, F.col("_opens").alias("_last")).agg(F.max("_at").alias("_upto"))
    carried = left.join(upto, [key, "_last"]).withColumn("_to", F.least("_upto", "_again")).where(F.col("_to") > F.col("_at"))
    opening = carried.select(key, F.explode(F.sequence(F.col("_at") + 1, F.col("_to"))).alias("_at"), F.col("_last").alias("epoch"), "side", "price", F.col("_w.size").alias("size"))
    own = F.struct("_at", "epoch").alias("epoch")
    rest = ["seq", "side", "price", "size", "pos"]
    # a null seq comes before every other
    first = opening.select(key, own, F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), "side", "price", "size", F.lit(0).alias("pos"))
    return rows.select(key, own, *rest).unionByName(first), marks.withColumn("epoch", F.struct("_at", "epoch")).drop("_at", "_last")


def as_of(level_rows: DataFrame, sampled: DataFrame, key: str = "symbol", part: Column | None = None) -> DataFrame:
    """key, sample_ts, side, price, size: each sample's book.

    Within an epoch one sort gives every level row the first sample that sees it; the row lives until the next row of its
    price, so it is repeated for its own samples only, and the work is that of the result. With ``part``, a long epoch is cut
    into its parts, each of which opens with the levels that the one before leaves.
    """
    level_rows = level_rows.where(F.col("action").isin("snapshot", "update"))
    if "pos" not in level_rows.columns:
        level_rows = level_rows.withColumn("pos", F.lit(0))
    if part is not None:
        level_rows, sampled = opened(level_rows, sampled, part, key)
    rows = level_rows.select(key, "epoch", "seq", "side", "price", "size", "pos", F.lit(0).alias("_is"))
    marks = rows.unionByName(sampled.select(key, "epoch", "seq", F.col("ts").alias("sample_ts"), F.lit(1).alias("_is")), allowMissingColumns=True)
    epoch = Window.partitionBy(key, "epoch")
    placed = marks.withColumn("_no", F.sum("_is").over(epoch.orderBy("seq", "_is").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_is").over(epoch))
    at = placed.where("_is = 1").select(key, "epoch", (F.col("_no") - 1).alias("_no"), "sample_ts")
    price = Window.partitionBy(key, "epoch", "side", "price").orderBy("seq", "pos")
    lived = placed.where("_is = 0").withColumn("_to", F.coalesce(F.lead("_no").over(price), F.col("_all"))).where((F.col("size") != 0) & (F.col("_no") < F.col("_to")))
    each = lived.select(key, "epoch", "side", "price", "size", F.explode(F.sequence(F.col("_no"), F.col("_to") - 1)).alias("_no"))
    return each.join(at, [key, "epoch", "_no"]).select(key, "sample_ts", "side", "price", "size")


def top(book: DataFrame, sampled: DataFrame, depths: tuple[int, ...] = (1, 5, 10), key: str = "symbol") -> DataFrame:
    """Best prices, spread in basis points, quote depth of either side and both and imbalance over the best levels, empty and crossed flags of every sample."""
    rank = F.row_number().over(Window.partitionBy(key, "sample_ts", "side").orderBy(F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))))
    ranked = book.withColumn("_rank", rank)
    ask, bid = F.col("side") == "ask", F.col("side") == "bid"
    quote = F.col("price") * F.col("size")
    sums = [F.sum(F.when((F.col("_rank") <= k) & (ask if s == "ask" else bid), quote)).alias(f"{s}_{k}") for k in depths for s in ("ask", "bid")]
    got = ranked.groupBy(key, "sample_ts").agg(F.min(F.when(ask, F.col("price"))).alias("best_ask"), F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.count_if(ask).alias("ask_levels"), F.count_if(bid).alias("bid_levels"), *sums)
    out = sampled.select(key, F.col("ts").alias("sample_ts")).join(got, [key, "sample_ts"], "left")
    empty = F.coalesce("ask_levels", F.lit(0)) * F.coalesce("bid_levels", F.lit(0)) == 0
    mid = (F.col("best_ask") + F.col("best_bid")) / 2
    c = {"empty": empty, "crossed": ~empty & F.coalesce(F.col("best_bid") >= F.col("best_ask"), F.lit(False)), "spread_bps": F.when(~empty, F.try_divide(F.col("best_ask") - F.col("best_bid"), mid) * 10_000)}
    for k in depths:
        a, b = F.col(f"ask_{k}"), F.col(f"bid_{k}")
        c |= {f"ask_depth_{k}": F.when(~empty, a), f"bid_depth_{k}": F.when(~empty, b), f"depth_{k}": F.when(~empty, a + b), f"imbalance_{k}": F.when(~empty, F.try_divide(b - a, a + b))}
    return out.withColumns(c).select(key, "sample_ts", "empty", "crossed", "best_bid", "best_ask", "ask_levels", "bid_levels", *[x for x in c if x not in ("empty", "crossed")])


def liquidity(minutes: DataFrame, interval: str) -> DataFrame:
    """Exact medians of spread, depth and imbalance over valid samples, by bucket."""
    ok = minutes.where(~F.col("empty") & ~F.col("crossed"))
    return ok.groupBy(F.window("sample_ts", interval).start.alias("bucket_start"), "symbol").agg(F.median("spread_bps").alias("spread_bps"), F.median("depth_10").alias("top10_depth_quote"), F.median("imbalance_10").alias("book_imbalance_10"), F.median(F.abs("imbalance_10")).alias("abs_book_imbalance_10"), F.count("*").alias("observed_minutes"))


def zero_levels() -> Column:
    """How many levels of a nested message are deletions."""
    zeros = lambda side: F.size(F.filter(F.coalesce(side, F.array().cast("array<array<string>>")), lambda l: (F.size(l) >= 2) & (l[1].cast("double") == 0)))  # noqa: E731, E741
    return zeros(F.col("asks")) + zeros(F.col("bids"))


def audit(messages: DataFrame, part: Column | None = None, key: str = "symbol", zeros: Column | None = None) -> DataFrame:
    """Counters, gaps (in ms) and bounds of each book's messages, in the order of seq. ``zeros``: deletions in a message (by default its one level's)."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    known = F.col("action").isin("snapshot", "update")
    deleted = (F.col("size") == 0).cast("int") if zeros is None else zeros
    cut = _carried(messages.withColumn("_ms", ms), key, part, F.max_by("_ms", "seq"), F.lag("_figure").over(Window.partitionBy(key).orderBy("_part")), "_before")
    gap = F.col("_ms") - F.coalesce(F.lag("_ms").over(_within(key, part)), "_before")
    return (
        cut.withColumn("_gap", gap)
        .groupBy(key)
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("action") == "snapshot").alias("snapshots"),
            F.count_if(F.col("action") == "update").alias("updates"),
            F.count_if(~known).alias("unknown_actions"),
            F.count_if(F.col("_gap") < 0).alias("out_of_order_rows"),
            F.count_if(F.col("_gap") == 0).alias("duplicate_timestamps"),
            F.coalesce(F.sum(F.when(known, deleted)), F.lit(0)).cast("long").alias("zero_size_deletions"),
            *(F.count_if(F.col("_gap") > k).alias(f"gaps_over_{n}") for k, n in ((100, "100ms"), (1000, "1s"), (5000, "5s"))),
            F.coalesce(F.max(F.when(F.col("_gap") > 0, F.col("_gap"))), F.lit(0)).cast("long").alias("max_gap_ms"),
            F.min_by("ts", "seq").alias("first_timestamp"),
            F.max_by("ts", "seq").alias("last_timestamp"),
        )
    )


#: Lines of an archive that are one part of its book.
PART = 100_000


def archive_minutes(messages: DataFrame, seconds: int = 60, lines: int = PART) -> DataFrame:
    """The sampled books of archives: ``messages`` as read from them, each file a book of its own, in parts of so many lines."""
    part = F.floor(F.col("seq") / lines)
    good = epochs(messages.where("NOT parse_error"), part, "file")
    s = samples(good, seconds, part, "file")
    return top(as_of(levels(good), s, "file", part), s, key="file")


def archive_days(messages: DataFrame, jobs: DataFrame, minutes: DataFrame, part_lines: int = PART) -> DataFrame:
    """A row for each file of ``jobs`` (file, symbol, date): the audit of its messages, how late it starts and how early it ends, the first snapshot's levels, its samples.

    Lines that can't be read count as rows and as parse_errors, and change nothing else. A file without a readable line has
    nulls, which fail a day's quality by name.
    """
    good = messages.where("NOT parse_error")
    lines = messages.join(F.broadcast(jobs.select("file", F.col("symbol").alias("expected"))), "file").groupBy("file").agg(F.count("*").alias("rows"), F.count_if("parse_error").alias("parse_errors"), F.count_if(~F.col("parse_error") & ~F.col("symbol").eqNullSafe(F.col("expected"))).alias("symbol_mismatches"))
    first = good.where("action = 'snapshot'").groupBy("file").agg(F.min("seq").alias("seq"))  # a row a file
    opened = levels(good.join(F.broadcast(first), ["file", "seq"])).groupBy("file", "side", "price").agg(F.max_by("size", "pos").alias("size")).where("size <> 0")
    depth = first.select("file").join(opened.groupBy("file").agg(*(F.count_if(F.col("side") == s).alias(f"initial_{s}_levels") for s in ("ask", "bid"))), "file", "left").fillna(0)
    sampled = minutes.groupBy("file").agg(F.count("*").alias("sample_count"), F.count_if("crossed").alias("sampled_crossed_books"), F.count_if("empty").alias("sampled_empty_books"))
    out = jobs.select("file", "symbol", "date")
    for table in (lines, audit(good, F.floor(F.col("seq") / part_lines), "file", zero_levels()).drop("rows"), depth, sampled):
        out = out.join(table, "file", "left")
    at = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    day = F.unix_millis(F.col("date").cast("date").cast("timestamp_ntz").cast("timestamp"))
    return out.withColumns({"start_delay_ms": at("first_timestamp") - day, "end_early_ms": day + 86_400_000 - at("last_timestamp"), "observed_span_seconds": (at("last_timestamp") - at("first_timestamp")) / 1000})
