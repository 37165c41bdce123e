"""Books kept as state equal the batch operators, wherever the stream is cut and whenever it is started again."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import as_messages, random_messages, replay
from tidalflow.operators import book
from tidalflow.streaming import flows

SHAPE = "symbol string, seq long, ts timestamp_ntz, action string, asks array<array<string>>, bids array<array<string>>"


def nested(n, seed, symbols="xy"):
    """Messages of several levels a side, some without any, with times that go back."""
    rng, rows, ms = np.random.default_rng(seed), [], 1_700_000_000_000
    side = lambda base: [[str(base + int(rng.integers(1, 12)) / 2), str(int(rng.choice([0, 1, 2]))), "0"] for _ in range(rng.integers(0, 4))] + ([["1"]] if rng.random() < 0.1 else [])
    for i in range(n):
        ms += int(rng.integers(-900, 9000))
        rows.append((symbols[int(rng.integers(len(symbols)))], i, ms, str(rng.choice(["update", "snapshot", "odd"], p=[0.9, 0.06, 0.04])), side(20), side(16)))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, seq long, ms long, action string, asks array<array<string>>, bids array<array<string>>")
    return df.select("symbol", "seq", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "action", "asks", "bids")


def streamed(spark, tmp, name, parts, make, stops=()):
    """Runs ``make`` over files that come one a batch; at ``stops`` the query ends and another takes it up from its checkpoint."""
    source, sink = f"{tmp}/{name}-in", f"{tmp}/{name}-out"
    for k, (lo, hi) in enumerate(zip([0, *stops], [*stops, len(parts)], strict=True)):
        for i in range(lo, hi):
            parts[i].coalesce(1).write.mode("append").parquet(f"{tmp}/{name}-{i}")
            os.makedirs(source, exist_ok=True)
            [f] = [x for x in os.listdir(f"{tmp}/{name}-{i}") if x.endswith(".parquet")]
            os.rename(f"{tmp}/{name}-{i}/{f}", f"{source}/{i:04d}.parquet")
            os.utime(f"{source}/{i:04d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
        stream = make(flows.read(spark, source, parts[0].schema, 1))
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{tmp}/{name}-check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert k >= 0 and q.exception() is None
    return spark.read.parquet(sink)


def cut(rows, places):
    return [rows[a:b] for a, b in zip([0, *places], [*places, len(rows)], strict=True) if a < b]


def rounded(rows, columns):
    return sorted(tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns) for r in rows)


@pytest.mark.parametrize("places, stops", [([], ()), ([1, 2, 40, 41, 90], (2, 4)), ([60], (1,))])
def test_samples_equal_the_batch_books(spark, tmp_path, places, stops):
    rows = nested(150, 11)
    m = frame(spark, rows)
    e = book.epochs(m)
    s = book.samples(e, 60)
    want = book.top(book.as_of(book.levels(e), s), s).withColumn("sample_ms", F.unix_millis(F.col("sample_ts").cast("timestamp"))).fillna(0, ["ask_levels", "bid_levels"])
    got = streamed(spark, tmp_path, "s", [frame(spark, x) for x in cut(rows, places)], lambda x: flows.book_samples(x, 60), stops)
    columns = [c for c in want.columns if c != "sample_ts"]
    assert rounded(got.collect(), columns) == rounded(want.collect(), columns) and got.count() > 8


def test_counters_equal_the_batch_audit(spark, tmp_path):
    rows = nested(120, 5)
    want = {r.symbol: r for r in book.audit(frame(spark, rows), zeros=book.zero_levels()).collect()}
    got = streamed(spark, tmp_path, "a", [frame(spark, x) for x in cut(rows, [1, 33, 34, 80])], flows.book_audit, (3,))
    last = {r.symbol: r for r in got.groupBy("symbol").agg(*(F.max(c).alias(c) for c in flows.COUNTERS)).collect()}
    assert set(last) == set(want) and any(r.out_of_order_rows for r in want.values())
    for s, r in last.items():
        assert {c: r[c] for c in flows.COUNTERS if c != "late_messages"} == {c: want[s][c] for c in flows.COUNTERS if c != "late_messages"}
        assert r.late_messages == 0


def test_rows_of_one_level_and_late_ones(spark, tmp_path):
    rows = random_messages(150, 8)
    m = as_messages(spark, rows).drop("ts")
    parts = [m.where(f"seq >= {a} AND seq < {b}") for a, b in ((0, 50), (50, 51), (51, 150))]
    got = streamed(spark, tmp_path, "r", parts, lambda x: flows.book_samples(x, 60), (1,)).orderBy("sample_ms").collect()
    assert [(r.sample_ms, r.ask_levels, r.bid_levels) for r in got] == [(t, len(a), len(b)) for t, a, b in sorted(replay(rows, 60))]
    late = streamed(spark, tmp_path, "l", [parts[1], parts[0]], flows.book_audit).groupBy().agg(F.max("rows").alias("rows"), F.max("late_messages").alias("late")).first()
    assert (late["rows"], late["late"]) == (51, 50)


def test_ladders():
    rng, ladder, plain = np.random.default_rng(1), flows.Ladder(-1), {}
    for _ in range(300):
        n = int(rng.integers(0, 9))
        p, s = rng.integers(1, 30, n).astype(float), rng.integers(0, 3, n).astype(float)
        ladder.apply(p, s)
        for a, b in zip(p.tolist(), s.tolist(), strict=True):
            plain.pop(a, None) if b == 0 else plain.__setitem__(a, b)
        assert list(zip(ladder.prices.tolist(), ladder.sizes.tolist(), strict=True)) == sorted(plain.items(), reverse=True)
        assert ladder.quote(3) == sum(a * b for a, b in sorted(plain.items(), reverse=True)[:3])
