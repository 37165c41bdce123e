"""Archives, the catalogue client, sinks, streams, the command line."""

import io
import json
import os
import tarfile
import zipfile
from urllib.error import HTTPError

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import as_messages, random_messages, replay, ticks

from tidalflow import cli
from tidalflow.operators import book, gates, panel
from tidalflow.plans import sinks
from tidalflow.sources import archives, calendar, catalog
from tidalflow.streaming import flows

HEAD = "instrument_name,trade_id,side,price,size,created_time\n"


def zipped(path, *members):
    with zipfile.ZipFile(path, "w") as z:
        for i, text in enumerate(members):
            z.writestr(f"m{i}.csv", text)
    return str(path)


def test_zipped_ticks(spark, tmp_path):
    p = zipped(tmp_path / "a.zip", HEAD + "B,1,buy,100,2,1744041600000\nB,2,SELL,100,1,1744041660000\nB,2,hold,1,1,1744041660001\n")
    t = archives.zipped_ticks(spark, p)
    assert t.count() == 3 and archives.readable_zip(p)
    got = archives.tick_problems(t).first()
    assert (got.wrong_side, got.not_increasing, got.non_finite, got.symbols) == (1, 1, 0, 1)
    assert panel.trade_buckets(archives.trades(t), "15 minutes").first().transaction_count == 3
    two = zipped(tmp_path / "b.zip", HEAD, HEAD)
    assert not archives.readable_zip(two)
    with pytest.raises(Exception, match="expected one CSV"):
        archives.zipped_ticks(spark, two).count()


def test_tarred_lines(spark, tmp_path):
    rows = [json.dumps({"instId": "A", "action": "snapshot", "ts": "1712534400005", "asks": [["0.501", "10", "2"], ["0.502", "20", "1"]], "bids": [["0.499", "10", "2"]]}), json.dumps({"instId": "A", "action": "update", "ts": "1712534460005", "asks": [["0.501", "0", "0"]], "bids": []}), "{broken", json.dumps({"instId": "A", "ts": "x", "action": "update"})]
    data = ("\n".join(rows) + "\n").encode()
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("book.data")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    m = archives.book_messages(archives.tarred_lines(spark, str(tmp_path / "b.tar.gz")))
    assert [r.parse_error for r in m.orderBy("seq").collect()] == [False, False, True, True]
    good = book.epochs(m.where("NOT parse_error"))
    lv = book.levels(good)
    s = book.samples(good, 60)
    top = book.top(book.as_of(lv, s), s).orderBy("sample_ts").collect()
    assert [(r.best_ask, r.best_bid) for r in top] == [(0.501, 0.499), (0.502, 0.499)]


def test_archive_day(spark, tmp_path):
    """A day of three messages: rows, samples and the day's quality through the whole path."""
    start = catalog.epoch_ms("2024-04-08")
    message = lambda ms, action, asks, bids: json.dumps({"instId": "A", "action": action, "ts": str(start + ms), "asks": asks, "bids": bids})
    lines = [message(5, "snapshot", [["0.501", "10", "2"], ["0.502", "20", "1"]], [["0.499", "10", "2"], ["0.498", "20", "1"]]), message(60_005, "update", [["0.501", "0", "0"], ["0.503", "30", "1"]], [["0.499", "12", "3"]]), message(86_399_500, "update", [], [])]
    files = {"good": lines, "broken": ["{", "{"], "late": [message(5000, "update", [["1", "0", "0"]], []), "x", *lines[1:2], lines[1]]}
    for name, of in files.items():
        data = ("\n".join(of) + "\n").encode()
        with tarfile.open(tmp_path / f"{name}.tar.gz", "w:gz") as t:
            info = tarfile.TarInfo("book.data")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    m = archives.book_messages(archives.tarred_lines(spark, str(tmp_path))).cache()
    jobs = m.select("file").distinct().withColumns({"symbol": F.lit("A"), "date": F.lit("2024-04-08")})
    minutes = book.archive_minutes(m)
    days = {r.file.rsplit("/", 1)[1].split(".")[0]: r for r in book.archive_days(m, jobs, minutes).collect()}
    good = days["good"]
    assert (good["rows"], good.snapshots, good.updates, good.zero_size_deletions, good.out_of_order_rows, good.sample_count) == (3, 1, 2, 1, 0, 3)
    assert (good.start_delay_ms, good.end_early_ms, good.initial_ask_levels, good.initial_bid_levels, good.sampled_empty_books, good.gaps_over_5s) == (5, 500, 2, 2, 0, 2)
    second = minutes.where(F.col("file").contains("good")).orderBy("sample_ts").collect()[1]
    assert (second.best_ask, second.best_bid) == (0.502, 0.499) and abs(second.ask_depth_10 - (0.502 * 20 + 0.503 * 30)) < 1e-12 and abs(second.bid_depth_1 - 0.499 * 12) < 1e-12
    assert (days["broken"]["rows"], days["broken"].parse_errors, days["broken"].snapshots, days["broken"].sample_count) == (2, 2, None, None)
    late = days["late"]
    assert (late["rows"], late.parse_errors, late.duplicate_timestamps, late.start_delay_ms, late.initial_ask_levels, late.zero_size_deletions) == (4, 1, 1, 5000, None, 3)
    limits = {"minimum_initial_levels_per_side": 2, "maximum_start_delay_ms": 1000, "maximum_end_early_ms": 1000}
    quality = {r.file.rsplit("/", 1)[1]: r.failures for r in gates.day_quality(book.archive_days(m, jobs, minutes), limits, 3).collect()}
    assert quality["good.tar.gz"] == "" and quality["late.tar.gz"] == "snapshot;initial_depth;start_boundary;end_boundary;parse;empty;minutes"
    assert quality["broken.tar.gz"].startswith("snapshot;initial_depth")


def test_futures_zip(spark, tmp_path):
    head = "create_time,symbol,sum_open_interest,sum_open_interest_value,count_toptrader_long_short_ratio,sum_toptrader_long_short_ratio,count_long_short_ratio,sum_taker_long_short_vol_ratio\n"
    a = zipped(tmp_path / "A-metrics-2024-01-01.zip", head + "2024-01-01 00:05:00,A,10.5,1,2,3,4,1.5\n2024-01-01 00:10:00,A,11,1,,x,4,0.5\n")
    b = zipped(tmp_path / "A-metrics-2024-01-02.zip", head + "2024-01-02 00:00:00,A,,1,2,3,4,1\n")
    raw = archives.zipped_metrics(spark, a, b)
    found = {r.file.rsplit("/", 1)[1]: r for r in archives.metrics_inventory(raw).collect()}
    one = found["A-metrics-2024-01-01.zip"]
    assert (one["rows"], one.missing_count_toptrader_long_short_ratio, one.missing_sum_toptrader_long_short_ratio, one.missing_sum_open_interest) == (2, 1, 1, 0)
    got = panel.futures_buckets(archives.futures_metrics(raw, "2024-01-01", "2024-01-02"), "15 minutes").first()
    assert (got.open_interest, got.source_rows) == (11.0, 2) and abs(got.taker_direction - (0.5 / 2.5 - 0.5 / 1.5) / 2) < 1e-12
    with pytest.raises(ValueError, match="1 rows"):
        archives.futures_metrics(raw, "2024-01-01", "2024-01-03")
    assert [p.rsplit("/", 1)[1] for p in archives.daily_files([a, b], "2024-01-02", "2024-01-03")] == ["A-metrics-2024-01-02.zip"]


def test_catalog():
    p = catalog.payload(["ADA-USDT"], "2024-04-08")
    assert p["dateQuery"]["begin"] == "1712534400000" and p["instQueryParam"]["instIdList"] == ["ADA-USDT"]
    answer = {"code": "0", "data": {"details": [{"instId": "A", "groupDetails": [{"url": "u", "filename": "f", "sizeMB": "2.5"}]}]}}
    assert catalog.rows(answer, ["A", "B"], "d") == [("d", "A", True, "f", 2.5, "u"), ("d", "B", False, None, None, None)]
    with pytest.raises(RuntimeError):
        catalog.rows({"code": "1"}, [], "d")
    waits, calls = [], []

    def ask():
        calls.append(1)
        if len(calls) < 3:
            raise HTTPError("u", 429, "slow", {"Retry-After": "90"} if len(calls) == 1 else {}, None)
        return {}

    assert catalog.patient(ask, sleep=waits.append) == {} and waits == [30.0, 2.0]
    now = catalog.datetime(2024, 1, 1, tzinfo=catalog.timezone.utc)
    assert catalog.asked_wait("Mon, 01 Jan 2024 00:00:12 GMT", now) == 12 and catalog.asked_wait("7") == 7 and catalog.asked_wait("soon") is None and catalog.asked_wait(None) is None


def test_plausible(tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 2**20)
    assert catalog.plausible(str(tmp_path / "f"), 1.04) and not catalog.plausible(str(tmp_path / "f"), 1.2) and not catalog.plausible(str(tmp_path / "g"), None)
    assert catalog.download("unused", str(tmp_path / "f"), 1.0) == "cache"


def test_calendar(spark):
    assert calendar.jobs(spark, "2025-10-08", "2026-04-06", list("abcdefg")).count() == 1260
    assert calendar.spine(spark, "2024-01-01", "2024-01-03", "15 minutes").count() == 192
    assert archives.daily_files(["x/m-2024-01-01.zip", "x/m-2024-01-02.zip", "x/readme"], "2024-01-01", "2024-01-02") == ["x/m-2024-01-01.zip"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    sinks.table(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        sinks.table(df, str(tmp_path / "t"))
    sinks.document({"a": 1}, str(tmp_path / "d/x.json"))
    got = sinks.manifest(spark, str(tmp_path / "d/x.json")).first()
    assert got.size == os.path.getsize(tmp_path / "d/x.json") and len(got.sha256) == 64
    assert "| 1 | 2 |" in sinks.report("t", {"x": pd.DataFrame({"a": [1], "b": [2.0]})})
    assert sinks.plot_bins(spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y")), "x", "y", 10).count() == 10


def test_progress(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,symbol,status,quality_passed,completed_at\n2024-01-01,A,complete,True,2024-01-02\n2024-01-01,B,failed,false,\n")
    assert [r.quality_passed for r in archives.progress(spark, str(tmp_path / "p.csv")).orderBy("symbol").collect()] == [True, False]


def test_streamed_buckets_equal_batch(spark, tmp_path):
    t0 = 1744041600000
    rows = [("B", i, "buy" if i % 3 else "sell", 100.0 + i % 7, 1.0 + i % 2, t0 + 60_000 * i) for i in range(200)]
    batch = ticks(spark, rows).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    got = flows.drain(flows.trade_buckets(flows.read(spark, str(tmp_path / "in"), batch.schema, 100), "15 minutes"), "streamed", str(tmp_path / "c")).collect()
    want = {r.bucket_start: r for r in panel.trade_buckets(batch, "15 minutes").collect()}
    assert len(got) >= len(want) - 1
    for r in got:
        w = want[r.bucket_start]
        assert (r.transaction_count, r.bucket_return) == (w.transaction_count, w.bucket_return) and abs(r.aggressor_imbalance - w.aggressor_imbalance) < 1e-12


def test_streamed_book_equals_replay(spark, tmp_path):
    rows = random_messages(150, 8)
    df = as_messages(spark, rows).drop("ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = flows.drain(flows.book_samples(flows.read(spark, str(tmp_path / "in"), df.schema), 60), "books", str(tmp_path / "c")).orderBy("sample_ms").collect()
    want = replay(rows, 60)
    assert [(r.sample_ms, r.ask_levels, r.bid_levels) for r in got] == [(m, len(a), len(b)) for m, a, b in sorted(want)]


def test_command_line(capsys):
    cli.main(["list"])
    assert "trade_buckets" in capsys.readouterr().out
