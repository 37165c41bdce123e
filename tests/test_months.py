"""Monthly archives: fetched, cached, merged at the months' edges, resumed."""

import io
import json
import os
import shutil
import zipfile

import numpy as np
import pandas as pd
import pytest

from tests.test_collector import Killed
from tidalflow.operators import gates, panel
from tidalflow.plans import collector, months
from tidalflow.sources import archives

SYMBOLS, MONTHS = ["A", "B"], ["2024-01", "2024-02"]
#: Archives end by the clock of a place half a bucket west of UTC, so the last bucket of a month is in two of them.
EDGE = pd.Timestamp("2024-02-01T00:07:30")
CONFIG = {"source": {"local_data_dir": "raw", "retries": 1, "timeout_seconds": 5}, "data": {"symbols": SYMBOLS, "expected_start": "2024-01-30T00:00:00Z", "expected_end_exclusive": "2024-02-03T00:00:00Z", "expected_interval_minutes": 15}, "download": {"max_workers": 2}}


def ticks(symbol, seed):
    rng = np.random.default_rng(seed)
    at = pd.Timestamp("2024-01-30") + pd.to_timedelta(np.sort(rng.integers(0, 4 * 86_400_000, 3000)), unit="ms")
    return [(symbol, i + 1, "BUY" if rng.random() < 0.5 else "sell", round(100 + rng.normal(), 4), round(rng.uniform(1, 2), 4), t.value // 10**6, t) for i, t in enumerate(at)]


def zipped(path, rows):
    text = io.StringIO("instrument_name,trade_id,side,price,size,created_time\n")
    text.seek(0, io.SEEK_END)
    text.writelines(",".join(map(str, r[:6])) + "\n" for r in rows)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("t.csv", text.getvalue())


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    at = tmp_path_factory.mktemp("months")
    for k, s in enumerate(SYMBOLS):
        rows = ticks(s, k)
        for m, part in zip(MONTHS, ([r for r in rows if r[6] < EDGE], [r for r in rows if r[6] >= EDGE]), strict=True):
            zipped(f"{at}/{m.replace('-', '')}/{s}-trades-{m}.zip", part)
    return at


@pytest.fixture
def loose(monkeypatch):
    """The edge here is no month of any zone."""
    monkeypatch.setattr(gates, "month_caches", lambda table, zone: table.groupBy("symbol", "month").agg(months.F.lit(0).alias("violations")))


def asked(shelf):
    return {**CONFIG, "source": {**CONFIG["source"], "base_url": f"file://{shelf}"}}


def rounded(df):
    return sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_months_are_fetched_merged_and_resumed(spark, shelf, tmp_path, loose):
    out, heard, steps = f"{tmp_path}/out", [], []
    got, manifest = months.collect(spark, asked(shelf), str(tmp_path), out, heard.append, steps.append, batches=1)
    whole = spark.createDataFrame([r[:6] for s, k in zip(SYMBOLS, range(2), strict=True) for r in ticks(s, k)], "instrument_name string, trade_id long, side string, price double, size double, created_time long")
    want = panel.trade_buckets(archives.trades(whole), "15 minutes")
    assert rounded(got.select(want.columns)) == rounded(want)
    # the bucket at the edge has trades of both archives
    parts = collector.read(spark, f"{out}/monthly_cache", months.CACHE)
    assert parts.where("bucket_start = '2024-02-01 00:00:00'").groupBy("symbol").count().where("count = 2").count() == 2
    assert manifest["source_used"].tolist() == ["download"] * 4 and manifest["raw_rows"].sum() == 6000 and manifest["archive_sha256"].nunique() == 4
    assert steps == ["archives", "cache", "facts", "state"] * 2 and [h["completed_jobs"] for h in heard] == [2, 4, 4] and heard[-1]["status"] == "complete"
    assert json.load(open(f"{out}/collection_state.json"))["panel_rows"] == want.count() and len(pd.read_csv(f"{out}/collection_progress.csv")) == 4
    # again: nothing is done; then one cache is gone, one is changed, and one archive is gone
    steps.clear()
    again, manifest = months.collect(spark, asked(shelf), str(tmp_path), out, None, steps.append)
    assert steps == [] and manifest["source_used"].tolist() == ["cache"] * 4 and rounded(again) == rounded(got)
    shutil.rmtree(f"{out}/monthly_cache/symbol=A/month=2024-01")
    changed = spark.createDataFrame(collector.read(spark, f"{out}/monthly_cache", months.CACHE).where("symbol = 'A'").collect(), months.CACHE).withColumn("transaction_count", months.F.col("transaction_count") + 1)
    collector.replace(changed, f"{out}/monthly_cache", months.KEY, "bucket_start")
    os.unlink(f"{tmp_path}/raw/B/B-trades-2024-02.zip")
    mended, manifest = months.collect(spark, asked(shelf), str(tmp_path), out, None, steps.append)
    assert steps == ["archives", "cache", "facts", "state"] and rounded(mended) == rounded(want.select(mended.columns))
    assert manifest["source_used"].tolist() == ["archive", "archive", "cache", "download"]


@pytest.mark.parametrize("step", ["archives", "cache", "facts"])
def test_killed_months(spark, shelf, tmp_path, loose, step):
    def reached(now):
        if now == step:
            raise Killed

    with pytest.raises(Killed):
        months.collect(spark, asked(shelf), str(tmp_path), f"{tmp_path}/out", None, reached, batches=1)
    got, _ = months.collect(spark, asked(shelf), str(tmp_path), f"{tmp_path}/out", batches=1)
    assert got.groupBy("bucket_start", "symbol").count().where("count > 1").count() == 0
    assert got.agg({"transaction_count": "sum"}).first()[0] == 6000


def test_faults_of_ticks_and_months(spark, tmp_path):
    rows = ticks("A", 0)
    config = {**CONFIG, "data": {**CONFIG["data"], "symbols": ["A"], "expected_end_exclusive": "2024-01-31T00:00:00Z"}}
    january = [r for r in rows if r[6] < pd.Timestamp("2024-02-01")]
    at = f"{tmp_path}/raw/A/A-trades-2024-01.zip"
    bad = {"1 wrong_side": (2, "hold"), "1 not_increasing": (1, january[3][1]), "1 wrong_symbol": (0, "B"), "1 non_finite": (3, "inf")}
    for said, (column, value) in bad.items():
        odd = list(january[4])
        odd[column] = value
        zipped(at, [*january[:4], odd, *january[5:]])
        with pytest.raises(ValueError, match=said):
            months.collect(spark, config, str(tmp_path), f"{tmp_path}/out")
    zipped(at, [])
    with pytest.raises(Exception, match="no trades|Empty|empty"):
        months.collect(spark, config, str(tmp_path), f"{tmp_path}/out")
    zipped(at, rows)  # runs on into February
    with pytest.raises(ValueError, match="invalid months"):
        months.collect(spark, config, str(tmp_path), f"{tmp_path}/out")
    zipped(at, january)
    assert months.collect(spark, config, str(tmp_path), f"{tmp_path}/out")[1]["source_used"].tolist() == ["archive"]
    with pytest.raises(Exception, match="FileNotFound"):
        months.collect(spark, {**config, "data": {**config["data"], "symbols": ["C"]}}, str(tmp_path), f"{tmp_path}/out")


def test_order_and_zone_of_a_month(spark, tmp_path):
    at = [pd.Timestamp(x).to_pydatetime() for x in ("2023-12-31 16:00", "2024-01-02", "2024-01-01", "2024-01-01", "2024-01-31 16:00")]
    rows = spark.createDataFrame([("A", "2024-01", t, "f", i) for i, t in enumerate(at)], "symbol string, month string, bucket_start timestamp_ntz, _file string, _row long")
    assert tuple(gates.month_caches(rows, "Asia/Shanghai").first()) == ("A", "2024-01", 2, 1, 3)
    assert tuple(gates.month_caches(rows, "UTC").first())[2:] == (2, 1, 3)
