"""The collection of archives: killed after each step, run again, repaired."""

import io
import json
import os
import shutil
import tarfile

import pytest
from pyspark.sql import functions as F

from tidalflow import cli
from tidalflow.plans import collector

DAYS, SYMBOLS = ["2024-01-01", "2024-01-02"], ["A-T", "B-T"]
RESEARCH = {"data": {"start_inclusive": "2024-01-01T00:00:00Z", "end_exclusive": "2024-01-03T00:00:00Z", "symbols": SYMBOLS, "bucket_minutes": 15, "l2_module": "4", "instrument_type": "SPOT"}, "output": {"base_dir": "out"}}
SETTINGS = {"source": {"catalog_endpoint": "http://localhost:9/none", "raw_data_dir": "raw", "delete_archive_after_cache": True, "timeout_seconds": 5}, "collection": {"sample_interval_seconds": 60, "minimum_initial_levels_per_side": 2, "maximum_start_delay_ms": 1000, "maximum_end_early_ms": 60_000, "minimum_valid_day_share": 0.5}}


def archive(path, symbol, day, skip=()):
    """A day of one message a minute."""
    start, lines = collector.catalog.epoch_ms(day), []
    for i in range(1440):
        if i in skip:
            continue
        mid = 100 + (i * 7 % 13) + len(symbol) / 10 + int(day[-1])
        side = lambda way: [[str(mid + way * (1 + k) / 2), str(1 + (i + k) % 5), "0", "1"] for k in range(3)]  # noqa: B023, E731
        lines.append(json.dumps({"instId": symbol, "action": "snapshot", "ts": str(start + i * 60_000 + 5), "asks": side(1), "bids": side(-1)}))
    data = "\n".join(lines).encode()
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with tarfile.open(path, "w:gz") as t:
        info = tarfile.TarInfo("book.data")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    """Archives of both symbols and days, but for the second symbol's second day."""
    at = tmp_path_factory.mktemp("shelf")
    for s in SYMBOLS:
        for d in DAYS:
            if (s, d) != (SYMBOLS[1], DAYS[1]):
                archive(f"{at}/{s}-{d}.tar.gz", s, d)
    return at


class Shop:
    """The catalogue of a folder; counts what it is asked."""

    def __init__(self, spark, at):
        self.spark, self.at, self.asked = spark, at, []

    def __call__(self, symbols, day):
        self.asked.append((day, *symbols))
        rows = []
        for s in symbols:
            p = f"{self.at}/{s}-{day}.tar.gz"
            there = os.path.isfile(p)
            rows.append((day, s, there, os.path.basename(p) if there else None, os.path.getsize(p) / 2**20 if there else None, f"file://{p}" if there else None))
        return self.spark.createDataFrame(rows, collector.catalog.COLUMNS)


def tables(spark, base):
    at = collector.places(RESEARCH, SETTINGS, base)
    drop = lambda df: sorted(map(tuple, df.drop("completed_at").collect()), key=str)
    return [drop(collector.read(spark, at.table(n), s)) for n, s in (("features", collector.FEATURES), ("facts", collector.FACTS), ("progress", collector.PROGRESS))]


def raw_files(base):
    return sorted(f for _, _, names in os.walk(f"{base}/raw") for f in names)


@pytest.fixture(scope="module")
def clean(spark, shelf, tmp_path_factory):
    base, heard = str(tmp_path_factory.mktemp("clean")), []
    done = collector.collect(spark, RESEARCH, SETTINGS, base, said=heard.append, listed=Shop(spark, shelf), at_once=2)
    return base, done, heard, tables(spark, base)


def test_a_whole_collection(spark, shelf, clean):
    base, done, heard, (features, facts, progress) = clean
    assert done["status"] == "complete" and (done["completed_files"], done["total_files"], done["quality_passing_files"], done["quality_failing_files"], done["unavailable_files"]) == (4, 4, 3, 1, 1)
    assert [h["status"] for h in heard] == ["running", "running", "complete"] and json.load(open(f"{base}/out/collection_state.json")) == done
    assert len(features) == 3 * 96 and len(facts) == 3 and len(progress) == 4 and raw_files(base) == []
    panel = spark.read.parquet(f"{base}/out/intermediate/l2_feature_panel_15m.parquet")
    assert panel.count() == 288 and panel.where("depth_depletion IS NULL").count() == 2
    assert len(open(f"{base}/out/l2_feature_coverage.csv").read().splitlines()) == 4
    # again: nothing is asked for and nothing changes
    shop = Shop(spark, shelf)
    assert collector.collect(spark, RESEARCH, SETTINGS, base, listed=shop)["completed_files"] == 4 and shop.asked == []
    assert tables(spark, base) == [features, facts, progress]
    assert collector.status(spark, RESEARCH, base)["completed_files"] == 4
    os.unlink(f"{base}/out/collection_state.json")
    from_csv = collector.status(spark, RESEARCH, base)
    assert (from_csv["status"], from_csv["completed_files"], from_csv["unavailable_files"]) == ("not_started", 4, 1)


class Killed(Exception):
    pass


@pytest.mark.parametrize("steps", [("archives", "features", "facts", "progress", "unavailable", "removal", "panel"), ("state",)])
def test_killed_after_each_step_and_run_again(spark, shelf, clean, tmp_path, steps):
    """One collection of three files, one at a time: each run is killed after another step, and the next one takes it up."""
    for step in steps:

        def reached(now, step=step):
            if now == step:
                raise Killed

        with pytest.raises(Killed):
            collector.collect(spark, RESEARCH, SETTINGS, str(tmp_path), listed=Shop(spark, shelf), at_once=1, reached=reached)
    assert collector.collect(spark, RESEARCH, SETTINGS, str(tmp_path), listed=Shop(spark, shelf), at_once=1)["status"] == "complete"
    assert tables(spark, str(tmp_path)) == clean[3] and raw_files(tmp_path) == []


def test_progress_is_rebuilt_from_caches_and_caches_from_archives(spark, shelf, clean, tmp_path):
    base = f"{tmp_path}/b"
    shutil.copytree(clean[0], base)
    shutil.rmtree(f"{base}/out/intermediate/progress")
    shop = Shop(spark, shelf)
    collector.collect(spark, RESEARCH, SETTINGS, base, listed=shop)
    assert shop.asked == [(DAYS[1], SYMBOLS[1])]  # only the one that has no cache
    assert tables(spark, base) == clean[3]
    # a cache that was changed behind the collection's back, and one that is gone
    at = collector.places(RESEARCH, SETTINGS, base)
    changed = spark.createDataFrame(collector.read(spark, at.table("features"), collector.FEATURES).where("symbol = 'A-T' AND date = '2024-01-01'").collect(), collector.FEATURES).withColumn("spread_bps", F.col("spread_bps") + 1)
    collector.replace(changed, at.table("features"))
    shutil.rmtree(f"{at.table('features')}/symbol=B-T")
    shop = Shop(spark, shelf)
    collector.collect(spark, RESEARCH, SETTINGS, base, listed=shop)
    assert shop.asked == [(DAYS[0], *SYMBOLS)] and tables(spark, base) == clean[3]


def test_an_archive_stays_until_its_cache_was_read_back(spark, shelf, tmp_path):
    at = collector.places(RESEARCH, SETTINGS, str(tmp_path))

    def reached(now):
        if now == "facts":
            shutil.rmtree(f"{at.table('features')}/symbol=B-T")

    with pytest.raises(OSError, match="B-T 2024-01-01"):
        collector.collect(spark, RESEARCH, SETTINGS, str(tmp_path), listed=Shop(spark, shelf), at_once=2, reached=reached)
    assert raw_files(tmp_path) == ["B-T-2024-01-01.tar.gz"]
    assert [tuple(r[-2:]) for r in tables(spark, str(tmp_path))[2]] != [] and all(r[-2] == "A-T" for r in tables(spark, str(tmp_path))[2])


def test_paused_after_so_many_files(spark, shelf, clean, tmp_path):
    counts = [collector.collect(spark, RESEARCH, SETTINGS, str(tmp_path), most=1, listed=Shop(spark, shelf)) for _ in range(3)]
    assert [(c["status"], c["completed_files"]) for c in counts] == [("paused", 1), ("paused", 3), ("complete", 4)]  # the second meets the day without a file
    assert tables(spark, str(tmp_path)) == clean[3]


def test_a_day_that_fails_is_complete_and_not_in_the_panel(spark, tmp_path):
    archive(f"{tmp_path}/shelf/A-T-2024-01-01.tar.gz", "A-T", DAYS[0], skip=range(7))
    archive(f"{tmp_path}/shelf/A-T-2024-01-02.tar.gz", "A-T", DAYS[1])
    research = RESEARCH | {"data": RESEARCH["data"] | {"symbols": ["A-T"]}}
    done = collector.collect(spark, research, SETTINGS, str(tmp_path), listed=Shop(spark, f"{tmp_path}/shelf"))
    assert (done["completed_files"], done["quality_passing_files"]) == (2, 1)
    facts = {str(r.date): r for r in collector.read(spark, f"{tmp_path}/out/intermediate/facts", collector.FACTS).collect()}
    assert facts[DAYS[0]].quality_failures == "start_boundary;minutes" and facts[DAYS[1]].quality_passed
    assert spark.read.parquet(f"{tmp_path}/out/intermediate/l2_feature_panel_15m.parquet").count() == 96
    strict = SETTINGS | {"collection": SETTINGS["collection"] | {"minimum_valid_day_share": 0.95}}
    with pytest.raises(ValueError, match="valid"):
        collector.collect(spark, research, strict, str(tmp_path), listed=Shop(spark, f"{tmp_path}/shelf"))


def test_the_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda name: spark)
    monkeypatch.setattr(spark, "stop", lambda: None)
    settings = SETTINGS | {"collection": SETTINGS["collection"] | {"minimum_valid_day_share": 0.95}, "logging": {"level": "WARNING"}}
    for name, content in (("research", RESEARCH), ("collection", settings), ("odd", settings | {"logging": {"level": "LOUD"}}), ("kept", settings | {"source": settings["source"] | {"delete_archive_after_cache": False}})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    run = lambda c, *more: cli.main(["collect", "--config", f"{tmp_path}/research.json", "--collection", f"{tmp_path}/{c}.json", "--base", str(tmp_path), *more])
    run("collection")
    said = json.loads(capsys.readouterr().out)
    assert said == {"status": "dry_run", "files": 4, "days": 2, "symbols": 2, "raw_archives_deleted_after_verified_cache": True} and not (tmp_path / "out").exists()
    with pytest.raises(ValueError, match="LOUD"):
        run("odd")
    with pytest.raises(ValueError, match="archives are deleted"):
        run("kept")
    cli.main(["status", "--config", f"{tmp_path}/research.json", "--base", str(tmp_path)])
    assert json.loads(capsys.readouterr().out)["total_files"] == 4


def test_a_study_of_180_days_and_7_symbols(spark):
    research = {"data": {"start_inclusive": "2025-10-08T00:00:00Z", "end_exclusive": "2026-04-06T00:00:00Z", "symbols": list("abcdefg")}}
    assert collector.planned(spark, research) | {"status": 0} == {"status": 0, "files": 1260, "days": 180, "symbols": 7, "raw_archives_deleted_after_verified_cache": True}
