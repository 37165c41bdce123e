"""Operators against plain numpy and pandas, and the scenarios of the fixtures list."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidalflow.functions import numbers
from tidalflow.operators import book, collection, gates, panel, regression, synchronization
from tidalflow.plans import studies

RNG = np.random.default_rng(11)


def ticks(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, trade_id long, side string, price double, size double, ms long")
    return df.withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz")).drop("ms")


def series(spark, days, slots, symbols, seed=0, common=0.0, start="2024-01-01"):
    rng = np.random.default_rng(seed)
    at = pd.date_range(start, periods=days * slots, freq=f"{24 // slots}h")
    base = rng.normal(size=len(at))
    return pd.DataFrame([(t, s, float(common * base[i] + rng.normal())) for i, t in enumerate(at) for s in symbols], columns=["bucket_start", "symbol", "residual_z"])


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


def test_trade_buckets(spark):
    t0 = 1744041600000
    rows = [("B", 1, "buy", 100.0, 2.0, t0), ("B", 2, "sell", 100.0, 1.0, t0 + 60000), ("B", 3, "buy", 101.0, 1.0, t0 + 900000), ("B", 4, "buy", 102.0, 1.0, t0 + 960000)]
    for order in (rows, rows[::-1]):
        got = panel.trade_buckets(ticks(spark, order).repartition(3), "15 minutes").orderBy("bucket_start").collect()
        assert [r.transaction_count for r in got] == [2, 2]
        assert got[0].total_quote_quantity == 300 and math.isclose(got[0].aggressor_imbalance, 1 / 3) and got[0].bucket_return == 0
        assert math.isclose(got[1].bucket_return, 102 / 101 - 1)
    assert panel.trade_buckets(ticks(spark, []), "15 minutes").count() == 0


def test_violations_and_gaps(spark):
    pdf = pd.DataFrame({"bucket_start": pd.to_datetime(["2024-01-01", "2024-01-01", "2024-01-02"]), "symbol": ["a", "a", "z"], "aggressor_imbalance": [0.1, 2.0, 0.0]})
    grid = frame(spark, pdf[["bucket_start"]].drop_duplicates())
    got = {r.check: r.violations for r in panel.violations(frame(spark, pdf), grid, ["a"]).collect()}
    assert got == {"missing_cells": 1, "duplicate_keys": 1, "unknown_symbols": 1, "imbalance_out_of_bounds": 1}


def test_full_residuals_equal_dense_solve(spark):
    rng = np.random.default_rng(3)
    at = pd.date_range("2024-01-01", periods=240, freq="6h")
    pdf = pd.DataFrame([(t, s, rng.normal() / 50, rng.uniform(1, 1e6), int(rng.integers(1, 900)), rng.uniform(-1, 1)) for t in at for s in "abc"], columns=["bucket_start", "symbol", "bucket_return", "total_quote_quantity", "transaction_count", "aggressor_imbalance"])
    x = panel.spot_features(frame(spark, pdf), 3, ("2024-01-01", "2024-02-01"), ("2024-02-01", "2024-03-01"))
    done, coefficients = regression.residualized(x, "aggressor_imbalance", panel.design(x))
    names = [f"d{i}" for i in range(15)]
    dense = x.select("bucket_start", "symbol", "sample_split", "aggressor_imbalance", *(c.alias(n) for c, n in zip(panel.design(x), names, strict=True))).toPandas()
    got = done.select("bucket_start", "symbol", "fitted", "residual_z").toPandas()
    assert coefficients.count() == 45
    seen = {r.symbol: r for r in regression.diagnostics(done, "aggressor_imbalance").collect()}
    for s, g in dense.groupby("symbol"):
        dev = (g.sample_split == "development").to_numpy()
        d, y = g[names].to_numpy(float), g.aggressor_imbalance.to_numpy()
        beta = np.linalg.lstsq(d[dev], y[dev], rcond=None)[0]
        r = y - d @ beta
        assert math.isclose(seen[s].development_r_squared, 1 - (r[dev] ** 2).sum() / ((y[dev] - y[dev].mean()) ** 2).sum(), abs_tol=1e-8)
        assert (seen[s].development_rows, seen[s].oos_rows) == (dev.sum(), (~dev).sum()) and math.isclose(seen[s].development_residual_scale, r[dev].std(ddof=1), rel_tol=1e-8)
        z = (r - r[dev].mean()) / r[dev].std(ddof=1)
        m = g.assign(e=d @ beta, z=z)[["bucket_start", "e", "z"]].merge(got[got.symbol == s], on="bucket_start")
        assert np.allclose(m.e, m.fitted, atol=1e-8) and np.allclose(m.z, m.residual_z, atol=1e-7)


def dense_hac(y, x1, x2, lags):
    x = np.column_stack([np.ones(len(y)), x1, x2])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    u = x * (y - x @ beta)[:, None]
    meat = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(x.T @ x)
    return beta[1], math.sqrt((inv @ meat @ inv)[1, 1])


def test_hac_half_betas_and_bootstrap(spark):
    n = 96
    x1, x2 = RNG.normal(size=n), RNG.normal(size=n)
    y = 0.4 * x1 - 0.2 * x2 + RNG.normal(size=n)
    at = pd.date_range("2024-01-01", periods=n, freq="6h")
    d = frame(spark, pd.DataFrame({"bucket_start": at, "y": y, "x1": x1, "x2": x2})).repartition(3)
    got = regression.hac(d, "y", "x1", "x2", "bucket_start", 5).first()
    beta, se = dense_hac(y, x1, x2, 5)
    assert math.isclose(got.beta, beta, rel_tol=1e-9) and math.isclose(got.se, se, rel_tol=1e-9) and got.n == n
    solve = lambda k: np.linalg.lstsq(np.column_stack([np.ones(len(k)), x1[k], x2[k]]), y[k], rcond=None)[0][1]
    halves = {r.half: r.beta for r in regression.half_betas(d).collect()}
    assert math.isclose(halves[1], solve(np.arange(48)), rel_tol=1e-9) and math.isclose(halves[2], solve(np.arange(48, 96)), rel_tol=1e-9)
    draws = numbers.day_draws(spark, 24, 3, np.random.default_rng(5))
    by = {}
    for r in draws.collect():
        by.setdefault(r.draw, []).extend([r.day_index] * r.times)
    for r in regression.day_bootstrap(d, draws).collect():
        rows = np.concatenate([np.arange(4 * i, 4 * i + 4) for i in by[r.draw]])
        assert math.isclose(r.beta, solve(rows), rel_tol=1e-8)


def test_shift_is_a_permutation_and_day_products_equal_direct(spark):
    symbols = ["a", "b", "c"]
    pdf = series(spark, 40, 4, symbols, 1, 0.7, "2024-06-10")  # two half-years
    b = synchronization.blocks(frame(spark, pdf), 4)
    sizes = [(r.block, r.days) for r in b.select("block", "days").distinct().collect()]
    assert sorted(d for _, d in sizes) == [19, 21]
    offsets = numbers.shift_draws(spark, sizes, symbols, 3, 4, 9)
    moved = synchronization.shifted(b, offsets, "residual_z").toPandas()
    quick = {r.draw: r.mean_pairwise_correlation for r in synchronization.shifted_correlations(b, offsets, "residual_z").collect()}
    for draw, g in moved.groupby("draw"):
        wide = g.pivot(index="bucket_start", columns="symbol", values="shifted")
        for s in symbols:
            assert np.allclose(np.sort(wide[s]), np.sort(pdf[pdf.symbol == s].residual_z))
        direct = np.corrcoef(wide.to_numpy().T)[np.triu_indices(3, 1)].mean()
        assert math.isclose(direct, quick[draw], abs_tol=1e-10)
    whole = numbers.shift_draws(spark, sizes, None, 2, 4, 9)
    pair = frame(spark, pd.concat([pdf[pdf.symbol == "a"], pdf[pdf.symbol == "a"].assign(symbol="b", residual_z=lambda x: x.residual_z + 10)]))
    got = synchronization.shifted(synchronization.blocks(pair, 4), whole, "residual_z").groupBy("draw", "bucket_start").pivot("symbol").agg(F.max("shifted")).toPandas()
    assert np.allclose(got.b - got.a, 10)
    with pytest.raises(ValueError):
        numbers.shift_draws(spark, [(1, 8)], symbols, 1, 4, 0)
    assert numbers.shift_draws(spark, [(1, 8)], None, 1, 4, 0).first().offset == 4


def test_common_signal_and_alignment(spark):
    symbols = list("abcdefg")
    joint, apart = (frame(spark, series(spark, 50, 4, symbols, 2, c)) for c in (5.0, 0.0))
    mean = lambda df: synchronization.pairwise_corr(df, "residual_z").agg(F.avg("correlation")).first()[0]
    rate = lambda df: synchronization.alignment(df, "residual_z", 6).first().alignment_rate
    assert mean(joint) > 0.9 and abs(mean(apart)) < 0.1 and rate(joint) > rate(apart)
    zero = frame(spark, pd.DataFrame({"bucket_start": pd.to_datetime(["2024-01-01"] * 2), "symbol": ["a", "b"], "residual_z": [0.0, 0.0]}))
    assert rate(zero) == 0


def test_concordance(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 2.0), (2.0, -1.0)], "l double, r double")
    got = synchronization.concordance(df, "l", "r", 1.0, 1.0).first()
    assert (got.concordance, got.event_count) == (0.5, 2)
    none = synchronization.concordance(df, "l", "r", 5.0, 5.0).first()
    assert math.isnan(none.concordance) and none.event_count == 0
    assert synchronization.concordance(df.limit(1), "l", "r", -1.0, -1.0).first().concordance == 1.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(0, 1)), min_size=1, max_size=12))
def test_benjamini_hochberg(spark, p):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    got = [r.q for r in synchronization.benjamini_hochberg(df, "p", "q").orderBy("i").collect()]
    known = [x for x in p if x is not None]
    for x, q in zip(p, got, strict=True):
        want = None if x is None else min(1.0, min(y * len(known) / sum(z <= y for z in known) for y in known if y >= x))
        assert q is want if want is None else math.isclose(q, want, rel_tol=1e-12, abs_tol=1e-300)
    assert np.allclose([np.nan if q is None else q for q in got], studies.adjusted([np.nan if x is None else x for x in p]), equal_nan=True)


def test_null_summary_counts_nan_draws(spark):
    nulls = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (4.0,)], "v double")
    got = synchronization.null_summary(nulls, "v", spark.createDataFrame([(2.0,)], "observed double")).first()
    assert math.isclose(got.null_mean, 7 / 3) and got.p_value == 3 / 5


def test_published_figures():
    assert math.isclose(numbers.normal_p(0.014421754904227839 / 0.006144669495788801), 0.018923472683163488, rel_tol=1e-9)
    assert math.isclose(numbers.binomial_tail(2456, 3164), 2.7747555183496033e-224, rel_tol=1e-9)
    assert numbers.binomial_tail(0, 5) == 1 and math.isclose(numbers.binomial_tail(5, 5), 1 / 32)


def replay(rows, seconds):
    asks, bids, due, out = {}, {}, None, []
    for ms, action, side, price, size in rows:
        if action == "snapshot":
            asks, bids = {}, {}
        elif action != "update":
            continue
        s = asks if side == "ask" else bids
        s.pop(price, None) if size == 0 else s.__setitem__(price, size)
        if due is None or ms >= due:
            out.append((ms, tuple(sorted(asks.items())), tuple(sorted(bids.items()))))
            due = (ms // (seconds * 1000) + 1) * seconds * 1000
    return out


def random_messages(n, seed):
    rng = np.random.default_rng(seed)
    ms, rows = 1_700_000_000_000, []
    for i in range(n):
        ms += int(rng.integers(-400, 9000))  # sometimes back in time
        rows.append((ms, str(rng.choice(["update", "snapshot", "odd"], p=[0.9, 0.05, 0.05])), str(rng.choice(["ask", "bid"])), float(rng.integers(1, 15)), float(rng.choice([0, 1, 2]))))
    return rows


def as_messages(spark, rows):
    df = spark.createDataFrame([("x", i, *r) for i, r in enumerate(rows)], "symbol string, seq long, ms long, action string, side string, price double, size double")
    return df.withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz"))


def test_book_equals_replay(spark):
    rows = random_messages(400, 4)
    e = book.epochs(as_messages(spark, rows).repartition(4))
    s = book.samples(e, 60)
    got = {}
    for r in book.as_of(e, s.withColumn("ts", F.col("ts"))).join(s.select(F.col("ts").alias("sample_ts"), "ms"), "sample_ts").collect():
        got.setdefault(r.ms, {"ask": {}, "bid": {}})[r.side][r.price] = r["size"]
    want = replay(rows, 60)
    assert s.count() == len(want)
    for ms, asks, bids in want:
        have = got.get(ms, {"ask": {}, "bid": {}})
        assert (tuple(sorted(have["ask"].items())), tuple(sorted(have["bid"].items()))) == (asks, bids)


def test_books_in_parts_equal_one_window(spark):
    m = as_messages(spark, random_messages(400, 9))
    part = F.floor(F.col("seq") / 37)
    plain, cut = book.epochs(m), book.epochs(m.repartition(3), part)
    key = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert key(plain, "seq", "epoch") == key(cut, "seq", "epoch")
    assert key(book.samples(plain, 60), "seq") == key(book.samples(cut, 60, part), "seq")
    assert book.audit(m).first() == book.audit(m, part).first()


def test_a_book_without_snapshots_is_cut_into_parts(spark):
    """One epoch of three snapshots at most: each part is worked on by itself, and books are the same."""
    rng = np.random.default_rng(3)
    rows, ms = [], 1_700_000_000_000
    for i in range(600):
        ms += int(rng.integers(-400, 3000))
        action = "snapshot" if i in (0, 317, 318) else str(rng.choice(["update", "odd"], p=[0.95, 0.05]))
        rows.append((ms, action, str(rng.choice(["ask", "bid"])), float(rng.integers(1, 40)), float(rng.choice([0, 1, 2]))))
    m = as_messages(spark, rows).unionByName(as_messages(spark, rows[100:250]).withColumn("symbol", F.lit("y")))  # a book without any snapshot
    part = F.floor(F.col("seq") / 50)
    e = book.epochs(m.repartition(3), part)
    s = book.samples(e, 20, part)
    key = lambda df: sorted(tuple(r) for r in df.select("symbol", "sample_ts", "side", "price", "size").collect())
    whole, cut = book.as_of(e, s), book.as_of(e, s, part=part)
    assert key(whole) == key(cut) and cut.count() > 500
    assert key(book.as_of(e, s, part=F.lit(1))) == key(cut) == key(book.as_of(e, s, part=F.col("seq")))
    level_rows, marks = book.opened(e.where("action IN ('snapshot', 'update')").withColumn("pos", F.lit(0)), s, part, "symbol")
    most = level_rows.groupBy("symbol", "epoch").agg(F.count("*").alias("n"), F.count_if(F.col("seq").isNull()).alias("opening"))
    # a group has a part's rows and the levels that the part opens with, of which there are 78 prices at most
    assert most.agg(F.max(F.col("n") - F.col("opening"))).first()[0] <= 50 and 20 < most.agg(F.max("opening")).first()[0] <= 78
    assert marks.count() == s.count()


def test_large_means_cost_no_digits(spark):
    rng = np.random.default_rng(2)
    x1, x2 = rng.normal(size=60), rng.normal(size=60)
    y = 0.4 * x1 - 0.2 * x2 + rng.normal(size=60)
    at = pd.date_range("2024-01-01", periods=60, freq="6h")
    beta, se = dense_hac(y, x1, x2, 3)
    d = frame(spark, pd.DataFrame({"bucket_start": at, "y": y + 1e8, "x1": x1 + 1e8, "x2": x2 - 1e8}))
    got = regression.hac(d, "y", "x1", "x2", "bucket_start", 3).first()
    assert math.isclose(got.beta, beta, rel_tol=1e-5) and math.isclose(got.se, se, rel_tol=1e-5)
    near = frame(spark, pd.DataFrame({"bucket_start": at, "y": y, "x1": x1, "x2": x2}))
    fits = {r.half: r for r in regression.half_fits(near, 3).collect()}
    for half, k in ((1, slice(0, 30)), (2, slice(30, 60))):
        beta, se = dense_hac(y[k], x1[k], x2[k], 3)
        assert math.isclose(fits[half].beta, beta, rel_tol=1e-9) and math.isclose(fits[half].se, se, rel_tol=1e-9)


def test_book_levels_and_flags(spark):
    df = spark.createDataFrame([("x", 1, [["0.50", "1"], ["0.5"], ["0.6", "2", "9"]], [["0.4", "3"]])], "symbol string, seq long, asks array<array<string>>, bids array<array<string>>")
    assert sorted((r.side, r.price, r["size"]) for r in book.levels(df).collect()) == [("ask", 0.5, 1.0), ("ask", 0.6, 2.0), ("bid", 0.4, 3.0)]
    rows = [(1_700_000_000_000, "update", "bid", 5.0, 1.0), (1_700_000_060_000, "update", "ask", 5.0, 1.0)]
    e = book.epochs(as_messages(spark, rows))
    s = book.samples(e, 60)
    top = book.top(book.as_of(e, s), s).orderBy("sample_ts").collect()
    assert [(r.empty, r.crossed) for r in top] == [(True, False), (False, True)]


def test_liquidity_medians(spark):
    at = pd.date_range("2025-10-08", periods=30, freq="min")
    pdf = pd.DataFrame({"sample_ts": at, "symbol": "x", "empty": False, "crossed": False, "spread_bps": np.arange(30.0), "depth_10": 300.0, "imbalance_10": 1 / 3})
    got = book.liquidity(spark.createDataFrame(pdf).withColumn("sample_ts", F.col("sample_ts").cast("timestamp_ntz")), "15 minutes").orderBy("bucket_start").collect()
    assert [(r.spread_bps, r.top10_depth_quote, r.observed_minutes) for r in got] == [(7.0, 300.0, 15), (22.0, 300.0, 15)]


def test_futures_aggregation(spark):
    rows = [("a", 1, 1.0, 3.0), ("a", 2, None, 1.0), ("a", 3, 2.0, None)]
    df = spark.createDataFrame(rows, "symbol string, row_id long, open_interest double, taker_ratio double").withColumn("ts", F.timestamp_seconds(F.col("row_id")).cast("timestamp_ntz"))
    assert (panel.futures_buckets(df, "15 minutes").first().open_interest, panel.futures_buckets(df, "15 minutes", "last").first().taker_direction) == (2.0, 0.0)
    with pytest.raises(ValueError):
        panel.futures_buckets(df, "15 minutes", "median")


def test_log_change_skips_what_is_not_positive(spark):
    pdf = pd.DataFrame({"bucket_start": pd.date_range("2024-01-01", periods=4, freq="D"), "symbol": "a", "v": [1.0, 0.0, 4.0, 8.0]})
    got = [r.c for r in panel.log_change(frame(spark, pdf), "v", "c").orderBy("bucket_start").collect()]
    assert got[:3] == [None, None, None] and math.isclose(got[3], math.log(2))


def test_oos_changes_nothing_in_the_fit(spark):
    pdf = series(spark, 20, 4, ["a"], 6)
    a = frame(spark, pdf)
    b = a.withColumn("residual_z", F.when(F.col("bucket_start") >= F.lit("2024-01-11").cast("timestamp_ntz"), 99.0).otherwise(F.col("residual_z")))
    dev = F.col("bucket_start") < F.lit("2024-01-11").cast("timestamp_ntz")
    z = lambda df: [r.z for r in regression.standardised(df, "residual_z", "z", ["symbol"], dev).where(dev).orderBy("bucket_start").collect()]
    assert z(a) == z(b)


def test_collection(spark):
    jobs = spark.createDataFrame([("2025-11-08", "X"), ("2025-11-08", "B")], "date string, symbol string")
    progress = spark.createDataFrame([("2025-11-08", "X", "unavailable", False, "2026-07-23")], "date string, symbol string, status string, quality_passed boolean, completed_at string")
    got = collection.state(jobs, progress).first()
    assert (got.completed_files, got.unavailable_files, got.quality_failing_files, got.total_files) == (1, 1, 1, 2)
    assert [r.symbol for r in collection.pending(jobs, progress).collect()] == ["B"]
    done = progress.withColumn("status", F.lit("complete"))
    assert collection.pending(jobs, done, done.limit(0)).count() == 2 and collection.pending(jobs, done, done).count() == 1
    assert collection.upserted(progress, done).first().status == "complete"
    empty = collection.state(jobs, progress.limit(0)).first()
    assert empty.completed_files == 0 and empty.last_completed_date is None


def test_collection_resumes_and_assembles(spark):
    jobs = spark.createDataFrame([(d, s) for d in ("2025-11-08", "2025-11-09") for s in "XB"], "date string, symbol string")
    catalog = spark.createDataFrame([("2025-11-08", "X", True, 9.0), ("2025-11-08", "B", True, 2.0), ("2025-11-09", "X", False, None), ("2025-11-09", "B", True, 1.0)], "date string, symbol string, available boolean, size_mb double")
    assert [(r.date, r.symbol) for r in collection.next_files(jobs, catalog).collect()] == [("2025-11-08", "B"), ("2025-11-08", "X"), ("2025-11-09", "B")]
    assert collection.next_files(jobs, catalog, 1).count() == 1 and collection.unavailable(jobs, catalog).first().symbol == "X"
    needs = {r.design: r.estimated_compressed_gb for r in collection.resources(catalog, 180, 730).collect()}
    assert math.isclose(needs["sampled_catalog_day"], 0.006) and math.isclose(needs["full_two_year_window"], 4.38) and collection.resources(catalog.limit(0), 1, 2).count() == 0
    at = pd.date_range("2025-11-08", periods=192, freq="15min")
    rows = pd.DataFrame([(t.strftime("%Y-%m-%d"), s, s, t, 10.0 * (i + 1)) for s in "XB" for i, t in enumerate(at)], columns=["date", "symbol", "own_symbol", "bucket_start", "top10_depth_quote"])
    rows.loc[0, "own_symbol"] = "other"
    rows = frame(spark, rows)
    digests = jobs.withColumn("sha256", F.lit("a"))
    metadata = jobs.withColumn("cache_sha256", F.when((F.col("symbol") == "B") & (F.col("date") == "2025-11-09"), "b").otherwise("a"))
    valid = collection.valid_caches(rows.withColumn("date", F.col("date").cast("date")), digests.withColumn("date", F.col("date").cast("date")), metadata.withColumn("date", F.col("date").cast("date")))
    assert sorted((str(r.date), r.symbol) for r in valid.collect()) == [("2025-11-08", "B"), ("2025-11-09", "X")]
    progress = spark.createDataFrame([("2025-11-08", "B", "failed", False), ("2025-11-08", "X", "complete", True)], "date string, symbol string, status string, quality_passed boolean")
    caches = spark.createDataFrame([("2025-11-08", "B", True), ("2025-11-08", "X", False)], "date string, symbol string, quality_passed boolean")
    assert sorted((r.symbol, r.status, r.quality_passed) for r in collection.recovered(progress, caches).collect()) == [("B", "complete", True), ("X", "complete", True)]
    days = jobs.withColumn("quality_passed", ~((F.col("symbol") == "B") & (F.col("date") == "2025-11-09")))
    with pytest.raises(ValueError, match="0.5"):
        collection.feature_panel(rows.drop("own_symbol", "date"), days, jobs, 0.95)
    made = collection.feature_panel(rows.drop("own_symbol", "date"), days, jobs, 0.5)
    assert made.count() == 288 and math.isclose(made.where("symbol = 'X'").orderBy("bucket_start").collect()[1].depth_depletion, -math.log(2))


RULES = {"cascade_primary_horizon_minutes": 15, "cascade_minimum_standardized_beta": 0.02, "fdr_alpha": 0.05, "futures_minimum_standardized_beta": 0.05, "futures_minimum_event_count": 100, "futures_minimum_directional_concordance": 0.55}


def summaries(beta=0.1, sync=True):
    lead = pd.DataFrame([("major_to_alt", 15, beta, 0.01, 0.1, 0.1)], columns=["direction", "horizon_minutes", "standardized_beta", "q_value_bh_fdr", "first_half_beta", "second_half_beta"])
    fut = pd.DataFrame([("spot_to_futures_flow_regression", 0.3, 0.01, np.nan), ("extreme_event_direction_concordance", 0.7, 0.01, 500)], columns=["test", "estimate", "q_value_bh_fdr", "event_count"])
    return pd.DataFrame({"gate_pass": [True, sync]}), lead, pd.DataFrame({"horizon_minutes": [15], "ci_lower_95": [0.01]}), fut


def test_study_decisions():
    got = gates.study(*summaries(), RULES).set_index("decision")
    assert got.passed.tolist() == [True, True, True, True, False, False]
    assert got.classification["final"] == "synchronization_cascade_and_futures_confirmation_supported" and got.classification["directional_alpha"] == "not_tested"
    assert gates.study(*summaries(sync=False), RULES).set_index("decision").classification["final"] == "cross_asset_order_flow_synchronization_not_supported"
    assert gates.replication(*summaries(beta=0.01)[:3], RULES, "second").passed.tolist() == [True, False, False, False]
    with pytest.raises(ValueError):
        gates.one(summaries()[1], direction="none")


def test_cross_venue_decisions():
    rules = {"fdr_alpha": 0.05, "synchronization_minimum_correlation_excess": 0.02, "synchronization_minimum_concordance_ratio": 1.1, "synchronization_minimum_event_count": 100, "transmission_primary_horizon_minutes": 15, "transmission_minimum_standardized_beta": 0.02}
    sync = pd.DataFrame([("mean_same_asset_correlation", 0.3, 0.1, 0.01, 0.25, 3.0, np.nan), ("extreme_direction_concordance", 0.9, 0.6, 0.01, 0.3, 1.5, 500)], columns=["metric", "observed", "null_p95", "q_value_bh_fdr", "excess", "ratio", "event_count"])
    lead = pd.DataFrame([("there", 15, 0.1, 0.01, 0.1, 0.1), ("back", 15, 0.1, 0.01, 0.1, 0.1)], columns=["direction", "horizon_minutes", "standardized_beta", "q_value_bh_fdr", "first_half_beta", "second_half_beta"])
    got = gates.cross_venue(sync, lead, pd.Series([0.01, 0.02, 0.03]), rules, "there", "back")
    assert got.passed.tolist() == [True, True, False, False] and got.classification[1] == "there"
    assert gates.cross_venue(sync, lead, pd.Series([-0.01, 0.02]), rules, "there", "back").classification[1] == "not_supported"


def test_pilot_and_day_gates(spark):
    limits = {"minimum_initial_levels_per_side": 390, "maximum_start_delay_ms": 1000, "maximum_end_early_ms": 1000, "maximum_parse_errors": 0, "maximum_out_of_order_rows": 0, "maximum_sampled_crossed_books": 0}
    good = {"snapshots": 1, "initial_ask_levels": 400, "initial_bid_levels": 400, "start_delay_ms": 5, "end_early_ms": 5, "parse_errors": 0, "out_of_order_rows": 0, "sampled_crossed_books": 0}
    catalog = spark.createDataFrame([(True,), (False,)], "available boolean")
    assert not gates.pilot(catalog, good, limits).passed.iloc[-1] and gates.pilot(catalog.where("available"), good, limits).passed.all()
    assert not gates.pilot(catalog.where("available"), {**good, "initial_ask_levels": None}, limits).passed[2]
    day = spark.createDataFrame([(1, 400, 400, 5, 5, 0, 0, 0, 0, 1440), (0, None, None, 5, 5, 0, 0, 0, 0, 3)], "snapshots int, initial_ask_levels int, initial_bid_levels int, start_delay_ms int, end_early_ms int, parse_errors int, out_of_order_rows int, sampled_crossed_books int, sampled_empty_books int, sample_count int")
    assert [(r.passed, r.failures) for r in gates.day_quality(day, limits).collect()] == [(True, ""), (False, "snapshot;initial_depth;minutes")]


def test_configuration(tmp_path):
    gates.frozen({"a": {"b": 1}}, {"a.b": 1}, ["news"])
    for bad in (({"a": {"b": 2}}, {"a.b": 1}, []), ({"a": "News"}, {}, ["news"])):
        with pytest.raises(ValueError):
            gates.frozen(*bad)
    import hashlib
    import json

    for n in "pc":
        (tmp_path / n).write_text(n)
    h = {k: hashlib.sha256(n.encode()).hexdigest() for k, n in (("protocol_sha256", "p"), ("config_sha256", "c"))}
    (tmp_path / "s").write_text(json.dumps({**h, "results_observed_at_seal": False, "excluded_data_layers": ["x"]}))
    assert gates.seal(*(str(tmp_path / n) for n in "pcs"), ["x"])["verified"]
    with pytest.raises(ValueError):
        gates.seal(*(str(tmp_path / n) for n in "pcs"), ["y"])
    (tmp_path / "p").write_text("changed")
    with pytest.raises(ValueError):
        gates.seal(*(str(tmp_path / n) for n in "pcs"), ["x"])
