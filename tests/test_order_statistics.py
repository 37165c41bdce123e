"""Exact quantiles by selection and places without a window over everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalflow.operators import positions, quantiles

P = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]


def spread(seed):
    """Groups of very different spread: even, over 600 orders of magnitude, of few values, of one value, with infinite ends, tiny, null."""
    r = np.random.default_rng(seed)
    of = {
        "even": r.normal(size=900), "wide": 10.0 ** r.uniform(-300, 300, 700) * r.choice([-1, 1], 700), "ties": r.choice([1.0, 2.0, 2.0, 2.0, 7.5], 800),
        "one": np.full(500, 3.25), "ends": np.concatenate([r.normal(size=300), [np.inf] * 40, [-np.inf] * 40]), "near": 1 + r.integers(0, 50, 600) * 2.0**-52, "two": np.array([1.0, 2.0]), "single": np.array([9.0]), None: r.exponential(size=400),
    }
    return [(k, float(v)) for k, x in of.items() for v in x] + [("even", None), ("empty", None)], of


@pytest.mark.parametrize("left, bins", [(10_000, 4096), (20, 16), (3, 7)])
def test_quantiles_by_selection(spark, monkeypatch, left, bins):
    monkeypatch.setattr(quantiles, "LEFT", left)
    monkeypatch.setattr(quantiles, "BINS", bins)
    rows, of = spread(left)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r.g, r.p): r.value for r in quantiles.exact_quantiles(df, "v", P, ["g"]).collect()}
    assert len(got) == len(of) * len(P)
    for g, x in of.items():
        s = np.sort(x)
        for p in P:
            at = p * (len(s) - 1)
            lo, hi = s[math.floor(at)], s[math.ceil(at)]
            want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
            assert got[g, p] == want or math.isclose(got[g, p], want, rel_tol=1e-12), (g, p)


def test_quantiles_of_everything_equal_the_built_in_ones(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LEFT", 50)
    df = spark.range(5000).select((F.pmod(F.col("id") * 7919, F.lit(5003)) / 7).alias("v"))
    want = df.agg(*(F.percentile("v", p) for p in P)).first()
    assert [r.value for r in quantiles.exact_quantiles(df, F.col("v"), P).orderBy("p").collect()] == pytest.approx(list(want))
    assert quantiles.exact_quantiles(df.limit(0), "v", P).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(df, "v", [1.5])


def test_places(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1009)).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v")).repartition(5)
    placed = positions.numbered(df, ["k"], parts=6)
    got = placed.orderBy("k").collect()
    assert [r.position for r in got] == list(range(1000)) and sorted(r.k for r in got) == [r.k for r in got]
    for by in (1, 4, -2):
        moved = {r.position: r.w for r in positions.behind(placed, "v", "w", by).collect()}
        assert moved == {i: got[i - by].v if 0 <= i - by < 1000 else None for i in range(1000)}
    same = positions.numbered(spark.range(40).select(F.lit(1).alias("k")), ["k"], "n").collect()
    assert sorted(r.n for r in same) == list(range(40)) and positions.numbered(df.limit(0), ["k"]).count() == 0
