"""Small exact numbers for summary rows on the driver: normal and binomial tails, digests, draws."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The normal distribution's 97.5th percentile.
Z975 = 1.959963984540054


def normal_p(t: float) -> float:
    """Two-sided p of a normal statistic."""
    return math.erfc(abs(t) / math.sqrt(2))


def normal_ci(beta: float, se: float) -> tuple[float, float]:
    return beta - Z975 * se, beta + Z975 * se


def binomial_tail(k: int, n: int) -> float:
    """P(X >= k) of n fair coins: terms by log-gamma, added from the smallest."""
    if k <= 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k, n + 1)]
    top = max(log, default=-math.inf)
    return min(1.0, math.exp(top) * math.fsum(sorted(math.exp(x - top) for x in log))) if log else 0.0


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def shift_draws(spark: SparkSession, blocks: list[tuple[int, int]], symbols: list[str] | None, draws: int, least: int, seed: int) -> DataFrame:
    """draw, block, offset (and symbol, unless the panel moves together), from one seeded generator in the order draw, block, asset.

    Per-asset shifts need more than twice ``least`` days; a joint shift needs one candidate.
    """
    rng, rows = np.random.default_rng(seed), []
    for block, days in blocks:
        if days <= 2 * least if symbols else days - 2 * least + 1 <= 0:
            raise ValueError(f"block {block} is too short: {days} days")
    for d in range(1, draws + 1):
        for block, days in sorted(blocks):
            if symbols:
                rows += [(d, block, s, int(o)) for s, o in zip(symbols, (rng.integers(least, days - least + 1) for _ in symbols), strict=True)]
            else:
                rows.append((d, block, int(rng.choice(np.arange(least, days - least + 1)))))
    return spark.createDataFrame(rows, "draw int, block long, symbol string, offset int" if symbols else "draw int, block long, offset int")


def day_draws(spark: SparkSession, days: int, draws: int, rng: np.random.Generator) -> DataFrame:
    """draw, day_index, times: whole days drawn with replacement. One generator can serve several horizons in turn."""
    rows = []
    for d in range(1, draws + 1):
        day, times = np.unique(rng.integers(0, days, days), return_counts=True)
        rows += [(d, int(i), int(n)) for i, n in zip(day, times, strict=True)]
    return spark.createDataFrame(rows, "draw int, day_index int, times int")
