"""Exact quantiles of columns of any length, by selection: histograms are refined around the ranks asked for until what is left fits a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a pass, and values that a task sorts at the end.
BINS, LEFT = 4096, 10_000
#: Pivots of a pass whose range can't be cut evenly to advantage.
PIVOTS = 64
#: Intervals up to which they are sent to the rows; there is one for each group and rank.
SENT = 10_000


def exact_quantiles(df: DataFrame, value: str | Column, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """``by``, p, value: for each probability the linearly interpolated quantile of ``value`` (null: left out), exactly.

    A pass counts the values between the bounds of each wanted rank in BINS even bins, keeps the bin that holds the rank, and goes on
    within its least and greatest value. If that keeps more than an eighth, the next pass cuts at approximate quantiles, whatever the
    values' spread. Ends when each range has LEFT values at most, or one value only. No task holds more than that, or a pass's bins.
    """
    by = by or []
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities are between 0 and 1")
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, v.cast("double").alias("_v")).where("_v IS NOT NULL")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    asked = sizes.select(*by, "_n", F.explode(F.array(*map(F.lit, map(float, probabilities)))).alias("p"))
    place = F.col("p") * (F.col("_n") - 1)
    asked = asked.select(*by, "p", F.floor(place).alias("_floor"), F.ceil(place).alias("_ceil"), (place - F.floor(place)).alias("_part"))
    ranks = asked.select(*by, F.explode(F.array_distinct(F.array("_floor", "_ceil"))).alias("_rank")).distinct()
    state = _joined(ranks, sizes, by).withColumn("_below", F.lit(0).cast("long")).persist()
    even, before, kept = True, None, [state]
    while True:
        largest, intervals = state.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_n"))), F.count("*")).first()
        if (largest or 0) <= LEFT:
            break
        even = even and (before is None or largest * 8 <= before)
        before = largest
        state = _narrowed(rows, state, by, even and _finite(state), intervals <= SENT).persist()
        kept.append(state)
    ends = state.where("_lo < _hi")
    inside = _inside(rows, ends, by, intervals <= SENT)
    sorted_ = inside.groupBy(*by, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    key = [*by, "_lo", "_hi"]
    found = _joined(ends, sorted_, key).select(*by, "_rank", F.get("_all", (F.col("_rank") - F.col("_below")).cast("int")).alias("_at"))
    found = found.union(state.where("NOT _lo < _hi").select(*by, "_rank", F.col("_lo").alias("_at")))
    low, high = (found.select(*by, F.col("_rank").alias(f"_{n}"), F.col("_at").alias(f"_{n}_at")) for n in ("floor", "ceil"))
    out = _joined(_joined(asked, low, [*by, "_floor"]), high, [*by, "_ceil"])
    # equal ends need no interpolation, which would make infinite ones undefined
    return out.select(*by, "p", F.when(F.col("_floor_at") == F.col("_ceil_at"), F.col("_floor_at")).otherwise(F.col("_floor_at") + (F.col("_ceil_at") - F.col("_floor_at")) * F.col("_part")).alias("value"))


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A join in which null groups meet each other."""
    if not on:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [left[c].eqNullSafe(other[f"_r_{c}"]) for c in on]
    return left.join(other, same).drop(*(f"_r_{c}" for c in on))


def _finite(state: DataFrame) -> bool:
    return not state.where("isnan(_hi - _lo) OR _hi - _lo = double('Infinity')").limit(1).count()


def _inside(rows: DataFrame, state: DataFrame, by: list[str], sent: bool) -> DataFrame:
    """Rows with the intervals of ``state`` that they lie in; several ranks can share one."""
    intervals = state.select(*by, "_lo", "_hi", "_below").distinct()
    intervals = F.broadcast(intervals) if sent else intervals
    other = intervals.withColumnsRenamed({c: f"_r_{c}" for c in by})
    within = (rows["_v"] >= other["_lo"]) & (rows["_v"] <= other["_hi"])
    return rows.join(other, [*(rows[c].eqNullSafe(other[f"_r_{c}"]) for c in by), within]).drop(*(f"_r_{c}" for c in by))


def _narrowed(rows: DataFrame, state: DataFrame, by: list[str], even: bool, sent: bool) -> DataFrame:
    """``state`` with each rank's interval cut down to one bin."""
    open_ = state.where("_lo < _hi")
    inside, key = _inside(rows, open_, by, sent), [*by, "_lo", "_hi"]
    if even:
        at = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS), F.lit(BINS - 1))
    else:
        cuts = inside.groupBy(*key).agg(F.percentile_approx("_v", [k / PIVOTS for k in range(1, PIVOTS)], 10_000).alias("_cuts"))
        cuts = F.broadcast(cuts) if sent else cuts
        inside = _joined(inside, cuts, key)
        # twice as many bins: those of the cuts themselves, so that values that very many rows have get one of their own
        at = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))
    bins = inside.groupBy(*key, "_below", at.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))  # a pass's bins
    bins = bins.withColumn("_base", F.col("_below") + upto - F.col("_c")).drop("_below")
    met = _joined(open_.select(*key, "_rank"), bins, key).where("_base <= _rank AND _rank < _base + _c")
    new = met.select(*by, "_rank", F.col("_c").alias("_n"), F.col("_first").alias("_lo"), F.col("_last").alias("_hi"), F.col("_base").alias("_below"))
    return new.unionByName(state.where("NOT _lo < _hi").select(new.columns))
