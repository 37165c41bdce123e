"""Agreement between series: correlations, alignment, concordance, and their circular-shift nulls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairwise_corr(panel: DataFrame, value: str) -> DataFrame:
    """left_symbol, right_symbol, correlation of every unordered pair: a self-join on the bucket, so as wide as a bucket's assets."""
    a, b = panel.select("bucket_start", F.col("symbol").alias("left_symbol"), F.col(value).alias("_l")), panel.select("bucket_start", F.col("symbol").alias("right_symbol"), F.col(value).alias("_r"))
    return a.join(b, "bucket_start").where("left_symbol < right_symbol").groupBy("left_symbol", "right_symbol").agg(F.corr("_l", "_r").alias("correlation"))


def corr_matrix(pairs: DataFrame, symbols: list[str]) -> DataFrame:
    """The symmetric matrix in long form, with its diagonal."""
    one = pairs.sparkSession.createDataFrame([(s, s, 1.0) for s in symbols], pairs.schema)
    return pairs.union(pairs.select("right_symbol", "left_symbol", "correlation")).union(one)


def alignment(panel: DataFrame, value: str, least: int, *keys: str) -> DataFrame:
    """alignment_rate: the share of buckets in which at least ``least`` assets have one sign (zero has none); intensity: the mean of |mean|."""
    one = panel.groupBy(*keys, "bucket_start").agg(F.count_if(F.col(value) > 0).alias("_up"), F.count_if(F.col(value) < 0).alias("_down"), F.avg(value).alias("_mean"))
    return one.groupBy(*keys).agg(F.avg((F.greatest("_up", "_down") >= least).cast("double")).alias("alignment_rate"), F.avg(F.abs("_mean")).alias("intensity"))


def concordance(df: DataFrame, left: str, right: str, left_threshold, right_threshold, *keys: str) -> DataFrame:
    """Share of equal signs (two zeros agree) and number of rows where either side is beyond its threshold; without any, NaN and 0."""
    event = (F.abs(left) > left_threshold) | (F.abs(right) > right_threshold)
    same = F.when(event, (F.signum(left) == F.signum(right)).cast("double"))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(same), F.lit(float("nan"))).alias("concordance"), F.count(same).alias("event_count"))


def blocks(panel: DataFrame, slots: int, half: str = "year") -> DataFrame:
    """block (half of a year or of a month), day (0, 1, ... in the block), slot of each bucket, and days of the block."""
    ts = F.col("bucket_start")
    block = F.year(ts) * 2 + F.floor((F.month(ts) - 1) / 6) if half == "year" else (F.year(ts) * 12 + F.month(ts) - 1) * 2 + F.when(F.dayofmonth(ts) > 15, 1).otherwise(0)
    date = F.to_date(ts)
    days = panel.select(block.cast("long").alias("block"), date.alias("_date")).distinct()  # a row a day
    days = days.withColumn("day", F.row_number().over(Window.partitionBy("block").orderBy("_date")) - 1).withColumn("days", F.count("*").over(Window.partitionBy("block")))
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) * slots / 1440).cast("int")
    return panel.withColumn("_date", date).join(F.broadcast(days), "_date").withColumn("slot", slot).drop("_date")  # as long as the calendar


def shifted(panel: DataFrame, offsets: DataFrame, value: str) -> DataFrame:
    """draw and the panel's buckets with values of (day - offset) mod days of the same block and slot.

    ``offsets``: draw, block, offset, and symbol where each asset has its own shift; without it the panel moves together.
    """
    by = ["block", "symbol"] if "symbol" in offsets.columns else ["block"]
    moved = panel.select("block", "symbol", "slot", "days", F.col("day").alias("_from"), F.col(value).alias("shifted")).join(F.broadcast(offsets), by).withColumn("day", F.pmod(F.col("_from") + F.col("offset"), F.col("days")).cast("int"))
    return moved.select("draw", "block", "symbol", "slot", "day", "shifted").join(panel.select("block", "symbol", "slot", "day", "bucket_start"), ["block", "symbol", "slot", "day"])


def spectra(z: DataFrame, value: str) -> DataFrame:
    """block, days, symbol, width, spectrum of ``z``: for each slot the Fourier transform along a block's days, missing buckets being 0.

    A group is one asset's block: days times slots numbers, however long the calendar is.
    """

    def transform(rows: pd.DataFrame) -> pd.DataFrame:
        days, width = int(rows["days"].iloc[0]), int(rows["slot"].max()) + 1
        table = np.zeros((days, width))
        np.add.at(table, (rows["day"].to_numpy(), rows["slot"].to_numpy()), rows[value].to_numpy(float))
        found = np.fft.rfft(table, axis=0)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "days": days, "symbol": rows["symbol"].iloc[0], "width": width, "spectrum": [found.tobytes()]})

    return z.select("block", "days", "symbol", "day", "slot", value).groupBy("block", "symbol").applyInPandas(transform, "block long, days long, symbol string, width int, spectrum binary")


def lagged_products(spectrum: DataFrame) -> DataFrame:
    """block, days, l_symbol, r_symbol, dots of each pair of a block: dots[g] is the sum of products of the left asset's values, g days on (around the block), and the right's."""
    names = spectrum.select("block", "symbol")
    pairs = names.withColumnRenamed("symbol", "l_symbol").join(names.withColumnRenamed("symbol", "r_symbol"), "block").where("l_symbol < r_symbol")
    l, r = (spectrum.select("block", "days", *(F.col(c).alias(f"{s}_{c}") for c in ("symbol", "width", "spectrum"))) for s in "lr")  # noqa: E741
    both = pairs.join(l, ["block", "l_symbol"]).join(r.drop("days"), ["block", "r_symbol"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dots = []
            for x in batch.select(["days", "l_width", "l_spectrum", "r_width", "r_spectrum"]).to_pylist():
                left, right = (np.frombuffer(x[f"{s}_spectrum"], complex).reshape(-1, x[f"{s}_width"]) for s in "lr")
                width = min(x["l_width"], x["r_width"])
                dots.append(np.fft.irfft((left[:, :width] * right[:, :width].conj()).sum(axis=1), x["days"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("block", "days", "l_symbol", "r_symbol")), pa.array(dots, pa.list_(pa.float64()))], names=["block", "days", "l_symbol", "r_symbol", "dots"])

    return both.mapInArrow(products, "block long, days long, l_symbol string, r_symbol string, dots array<double>")


def shifted_correlations(panel: DataFrame, offsets: DataFrame, value: str) -> DataFrame:
    """draw, mean_pairwise_correlation under per-asset shifts, from circular cross-correlations of the assets' days.

    For each block and pair the sums of products at every distance in days are one inverse transform, days log days; a draw
    then looks up the distance that its two shifts make. A shift is a permutation, so means and deviations stay.
    """
    stats = panel.groupBy("symbol").agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = panel.join(F.broadcast(stats), "symbol").select("block", "symbol", "slot", "day", "days", ((F.col(value) - F.col("_m")) / F.col("_s")).alias("z"))
    dots = lagged_products(spectra(z, "z"))
    # at output day d the days that meet are (d - offset) mod days of either side, so their distance is fixed by the offsets
    lo, ro = (offsets.select("draw", "block", F.col("symbol").alias(f"{s}_symbol"), F.col("offset").alias(f"{s}_offset")) for s in ("l", "r"))
    asked = lo.join(ro, ["draw", "block"]).where("l_symbol < r_symbol")
    met = dots.join(asked, ["block", "l_symbol", "r_symbol"]).select("draw", "l_symbol", "r_symbol", F.get("dots", F.pmod(F.col("r_offset") - F.col("l_offset"), F.col("days")).cast("int")).alias("dot"))
    n = panel.groupBy("symbol").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"))
    pairs = met.groupBy("draw", "l_symbol", "r_symbol").agg(F.sum("dot").alias("dot")).crossJoin(F.broadcast(n))
    return pairs.groupBy("draw").agg(F.avg(F.col("dot") / F.col("n")).alias("mean_pairwise_correlation"))


def concordance_null(moved: DataFrame, panel: DataFrame, flows: DataFrame, value: str, left: str, right: str, left_threshold, right_threshold) -> DataFrame:
    """draw, concordance, event_count of ``left`` with the common flow of a panel that was shifted.

    ``moved`` (draw, bucket_start, shifted) are the shifted assets of ``panel`` (bucket_start, ``value``), whose common flow is
    ``right`` in ``flows``. The shifted means are brought to that flow's scale by the line that turns the panel's own means into it.
    A mean that this puts at the threshold, but for rounding, isn't beyond it.
    """
    own = panel.groupBy("bucket_start").agg(F.avg(value).alias("_m")).join(flows.select("bucket_start", right), "bucket_start")
    line = own.agg((F.covar_pop("_m", right) / F.var_pop("_m")).alias("_slope"), F.avg("_m").alias("_center"), F.avg(right).alias("_level"))
    means = moved.groupBy("draw", "bucket_start").agg(F.avg("shifted").alias("_m")).crossJoin(F.broadcast(line))  # one row
    scaled = means.select("draw", "bucket_start", (F.col("_level") + F.col("_slope") * (F.col("_m") - F.col("_center"))).alias("_moved"))
    return concordance(scaled.join(flows.drop(right), "bucket_start"), left, "_moved", left_threshold, right_threshold + F.lit(1e-12), "draw")


def null_summary(nulls: DataFrame, value: str, observed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """observed, null_mean, null_std, null_p95, null_p99, p_value, excess, ratio: exact quantiles, NaN draws left out of means but counted in p."""
    keys = keys or []
    joined = nulls.join(F.broadcast(observed), keys) if keys else nulls.crossJoin(F.broadcast(observed))
    v = F.nanvl(value, F.lit(None).cast("double"))
    out = joined.groupBy(*keys).agg(
        F.max("observed").alias("observed"),
        F.avg(v).alias("null_mean"),
        F.stddev_samp(v).alias("null_std"),
        F.percentile(v, 0.95).alias("null_p95"),
        F.percentile(v, 0.99).alias("null_p99"),
        ((1 + F.count_if(v >= F.col("observed"))) / (F.count("*") + 1)).alias("p_value"),
    )
    return out.withColumns({"excess": F.col("observed") - F.col("null_mean"), "ratio": F.try_divide("observed", "null_mean")})


def benjamini_hochberg(df: DataFrame, p: str, name: str, by: list[str] | None = None) -> DataFrame:
    """q values of a family (of each group): running minimum from the largest p; null and NaN stay out and null."""
    ok = F.nanvl(F.col(p), F.lit(None).cast("double"))
    w = Window.partitionBy(*(by or [F.lit(0)]), F.col("_ok").isNotNull())
    ranked = df.withColumn("_ok", ok).withColumn("_rank", F.row_number().over(w.orderBy("_ok"))).withColumn("_n", F.count("*").over(w))
    q = F.min(F.col("_ok") * F.col("_n") / F.col("_rank")).over(w.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn(name, F.when(F.col("_ok").isNotNull(), F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))).drop("_ok", "_rank", "_n")
