"""The studies as plans over the operators: lazy DataFrames up to small summary tables, which the driver decides on."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import regression, synchronization


def futures_joined(futures: DataFrame, flows: DataFrame, symbols: list[str], split: str, spot: str = "five_flow") -> DataFrame:
    """bucket_start, sample_split, spot_flow, futures_flow: complete buckets, standardised by symbol and again as a mean, on the development split."""
    five = futures.where(F.col("symbol").isin(symbols) & F.col("taker_direction").isNotNull())
    whole = five.groupBy("bucket_start").agg(F.count("*").alias("_n")).where(F.col("_n") == len(symbols)).select("bucket_start")
    dev = F.col("bucket_start") < F.lit(split).cast("timestamp_ntz")
    z = regression.standardised(five.join(whole, "bucket_start", "left_semi"), "taker_direction", "_z", ["symbol"], dev)
    mean = regression.standardised(z.groupBy("bucket_start").agg(F.avg("_z").alias("_m")), "_m", "futures_flow", [], dev)
    return flows.select("bucket_start", "sample_split", F.col(spot).alias("spot_flow")).join(mean.select("bucket_start", "futures_flow"), "bucket_start").dropna()


def futures_figures(joined: DataFrame, quantile: float) -> DataFrame:
    """observations, beta (of spot on futures, beside the futures' lag within the sample), event_count, matches."""
    edge = joined.where("sample_split = 'development'").agg(F.percentile(F.abs("spot_flow"), quantile).alias("edge"))
    oos = joined.where("sample_split = 'oos'").withColumn("lagged", F.lag("futures_flow").over(Window.orderBy("bucket_start"))).crossJoin(F.broadcast(edge))
    event = F.abs("spot_flow") >= F.col("edge")
    counts = oos.agg(F.count_if(event).alias("event_count"), F.count_if(event & (F.signum("spot_flow") == F.signum("futures_flow"))).alias("matches"))
    fit = oos.where("lagged IS NOT NULL").agg(*regression.moments(F.col("spot_flow"), F.col("lagged"), F.col("futures_flow"))).withColumns(regression.slopes())
    return fit.select(F.col("n").cast("long").alias("observations"), F.col("beta1").alias("beta")).crossJoin(F.broadcast(counts))


def futures_summary(joined: DataFrame, quantile: float, lags: int) -> pd.DataFrame:
    """test, observations, estimate, standard_error, test_statistic, p_value, event_count, q_value: the regression with robust errors, and the sign test."""
    oos = joined.where("sample_split = 'oos'").withColumn("lagged", F.lag("futures_flow").over(Window.orderBy("bucket_start")))
    fit = known(regression.hac(oos, "futures_flow", "spot_flow", "lagged", "bucket_start", lags))
    counts = futures_figures(joined, quantile).first()
    n, k = counts["event_count"], counts["matches"]
    rows = [
        ("spot_to_futures_flow_regression", fit["n"], fit["beta"], fit["se"], fit["t"], numbers.normal_p(fit["t"]), math.nan),
        ("extreme_event_direction_concordance", n, k / n if n else math.nan, math.nan, math.nan, numbers.binomial_tail(k, n) if n else math.nan, n),
    ]
    out = pd.DataFrame(rows, columns=["test", "observations", "estimate", "standard_error", "test_statistic", "p_value", "event_count"])
    return out.assign(q_value_bh_fdr=adjusted(out["p_value"]))


def known(fit: DataFrame) -> dict:
    """The only row of a fit; what a design without full rank leaves open is NaN."""
    return {k: math.nan if v is None else v for k, v in fit.first().asDict().items()}


def adjusted(p) -> np.ndarray:
    """Benjamini-Hochberg q values of a short list; missing p stay missing."""
    p = np.asarray(p, float)
    out = np.full(len(p), np.nan)
    ok = np.flatnonzero(np.isfinite(p))
    order = ok[np.argsort(p[ok], kind="stable")]
    if len(order):
        q = np.minimum.accumulate((p[order] * len(order) / np.arange(1, len(order) + 1))[::-1])[::-1]
        out[order] = np.clip(q, 0, 1)
    return out


def lead_lag(flows: DataFrame, directions: Mapping[str, tuple[str, str]], horizons: Mapping[int, int], lags: int, same_day: bool) -> pd.DataFrame:
    """A row for each direction (name: source, target) and horizon (minutes: steps): beta, robust error, t, p, interval, both halves' betas, q over the family."""
    oos, rows = flows.where("sample_split = 'oos'"), []
    for minutes, steps in horizons.items():
        for name, (source, target) in directions.items():
            d = regression.lead_design(oos, source, target, steps, same_day)
            fit = known(regression.hac(d, "y", "x1", "x2", "bucket_start", lags))
            halves = {r["half"]: r["beta"] for r in regression.half_betas(d).collect()}
            low, high = numbers.normal_ci(fit["beta"], fit["se"])
            rows.append((name, minutes, fit["n"], fit["beta"], fit["se"], fit["t"], numbers.normal_p(fit["t"]), low, high, halves.get(1), halves.get(2)))
    columns = "direction horizon_minutes observations standardized_beta standard_error_hac t_stat_hac p_value_hac ci_lower_95 ci_upper_95 first_half_beta second_half_beta".split()
    out = pd.DataFrame(rows, columns=columns)
    return out.assign(q_value_bh_fdr=adjusted(out["p_value_hac"]))


def bootstrap_difference(flows: DataFrame, first: tuple[str, str], second: tuple[str, str], steps: int, draws: int, rng: np.random.Generator, same_day: bool) -> pd.DataFrame:
    """draw, difference of the two directions' betas over the same resampled days, drawn from those that both have."""
    oos = flows.where("sample_split = 'oos'")
    one, two = (regression.lead_design(oos, *x, steps, same_day) for x in (first, second))
    days = regression.shared_days(one, two)
    drawn = numbers.day_draws(flows.sparkSession, days.count(), draws, rng)
    a, b = (regression.day_bootstrap(x, drawn, days=days).withColumnRenamed("beta", name) for x, name in ((one, "a"), (two, "b")))
    return a.join(b, "draw").select("draw", (F.col("a") - F.col("b")).alias("difference")).orderBy("draw").toPandas()


def bootstrap_summary(differences: pd.DataFrame, minutes: int) -> dict:
    x = differences["difference"].to_numpy()
    return {"horizon_minutes": minutes, "repetitions": len(x), "mean_beta_difference": float(x.mean()), "ci_lower_95": float(np.quantile(x, 0.025)), "ci_upper_95": float(np.quantile(x, 0.975)), "one_sided_p_value": float((1 + (x <= 0).sum()) / (len(x) + 1))}


def synchronisation(panel: DataFrame, slots: int, block: str, symbols: list[str], draws: int, least_shift: int, least_aligned: int, seed: int, gates: Mapping[str, float]) -> pd.DataFrame:
    """The two metrics against their circular-shift nulls, with q values and gates. ``panel``: bucket_start, symbol, residual_z out of sample."""
    b = synchronization.blocks(panel, slots, block)
    sizes = [(r["block"], r["days"]) for r in b.select("block", "days").distinct().collect()]
    offsets = numbers.shift_draws(panel.sparkSession, sizes, symbols, draws, least_shift, seed)
    seen = synchronization.pairwise_corr(b, "residual_z").agg(F.avg("correlation").alias("observed"))
    one = synchronization.null_summary(synchronization.shifted_correlations(b, offsets, "residual_z"), "mean_pairwise_correlation", seen).toPandas()
    seen = synchronization.alignment(b, "residual_z", least_aligned).select(F.col("alignment_rate").alias("observed"))
    two = synchronization.null_summary(synchronization.alignment(synchronization.shifted(b, offsets, "residual_z"), "shifted", least_aligned, "draw"), "alignment_rate", seen).toPandas()
    out = pd.concat([one, two], ignore_index=True)
    out.insert(0, "metric", ["mean_pairwise_correlation", "extreme_alignment_rate"])
    out["q_value_bh_fdr"] = adjusted(out["p_value"])
    out["above_null_p95"] = out["observed"] > out["null_p95"]
    out["effect_size_pass"] = [out["excess"][0] >= gates["minimum_correlation_excess"], out["ratio"][1] >= gates["minimum_alignment_ratio"]]
    out["gate_pass"] = (out["q_value_bh_fdr"] <= gates["fdr_alpha"]) & out["above_null_p95"] & out["effect_size_pass"]
    return out


def cross_synchronisation(panels: DataFrame, flows: DataFrame, first: str, second: str, slots: int, block: str, quantile: float, draws: int, least_shift: int, seed: int) -> pd.DataFrame:
    """Agreement of two venues against shifts of the second as a whole: same-asset correlation, and concordance of extreme common flows.

    ``panels``: bucket_start, symbol, venue, flow, sample_split. ``flows``: bucket_start, sample_split, and a common flow of each
    venue, ``<venue>_flow``, standardised on the development split, whose quantile is the threshold of an extreme.
    """
    v = synchronization.blocks(panels.where("sample_split = 'oos'"), slots, block)
    sizes = [(r["block"], r["days"]) for r in v.select("block", "days").distinct().collect()]
    offsets = numbers.shift_draws(panels.sparkSession, sizes, None, draws, least_shift, seed)
    one, two = (v.where(F.col("venue") == x) for x in (first, second))
    moved = synchronization.shifted(two, offsets, "flow")
    left = one.select("bucket_start", "symbol", F.col("flow").alias("l"))

    def same_asset(right, value, *keys):
        return left.join(right, ["bucket_start", "symbol"]).groupBy(*keys, "symbol").agg(F.corr("l", value).alias("c")).groupBy(*keys).agg(F.avg("c").alias("observed"))

    l, r = f"{first}_flow", f"{second}_flow"
    dev = flows.where("sample_split = 'development'")
    e1, e2 = dev.agg(F.percentile(F.abs(l), quantile), F.percentile(F.abs(r), quantile)).first()
    oos = flows.where("sample_split = 'oos'")
    met = synchronization.concordance(oos, l, r, F.lit(e1), F.lit(e2))
    rows = [
        synchronization.null_summary(same_asset(moved, "shifted", "draw").withColumnRenamed("observed", "v"), "v", same_asset(two.select("bucket_start", "symbol", "flow"), "flow")),
        synchronization.null_summary(synchronization.concordance_null(moved, two, oos, "flow", l, r, F.lit(e1), F.lit(e2)), "concordance", met.select(F.col("concordance").alias("observed"))),
    ]
    out = pd.concat([x.toPandas() for x in rows], ignore_index=True)
    out.insert(0, "metric", ["mean_same_asset_correlation", "extreme_direction_concordance"])
    out["event_count"] = [math.nan, met.first()["event_count"]]
    return out.assign(q_value_bh_fdr=adjusted(out["p_value"]))


def provider_comparison(new_sync: DataFrame, new_lead: DataFrame, old_sync: DataFrame, old_lead: DataFrame) -> DataFrame:
    """family, metric, old_estimate, new_estimate, ratio (of synchronisation metrics only)."""
    def both(family, new, old, value, ratio):
        j = new.select("metric", F.col(value).alias("new_estimate")).join(old.select("metric", F.col(value).alias("old_estimate")), "metric")
        return j.select(F.lit(family).alias("family"), "metric", "old_estimate", "new_estimate", (F.try_divide("new_estimate", "old_estimate") if ratio else F.lit(None).cast("double")).alias("ratio"))

    return both("synchronization", new_sync, old_sync, "observed", True).unionByName(both("lead_lag", new_lead, old_lead, "standardized_beta", False))
