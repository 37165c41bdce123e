"""The studies from their inputs to their decisions and files: primary, external, between venues, sensitivity, audit, verification.

Configuration is a mapping as read from YAML. Paths in it are taken from ``base``. Every runner refuses to replace decisions
that are there; seals are checked before a result is computed. What reaches the driver are summary tables.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import book, collection, gates, panel, regression, synchronization
from ..sources import archives, calendar, catalog
from . import collector, months, reports, sinks, studies

#: Layers of text data that no study may use.
EXCLUDED = ("news", "reddit", "sentiment")
PANEL = ["bucket_start", "symbol", "bucket_return", "total_quote_quantity", "transaction_count", "aggressor_imbalance"]


def _plain(at: str) -> str:
    """A UTC time of the configuration as Spark's time without zone reads it."""
    return str(at).replace("Z", "").replace("T", " ")


def split_of(config: Mapping) -> tuple[tuple[str, str], tuple[str, str]]:
    s = config["sample_split"]
    return (_plain(s["development_start"]), _plain(s["development_end_exclusive"])), (_plain(s["oos_start"]), _plain(s["oos_end_exclusive"]))


def output(config: Mapping, base: str) -> str:
    """The study's folder; an error if it holds decisions."""
    out = os.path.join(base, config["output"]["base_dir"])
    if os.path.exists(f"{out}/decisions.csv"):
        raise FileExistsError(f"{out} holds decisions")
    return out


def sealed(config: Mapping, path: str, base: str, excluded=EXCLUDED, others: Mapping[str, str] | None = None) -> dict | None:
    """The seal's content, checked; None for a study without a protocol."""
    p = config.get("protocol")
    return p and gates.seal(os.path.join(base, p["path"]), path, os.path.join(base, p["seal_path"]), excluded, others)


def write(tables: Mapping[str, pd.DataFrame | DataFrame], out: str) -> None:
    """Summary tables as CSV, panels (Spark's) as Parquet under intermediate."""
    for name, t in tables.items():
        if isinstance(t, DataFrame):
            sinks.table(t, f"{out}/intermediate/{name}.parquet")
        else:
            sinks.small_csv(t, f"{out}/{name}.csv")


def papers(config: Mapping, path: str, out: str, kind: str, tables: Mapping[str, pd.DataFrame], panels: Mapping[str, DataFrame], said: Mapping, seal: dict | None, base: str) -> None:
    """The figures' data, the report, a snapshot of the configuration and protocol, the seal's check, provenance, and the summary."""
    drawn = reports.figures(tables, panels, list(config["data"]["symbols"]))
    for name, data in drawn.items():
        sinks.small_csv(data, f"{out}/figures/{name}.csv")
    sinks.document(reports.written(kind, tables, [f"figures/{n}.csv" for n in drawn]), f"{out}/report.md")
    sinks.snapshot(config, f"{out}/config_snapshot.yaml")
    if seal:
        with open(os.path.join(base, config["protocol"]["path"]), encoding="utf-8") as f:
            sinks.document(f.read(), f"{out}/protocol_snapshot.md")
        sinks.document(seal, f"{out}/preregistration_seal_verification.json")
    sinks.document(sinks.provenance(dict(config), [path], **{k: config.get("sample_split", {}).get(k) for k in ("development_start", "development_end_exclusive", "oos_start", "oos_end_exclusive")}), f"{out}/provenance.json")
    sinks.document({**said, "intentional_herding_identified": False, "directional_alpha_tested": False, "news_reddit_sentiment_used": False}, f"{out}/run_summary.json")


def core(spot: DataFrame, config: Mapping) -> tuple[dict[str, pd.DataFrame], dict[str, DataFrame]]:
    """Summaries and panels that the primary and the external study share: residuals, synchronisation, composites, lead-lag, bootstrap."""
    d, a = config["data"], config["analysis"]
    split, interval, symbols = split_of(config), int(d["expected_interval_minutes"]), list(d["symbols"])
    x = panel.spot_features(spot.select(PANEL), len(symbols), *split)
    if x.where("sample_split = 'excluded'").take(1):
        raise ValueError("the split doesn't cover the panel")
    rows, coefficients = regression.residualized(x, "aggressor_imbalance", panel.design(x))
    rows = rows.persist()  # a row for each asset and bucket
    oos = rows.where("sample_split = 'oos'").select("bucket_start", "symbol", "residual_z")
    rules = {"minimum_correlation_excess": a["synchronization_minimum_correlation_excess"], "minimum_alignment_ratio": a["synchronization_minimum_alignment_ratio"], "fdr_alpha": a["fdr_alpha"]}
    sync = studies.synchronisation(oos, 1440 // interval, "year", symbols, a["null_repetitions"], a["minimum_shift_days"], a["alignment_minimum_assets"], a["null_seed"], rules)
    dev = F.col("sample_split") == "development"
    flows = None
    for name, group in (("major_flow", d["major_symbols"]), ("alt_flow", d["alt_symbols"]), ("spot_futures5_flow", d.get("futures_symbols"))):
        if group:
            mean = rows.where(F.col("symbol").isin(list(group))).groupBy("bucket_start").agg(F.any_value("sample_split").alias("sample_split"), F.avg("residual_z").alias("_m"))
            one = regression.standardised(mean, "_m", name, [], dev).drop("_m")
            flows = one if flows is None else flows.join(one.drop("sample_split"), "bucket_start")
    flows = flows.persist()  # a row a bucket
    there, back = ("major_flow", "alt_flow"), ("alt_flow", "major_flow")
    horizons = {h: h // interval for h in a["lead_horizons_minutes"]}
    lead = studies.lead_lag(flows, {"major_to_alt": there, "alt_to_major": back}, horizons, a["hac_maxlags"], same_day=False)
    rng = np.random.default_rng(a["bootstrap_seed"])
    boot = pd.DataFrame([studies.bootstrap_summary(studies.bootstrap_difference(flows, there, back, steps, a["bootstrap_repetitions"], rng, False), h) for h, steps in horizons.items()])
    pairs = synchronization.pairwise_corr(oos, "residual_z")
    tables = {"residualization_coefficients": coefficients.toPandas(), "residualization_diagnostics": regression.diagnostics(rows, "aggressor_imbalance").toPandas(), "synchronization_summary": sync, "pairwise_residual_correlations": pairs.toPandas(), "lead_lag_summary": lead, "lead_lag_direction_bootstrap": boot}
    kept = rows.select("bucket_start", "symbol", "sample_split", "aggressor_imbalance", F.col("fitted").alias("aggressor_fitted"), F.col("residual").alias("aggressor_residual"), F.col("residual_z").alias("aggressor_residual_z"))
    return tables, {"aggressor_residual_panel": kept, "flow_composites": flows}


def futures(spark: SparkSession, config: Mapping, base: str, flows: DataFrame, taker: str) -> tuple[pd.DataFrame, DataFrame, DataFrame]:
    """The confirmation's summary, the futures' buckets and the archives' inventory, from daily zips chosen by the date in their name."""
    d, a = config["data"], config["analysis"]
    (start, split), (_, end) = split_of(config)
    wanted = sorted(f for s in d["futures_symbols"] for f in archives.daily_files(glob.glob(f"{os.path.join(base, d['futures_archive_dir'])}/{s}/metrics/{s}-metrics-*.zip"), start[:10], _next_day(end)))
    lacking = [s for s in d["futures_symbols"] if not any(f"/{s}/metrics/" in f for f in wanted)]
    if lacking:
        raise FileNotFoundError(f"no futures metrics of {', '.join(lacking)}")
    raw = archives.zipped_metrics(spark, *wanted).persist()  # read for the checks, the buckets and the inventory
    buckets = panel.futures_buckets(archives.futures_metrics(raw, start, end), f"{int(d['expected_interval_minutes'])} minutes", taker).persist()
    joined = studies.futures_joined(buckets, flows, list(d["futures_symbols"]), split, "spot_futures5_flow")
    return studies.futures_summary(joined, a["futures_event_quantile"], a["hac_maxlags"]), buckets, archives.metrics_inventory(raw)


def _next_day(end: str) -> str:
    """The first date that no bucket before ``end`` has."""
    at = pd.Timestamp(end)
    return (at if at == at.normalize() else at + pd.Timedelta(days=1)).strftime("%Y-%m-%d")


def primary(spark: SparkSession, config: Mapping, path: str, base: str = ".") -> dict[str, pd.DataFrame]:
    """Spot synchronisation, cascade and, with futures symbols in the configuration, their confirmation; then the decisions."""
    gates.frozen(config, {}, EXCLUDED)
    seal, out = sealed(config, path, base), output(config, base)
    spot = spark.read.parquet(os.path.join(base, config["data"]["spot_input_path"]))
    spot = spot.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))
    coverage = gates.spot(spot, config["data"])
    tables, panels = core(spot, config)
    tables = {"spot_coverage": coverage, **tables}
    if config["data"].get("futures_symbols"):
        tables["futures_confirmation_summary"], panels["futures_metrics"], inventory = futures(spark, config, base, panels["flow_composites"], "mean")
        tables["futures_file_manifest"] = inventory.toPandas()  # a row a file
        decisions = gates.study(tables["synchronization_summary"], tables["lead_lag_summary"], tables["lead_lag_direction_bootstrap"], tables["futures_confirmation_summary"], config["analysis"])
    else:
        decisions = gates.replication(tables["synchronization_summary"], tables["lead_lag_summary"], tables["lead_lag_direction_bootstrap"], config["analysis"], "spot")
    return _finish(config, path, base, out, "primary", tables, panels, decisions, seal)


def external(spark: SparkSession, config: Mapping, path: str, base: str = ".", others: Mapping[str, str] | None = None) -> dict[str, pd.DataFrame]:
    """The same study on a second provider's monthly archives of ticks, collected month by month, compared with the first one's stored summaries (``compared_with``)."""
    gates.frozen(config, {}, EXCLUDED)
    source, d = config["source"], config["data"]
    seal, out = sealed(config, path, base, (*EXCLUDED, "twitter_x"), others), output(config, base)
    interval = int(d["expected_interval_minutes"])
    found, manifest = months.collect(spark, config, base, out)
    buckets = found.persist()
    whole = panel.complete_buckets(buckets, len(d["symbols"]))
    grid = calendar.spine(spark, _plain(d["expected_start"]), _plain(d["expected_end_exclusive"]), f"{interval} minutes").count()
    share = whole.count() / grid
    if share < d["minimum_complete_intersection_share"]:
        raise ValueError(f"only {share:.5f} of the buckets have every asset")
    kept = buckets.join(whole, "bucket_start", "left_semi")
    coverage = buckets.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("bucket_start").alias("start"), F.max("bucket_start").alias("end")).withColumns({"available_share": F.col("rows") / grid, "complete_intersection_share": F.lit(share)}).toPandas()
    tables, panels = core(kept, config)
    tables = {"source_coverage": coverage, "source_file_manifest": manifest, **tables}
    if config.get("compared_with"):
        old = {n: spark.createDataFrame(archives.stored(f"{os.path.join(base, config['compared_with'])}/{n}.csv")) for n in ("synchronization_summary", "lead_lag_summary")}
        new = {n: spark.createDataFrame(tables[n]) for n in old}
        lead = lambda t: t["lead_lag_summary"].withColumn("metric", F.concat_ws("_", "direction", "horizon_minutes"))
        tables["provider_comparison"] = studies.provider_comparison(new["synchronization_summary"], lead(new), old["synchronization_summary"], lead(old)).toPandas()
    decisions = gates.replication(tables["synchronization_summary"], tables["lead_lag_summary"], tables["lead_lag_direction_bootstrap"], config["analysis"], source["provider"].lower())
    return _finish(config, path, base, out, "external", tables, {"trade_buckets": kept, **panels}, decisions, seal)


def cross(spark: SparkSession, config: Mapping, path: str, base: str = ".") -> dict[str, pd.DataFrame]:
    """Agreement and transmission between two venues, from the residual panels at ``data.<venue>_residual_path``."""
    gates.frozen(config, {}, EXCLUDED)
    d, a = config["data"], config["analysis"]
    seal, out = sealed(config, path, base), output(config, base)
    venues = {k.removesuffix("_residual_path"): os.path.join(base, v) for k, v in d.items() if k.endswith("_residual_path")}
    first, second = venues
    rows = archives.residuals(spark, venues).persist()  # a row for each venue, asset and bucket
    coverage = gates.venues(rows, d, split_of(config)[0][1])
    dev = F.col("sample_split") == "development"
    mean = rows.groupBy("bucket_start", "venue").agg(F.any_value("sample_split").alias("sample_split"), F.avg("flow").alias("_m"))
    z = regression.standardised(mean, "_m", "_z", ["venue"], dev)
    flows = z.groupBy("bucket_start").agg(F.any_value("sample_split").alias("sample_split"), *(F.max(F.when(F.col("venue") == v, F.col("_z"))).alias(f"{v}_flow") for v in venues)).persist()
    interval = int(d["expected_interval_minutes"])
    sync = studies.cross_synchronisation(rows, flows, first, second, 1440 // interval, "year", a["extreme_event_quantile"], a["null_repetitions"], a["minimum_shift_days"], a["null_seed"])
    there, back = f"{first}_to_{second}", f"{second}_to_{first}"
    ways = {there: (f"{first}_flow", f"{second}_flow"), back: (f"{second}_flow", f"{first}_flow")}
    lead = studies.lead_lag(flows, ways, {h: h // interval for h in a["lead_horizons_minutes"]}, a["hac_maxlags"], same_day=True)
    boot = studies.bootstrap_difference(flows, *ways.values(), int(a["transmission_primary_horizon_minutes"]) // interval, a["bootstrap_repetitions"], np.random.default_rng(a["bootstrap_seed"]), True)
    decisions = gates.cross_venue(sync, lead, boot["difference"], a, there, back)
    tables = {"source_coverage": coverage, "synchronization_summary": sync, "lead_lag_summary": lead, "lead_lag_direction_bootstrap": boot}
    return _finish(config, path, base, out, "cross", tables, {"cross_venue_common_flows": flows}, decisions, seal)


def sensitivity(spark: SparkSession, config: Mapping, path: str, base: str = ".") -> dict[str, pd.DataFrame]:
    """The futures confirmation by each bucket's last taker figure, beside the primary one by means, whose decision it never replaces."""
    sealed(config, path, base)
    done = os.path.join(base, config["output"]["base_dir"])
    out = f"{done}/futures_aggregation_sensitivity"
    if os.path.exists(f"{out}/futures_aggregation_comparison.csv"):
        raise FileExistsError(f"{out} holds a comparison")
    by_mean = archives.stored(f"{done}/futures_confirmation_summary.csv")
    by_last, buckets, _ = futures(spark, config, base, spark.read.parquet(f"{done}/intermediate/flow_composites.parquet"), "last")
    quality = buckets.groupBy(F.col("source_rows").alias("source_rows_per_bucket")).agg(F.count("*").alias("bucket_asset_rows")).orderBy("source_rows_per_bucket").toPandas()
    quality["share"] = quality["bucket_asset_rows"] / quality["bucket_asset_rows"].sum()
    tables = {"futures_confirmation_last_summary": by_last, "futures_source_row_quality": quality, "futures_aggregation_comparison": pd.concat([by_mean.assign(aggregation="mean_primary"), by_last.assign(aggregation="last_sensitivity")], ignore_index=True)}
    write(tables, out)
    passed = {"primary_mean_gate_passed": gates.futures(by_mean, config["analysis"]), "last_snapshot_gate_passed": gates.futures(by_last, config["analysis"])}
    sinks.document(reports.written("sensitivity", tables) + "\n" + "\n".join(f"- {k}: {v}" for k, v in passed.items()) + "\n", f"{out}/report.md")
    sinks.document({"status": "complete", "analysis_type": "post_result_sensitivity", **passed, "primary_decision_replaced": False, "news_reddit_sentiment_used": False}, f"{out}/run_summary.json")
    return tables


def audit(spark: SparkSession, config: Mapping, path: str, base: str = ".", listed: DataFrame | None = None) -> dict[str, pd.DataFrame]:
    """A pilot archive's books and gates, and what whole designs would need. ``listed``: the catalogue, instead of asking for it."""
    d, a = config["data"], config["audit"]
    out = os.path.join(base, config["output"]["base_dir"])
    files = listed if listed is not None else catalog.fetch(spark, d["symbols"], d["sample_dates"], d["catalog_endpoint"], str(d["module"]), d["instrument_type"])
    pilot = files.where((F.col("symbol") == d["pilot_symbol"]) & (F.col("date") == d["pilot_date"]) & F.col("available")).collect()
    if len(pilot) != 1:
        raise RuntimeError("the pilot's archive isn't listed as available")
    archive = os.path.join(base, d["archive_dir"], pilot[0]["filename"])
    catalog.download(pilot[0]["url"], archive, pilot[0]["size_mb"])
    messages, days, minutes = collector.archive_figures(spark, [(archive, d["pilot_symbol"], d["pilot_date"])], int(a["sample_interval_seconds"]))
    summary = days.toPandas()
    tables = {"archive_catalog_sample": files.toPandas(), "pilot_audit_summary": summary, "resource_estimates": collection.resources(files, int(a["confirmatory_window_days"]), int(a["full_history_days"])).toPandas(), "quality_decisions": gates.pilot(files, summary.iloc[0].to_dict(), a)}
    write(tables, out)
    sinks.table(minutes, f"{out}/pilot_minute_books.parquet", overwrite=True)
    ready = bool(gates.one(tables["quality_decisions"], quality_gate="bounded_l2_study_ready")["passed"])
    papers(config, path, out, "audit", tables, {}, {"bounded_l2_study_ready": ready}, None, base)
    messages.unpersist()
    minutes.unpersist()
    return tables


def _finish(config, path, base, out, kind, tables, panels, decisions, seal) -> dict[str, pd.DataFrame]:
    """Files in an order that leaves the decisions for last: a run that died can be repeated."""
    write({**tables, **panels}, out)
    said = {"status": "complete", **{r["decision"]: r["classification"] for _, r in decisions.iterrows()}}
    papers(config, path, out, kind, {**tables, "decisions": decisions}, panels, said, seal, base)
    write({"decisions": decisions}, out)
    return {**tables, "decisions": decisions}


def verify(config: Mapping, path: str, base: str = ".", kind: str = "primary") -> dict:
    """Recomputes the decisions from the stored summaries, and checks the seal, the families' sizes and what no study may claim."""
    out, a = os.path.join(base, config["output"]["base_dir"]), config["analysis"]
    seal = sealed(config, path, base, (*EXCLUDED, "twitter_x") if kind == "external" else EXCLUDED, config.get("sealed_with"))
    names = ["synchronization_summary", "lead_lag_summary", "lead_lag_direction_bootstrap", "decisions"] + (["futures_confirmation_summary"] if kind == "primary" else [])
    missing = [n for n in (*(f"{x}.csv" for x in names), "report.md", "run_summary.json") if not os.path.isfile(f"{out}/{n}")]
    if missing:
        raise FileNotFoundError(f"missing results: {', '.join(missing)}")
    t = {n: archives.stored(f"{out}/{n}.csv") for n in names}
    sync, lead, boot, stored = (t[n] for n in names[:4])
    sizes = {"synchronization": (sync, 2), "lead-lag": (lead, 2 * len(a["lead_horizons_minutes"]))}
    if kind == "primary":
        again = gates.study(sync, lead, boot, t["futures_confirmation_summary"], a)
        sizes["futures"] = (t["futures_confirmation_summary"], 2)
    elif kind == "external":
        again = gates.replication(sync, lead, boot, a, config["source"]["provider"].lower())
    else:
        first, second = (k.removesuffix("_residual_path") for k in config["data"] if k.endswith("_residual_path"))
        again = gates.cross_venue(sync, lead, boot["difference"], a, f"{first}_to_{second}", f"{second}_to_{first}")
        if len(boot) != a["bootstrap_repetitions"]:
            raise ValueError("draws of the bootstrap are missing")
    gates.same_tables(stored, again)
    gates.families(sizes)
    for name, passed, said in gates.LIMITS:
        row = gates.one(stored, decision=name)
        if bool(row["passed"]) is not passed or row["classification"] != said:
            raise ValueError(f"the limit {name} isn't kept")
    found = {"verified": True, "preregistration_seal_verified": bool(seal), "decision_recomputation_match": True, **{f"{k}_family_size": n for k, (_, n) in sizes.items()}}
    sinks.document(found, f"{out}/verification.json")
    return found
