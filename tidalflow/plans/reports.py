"""What each study's report says, and the data of its figures: small tables, formatted on the driver."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates
from . import sinks

Tables = Mapping[str, pd.DataFrame]


class Section(NamedTuple):
    """A heading, sentences made from the tables, and a table's columns: (name, heading, format)."""

    heading: str
    says: Callable[[Tables], list[str]] = lambda tables: []
    table: str | None = None
    columns: tuple[tuple[str, str, str], ...] = ()


def _decided(name: str) -> Callable[[Tables], list[str]]:
    def says(tables: Tables) -> list[str]:
        row = gates.one(tables["decisions"], decision=name)
        return [f"{name}: **{'supported' if row['passed'] else 'not supported'}** (`{row['classification']}`)"]

    return says


def _all(*parts: Callable[[Tables], list[str]]) -> Callable[[Tables], list[str]]:
    return lambda tables: [line for says in parts for line in says(tables)]


def _spot(tables: Tables) -> list[str]:
    c = tables["spot_coverage"].iloc[0]
    lines = [f"{int(c['rows']):,} rows, {int(c['timestamps']):,} buckets, {int(c['symbols'])} assets"] if "timestamps" in c else []
    return [*lines, *([f"from {c['start']} to {c['end']}"] if "start" in c else []), *([f"aggressor figures in {c['aggressor_available_share']:.2%} of the rows"] if "aggressor_available_share" in c else []), "coefficients and scales are fitted on the development split and held fixed out of sample"]


def _sources(tables: Tables) -> list[str]:
    return [", ".join(f"{k}: {v}" for k, v in row.items()) for row in tables["source_coverage"].to_dict("records")]


_SYNC = (("metric", "metric", "s"), ("observed", "observed", ".5f"), ("null_mean", "null mean", ".5f"), ("null_p95", "null p95", ".5f"), ("q_value_bh_fdr", "q", ".4g"), ("effect_size_pass", "effect size", "s"), ("gate_pass", "gate", "s"))
_LEAD = (("direction", "direction", "s"), ("horizon_minutes", "minutes", "d"), ("standardized_beta", "beta", ".5f"), ("t_stat_hac", "HAC t", ".3f"), ("q_value_bh_fdr", "q", ".4g"), ("first_half_beta", "beta, first half", ".5f"), ("second_half_beta", "beta, second half", ".5f"))
_BOOT = (("horizon_minutes", "minutes", "d"), ("mean_beta_difference", "mean difference", ".5f"), ("ci_lower_95", "from", ".5f"), ("ci_upper_95", "to", ".5f"), ("one_sided_p_value", "one-sided p", ".4g"))
_FUTURES = (("test", "test", "s"), ("observations", "n", ",d"), ("estimate", "estimate", ".5f"), ("p_value", "p", ".4g"), ("q_value_bh_fdr", "q", ".4g"))
_NULL = "The null shifts whole UTC days around half-year blocks, each asset by itself, which keeps autocorrelation and the pattern of the day."


def _resources(tables: Tables) -> list[str]:
    r = tables["resource_estimates"].set_index("design")["estimated_compressed_gb"]
    return [f"{label}: {r[name]:.1f} GB compressed" for name, label in (("bounded_confirmatory_window", "bounded window, all assets"), ("full_two_year_window", "whole window, all assets")) if name in r] + ["raw archives are read as streams and removed; features are what stays"]


def _catalogue(tables: Tables) -> list[str]:
    c = tables["archive_catalog_sample"]
    daily = c.groupby("date")["size_mb"].sum().mean() / 1000
    return [f"{c['symbol'].nunique()} assets on {c['date'].nunique()} days: {len(c)} files asked for, {int(c['available'].sum())} available", f"{daily:.2f} GB compressed on a sampled day"]


def _pilot(tables: Tables) -> list[str]:
    r = tables["pilot_audit_summary"].iloc[0]
    return [
        f"{r['symbol']} {r['date']}: {int(r['rows']):,} lines, {int(r['snapshots']):,} snapshots, {int(r['updates']):,} updates",
        f"first book: {int(r['initial_ask_levels'])} asks, {int(r['initial_bid_levels'])} bids; begins {int(r['start_delay_ms'])} ms late, ends {int(r['end_early_ms'])} ms early",
        f"{int(r['parse_errors'])} lines that can't be read, {int(r['out_of_order_rows'])} times that go back; {int(r['sample_count']):,} samples, {int(r['sampled_crossed_books'])} crossed",
    ]


def _ready(tables: Tables) -> list[str]:
    d = tables["quality_decisions"]
    failed = d.loc[~d["passed"].astype(bool) & (d["quality_gate"] != "bounded_l2_study_ready"), "quality_gate"].tolist()
    return ["every gate passed: a bounded study may be registered; this tests no hypothesis and no return"] if not failed else [f"the study isn't begun; gates that failed: {', '.join(failed)}"]


_FINAL = Section("Conclusion", lambda t: [f"`{gates.one(t['decisions'], decision='final')['classification']}`: a statement about order flow of the whole market, not about intent, and not about returns"] if (t["decisions"]["decision"] == "final").any() else [])
_LIMITS = Section("Limits", lambda t: ["trades have no accounts, so imitation on purpose can't be seen", "no future return, cost or strategy was tested", "no news, forum or sentiment data were used"])
#: Title and sections of each study's report.
STUDIES: dict[str, tuple[str, list[Section]]] = {
    "primary": ("Synchronisation of order flow across assets", [
        _FINAL, Section("Data", _spot), Section("Synchronisation", _all(lambda t: [_NULL], _decided("spot_synchronization")), "synchronization_summary", _SYNC),
        Section("From major to other assets", _decided("major_to_alt_cascade"), "lead_lag_summary", _LEAD), Section("Difference of the directions, days resampled", table="lead_lag_direction_bootstrap", columns=_BOOT),
        Section("Confirmation by futures", lambda t: _decided("futures_confirmation")(t) if "futures_confirmation_summary" in t else [], "futures_confirmation_summary", _FUTURES), _LIMITS]),
    "external": ("External validation on a second provider", [
        _FINAL, Section("Source", lambda t: [*_sources(t), f"{len(t['source_file_manifest'])} archives, {int(t['source_file_manifest']['raw_rows'].sum()):,} ticks"]), Section("Synchronisation", lambda t: [_NULL], "synchronization_summary", _SYNC),
        Section("From major to other assets", table="lead_lag_summary", columns=_LEAD), Section("Difference of the directions, days resampled", table="lead_lag_direction_bootstrap", columns=_BOOT),
        Section("Against the first provider", table="provider_comparison", columns=(("family", "family", "s"), ("metric", "metric", "s"), ("old_estimate", "first", ".5f"), ("new_estimate", "second", ".5f"), ("ratio", "ratio", ".3f"))), _LIMITS]),
    "cross": ("Order flow between venues", [
        _FINAL, Section("Sources", _sources), Section("Agreement", _decided("cross_venue_synchronization"), "synchronization_summary", (*_SYNC[:5], ("event_count", "events", ".0f"))),
        Section("Transmission", table="lead_lag_summary", columns=_LEAD), _LIMITS]),
    "sensitivity": ("Sensitivity to the futures' aggregation", [
        Section("What was changed", lambda t: ["each bucket's last figure in place of the mean; the primary decision stands whatever this gives"]), Section("Both aggregations", table="futures_aggregation_comparison", columns=(("aggregation", "aggregation", "s"), *_FUTURES)),
        Section("Rows a bucket", table="futures_source_row_quality", columns=(("source_rows_per_bucket", "source rows", "d"), ("bucket_asset_rows", "buckets", ",d"), ("share", "share", ".4f")))]),
    "audit": ("Availability and quality of order-book archives", [
        Section("Purpose", lambda t: ["whether full-depth books can be rebuilt from the archives, before any hypothesis is looked at"]), Section("Files", _catalogue), Section("One archive, read whole", _pilot), Section("Size", _resources), Section("Conclusion", _ready, "quality_decisions", (("quality_gate", "gate", "s"), ("passed", "passed", "s"), ("evidence", "evidence", "s")))]),
}


def _cell(value, form: str) -> str:
    if value is None or value != value:  # noqa: PLR0124
        return ""
    return format(int(value) if form.endswith("d") else value, form) if form != "s" else str(value)


def written(kind: str, tables: Tables, files: list[str] | None = None) -> str:
    """The report of a study as Markdown; sections of tables that it doesn't have are left out, and so are their columns."""
    title, sections = STUDIES[kind]
    out = [f"# {title}"]
    for s in sections:
        if s.table and s.table not in tables:
            continue
        body = "\n".join(f"- {x}" for x in s.says(tables))
        if s.table:
            t = tables[s.table]
            columns = [c for c in s.columns if c[0] in t.columns]
            rows = [[h for _, h, _ in columns], ["---"] * len(columns), *([_cell(r[n], form) for n, _, form in columns] for r in t.to_dict("records"))]
            body = "\n\n".join(x for x in (body, "\n".join(f"| {' | '.join(r)} |" for r in rows)) if x)
        if body:
            out.append(f"## {s.heading}\n\n{body}")
    if files:
        out.append("## Figures' data\n\n" + "\n".join(f"- `{x}`" for x in files))
    return "\n\n".join(out) + "\n"


def null_bars(sync: pd.DataFrame) -> pd.DataFrame:
    """metric, value, kind: a bar for what was observed, the null's mean and its 95th percentile."""
    return sync.melt("metric", ["observed", "null_mean", "null_p95"], "kind", "value")[["metric", "kind", "value"]]


def intervals(lead: pd.DataFrame) -> pd.DataFrame:
    """direction, horizon_minutes, beta, below, above: points with the lengths of their error bars."""
    return pd.DataFrame({"direction": lead["direction"], "horizon_minutes": lead["horizon_minutes"], "beta": lead["standardized_beta"], "below": lead["standardized_beta"] - lead["ci_lower_95"], "above": lead["ci_upper_95"] - lead["standardized_beta"]})


def figures(tables: Tables, panels: Mapping[str, DataFrame], symbols: list[str], bins: int = 40) -> dict[str, pd.DataFrame]:
    """The data of a study's figures by name: null bars, intervals, the correlations' matrix, and the density of its two flows out of sample."""
    out = {}
    if "synchronization_summary" in tables:
        out["null_bars"] = null_bars(tables["synchronization_summary"])
    if "lead_lag_summary" in tables:
        out["lead_lag_intervals"] = intervals(tables["lead_lag_summary"])
    pairs = tables.get("pairwise_residual_correlations")
    if pairs is not None and len(pairs):
        names = {c: pairs[c] for c in ("left_symbol", "right_symbol")}
        both = pd.concat([pairs, pairs.assign(left_symbol=names["right_symbol"], right_symbol=names["left_symbol"]), pd.DataFrame({"left_symbol": symbols, "right_symbol": symbols, "correlation": 1.0})], ignore_index=True)
        out["correlation_matrix"] = both.pivot(index="left_symbol", columns="right_symbol", values="correlation").reindex(index=symbols, columns=symbols).reset_index()
    for name, x, y in (("flow_composites", "major_flow", "alt_flow"), ("cross_venue_common_flows", None, None)):
        if name in panels:
            flows = panels[name].where("sample_split = 'oos'")
            x, y = (x, y) if x else [c for c in flows.columns if c.endswith("_flow")][:2]
            out["flow_density"] = sinks.plot_bins(flows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, bins).orderBy("x_bin", "y_bin").toPandas()  # bins, not rows
    return out
