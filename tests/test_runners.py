"""The studies from files to decisions, on small synthetic panels."""

import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest

from tidalflow import cli
from tidalflow.operators import gates
from tidalflow.plans import runners
from tidalflow.sources import catalog

SYMBOLS = [f"S{i}" for i in range(4)]
SPLIT = {"development_start": "2024-01-01T00:00:00Z", "development_end_exclusive": "2024-01-21T00:00:00Z", "oos_start": "2024-01-21T00:00:00Z", "oos_end_exclusive": "2024-02-10T00:00:00Z"}
RULES = {
    "fdr_alpha": 0.05, "hac_maxlags": 2, "alignment_minimum_assets": 3, "null_repetitions": 39, "null_seed": 1, "minimum_shift_days": 2, "synchronization_minimum_correlation_excess": 0.02, "synchronization_minimum_alignment_ratio": 1.1,
    "lead_horizons_minutes": [360], "cascade_primary_horizon_minutes": 360, "cascade_minimum_standardized_beta": 0.02, "bootstrap_repetitions": 9, "bootstrap_seed": 2, "futures_event_quantile": 0.8, "futures_minimum_standardized_beta": 0.05,
    "futures_minimum_event_count": 5, "futures_minimum_directional_concordance": 0.55, "extreme_event_quantile": 0.8, "synchronization_minimum_concordance_ratio": 1.1, "synchronization_minimum_event_count": 5,
    "transmission_primary_horizon_minutes": 360, "transmission_minimum_standardized_beta": 0.02,
}
DATA = {"expected_start": SPLIT["development_start"], "expected_end_exclusive": SPLIT["oos_end_exclusive"], "expected_interval_minutes": 360, "symbols": SYMBOLS, "major_symbols": SYMBOLS[:2], "alt_symbols": SYMBOLS[2:]}


def spot_panel(seed=5):
    rng = np.random.default_rng(seed)
    at = pd.date_range("2024-01-01", "2024-02-10", freq="6h", inclusive="left")
    common = rng.normal(size=len(at))
    rows = [(t, s, 360, 2, rng.normal() / 50, rng.uniform(1, 1e6), int(rng.integers(1, 900)), float(np.tanh(common[i] + rng.normal() / 2))) for i, t in enumerate(at) for s in SYMBOLS]
    return pd.DataFrame(rows, columns=["bucket_start", "symbol", "interval_minutes", "schema_version", "bucket_return", "total_quote_quantity", "transaction_count", "aggressor_imbalance"]), common


def config_file(base, name, config):
    (base / name).write_text(json.dumps(config))
    return str(base / name)


def test_primary_sensitivity_cross_and_verification(spark, tmp_path):
    pdf, common = spot_panel()
    pdf.to_parquet(tmp_path / "spot.parquet", coerce_timestamps="us")
    rng = np.random.default_rng(3)
    for s in SYMBOLS[2:]:
        lines = "create_time,symbol,sum_open_interest,count_toptrader_long_short_ratio,sum_toptrader_long_short_ratio,count_long_short_ratio,sum_taker_long_short_vol_ratio\n"
        for t, c in zip(pd.date_range("2024-01-01", periods=160, freq="6h"), common, strict=True):
            lines += "".join(f"{t + pd.Timedelta(minutes=5 * k)},{s},{rng.uniform(1, 2)},1,1,1,{np.exp(c + rng.normal() / 3)}\n" for k in range(2))
        (tmp_path / f"futures/{s}/metrics").mkdir(parents=True)
        with zipfile.ZipFile(tmp_path / f"futures/{s}/metrics/{s}-metrics-2024-01-01.zip", "w") as z:
            z.writestr("m.csv", lines)
    config = {"data": {**DATA, "spot_input_path": "spot.parquet", "futures_archive_dir": "futures", "futures_symbols": SYMBOLS[2:]}, "sample_split": SPLIT, "analysis": RULES, "output": {"base_dir": "out"}}
    path = config_file(tmp_path, "c.json", config)
    got = runners.primary(spark, config, path, str(tmp_path))
    said = got["decisions"].set_index("decision")
    assert said.passed["spot_synchronization"] and said.passed["futures_confirmation"] and not said.passed["directional_alpha"]
    assert got["synchronization_summary"]["observed"][0] > 0.5 and len(got["pairwise_residual_correlations"]) == 6 and got["spot_coverage"]["rows"][0] == 640
    report = (tmp_path / "out/report.md").read_text()
    assert "spot_synchronization: **supported** (`" in report and "640 rows, 160 buckets, 4 assets" in report and "## Confirmation by futures" in report and "no news, forum or sentiment data" in report
    assert f"| mean_pairwise_correlation | {got['synchronization_summary']['observed'][0]:.5f} |" in report and "| major_to_alt | 360 |" in report
    drawn = {n: pd.read_csv(tmp_path / f"out/figures/{n}.csv") for n in ("null_bars", "lead_lag_intervals", "correlation_matrix", "flow_density")}
    assert len(drawn["null_bars"]) == 6 and (drawn["lead_lag_intervals"][["below", "above"]] > 0).all(axis=None)
    matrix = drawn["correlation_matrix"].set_index("left_symbol")
    assert np.allclose(matrix, matrix.T) and (np.diag(matrix) == 1).all() and list(matrix.columns) == SYMBOLS and drawn["flow_density"]["n"].sum() == 80
    with pytest.raises(FileExistsError):
        runners.primary(spark, config, path, str(tmp_path))
    cli.main(["verify", "--config", path, "--base", str(tmp_path)])
    assert json.loads((tmp_path / "out/verification.json").read_text())["decision_recomputation_match"]
    both = runners.sensitivity(spark, config, path, str(tmp_path))["futures_aggregation_comparison"]
    assert set(both["aggregation"]) == {"mean_primary", "last_sensitivity"} and len(both) == 4
    assert (tmp_path / "out/futures_aggregation_sensitivity/report.md").read_text().count("| last_sensitivity |") == 2
    assert json.loads((tmp_path / "out/futures_aggregation_sensitivity/run_summary.json").read_text())["primary_decision_replaced"] is False
    stored = pd.read_csv(tmp_path / "out/decisions.csv")
    stored.loc[0, "classification"] = "other"
    stored.to_csv(tmp_path / "out/decisions.csv", index=False)
    with pytest.raises(AssertionError):
        runners.verify(config, path, str(tmp_path))

    residuals = "out/intermediate/aggressor_residual_panel.parquet"
    other = pd.read_parquet(tmp_path / residuals)
    other["symbol"] = "S-" + other["symbol"].str[1:]  # written with a hyphen by the second venue
    other["aggressor_residual_z"] += rng.normal(size=len(other)) / 4
    other.to_parquet(tmp_path / "two.parquet", coerce_timestamps="us")
    config = {"data": {**DATA, "one_residual_path": residuals, "two_residual_path": "two.parquet"}, "sample_split": SPLIT, "analysis": RULES, "output": {"base_dir": "cross"}}
    path = config_file(tmp_path, "x.json", config)
    got = runners.cross(spark, config, path, str(tmp_path))
    assert got["decisions"].set_index("decision").passed["cross_venue_synchronization"] and 0.9 < got["synchronization_summary"]["observed"][0] < 1
    assert "cross_venue_synchronization: **supported**" in (tmp_path / "cross/report.md").read_text() and (tmp_path / "cross/figures/flow_density.csv").exists()
    assert len(got["lead_lag_direction_bootstrap"]) == 9 and got["source_coverage"]["rows"].tolist() == [640, 640]
    assert runners.verify(config, path, str(tmp_path), "cross")["lead-lag_family_size"] == 2


def test_spot_gate_names_what_fails(spark):
    pdf = spot_panel()[0]
    make = lambda p: spark.createDataFrame(p).withColumn("bucket_start", runners.F.col("bucket_start").cast("timestamp_ntz"))
    assert gates.spot(make(pdf), DATA)["timestamps"][0] == 160
    for change, said in ((lambda p: p.iloc[1:], "rows, grid"), (lambda p: p.assign(schema_version=1), "schema"), (lambda p: pd.concat([p.iloc[1:], p.iloc[-1:]]), "duplicates, grid"), (lambda p: p.assign(symbol=p.symbol.replace("S0", "Z")), "symbols")):
        with pytest.raises(ValueError, match=said):
            gates.spot(make(change(pdf)), DATA)


def test_external(spark, tmp_path):
    rng = np.random.default_rng(8)
    at = pd.date_range("2024-01-01", "2024-02-10", freq="6h", inclusive="left")
    common = rng.normal(size=len(at))
    for s in SYMBOLS:
        (tmp_path / f"raw/{s}").mkdir(parents=True)
        for month in ("2024-01", "2024-02"):
            text, k = io.StringIO(), 0
            text.write("instrument_name,trade_id,side,price,size,created_time\n")
            for i, t in enumerate(at):
                if t.strftime("%Y-%m") == month:
                    for j in range(3):
                        k += 1
                        side = "buy" if common[i] + rng.normal() / 2 > 0 else "sell"
                        text.write(f"{s},{k},{side},{100 + rng.normal()},{rng.uniform(1, 2)},{t.value // 10**6 + 1000 * j}\n")
            with zipfile.ZipFile(tmp_path / f"raw/{s}/{s}-trades-{month}.zip", "w") as z:
                z.writestr("t.csv", text.getvalue())
    config = {"source": {"provider": "Two", "local_data_dir": "raw"}, "data": {**DATA, "minimum_complete_intersection_share": 0.999}, "sample_split": SPLIT, "analysis": RULES, "output": {"base_dir": "ext"}}
    got = runners.external(spark, config, config_file(tmp_path, "e.json", config), str(tmp_path))
    said = got["decisions"].set_index("decision")
    assert said.classification["two_spot_synchronization_external_replication"] == "two_order_flow_synchronization_replicated"
    assert len(got["source_file_manifest"]) == 8 and got["source_coverage"]["complete_intersection_share"].tolist() == [1.0] * 4


def test_the_audit_of_an_archive(spark, tmp_path):
    """Catalogue, one archive read whole, gates, sizes and the report; then an archive that fails."""
    from tests.test_collector import Shop, archive

    archive(f"{tmp_path}/shelf/A-T-2024-01-01.tar.gz", "A-T", "2024-01-01")
    archive(f"{tmp_path}/shelf/B-T-2024-01-01.tar.gz", "B-T", "2024-01-01", skip=range(30))
    limits = {"sample_interval_seconds": 60, "confirmatory_window_days": 180, "full_history_days": 730, "minimum_initial_levels_per_side": 3, "maximum_start_delay_ms": 1000, "maximum_end_early_ms": 60_000, "maximum_parse_errors": 0, "maximum_out_of_order_rows": 0, "maximum_sampled_crossed_books": 0}
    for symbol, ready in (("A-T", True), ("B-T", False)):
        config = {"data": {"symbols": ["A-T", "B-T"], "sample_dates": ["2024-01-01"], "pilot_symbol": symbol, "pilot_date": "2024-01-01", "archive_dir": "raw", "module": "4"}, "audit": limits, "output": {"base_dir": f"audit-{symbol}"}}
        listed = Shop(spark, f"{tmp_path}/shelf")(["A-T", "B-T"], "2024-01-01")
        got = runners.audit(spark, config, config_file(tmp_path, "a.json", config), str(tmp_path), listed)
        out = tmp_path / f"audit-{symbol}"
        summary = got["pilot_audit_summary"].iloc[0]
        assert (summary["symbol"], summary["sample_count"], summary["initial_ask_levels"]) == (symbol, 1440 if ready else 1410, 3)
        assert bool(gates.one(got["quality_decisions"], quality_gate="bounded_l2_study_ready")["passed"]) is ready
        report = (out / "report.md").read_text()
        assert "2 assets on 1 days: 2 files asked for, 2 available" in report and (("every gate passed" in report) is ready) and f"- {symbol} 2024-01-01: {summary['rows']:,} lines" in report
        assert spark.read.parquet(f"{out}/pilot_minute_books.parquet").count() == summary["sample_count"]
        assert json.loads((out / "run_summary.json").read_text())["bounded_l2_study_ready"] is ready
    with pytest.raises(RuntimeError, match="pilot"):
        runners.audit(spark, {**config, "data": {**config["data"], "pilot_date": "2024-01-09"}}, "", str(tmp_path), listed)


def test_whole_downloads(tmp_path, monkeypatch):
    """A file whose content isn't accepted is fetched again; one that stays wrong leaves no part behind."""
    monkeypatch.setattr(catalog.urllib.request, "urlopen", lambda *a, **k: io.BytesIO(b"new"))
    monkeypatch.setattr(catalog.time, "sleep", lambda s: None)
    (tmp_path / "f").write_bytes(b"old")
    is_new = lambda p: open(p, "rb").read() == b"new"
    assert catalog.download("http://x", str(tmp_path / "f"), whole=is_new) == "download" and (tmp_path / "f").read_bytes() == b"new"
    with pytest.raises(OSError, match="asked for"):
        catalog.download("http://x", str(tmp_path / "g"), whole=lambda p: False)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f"]
