"""Model selection, cusp, triggers, operational features and streams on small rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quantloom.functions import registry
from quantloom.models import cusp, roots, selection, sequential
from quantloom.operators import feature_rows, labels, operations, triggers, windows
from quantloom.streaming import sinks

SF = "/root/testdata/sf0.001"


def test_calibrators_are_selected_on_the_rest():
    rng = np.random.default_rng(1)
    z = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2.5 * z - 1)))).astype(float)
    fitting = np.arange(2000) % 2 == 0
    best, scores = selection.select_calibrator(z, y, np.ones(2000), fitting)
    assert set(scores) == {"identity", "platt", "beta", "isotonic"} and scores[best.kind] == min(scores.values()) < scores["identity"]
    assert "isotonic" not in selection.select_calibrator(z[:100], y[:100], np.ones(100), fitting[:100])[1]
    p = best(np.sort(z))
    assert (np.diff(p) >= -1e-12).all() and 0 < p[0] and p[-1] < 1


def test_ablation_and_penalty_path():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    x[5, 1] = np.nan
    drop = selection.ablations(x, y, np.ones(400))
    assert drop[0] > 0.05 > max(drop[1], drop[2])
    cause = np.where(rng.random(400) < 1 / (1 + np.exp(-x[:, 0])), 1, 0)
    path = selection.hazard_path(np.nan_to_num(x), cause, 1, [0.0, 0.05, 10.0])
    sizes = [np.abs(path[p][1:]).sum() for p in (0.0, 0.05, 10.0)]
    assert sizes[0] > sizes[1] > sizes[2] == 0


def test_states_are_counted_on_held_out_folds():
    rng = np.random.default_rng(3)
    series = np.concatenate([rng.normal(m, 0.3, 60) for m in (-3, 3, -3, 3)])[:, None]
    best, scores = selection.select_states([(series[:120], series[120:180]), (series[:180], series[180:])], [1, 2])
    assert best == 2 and scores[2] > scores[1]
    model = sequential.StudentHMM(2).fit(series)
    words = selection.describe_states(model, np.zeros(1), np.ones(1), ["x"])
    assert sorted(w["x"] for w in words) == ["high", "low"]


def test_cusp_likelihood_and_posterior():
    y = np.array([0.9, 1.1, -1.0, 1.0])
    one = np.ones(4)
    loss = lambda a, b: cusp.stationary_loss(y, a * one, b * one, 0.7 * one, one)
    assert loss(0.0, 1.0) < loss(0.0, -2.0) and loss(0.0, 1.0) < loss(3.0, 1.0)
    grid = np.linspace(-6, 6, 1201)
    v = grid**4 / 4 - grid**2 / 2
    density = np.exp(-2 / 0.49 * v)
    density /= np.trapezoid(density, grid)
    assert math.isclose(loss(0.0, 1.0), float(-np.log(np.interp(y, grid, density)).mean()), rel_tol=1e-6)
    cov, good = cusp.laplace(np.diag([2.0, 0.5]), 10)
    assert good and np.allclose(cov, np.diag([0.05, 0.2]))
    assert not cusp.laplace(np.diag([1.0, -1.0]), 10)[1]
    sample = cusp.draws(np.array([1.0, 2.0]), cov, 4000, 5)
    assert np.allclose(sample.mean(axis=0), [1, 2], atol=0.05) and np.allclose(np.cov(sample.T), cov, atol=0.02)


def test_controls_and_online(spark):
    features = [cusp.ControlFeature("a", 1.0, 2.0, 0.5, 1.0, required=True), cusp.ControlFeature("b", 0.0, 1.0, -1.0, 0.0)]
    rows = spark.createDataFrame([(1, 3.0, 2.0), (2, 3.0, None), (3, None, 2.0)], "seq long, a double, b double")
    alpha, beta, missing, reason = cusp.controls(features, (0.1, 0.2))
    got = [tuple(r) for r in rows.select(alpha, beta, missing, reason).orderBy("seq").collect()]
    assert got == [(pytest.approx(-1.4), pytest.approx(1.2), [], None), (pytest.approx(0.6), pytest.approx(1.2), ["b"], None), (None, None, [], "required_feature_missing")]
    series = [(7, t, t, y, 0.0, 1.0) for t, y in enumerate([1.0, 1.0, -1.0, -1.0, -1.0])] + [(8, 0, 0, None, 0.0, 1.0)]
    out = cusp.online(spark.createDataFrame(series, "k long, t long, seq long, state double, alpha double, beta double"), "k", np.zeros((4, 2))).orderBy("k", "seq").collect()
    want = sequential.track_branches(np.array([1.0, 1.0, -1.0, -1.0, -1.0]), np.full(5, -1.0), np.full(5, 1.0))
    assert [r["followed"] for r in out[:5]] == [float(b == "upper") for _, b in want] and np.allclose([r["p_upper"] for r in out[:5]], [p for p, _ in want])
    assert out[0]["region"] == 1.0 and out[5]["p_upper"] is None


def test_fold_distances_agree():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=200), rng.normal(size=200) * 2
    assert np.allclose(roots.fold_distances(a, b), [roots.fold_distance(x, y) for x, y in zip(a, b, strict=True)], atol=1e-6)


def test_streamed_series_equal_whole_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, t, float(v)) for k in (1, 2, 3) for t, v in enumerate(rng.normal(size=40 * k))] + [(3, 500, 500, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = sequential.stream_series(spark.createDataFrame(rows, "k long, t long, seq long, x double"), "k", "x", lambda _: (lambda m: lambda x: list(m.update(x).T))(sequential.RunLengths(0.02)), "k long, seq long, p double, run double, expected double, cut double").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (1, 2, 3):
        whole = sequential.run_lengths(np.array([r[3] for r in rows if r[0] == k], float), 0.02)
        got = sorted((r for r in out if r["k"] == k), key=lambda r: r["seq"])
        assert np.allclose([[r["p"], r["run"], r["expected"]] for r in got if r["p"] is not None], whole[~np.isnan(whole[:, 0]), :3])
    assert [r["p"] for r in out if r["seq"] == 500] == [None]


def test_trigger_vectors(spark):
    schema = "e long, as_of_ns long, input string, value double, event_ns long, ttl_ns long, source_lost boolean, quality long, coverage long"
    ok = (False, 950_000, 1_000_000)
    rows = [(1, 100, "a", 1.0, 90, 20, *ok), (1, 100, "a", 9.0, 200, 20, *ok), (1, 100, "b", 2.0, 10, 20, *ok), (1, 100, "c", 3.0, 95, 20, *ok), (1, 100, "d", 4.0, 95, 20, *ok)]
    rows += [(2, 100, "a", 1.0, 90, 20, True, 950_000, 1_000_000), (2, 100, "c", 1.0, 99, 20, *ok), (2, 100, "d", 1.0, 98, 20, *ok)]
    out = triggers.trigger_vectors(spark.createDataFrame(rows, schema), ["e"], ["a", "b", "c", "d"], ["a", "b"], aligned=("c", "d"))
    got = {r["e"]: r for r in out.collect()}
    assert (got[1]["a"], got[1]["b"], got[1]["c"], got[1]["missing"], got[1]["health"]) == (1.0, None, 3.0, ["b:expired"], "degraded")
    assert (got[2]["missing"], got[2]["health"]) == (["a:source_disconnected", "b:source_disconnected", "c:unaligned", "d:unaligned"], "unavailable")


def test_ledger_and_predicates(spark):
    schema = "s string, t long, seq long, kind string, latency_ns long, skew_ns long, feature_end_ns long, computed_ns long, health string, completeness string, used double, capacity double"
    rows = [("x", 1, 1, "reconnect", 5, 1, 0, 3, "healthy", "complete", 1.0, 4.0), ("x", 9, 2, "sequence_gap", 2, 2, 4, 12, "quarantined", "sampled", 2.0, 4.0)]
    r = operations.ledger_features(spark.createDataFrame(rows, schema), ["s"], F.lit(100), 50).first()
    assert (r["reconnect_count"], r["sequence_gap_count"], r["feed_jitter_ns"], r["feature_age_ns"], r["local_processing_lag_ns"], r["stale_quote_duration_ns"]) == (1, 1, 3, 8, 3, 91)
    assert (r["source_outage_indicator"], r["source_health_gate"], r["source_completeness_gate"], r["liquidation_source_completeness_flag"], r["disk_pressure_fraction"]) == (True, False, False, 1, 0.5)
    books = spark.createDataFrame([("normal", True, 10, "spot"), ("normal", True, 3001, "spot"), ("crossed", True, 1, "spot"), (None, None, None, "spot"), ("normal", True, 1, "option")], "c string, y boolean, a long, p string")
    got = [x[0] for x in books.select(operations.usable_book(F.col("c"), F.col("y"), F.col("a"), F.col("p"))).collect()]
    assert got == [None, "stale", "untrusted", "untrusted", "source_not_supported"]


def test_watermarks_refuse_and_keep_their_state(spark):
    rows = [("a", 1, 10, 12), ("a", 2, 8, 20), ("a", 3, 15, 11), ("a", 4, 14, 11), ("a", 5, 16, 30), ("a", 6, 17, 25), ("a", 7, None, 40), ("b", 1, -1, 5)]
    out = windows.watermark_history(spark.createDataFrame(rows, "k string, seq long, event_time_ns long, as_known_ns long"), ["k"]).orderBy("k", "seq").collect()
    assert [(r["watermark_ns"], r["fault"]) for r in out] == [
        (10, None), (10, "regression"), (10, "invalid_watermark"), (10, "invalid_watermark"), (16, None), (16, "invalid_watermark"), (16, "invalid_watermark"), (None, "invalid_watermark"),
    ]


def test_rolling_counts_of_one_key(spark):
    rng = np.random.default_rng(6)
    at = rng.integers(-50, 200, 300).tolist()
    rows = spark.createDataFrame([("k", i, a) for i, a in enumerate(at)], "k string, i long, a long")
    got = {r["i"]: r["rolling"] for r in windows.rolling_count(rows, ["k"], "a", 10).collect()}
    assert got == {i: sum(a - 10 < b <= a for b in at) for i, a in enumerate(at)}


def test_incomplete_grids_and_open_windows_have_reasons(spark):
    prices = [("a", t, t, p) for t, p in ((0, 10.0), (1, 11.0), (2, 12.0), (3, 11.0), (5, 12.0), (6, 12.0), (7, 12.0), (8, 12.0))]
    wide = feature_rows.feature_windows(spark.createDataFrame(prices, "entity string, t long, seq long, price double"), 1, 3, "w", lateness_ns=1)
    long = feature_rows.long_rows(wide, [*feature_rows.PRICE_FEATURES, "consolidated_fair_price_distance"])
    got = {(r["event_time_end_ns"], r["feature_id"]): (r["value"], r["missing_reason"]) for r in long.collect()}
    assert got[3, "cumulative_return"] == (pytest.approx(0.1), None) and got[4, "cumulative_return"] == (None, "sequence_gap")
    assert got[8, "realized_variance"] == (None, "window_not_final") and got[3, "consolidated_fair_price_distance"] == (None, "insufficient_history")
    assert all((v is None) != (r is None) and (r is None or r in feature_rows.REASONS) for v, r in got.values())
    made = feature_rows.canonical(long, 1)
    faults = made.filter("event_time_start_ns > event_time_end_ns or event_time_end_ns > as_known_at_ns or as_known_at_ns > computed_at_ns or watermark_ns > computed_at_ns or finality_as_known_at_ns > as_known_at_ns")
    assert faults.count() == 0 and made.select("lineage_hash").distinct().count() == made.count()


def test_thresholds_folds_and_overlaps(spark):
    one = spark.createDataFrame([(0.3,), (None,), (2.0,)], "v double")
    made = [labels.price_threshold("absolute", 0.2), labels.price_threshold("scaled", None, 2.0, F.col("v")), labels.price_threshold("combined", 0.5, 1.0, F.col("v"))]
    assert [tuple(r) for r in one.select(*made).collect()] == [(0.2, 0.6, 0.5), (0.2, None, None), (0.2, None, None)]
    rows = [(1, "upside", "occurred", 5), (1, "downside", "occurred", 5), (1, "volatility_explosion", "occurred", 2), (2, "upside", "occurred", 5), (2, "downside", "occurred", 5), (3, "upside", "censored", None)]
    out = spark.createDataFrame(rows, "k long, event_type string, outcome string, offset_s long")
    got = {p: {r["k"]: (r["events"], r["status"]) for r in labels.resolve_overlaps(out, ["k"], p).collect()} for p in ("allow", "primary", "exclude_ties")}
    assert got["allow"][1] == (["volatility_explosion", "downside", "upside"], "resolved") and got["primary"][2] == (["downside"], "resolved")
    assert got["exclude_ties"] == {1: (["volatility_explosion"], "resolved"), 2: ([], "excluded"), 3: ([], "none")}
    assert labels.purge_ns(3600, 60) == 3_660_000_000_000 and sum(labels.REFERENCE_DAYS[:5]) == 330


def test_seal_verify_and_scan(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, 5, 1.0), ("p", 1, 5, 1.0), ("p", 2, 6, 2.0), ("p", 2, 6, 3.0)], "event_type string, id long, event_time_ns long, v double")
    sealed = {r["id"]: (r["v"], r["conflicts"]) for r in sinks.sealed(rows, ["event_type"], ["id"]).collect()}
    assert sealed == {1: (1.0, 0), 2: (2.0, 1)}
    path = str(tmp_path / "d")
    rows.write.parquet(path)
    known = sinks.manifest(spark.read.parquet(path))
    assert sinks.read_verified(spark, path, known).count() == 4
    rows.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError):
        sinks.read_verified(spark, path, spark.createDataFrame(known.limit(0).collect(), known.schema))
    log = spark.createDataFrame([(1, 1, 1, 5), (1, 1, 2, 6), (1, 1, 4, 7), (1, 1, 5, 3), (1, 2, 1, 0)], "stream_id long, connection_epoch long, record_sequence long, receive_wall_time_ns long")
    good, bad = sinks.log_scan(log)
    assert good.count() == 3 and {r["record_sequence"]: r["fault"] for r in bad.collect()} == {4: "sequence_gap", 5: "time_regression"}


def test_every_emitted_feature_is_computed(spark):
    queries, columns = entry.queries(), {}
    for f in registry.catalogue():
        if not f.emits:
            continue
        query = registry.COMPUTED_BY[f.feature_id]
        if query == "feature_rows":
            assert f.feature_id in [*feature_rows.PRICE_FEATURES, "volatility_forecast_residual", "consolidated_fair_price_distance"]
            continue
        if query not in columns:
            columns[query] = queries[query](spark, SF).columns
        assert any(c == f.feature_id or c.startswith(f.feature_id + "_per_") for c in columns[query]), f.feature_id
