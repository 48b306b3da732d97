"""Operators against plain computations on small rows."""

import math
from itertools import pairwise

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.functions import registry, returns, scoring
from quantloom.models import fitted, roots, sequential
from quantloom.operators import bars, flow, joins, labels, market, windows


def shares_by_trial(raw, cap):
    """Shares of a million by trying every number of capped weights (largest first)."""
    cap = max(cap, -(-1_000_000 // len(raw)))
    order = sorted(range(len(raw)), key=lambda i: (-raw[i], i))
    for m in range(len(raw) + 1):
        capped, free = order[:m], sorted(order[m:])
        left, total = 1_000_000 - len(raw) - m * (cap - 1), sum(raw[i] for i in free)
        if left < 0 or any(left * raw[i] // total >= cap for i in free):
            continue
        share = dict.fromkeys(capped, cap - 1) | {i: left * raw[i] // total for i in free}
        can = sorted((i for i in free if share[i] < cap - 1), key=lambda i: (-(left * raw[i] % total), i))
        for i in can[: 1_000_000 - len(raw) - sum(share.values())]:
            share[i] += 1
        return [share[i] + 1 for i in range(len(raw))]


def test_capped_weights(spark):
    rng = np.random.default_rng(6)
    groups = [[50, 30, 15, 5], [1], [7, 7], [10**6, 1, 1, 1], [5, 5, 5], [10**9, 10**9, 3, 2, 1], *(rng.integers(1, 10 ** rng.integers(1, 7), rng.integers(1, 13)).tolist() for _ in range(60))]
    rows = [(g, i, x) for g, raw in enumerate(groups) for i, x in enumerate(raw)] + [(900, 0, None), (900, 1, 0), (900, 2, 4)]
    out = market.with_capped_weights(spark.createDataFrame(rows, "g long, i long, raw long"), ["g"], "raw", "i", 400_000)
    got = {(r["g"], r["i"]): r["weight_ppm"] for r in out.collect()}
    assert len(got) == len(rows)
    for g, raw in enumerate(groups):
        w = [got[g, i] for i in range(len(raw))]
        assert w == shares_by_trial(raw, 400_000), raw
        assert sum(w) == 1_000_000 and min(w) >= 1 and (len(raw) < 3 or max(w) <= 400_000)
    assert [got[900, i] for i in range(3)] == [None, None, 1_000_000]


def test_asof_joins(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 7, "c"), (1, 100, "d")], "k long, t long, name string")
    right = spark.createDataFrame([(1, 5, 1.0), (1, 9, 2.0), (2, 8, 3.0)], "k long, t long, value double")
    back = {r["name"]: r["value"] for r in joins.asof_backward(left, right, "k", 50).collect()}
    assert back == {"a": 2.0, "b": 1.0, "c": None, "d": None}
    ahead = {r["name"]: r["value"] for r in joins.asof_forward(left, right, "k").collect()}
    assert ahead == {"a": None, "b": 1.0, "c": 3.0, "d": None}


def test_point_in_time_never_leaks(spark):
    f = spark.createDataFrame(
        [(1, "x", 0, 10, 12, 13, 12, 1, 1.0), (1, "x", 0, 10, 20, 21, 20, 2, 2.0), (1, "x", 10, 20, 22, 99, 22, 1, 3.0)],
        "entity long, feature_id string, event_time_start_ns long, event_time_end_ns long, as_known_at_ns long, computed_at_ns long, finality_as_known_at_ns long, revision long, value double",
    )
    p = spark.createDataFrame([(1, 1, 12), (2, 1, 15), (3, 1, 30), (4, 1, 99)], "prediction_id long, entity long, prediction_ns long")
    out = joins.point_in_time_join(p, f, "entity", ["feature_id", "event_time_start_ns", "event_time_end_ns"])
    got = sorted((r["prediction_id"], r["value"]) for r in out.collect())
    assert got == [(2, 1.0), (3, 2.0), (4, 2.0), (4, 3.0)]


def test_revision_faults(spark):
    rows = [("a", 1, 5, "final"), ("a", 2, 6, "corrected"), ("b", 2, 5, "final"), ("c", 1, 5, "final"), ("c", 2, 4, "corrected")]
    f = spark.createDataFrame(rows, "id string, revision int, as_known_at_ns long, finality_state string")
    assert sorted(r["id"] for r in joins.revision_faults(f, ["id"]).collect()) == ["b", "c"]


def test_sliding_windows_hold_their_rows(spark):
    rows = spark.createDataFrame([(0,), (5,), (12,)], "t long")
    got = sorted((r["t"], r["window_start_ns"]) for r in windows.sliding(rows, 10, 5).collect())
    assert got == [(0, 0), (5, 0), (5, 5), (12, 5), (12, 10)]
    with pytest.raises(ValueError):
        windows.sliding(rows, 5, 10)


def test_finality_needs_every_required_source(spark):
    w = spark.createDataFrame([("s", 0, 10), ("s", 10, 20)], "scope string, window_start_ns long, window_end_ns long")
    m = "scope string, source string, required boolean, watermark_ns long, as_known_ns long, health string"
    marks = spark.createDataFrame([("s", "a", True, 30, 1, "healthy"), ("s", "b", True, 14, 2, "healthy"), ("s", "c", False, None, 3, "unhealthy")], m)
    got = {r["window_start_ns"]: r["finality_state"] for r in windows.finality(w, marks, ["scope"], 2).collect()}
    assert got == {0: "final", 10: "provisional"}
    bad = spark.createDataFrame([("s", "a", True, 30, 1, "quarantined")], m)
    assert {r["finality_state"] for r in windows.finality(w, bad, ["scope"], 2).collect()} == {"invalid"}
    assert windows.effective_frontier(marks, ["scope"], 2).first()["frontier_ns"] == 12


def test_threshold_bars_restart_at_zero(spark):
    rng = np.random.default_rng(1)
    rows = [(k, t, t, float(a)) for k in (1, 2) for t, a in enumerate(rng.integers(1, 9, 60))]
    out = bars.threshold_bars(spark.createDataFrame(rows, "k long, t long, seq long, amount double"), "k", 20.0)
    for k in (1, 2):
        closes = bars.fold_threshold(np.array([r[3] for r in rows if r[0] == k]), 20.0)
        assert [r["close_t"] for r in out.filter(f"k = {k}").orderBy("bar").collect()] == closes


def test_ewma_is_the_recursion(spark):
    rows = [(1, t, k, float(x)) for k, (t, x) in enumerate([(0, 3), (5, 1), (9, 4), (9, 1), (30, 5)])]
    value = None
    for (_, t, _, x), before in zip(rows, [None, *[r[1] for r in rows]], strict=False):
        d = 0.0 if before is None else 2 ** (-(t - before) / 10)
        value = x if value is None else d * value + (1 - d) * x
    got = bars.ewma(spark.createDataFrame(rows, "k long, t long, seq long, x double"), ["k"], "x", 10).first()
    assert math.isclose(got["ewma"], value, rel_tol=1e-12)


def test_first_passage_cases(spark):
    def path(name, frames):
        return [(name, o, o + 1, bool(t), bool(x), v) for o, t, x, v in frames]

    rows = path("hit", [(0, 1, 0, 0.0), (10, 1, 0, 2.0), (20, 1, 0, 2.0), (30, 1, 0, 0.0)])
    rows += path("short", [(0, 1, 0, 0.0), (10, 1, 0, 0.0)])
    rows += path("never", [(0, 1, 0, 0.0), (10, 1, 0, 2.0), (20, 1, 0, 0.0), (30, 1, 0, 0.0)])
    rows += path("untrusted", [(0, 1, 0, 0.0), (10, 0, 0, 2.0), (20, 1, 0, 2.0), (30, 1, 0, 2.0)])
    rows += path("excluded", [(0, 1, 0, 0.0), (10, 0, 1, 0.0), (30, 1, 0, 0.0)])
    frames = spark.createDataFrame(rows, "id string, offset_s long, known_s long, trusted boolean, excluded boolean, v double")
    from pyspark.sql import functions as F

    out = {r["id"]: (r["outcome"], r["offset_s"], r["known_s"]) for r in labels.first_passage(frames, ["id"], F.col("v") > 1, 30, 10).collect()}
    assert out == {"hit": ("occurred", 10, 21), "short": ("censored", None, 11), "never": ("not_occurred", None, 31), "untrusted": ("censored", None, 1), "excluded": ("excluded", None, 11)}


def test_folds_leave_purges():
    folds = labels.outer_folds(0, 999, 300, 100, 100, 10, 50)
    assert folds and all(f["calibration_start"] - f["training_end"] == 10 and f["test_start"] - f["calibration_end"] == 10 for f in folds)
    assert all(f["test_end"] <= 1000 for f in folds) and all(b["training_start"] - a["training_start"] == 50 for a, b in pairwise(folds))


def test_catalogue_counts():
    found = registry.catalogue()
    assert len(found) == 172 and len({f.feature_id for f in found}) == 172
    assert sum(f.family == "price" for f in found) == 32 and sum(f.family == "venue" for f in found) == 63
    assert sum(not f.emits and f.family == "venue" for f in found) == 28


def test_beta_quantile_inverts():
    for a, b in ((0.5, 0.5), (3, 9), (40, 2)):
        for p in (0.025, 0.5, 0.975):
            assert abs(scoring.beta_cdf(scoring.beta_quantile(p, a, b), a, b) - p) < 1e-9


@settings(deadline=None, max_examples=100)
@given(st.floats(-3, 3), st.floats(-3, 3))
def test_cubic_roots_solve(alpha, beta):
    found = roots.cubic_roots(alpha, beta)
    assert found and all(abs(y**3 - beta * y - alpha) < 1e-6 * max(1, abs(y) ** 3) for y in found)


def test_barriers_are_potential_differences():
    v = lambda y: y**4 / 4 - 2 * y * y / 2 - 0.3 * y
    a, b, c = roots.cubic_roots(0.3, 2.0)
    left, right = fitted.barriers(0.3, 2.0)
    assert math.isclose(left, v(b) - v(a), rel_tol=1e-9) and math.isclose(right, v(b) - v(c), rel_tol=1e-9)


def test_isotonic_is_monotone_and_platt_slope_not_negative():
    rng = np.random.default_rng(0)
    z = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-z))).astype(float)
    upper, values = fitted.isotonic(z, y, np.ones(300))
    assert (np.diff(values) >= 0).all() and (np.diff(upper) > 0).all()
    assert fitted.platt(z, y, np.ones(300))[1] > 0 and fitted.platt(z, 1 - y, np.ones(300))[1] == 0
    with pytest.raises(ValueError):
        fitted.joint_curve(np.array([0.2, 0.1]))


def test_run_lengths_find_a_shift():
    x = np.concatenate([np.random.default_rng(2).normal(0, 0.3, 60), np.random.default_rng(3).normal(5, 0.3, 40)])
    out = sequential.run_lengths(x, 1 / 100)
    assert out[59, 1] > 50 and out[70, 1] < 15 and np.isfinite(out).all()


def test_hidden_states_separate():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(-2, 0.3, 50), rng.normal(2, 0.3, 50)])[:, None]
    p, _ = sequential.StudentHMM(2).fit(x).forward(x)
    assert (p[:50].argmax(1) == p[0].argmax()).all() and (p[52:].argmax(1) != p[0].argmax()).all()


def test_coupled_equilibria():
    found = fitted.coupled_equilibria(0.1, 1.0, 0.1, 1.0, 0.0)
    single = roots.cubic_roots(0.1, 1.0)
    assert len(found) == 9 and {round(f[0], 6) for f in found} == {round(s, 6) for s in single}
    assert sum(f[3] == "stable" for f in found) == 4 and sum(f[3] == "saddle" for f in found) == 4
    assert [f[3] for f in fitted.coupled_equilibria(0.0, 0.0, 0.0, 0.0, 0.0)] == ["degenerate"]


@settings(deadline=None, max_examples=60)
@given(*[st.floats(-2, 2)] * 4, st.sampled_from([0.0, 1e-6, 0.01, 0.3, -0.7, 2.0]))
def test_coupled_equilibria_are_all_there(a1, b1, a2, b2, c):
    found = fitted.coupled_equilibria(a1, b1, a2, b2, c)
    assert any(f[3] in ("stable", "degenerate") for f in found)  # the potential has a minimum
    for x, y, _, _ in found:
        assert abs(x**3 - b1 * x - a1 - c * y) < 1e-6 and abs(y**3 - b2 * y - a2 - c * x) < 1e-6
    lowest = min(f[2] for f in found)
    g = np.linspace(-3, 3, 61)
    x, y = np.meshgrid(g, g)
    v = x**4 / 4 - b1 * x * x / 2 - a1 * x + y**4 / 4 - b2 * y * y / 2 - a2 * y - c * x * y
    assert lowest <= v.min() + 1e-9


def test_stack_constraints():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    y = (rng.random(200) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    b = fitted.stack(x, y, np.ones(200), "simplex", locked=(2,))
    assert b[3] == 0 and abs(b[1:].sum() - 1) < 1e-9 and (b[1:] >= 0).all()


def test_scenarios_use_every_event(spark, monkeypatch):
    from quantloom.models import scenarios
    from quantloom.plans import models

    counted = scenarios.simulate(spark, [-0.5, 0.1, 2.0], 5, 8, 3, [30, 25, 1]).collect()
    assert sorted(counted) == sorted(scenarios.simulate(spark, [-0.5] * 30 + [0.1] * 25 + [2.0], 5, 8, 3).collect())

    def summary(late):
        rows = [(k, 50.0 + k % 7) for k in range(500)] + [(500 + k, late) for k in range(1500)]
        monkeypatch.setattr(models, "user_prices", lambda *_: spark.createDataFrame(rows, "seq long, price double"))
        return tuple(models.scenario_summary(spark, "").first())

    assert summary(20.0) != summary(90.0)


def test_prices_that_are_not_positive_are_missing(spark):
    values = [10.0, 0.0, 12.0, -3.0, float("nan"), None, float("inf"), 15.0, 18.0]
    rows = spark.createDataFrame([(1, t, t, v) for t, v in enumerate(values)], "k int, t long, seq long, price double")
    got = [r["r"] for r in returns.with_returns(rows, ["k"]).orderBy("t").collect()]
    assert got[:8] == [None] * 8 and math.isclose(got[8], math.log(18 / 15))
    bar = rows.groupBy("k").agg(returns.first_price().alias("o"), returns.last_price().alias("c")).first()
    assert (bar["o"], bar["c"]) == (10.0, 18.0)
    swing = returns.with_extremes(rows, ["k"]).groupBy("k").agg(returns.maximum_drawdown().alias("down"), returns.maximum_run_up().alias("up")).first()
    assert swing["down"] == 0.0 and math.isclose(swing["up"], 0.8)
    odd = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (1.0, 2.0, 0.0, 1.0)], "o double, h double, l double, c double")
    o, h, low, c = (F.col(x) for x in "ohlc")
    assert [tuple(r) for r in odd.select(returns.parkinson(h, low), returns.garman_klass(o, h, low, c), returns.relative(c, o)).collect()] == [(None, None, None), (None, None, 0.0)]
    mids = spark.createDataFrame([(1, 5, 0.0), (1, 4, 2.0), (1, 30, -1.0), (1, 31, 3.0)], "k long, t long, mid double")
    shock = spark.createDataFrame([(1, 10, 1, 2.5, 1.0)], "k long, t long, seq long, price double, sign double")
    out = flow.shock_response(shock, mids, "k", 15, 100, 100).first()
    assert (out["mid0"], out["mid1"], out["trade_shock_midprice_impact"]) == (2.0, 3.0, 0.5)
