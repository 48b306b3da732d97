"""Lifecycle, recovery and applicability on small rows."""

import numpy as np

from quantloom.functions import applicability
from quantloom.models import fitted
from quantloom.operators import lifecycle


def test_rates(spark):
    orders = spark.createDataFrame([(1, "place", True), (1, "place", True), (1, "cancel", True), (2, "place", False), (3, "modify", True)], "w long, action string, certified boolean")
    trades = spark.createDataFrame([(1,), (1,), (2,)], "w long")
    got = {r["w"]: r for r in lifecycle.lifecycle_rates(orders, trades, ["w"], 60.0).collect()}
    assert (got[1]["placement_rate_per_second"], got[1]["cancellation_to_trade_ratio"], got[1]["quote_to_trade_ratio"]) == (2 / 60, 0.5, 1.5)
    assert got[2]["missing_reason"] == "sequence_gap" and got[2]["placement_rate_per_second"] is None
    assert got[3]["quote_to_trade_ratio"] is None and got[3]["modification_rate_per_second"] == 1 / 60


def test_recovery(spark):
    shocks = spark.createDataFrame([(1, "a", 0, 100.0, 20.0), (2, "a", 0, 50.0, 60.0)], "shock_id long, k string, t long, pre double, post double")
    depths = spark.createDataFrame([("a", 5, 40.0), ("a", 9, 60.0), ("a", 20, 110.0), ("a", 99, 10.0)], "k string, t long, depth double")
    got = {r["shock_id"]: tuple(r)[1:] for r in lifecycle.depth_recovery(shocks, depths, "k", 50).collect()}
    assert got == {1: (20, 9, 1.125), 2: (None, None, None)}


def test_orders_to_levels(spark):
    rows = [("x", "1", 1, 1, "add", "bid", 10.0, 1.0), ("x", "1", 2, 2, "modify", "bid", 10.0, 3.0), ("x", "2", 1, 3, "add", "bid", 10.0, 2.0), ("x", "3", 1, 4, "add", "ask", 11.0, 2.0), ("x", "3", 5, 5, "delete", "ask", 11.0, 0.0)]
    orders = spark.createDataFrame(rows, "k string, order_id string, t long, seq long, action string, side string, price double, qty double")
    assert [tuple(r) for r in lifecycle.l3_levels(orders, ["k"]).collect()] == [("x", "bid", 10.0, 5.0, 2)]


def test_changes_stay_in_a_session(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1, 5.0), ("a", 1, 2, 2, 7.0), ("a", 2, 3, 3, 1.0)], "k string, session long, t long, seq long, depth double")
    got = [r["depth_change"] for r in lifecycle.book_changes(rows, ["k"], ["depth"], "session").orderBy("t").collect()]
    assert got == [None, 2.0, None]


def test_applicability(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 2)) * [1, 5] + [0, 10]
    rows = spark.createDataFrame([(float(a), float(b), "v1") for a, b in x], "a double, b double, venue string")
    profile = applicability.robust_profile(rows, ["a", "b"])
    got = [r[0] for r in rows.select(applicability.robust_distance(profile)).collect()]
    assert np.allclose(got, fitted.RobustDistance(x).score(x))
    seen = applicability.range_profile(rows, ["a"], ["venue"])
    reasons, new = applicability.novelty(seen)
    odd = spark.createDataFrame([(99.0, "v2"), (0.0, "v1"), (None, "v1")], "a double, venue string").select(reasons, new).collect()
    assert [tuple(r) for r in odd] == [(["a_out_of_range", "venue_unseen"], True), ([], False), (["a_out_of_range"], True)]
