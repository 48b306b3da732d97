"""Reference-data operators on small rows."""

import pytest
from pyspark.sql import functions as F

from quantloom.operators import reference_data as rd


def test_symbols(spark):
    cat = spark.createDataFrame([("v", "A", "a1", 0, 10), ("v", "A", "a2", 10, None), ("v", "B", "b1", 0, None), ("v", "B", "b2", 5, None)], "venue string, symbol string, instrument string, listing_ns long, delisting_ns long")
    events = spark.createDataFrame([("v", "A", 5), ("v", "A", 10), ("v", "B", 3), ("v", "B", 7), ("v", "C", 1)], "venue string, symbol string, event_time_ns long")
    good, bad = rd.resolve_symbols(events, cat)
    assert sorted((r["event_time_ns"], r["instrument"]) for r in good.collect()) == [(3, "b1"), (5, "a1"), (10, "a2")]
    assert sorted((r["symbol"], r["reason"]) for r in bad.collect()) == [("B", "ambiguous"), ("C", "not_listed")]


def test_as_known(spark):
    log = spark.createDataFrame([("a", 1, 5, 0.1), ("a", 2, 9, 0.2), ("b", 1, 8, 0.3)], "instrument string, revision int, known_at_ns long, tick double")
    assert {r["instrument"]: r["tick"] for r in rd.catalogue_as_known(log, F.lit(8)).collect()} == {"a": 0.1, "b": 0.3}


def test_health(spark):
    rows = [("s", 1, 1, "recovering"), ("s", 1, 2, "healthy"), ("s", 1, 3, "quarantined"), ("s", 1, 4, "healthy"), ("s", 1, 6, "degraded")]
    bad = rd.illegal_health_moves(spark.createDataFrame(rows, "source string, epoch long, sequence long, health string"))
    assert sorted(r["sequence"] for r in bad.collect()) == [4, 6]


def test_ledger(spark):
    ops = spark.createDataFrame([("s", "gap", 1), ("s", "gap", 5), ("s", "reconnect", 9)], "source string, kind string, t long")
    assert {(r["kind"], r["n"]) for r in rd.ledger_counts(ops, 2, 9, 2).collect()} == {("gap", 1)}
    with pytest.raises(ValueError):
        rd.ledger_counts(ops, 0, 9, 2)


def test_at_risk(spark):
    rows = spark.createDataFrame([(1, 25, 2), (2, 25, 0), (3, 10, 1)], "sample_id long, duration_s long, cause int")
    got = sorted((r["sample_id"], r["bucket"], r["outcome"]) for r in rd.expand_at_risk(rows, [10, 20, 30]).collect())
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 2), (2, 0, 0), (2, 1, 0), (3, 0, 1)]


def test_forecast_rules(spark):
    p = "array<struct<horizon_s: int, probability: double, lower: double, upper: double>>"
    rows = [([(1, 0.1, 0.0, 0.2), (2, 0.2, 0.1, 0.3)],), ([(1, 1.2, 0.0, 2.0)],), ([(1, 0.5, 0.6, 0.7)],), ([(2, 0.1, 0.0, 1.0), (1, 0.2, 0.0, 1.0)],), ([(1, 0.3, 0.0, 1.0), (2, 0.2, 0.0, 1.0)],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, f"points {p}").select(rd.forecast_faults()).collect()]
    assert got == [None, "probability_range", "interval", "horizon_order", "incidence_decreases", "empty"]


def test_matrix_and_fallback(spark):
    rows = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "a", 0.3), (3, "a", 0.1), (3, "a", 0.2)], "row_id long, module string, value double")
    got = {r["row_id"]: (r["a"], r["b"], r["missing"]) for r in rd.oof_matrix(rows, ["a", "b"]).collect()}
    assert got == {1: (0.1, 0.2, []), 2: (0.3, None, ["b"])}
    s = spark.createDataFrame([(1, 0.9, 9, 0.5, 50, 0.4, 99, 0.3)], "n_combined int, rate_combined double, n_regime int, rate_regime double, n_hour int, rate_hour double, n_all int, rate_all double")
    row = rd.base_rate_fallback(s, 20).first()
    assert (row["stratum"], row["rate"]) == ("hour", 0.4)
