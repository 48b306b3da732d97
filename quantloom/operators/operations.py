"""Operational features of a source from its ledger, and cross-venue features
of a set of venues at one time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Counted kinds of ledger rows and the features they become (fixed values).
COUNTED = {
    "sequence_gap": "sequence_gap_count",
    "checksum_failure": "checksum_failure_count",
    "reconnect": "reconnect_count",
    "recovery": "recovery_count",
    "correction": "correction_count",
    "revision": "revision_count",
    "rejection": "raw_to_normalized_rejection_count",
}
#: Classes of liquidation completeness (fixed values).
COMPLETENESS = ("complete", "sampled", "partial", "unknown")
BAD_HEALTH = ("unhealthy", "quarantined")


def ledger_features(ledger: DataFrame, keys: list[str], end_ns: Column, stale_after_ns: int) -> DataFrame:
    """One row per ``keys`` (a source and a window).  ``ledger``: ``t``, ``seq``,
    ``kind``, ``latency_ns``, ``skew_ns``, ``feature_end_ns``, ``computed_ns``,
    ``health``, ``completeness``, ``used`` and ``capacity``; gauges are the last
    by ``(t, seq)``.  ``end_ns``: the window's end, of the grouped columns.

    Counts and gauges need no order but the last one, so this is one
    aggregation with partial sums; only jitter looks at the row before, inside
    its own window."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    rows = ledger.withColumn("__jitter", F.abs(F.col("latency_ns") - F.lag("latency_ns").over(order)))
    at = F.struct("t", "seq")
    last = lambda c: F.max_by(c, at)
    counts = {name: F.count_if(F.col("kind") == kind) for kind, name in COUNTED.items()}
    health = last("health")
    silent = end_ns - F.max("t")
    made = {
        **counts,
        "source_latency_ns": last("latency_ns"),
        "feed_jitter_ns": last("__jitter"),
        "clock_skew_estimate_ns": last("skew_ns"),
        "feature_age_ns": last(F.col("computed_ns") - F.col("feature_end_ns")),
        "local_processing_lag_ns": last(F.col("computed_ns") - F.col("t")),
        "stale_quote_duration_ns": F.when(silent > stale_after_ns, silent).otherwise(F.lit(0).cast("long")),
        "source_outage_indicator": F.coalesce(health.isin(*BAD_HEALTH), F.lit(False)),
        "source_health_gate": F.coalesce(health == "healthy", F.lit(False)),
        "source_completeness_gate": (counts["sequence_gap_count"] == 0) & (counts["checksum_failure_count"] == 0),
        "liquidation_source_completeness_flag": F.max(F.array_position(F.array(*map(F.lit, COMPLETENESS)), F.col("completeness")) - 1).cast("int"),
        "disk_pressure_fraction": last(F.col("used") / F.nullif(F.col("capacity"), F.lit(0.0))),
    }
    return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in made.items()))


def venue_features(quotes: DataFrame, fair: DataFrame, keys: list[str], price: str, depth: str) -> tuple[DataFrame, DataFrame]:
    """``quotes``: eligible venues with ``reason`` (null: included) and
    ``healthy``; ``fair``: ``keys`` and ``fair_price``.  Returns a row per
    included venue (deviation, depth share) and one per ``keys`` (healthy
    fraction, coverage, disagreement, gate)."""
    included = quotes.filter("reason is null").join(fair, keys)
    relative = F.col(price) / F.col("fair_price") - 1
    total = F.sum(depth).over(Window.partitionBy(*keys))
    each = included.withColumns({"venue_midprice_deviation": relative, "venue_depth_share": F.col(depth) / F.nullif(total, F.lit(0))})
    spread = included.groupBy(*keys).agg(F.median(F.abs(relative)).alias("cross_source_disagreement"))
    counted = quotes.groupBy(*keys).agg(
        F.count("*").alias("eligible_venues"),
        F.count_if(F.col("reason").isNull()).alias("included_venues"),
        F.count_if(F.col("reason").isNull() & F.col("healthy")).alias("__good"),
    )
    share = lambda c: F.col(c) / F.col("eligible_venues")
    out = counted.join(spread, keys, "left").withColumns(
        {
            "healthy_venue_fraction": share("__good"),
            "source_coverage_fraction": share("included_venues"),
            "cascade_eligibility_gate": F.col("__good") == F.col("eligible_venues"),
        }
    )
    return each, out.drop("__good")


def usable_book(classification: Column, synchronized: Column, age_ms: Column, product: Column, most_ms: int = 3_000) -> Column:
    """Null for a book whose features may be trusted, else the reason why not:
    other products than spot are not supported, an unsynchronised or abnormal
    book is not trusted, an old one is stale."""
    return (
        F.when(product != "spot", "source_not_supported")
        .when(~F.coalesce(synchronized, F.lit(False)) | (F.coalesce(classification, F.lit("none")) != "normal"), "untrusted")
        .when(F.coalesce(age_ms > most_ms, F.lit(True)), "stale")
    )


def histogram(values: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Counts by bucket: ``upper`` is the least bound not below the value (null
    above all), cumulative counts as well."""
    upper = F.coalesce(*(F.when(F.col(value) <= b, F.lit(float(b))) for b in sorted(bounds)))
    counted = values.filter(F.col(value).isNotNull()).groupBy(*keys, upper.alias("upper")).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(*keys).orderBy(F.col("upper").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("cumulative", F.sum("n").over(so_far))


def source_sets(rows: DataFrame, keys: list[str], source: str, required: list[str]) -> DataFrame:
    """Distinct sources of each group in order, the required ones that are
    missing, and whether the set is the required one (whatever the order)."""
    need = F.array_sort(F.array(*map(F.lit, required)))
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(source)).alias("sources"))
    return found.withColumns({"missing": F.array_except(need, F.col("sources")), "complete": F.col("sources") == need})
