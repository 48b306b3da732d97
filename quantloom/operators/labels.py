"""First-passage labels, competing events and walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Priority of events that occur at one offset, first wins (fixed values).
PRIORITY = ("liquidity_vacuum", "liquidation_cascade", "downside", "upside", "volatility_explosion")
#: Horizons of the production definition in seconds (fixed values).
HORIZONS = (900, 3_600, 14_400, 86_400)


def first_passage(frames: DataFrame, keys: list[str], condition: Column, horizon_s: int, persistence_s: int, ties: Sequence[str] = ()) -> DataFrame:
    """Outcome of each path at a horizon.  ``frames``: ``offset_s``,
    ``known_s``, ``trusted``, ``excluded`` (booleans) and what ``condition``
    reads.  Frames at one offset follow each other in the order of the columns
    ``ties``; without them in none that is certain.

    Only frames up to the horizon and before the first untrusted one count.
    The first run of matching frames that lasts ``persistence_s`` has occurred
    at its first frame, known at the confirming one.  Otherwise an excluded
    frame excludes, an untrusted one or a short path censors.
    """
    order = Window.partitionBy(*keys).orderBy("offset_s", *ties)
    place = F.struct("offset_s", *ties)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.filter(F.col("offset_s") <= horizon_s)
    rows = rows.withColumn("__broken", F.max((~F.col("trusted")).cast("int")).over(so_far))
    good = rows.filter("__broken = 0").withColumn("__match", F.coalesce(condition, F.lit(False)))
    # Islands: runs of matching frames share the number of misses before them.
    good = good.withColumn("__miss", F.sum((~F.col("__match")).cast("int")).over(so_far))
    run = Window.partitionBy(*keys, "__miss", "__match")
    good = good.withColumn("__start", F.min("offset_s").over(run))
    confirmed = good.filter(F.col("__match") & (F.col("offset_s") - F.col("__start") >= persistence_s))
    hit = confirmed.groupBy(*keys).agg(F.min_by(F.struct("__start", "known_s"), place).alias("__hit"))
    seen = good.groupBy(*keys).agg(F.max("offset_s").alias("__observed"), F.max_by("known_s", place).alias("__known"))
    broken = rows.filter("__broken = 1").groupBy(*keys).agg(F.min_by(F.struct("excluded", "known_s"), place).alias("__first_bad"))
    every = frames.select(*keys).distinct()
    joined = every.join(hit, keys, "left").join(seen, keys, "left").join(broken, keys, "left")
    excluded = F.coalesce(F.col("__first_bad.excluded"), F.lit(False))
    observed = F.coalesce("__observed", F.lit(0))
    outcome = (
        F.when(F.col("__hit").isNotNull(), "occurred")
        .when(excluded, "excluded")
        .when(F.col("__first_bad").isNotNull() | (observed < horizon_s), "censored")
        .otherwise("not_occurred")
    )
    known = F.when(F.col("__hit").isNotNull(), F.col("__hit.known_s")).when(excluded, F.col("__first_bad.known_s")).otherwise(F.coalesce("__known", F.lit(0)))
    return joined.select(*keys, outcome.alias("outcome"), F.col("__hit.__start").alias("offset_s"), known.cast("long").alias("known_s"), observed.cast("long").alias("observed_s"))


def resolve_competing(outcomes: DataFrame, keys: list[str], exclude_ties: bool = False) -> DataFrame:
    """Earliest occurred event of each origin, ties by priority, with the
    number of events at the same offset."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("event_type"))
    happened = outcomes.filter("outcome = 'occurred'").withColumn("__rank", rank)
    first = happened.groupBy(*keys).agg(
        F.min_by("event_type", F.struct("offset_s", "__rank")).alias("event_type"), F.min("offset_s").alias("offset_s"), F.collect_list("offset_s").alias("__all")
    )
    first = first.withColumn("simultaneous", F.size(F.filter("__all", lambda x: x == F.col("offset_s"))) - 1).drop("__all")
    tied = (F.col("simultaneous") > 0) if exclude_ties else F.lit(False)
    return first.withColumn("resolution", F.when(tied, "excluded").otherwise("primary"))


def outer_folds(first_ns: int, last_ns: int, training: int, calibration: int, test: int, purge: int, step: int) -> list[dict]:
    """Rolling folds: training, purge, calibration, purge, test; as many as fit
    before the end of coverage (last origin + 1)."""
    out, start = [], first_ns
    while True:
        training_end = start + training
        calibration_start = training_end + purge
        calibration_end = calibration_start + calibration
        test_start = calibration_end + purge
        if test_start + test > last_ns + 1:
            return out
        out.append(
            {
                "fold": len(out),
                "training_start": start,
                "training_end": training_end,
                "calibration_start": calibration_start,
                "calibration_end": calibration_end,
                "test_start": test_start,
                "test_end": test_start + test,
            }
        )
        start += step


def inner_folds(training_start: int, training_end: int, initial: int, validation: int, purge: int, step: int) -> list[dict]:
    """Expanding training, purge, validation inside an outer fold's training range."""
    out, end = [], training_start + initial
    while end + purge + validation <= training_end:
        out.append({"inner": len(out), "training_start": training_start, "training_end": end, "validation_start": end + purge, "validation_end": end + purge + validation})
        end += step
    return out


def fold_membership(spark: SparkSession, samples: DataFrame, folds: list[dict]) -> DataFrame:
    """Samples (``origin_ns``, ``outcome_end_ns``, ``as_known_ns``) with each
    fold and part that holds them: origin in the range, outcome over and known
    by its end.  The folds are a few rows (at most some hundreds) by design."""
    parts = [(f["fold"], p, f[f"{p}_start"], f[f"{p}_end"]) for f in folds for p in ("training", "calibration", "test")]
    table = spark.createDataFrame(parts, "fold long, part string, start_ns long, end_ns long")
    inside = (F.col("origin_ns") >= F.col("start_ns")) & (F.col("origin_ns") < F.col("end_ns"))
    done = (F.col("outcome_end_ns") <= F.col("end_ns")) & (F.col("as_known_ns") <= F.col("end_ns"))
    return samples.join(F.broadcast(table), inside & done)


def price_threshold(kind: str, floor: float | None = None, multiple: float | None = None, volatility: Column | None = None) -> Column:
    """Log-price threshold of a rule: a fixed fraction, a multiple of the
    origin's volatility, or the larger of both; missing unless in (0, 1)."""
    made = {"absolute": lambda: F.lit(floor), "scaled": lambda: volatility * multiple, "combined": lambda: F.greatest(F.lit(floor), volatility * multiple)}[kind]()
    valid = (made > 0) & (made < 1)
    if kind == "combined":  # without a volatility there is no threshold, not the floor alone
        valid = valid & volatility.isNotNull()
    return F.when(valid, made)


def rules(threshold: Column, limits: dict[str, float]) -> dict[str, Column]:
    """Conditions of the five event types on a frame against its origin
    (``*_0``): log return, volatility ratio, and the states of liquidity and of
    liquidations, each inclusive."""
    c = F.col
    thin = (c("depth") <= limits["depth_share"] * c("depth_0")) & (c("spread_bps") >= limits["spread_bps"])
    cascade = (c("liquidation_notional") >= limits["liquidation_notional"]) & (c("open_interest") <= (1 - limits["oi_drop"]) * c("open_interest_0"))
    return {
        "downside": c("log_return") <= -threshold,
        "upside": c("log_return") >= threshold,
        "volatility_explosion": c("volatility") >= limits["volatility_multiple"] * c("volatility_0"),
        "liquidity_vacuum": thin,
        "liquidation_cascade": cascade,
    }


def resolve_overlaps(outcomes: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """Occurred events of each origin under an overlap policy: ``allow`` keeps
    all, in order; ``primary`` the first, ties by priority; ``exclude_ties``
    none where several come first at once.  ``events`` (in order), ``status``."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("event_type"))
    hit = F.when(F.col("outcome") == "occurred", F.struct("offset_s", rank.alias("rank"), "event_type"))
    rows = outcomes.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("all"))
    ties = F.size(F.filter("all", lambda x: x["offset_s"] == F.col("all")[0]["offset_s"]))
    names = F.transform("all", lambda x: x["event_type"])
    keep = {"allow": names, "primary": F.slice(names, 1, 1), "exclude_ties": F.when(ties > 1, F.array().cast("array<string>")).otherwise(F.slice(names, 1, 1))}[policy]
    status = F.when(F.size("all") == 0, "none").when((F.lit(policy) == "exclude_ties") & (ties > 1), "excluded").otherwise("resolved")
    return rows.select(*keys, F.when(F.size("all") == 0, F.array().cast("array<string>")).otherwise(keep).alias("events"), status.alias("status"))


def evidence_hash(columns: list[str]) -> Column:
    """Digest of a label's evidence: its columns in order, nulls marked."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)


#: Days of the reference schedule: training, purge, calibration, purge, test, step (fixed values).
REFERENCE_DAYS = (180, 60, 30, 30, 30, 30)


def purge_ns(longest_horizon_s: int, longest_lag_s: int) -> int:
    """What must lie between two parts of a fold: the longest outcome and the
    longest time until one is known."""
    return (longest_horizon_s + longest_lag_s) * 1_000_000_000


def fold_manifest(samples: DataFrame, membership: DataFrame, identity: str) -> DataFrame:
    """Per fold and part: number of samples and an order-free digest of them."""
    digest = F.sum(F.xxhash64(identity).cast("decimal(38,0)")).cast("string")
    rows = membership.join(samples.select(identity).distinct(), identity)
    return rows.groupBy("fold", "part").agg(F.count("*").alias("samples"), digest.alias("digest"))
