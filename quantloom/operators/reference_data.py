"""Reference data: instrument history, source health, forecasts and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed moves of a source's health (fixed values).
HEALTH_MOVES = {
    "recovering": ("healthy", "degraded", "unhealthy", "quarantined"),
    "healthy": ("degraded", "unhealthy", "quarantined"),
    "degraded": ("healthy", "unhealthy", "recovering", "quarantined"),
    "unhealthy": ("recovering", "quarantined"),
    "quarantined": ("recovering",),
}


def catalogue_as_known(log: DataFrame, when: Column, key: str = "instrument") -> DataFrame:
    """Latest revision of each instrument among the log's entries known by ``when``."""
    newest = Window.partitionBy(key).orderBy(F.desc("revision"))
    return log.filter(F.col("known_at_ns") <= when).withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank")


def resolve_symbols(events: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (``venue``, ``symbol``, ``event_time_ns``) with the one listed
    instrument of that symbol then; those with none or several, with a reason."""
    listed = (F.col("event_time_ns") >= F.col("listing_ns")) & (F.col("delisting_ns").isNull() | (F.col("event_time_ns") < F.col("delisting_ns")))
    keyed = events.withColumn("__row", F.monotonically_increasing_id())
    found = keyed.join(catalogue.select("venue", "symbol", "instrument", "listing_ns", "delisting_ns"), ["venue", "symbol"], "left")
    matches = found.groupBy("__row").agg(F.count_if(F.coalesce(listed, F.lit(False))).alias("__n"), F.max(F.when(listed, F.col("instrument"))).alias("instrument"))
    joined = keyed.join(matches, "__row").drop("__row")
    good = joined.filter("__n = 1").drop("__n")
    bad = joined.filter("__n <> 1").withColumn("reason", F.when(F.col("__n") == 0, "not_listed").otherwise("ambiguous")).drop("__n", "instrument")
    return good, bad


def illegal_health_moves(states: DataFrame) -> DataFrame:
    """Rows (``source``, ``epoch``, ``sequence``, ``health``) whose state cannot
    follow the one before, or whose sequence does not grow by one."""
    order = Window.partitionBy("source", "epoch").orderBy("sequence")
    before, last = F.lag("health").over(order), F.lag("sequence").over(order)
    allowed = F.create_map(*[x for k, v in HEALTH_MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = states.withColumns({"__before": before, "__last": last})
    jump = F.col("__before").isNotNull() & ~F.array_contains(F.element_at(allowed, F.col("__before")), F.col("health"))
    return rows.filter(jump | (F.col("sequence") - F.col("__last") != 1)).drop("__before", "__last")


def ledger_counts(ops: DataFrame, start_ns: int, end_ns: int, retired_ns: int) -> DataFrame:
    """Operational events per source and kind in [start, end); events below the
    retirement watermark are gone, so a window that begins before it is refused."""
    if start_ns < retired_ns:
        raise ValueError("the window begins before the retirement watermark")
    return ops.filter((F.col("t") >= start_ns) & (F.col("t") < end_ns)).groupBy("source", "kind").agg(F.count("*").alias("n"))


def expand_at_risk(samples: DataFrame, edges: list[int]) -> DataFrame:
    """One row per bucket in which a sample is still at risk.  ``samples``:
    ``sample_id``, ``duration_s``, ``cause`` (0: censored).  ``outcome`` is the
    cause in the last bucket, else 0; a censored sample counts full buckets only."""
    starts = [0, *edges[:-1]]
    table = F.array(*[F.struct(F.lit(k).alias("bucket"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s")) for k, (a, b) in enumerate(zip(starts, edges, strict=True))])
    rows = samples.withColumn("__b", F.explode(table)).select(*samples.columns, "__b.*")
    at_risk = F.when(F.col("cause") == 0, F.col("duration_s") >= F.col("end_s")).otherwise(F.col("duration_s") > F.col("start_s"))
    hit = (F.col("cause") != 0) & (F.col("duration_s") > F.col("start_s")) & (F.col("duration_s") <= F.col("end_s"))
    return rows.filter(at_risk).withColumn("outcome", F.when(hit, F.col("cause")).otherwise(0)).drop("duration_s", "cause")


def forecast_faults() -> Column:
    """First rule a forecast's ``points`` (horizon_s, probability, lower, upper) break."""
    p = F.col("points")
    n = F.size(p)
    pairs = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda k: F.get(p, k)
    return (
        F.when(n == 0, "empty")
        .when(F.exists(p, lambda x: ~x["probability"].between(0, 1)), "probability_range")
        .when(F.exists(p, lambda x: (x["lower"] > x["probability"]) | (x["probability"] > x["upper"])), "interval")
        .when(F.exists(pairs, lambda k: at(k)["horizon_s"] <= at(k - 1)["horizon_s"]), "horizon_order")
        .when(F.exists(pairs, lambda k: at(k)["probability"] < at(k - 1)["probability"]), "incidence_decreases")
    )


def oof_matrix(predictions: DataFrame, modules: list[str]) -> DataFrame:
    """Out-of-fold predictions (``row_id``, ``module``, ``value``) as a row per
    sample; modules without a value are listed in ``missing``.  A row with two
    values of one module is left out (duplicates are errors)."""
    twice = predictions.groupBy("row_id", "module").count().filter("count > 1").select("row_id").distinct()
    wide = predictions.join(twice, "row_id", "left_anti").groupBy("row_id").pivot("module", modules).agg(F.first("value"))
    missing = F.array_compact(F.array(*[F.when(F.col(m).isNull(), m) for m in modules]))
    return wide.withColumn("missing", missing)


def base_rate_fallback(strata: DataFrame, least: int) -> DataFrame:
    """Rate of the narrowest stratum with ``least`` observations: combined,
    then regime, hour of week, unconditional.  Columns ``n_<s>``, ``rate_<s>``."""
    order = ("combined", "regime", "hour", "all")
    chosen = F.coalesce(*[F.when(F.col(f"n_{s}") >= least, F.lit(s)) for s in order], F.lit("all"))
    rate = F.coalesce(*[F.when(F.col(f"n_{s}") >= least, F.col(f"rate_{s}")) for s in order], F.col("rate_all"))
    return strata.withColumns({"stratum": chosen, "rate": rate})
