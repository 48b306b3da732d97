"""As-of, bitemporal and range joins.

As-of joins are a union and one window over the key: both sides are shuffled
once by the key and nothing is multiplied.  The bitemporal join needs all rows
before a time, so it is an equi-join on the entity with each revision's
interval of knowledge as residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _asof(left: DataFrame, right: DataFrame, key: str, limit_ns: int | None, forward: bool) -> DataFrame:
    names = left.columns
    probe = left.select(F.struct(*names).alias("__row"), F.col(key).alias("__k"), F.col("t").alias("__t"), F.lit(None).cast(right.schema["value"].dataType).alias("value"))
    quote = right.select(F.lit(None).cast(probe.schema["__row"].dataType).alias("__row"), F.col(key).alias("__k"), F.col("t").alias("__t"), "value")
    both = probe.unionByName(quote)
    is_quote = F.col("__row").isNull()
    at = F.when(is_quote, F.struct(F.col("__t").alias("t"), "value"))
    # At equal times a quote counts as known, whichever way one looks.
    if forward:
        w = Window.partitionBy("__k").orderBy("__t", is_quote.cast("int"), F.col("value")).rowsBetween(1, Window.unboundedFollowing)
        seen = F.first(at, ignorenulls=True).over(w)
    else:
        w = Window.partitionBy("__k").orderBy("__t", (~is_quote).cast("int"), F.col("value")).rowsBetween(Window.unboundedPreceding, -1)
        seen = F.last(at, ignorenulls=True).over(w)
    found = both.withColumn("__seen", seen).filter(F.col("__row").isNotNull())
    near = F.lit(True) if limit_ns is None else F.abs(F.col("__seen.t") - F.col("__t")) <= limit_ns
    return found.select("__row.*", F.when(near, F.col("__seen.t")).alias("value_t"), F.when(near, F.col("__seen.value")).alias("value"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, max_age_ns: int | None = None) -> DataFrame:
    """``left`` (with ``key``, ``t``) and ``value``, ``value_t`` of the last
    ``right`` row at or before ``t`` (of equal times the largest value)."""
    return _asof(left, right, key, max_age_ns, forward=False)


def asof_forward(left: DataFrame, right: DataFrame, key: str, tolerance_ns: int | None = None) -> DataFrame:
    """The same for the first ``right`` row at or after ``t``."""
    return _asof(left, right, key, tolerance_ns, forward=True)


def point_in_time_join(predictions: DataFrame, features: DataFrame, entity: str, identity: list[str]) -> DataFrame:
    """For each prediction (``prediction_id``, ``entity``, ``prediction_ns``)
    the newest revision, known by then, of each feature identity (which holds
    the window's start and end, so every past window is returned).

    A revision is the newest from when all its guards hold until a later one's
    do, so each gets its interval first, by a window over its own history; the
    join then gives the result's rows and nothing more."""
    known = F.greatest("event_time_end_ns", "as_known_at_ns", "computed_at_ns", "finality_as_known_at_ns")
    later = Window.partitionBy(entity, *identity).orderBy(F.desc("revision")).rowsBetween(Window.unboundedPreceding, -1)
    spans = features.withColumn("__from", known).withColumn("__until", F.min("__from").over(later))
    spans = spans.filter(F.col("__until").isNull() | (F.col("__from") < F.col("__until")))
    return range_join(predictions, spans, entity, "prediction_ns", "__from", "__until").drop("__from", "__until")


def as_known_at(features: DataFrame, when: Column, identity: list[str]) -> DataFrame:
    """Corrections known by ``when``, latest revision of each identity."""
    newest = Window.partitionBy(*identity).orderBy(F.desc("revision"))
    known = features.filter((F.col("as_known_at_ns") <= when) & (F.col("computed_at_ns") <= when) & (F.col("finality_as_known_at_ns") <= when))
    return known.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank")


def revision_faults(features: DataFrame, identity: list[str]) -> DataFrame:
    """Identities whose history does not start at 1, skips a revision, goes
    back in knowledge time, or whose later rows are not corrections."""
    w = Window.partitionBy(*identity).orderBy("revision")
    checked = features.select(
        *identity,
        (F.col("revision") - F.coalesce(F.lag("revision").over(w), F.lit(0)) != 1).alias("__gap"),
        F.coalesce(F.col("as_known_at_ns") < F.lag("as_known_at_ns").over(w), F.lit(False)).alias("__back"),
        ((F.col("revision") > 1) & (F.col("finality_state") != "corrected")).alias("__state"),
    )
    return checked.filter("__gap or __back or __state").select(*identity).distinct()


def range_join(facts: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Rows with the spans of their key that hold ``at`` (start <= at < end; an
    open end is null)."""
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return facts.join(spans, key).filter(inside)


def dataset_rows(features: DataFrame, labels: DataFrame, universe: DataFrame, keys: list[str], least_quality: int) -> DataFrame:
    """Training rows: labels at an origin, members of the universe then, with
    their features as an ordered list.  Only the guards that a dataset row has
    are tested: event end and knowledge by the origin, and the quality."""
    usable = features.filter(
        (F.col("event_time_end_ns") <= F.col("origin_ns")) & (F.col("as_known_at_ns") <= F.col("origin_ns")) & (F.col("quality_millionths") >= least_quality)
    )
    rows = usable.groupBy(*keys, "origin_ns").agg(
        F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("features"),
        F.min("quality_millionths").alias("quality_millionths"),
        (F.count("*") - F.countDistinct("feature_id")).alias("duplicates"),
    )
    member = range_join(labels, universe, keys[0], "origin_ns", "valid_from_ns", "valid_to_ns").filter(F.col("known_at_ns") <= F.col("origin_ns"))
    return rows.filter("duplicates = 0").drop("duplicates").join(member, [*keys, "origin_ns"])
