"""Fast-state trigger vectors: the newest inputs of an entity, masked by what
may be trusted of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.derivatives import trigger_health


def trigger_vectors(inputs: DataFrame, keys: list[str], names: list[str], market: list[str], aligned: tuple[str, str] | None = None) -> DataFrame:
    """One row per ``keys`` and ``as_of_ns`` with a column per input and the
    reasons of those it lacks.  ``inputs``: ``keys``, ``as_of_ns``, ``input``,
    ``value``, ``event_ns``, ``ttl_ns``, ``source_lost``, ``quality``,
    ``coverage``.

    The newest value at or before ``as_of_ns`` counts; past its time to live it
    is ``expired``.  A lost source takes the ``market`` inputs away
    (``source_disconnected``).  Two ``aligned`` inputs must be of one event
    time, else both are ``unaligned``."""
    known = inputs.filter(F.col("event_ns") <= F.col("as_of_ns"))
    newest = lambda n: F.max_by(F.when(F.col("input") == n, F.struct("value", "event_ns", "ttl_ns")), F.when(F.col("input") == n, F.col("event_ns")))
    rows = known.groupBy(*keys, "as_of_ns").agg(
        F.bool_or("source_lost").alias("source_lost"), F.min("quality").alias("quality"), F.min("coverage").alias("coverage"), *(newest(n).alias(f"__{n}") for n in names)
    )
    reasons, values = [], {}
    for n in names:
        x = F.col(f"__{n}")
        reason = F.when(x.isNull() | x["value"].isNull(), "missing").when(F.col("as_of_ns") - x["event_ns"] > x["ttl_ns"], "expired")
        if n in market:
            reason = F.when(F.col("source_lost"), "source_disconnected").otherwise(reason)
        if aligned and n in aligned:
            other = F.col(f"__{aligned[1 - aligned.index(n)]}")
            reason = F.coalesce(reason, F.when(~F.coalesce(other["event_ns"] == x["event_ns"], F.lit(False)), "unaligned"))
        reasons.append(F.when(reason.isNotNull(), F.concat_ws(":", F.lit(n), reason)))
        values[n] = F.when(reason.isNull(), x["value"])
    missing = F.array_compact(F.array(*reasons))
    health = trigger_health(F.col("source_lost"), F.size(missing), F.col("quality"), F.col("coverage"))
    return rows.select(*keys, "as_of_ns", *(c.alias(n) for n, c in values.items()), missing.alias("missing"), health.alias("health"))
