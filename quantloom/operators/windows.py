"""Window membership, per-source finality and revisions.

Windows are half-open and anchored to the epoch, in integer nanoseconds.
Finality is decided by the slowest required source plus a lateness, with
source health; one watermark for the whole stream cannot express that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Health of a source, best first (fixed values).
HEALTH = ("healthy", "recovering", "degraded", "unhealthy", "quarantined")


def tumbling_start(t: Column, extent_ns: int, anchor_ns: int = 0) -> Column:
    """Start of the window that holds ``t`` (also before the anchor)."""
    return t - F.pmod(t - F.lit(anchor_ns), F.lit(extent_ns))


def sliding(df: DataFrame, extent_ns: int, advance_ns: int, anchor_ns: int = 0) -> DataFrame:
    """One row per window (``window_start_ns``, ``window_end_ns``) of each row;
    windows that start before the epoch are dropped."""
    if not 0 < advance_ns <= extent_ns or -(-extent_ns // advance_ns) > 1024:
        raise ValueError("the advance must be positive, at most the extent, and give at most 1,024 windows")
    last = tumbling_start(F.col("t"), advance_ns, anchor_ns)
    starts = F.transform(F.sequence(F.lit(0), F.lit(-(-extent_ns // advance_ns) - 1)), lambda k: last - k.cast("long") * advance_ns)
    rows = df.withColumn("window_start_ns", F.explode(starts))
    rows = rows.filter((F.col("window_start_ns") >= 0) & (F.col("t") < F.col("window_start_ns") + extent_ns))
    return rows.withColumn("window_end_ns", F.col("window_start_ns") + extent_ns)


def finality(windows: DataFrame, marks: DataFrame, keys: list[str], lateness_ns: int, allowed: tuple[str, ...] = ("healthy",)) -> DataFrame:
    """State of each window from its key's sources.  ``marks``: ``keys``,
    ``source``, ``required`` (boolean), ``watermark_ns`` (null: none yet),
    ``as_known_ns``, ``health`` (null: not known yet).  A required source whose
    health is not among the allowed makes the window invalid; all of them past
    end + lateness, with a known health, make it final."""
    past = F.coalesce(F.col("watermark_ns") >= F.col("window_end_ns") + lateness_ns, F.lit(False)) & F.col("health").isNotNull()
    need = marks.filter("required")
    bad = F.coalesce(F.bool_or(~F.col("health").isin(*allowed)), F.lit(False))
    state = F.when(bad, "invalid").when(F.bool_and(past), "final").otherwise("provisional")
    return windows.join(need, keys).groupBy(*keys, "window_start_ns", "window_end_ns").agg(
        state.alias("finality_state"),
        F.min("watermark_ns").alias("watermark_ns"),
        F.max("as_known_ns").alias("finality_as_known_at_ns"),
        F.count("*").alias("required_sources"),
        F.count_if(past).alias("sources_past"),
    )


def effective_frontier(marks: DataFrame, keys: list[str], lateness_ns: int, allowed: tuple[str, ...] = ("healthy",)) -> DataFrame:
    """Least required watermark less the lateness; null if any is missing or its health is not allowed."""
    usable = F.bool_and(F.col("watermark_ns").isNotNull() & F.coalesce(F.col("health").isin(*allowed), F.lit(False)))
    return marks.filter("required").groupBy(*keys).agg(F.when(usable, F.min("watermark_ns") - lateness_ns).alias("frontier_ns"))


def coverage(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Expected and observed required sources and the worst health."""
    rank = F.array_position(F.array(*map(F.lit, HEALTH)), F.col("health"))
    return marks.filter("required").groupBy(*keys).agg(
        F.count("*").alias("expected"),
        F.count("watermark_ns").alias("observed"),
        F.element_at(F.array(*map(F.lit, HEALTH)), F.max(rank).cast("int")).alias("worst_health"),
    )


def revisions(emissions: DataFrame, keys: list[str]) -> DataFrame:
    """Append-only history of a window's emissions in order of
    ``(as_known_ns, seq)``: a row whose value differs from the one before is
    the next revision; once a window was final later ones are corrections."""
    order = Window.partitionBy(*keys).orderBy("as_known_ns", "seq")
    changed = emissions.withColumn("__new", ~F.col("value").eqNullSafe(F.lag("value").over(order)) | (F.row_number().over(order) == 1)).filter("__new").drop("__new")
    final_before = F.coalesce(F.bool_or(F.col("final")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    state = F.when(final_before, "corrected").when(F.col("final"), "final").when(F.row_number().over(order) > 1, "revised").otherwise("provisional")
    return changed.withColumns({"revision": F.row_number().over(order), "finality_state": state})


def watermark_history(updates: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Updates of each source and partition in order of ``seq``, with the
    ``watermark_ns`` after each and the ``fault`` of those that are refused: an
    event time that is not positive or later than it was known, or that falls
    back behind the accepted ones (``regression``), or a knowledge time that
    does.  A refused update changes nothing, so this is a fold: rows stream
    through sorted by key, and a task holds one state.

    ``updates``: ``keys``, ``seq``, ``event_time_ns``, ``as_known_ns``."""
    names = updates.columns
    at = [names.index(c) for c in ("event_time_ns", "as_known_ns")]
    key_at = [names.index(k) for k in keys]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mark, known = None, None, None
        for batch in batches:
            marks, faults = [], []
            for key, t, k in zip(zip(*(batch.column(i).to_pylist() for i in key_at), strict=True), *(batch.column(i).to_pylist() for i in at), strict=True):
                if key != now:
                    now, mark, known = key, None, None
                fault = None
                if t is None or k is None or t <= 0 or k < t:
                    fault = "invalid_watermark"
                elif mark is not None and t < mark:
                    fault = "regression"
                elif known is not None and k < known:
                    fault = "invalid_watermark"
                else:
                    mark, known = t, k
                marks.append(mark)
                faults.append(fault)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.int64()), pa.array(faults, pa.string())], [*names, "watermark_ns", "fault"])

    schema = T.StructType([*updates.schema.fields, T.StructField("watermark_ns", T.LongType()), T.StructField("fault", T.StringType())])
    dealt = updates.repartition(partitions, *keys) if partitions else updates.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "seq").mapInArrow(fold, schema)


def late_arrivals(events: DataFrame, keys: list[str], lateness_ns: int) -> DataFrame:
    """Events in order of arrival (``arrival``) with the ``frontier_ns`` that
    stood before each (largest event time so far less the lateness) and its
    ``route``: ``in_order``, ``replayed`` (late, but after the frontier, so the
    suffix is computed again), or ``correction`` (at or before the frontier:
    compacted, never dropped silently)."""
    before = Window.partitionBy(*keys).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    most = F.max("t").over(before)
    route = F.when(most.isNull() | (F.col("t") >= most), "in_order").when(F.col("t") > most - lateness_ns, "replayed").otherwise("correction")
    return events.withColumns({"frontier_ns": most - lateness_ns, "route": route})


def correction_decisions(corrections: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Corrections (``keys``, ``window_start_ns``, ``corrected_t``, ``health``)
    against the windows' states: ``accepted``, or the ``fault``: a time outside
    the window, a source that is not healthy, or a window that is not final."""
    rows = corrections.join(windows, [*keys, "window_start_ns"], "left")
    inside = (F.col("corrected_t") >= F.col("window_start_ns")) & (F.col("corrected_t") < F.col("window_end_ns"))
    fault = (
        F.when(F.col("window_end_ns").isNull(), "unknown_window")
        .when(~inside, "invalid_correction_time")
        .when(F.coalesce(F.col("health") != "healthy", F.lit(True)) | (F.col("finality_state") != "final"), "invalid_correction_state")
    )
    return rows.withColumns({"fault": fault, "accepted": fault.isNull()})


def ticks(spans: DataFrame, internal_ns: int = 100_000_000, published_ns: int = 1_000_000_000) -> DataFrame:
    """Every tick due in ``(from_ns, to_ns]`` of each span, internal ones before
    published ones at the same time, numbered without a gap."""
    due = lambda step: F.sequence(F.floor(F.col("from_ns") / step).cast("long") + 1, F.floor(F.col("to_ns") / step).cast("long"))
    made = lambda step, kind, rank: F.when(
        F.floor(F.col("to_ns") / step) > F.floor(F.col("from_ns") / step),
        F.transform(due(step), lambda k: F.struct((k * step).alias("at_ns"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))),
    ).otherwise(F.array().cast("array<struct<at_ns: bigint, rank: int, kind: string>>"))
    every = F.array_sort(F.concat(made(internal_ns, "internal", 0), made(published_ns, "published", 1)))
    return spans.select("*", F.posexplode(every).alias("pos", "tick")).select(*spans.columns, (F.col("pos") + 1).cast("long").alias("sequence"), "tick.at_ns", "tick.kind")


def fired(timers: DataFrame, clock: DataFrame, keys: list[str]) -> DataFrame:
    """Timers (``keys``, ``timer``, ``due_ns``, ``cancelled_ns``) that a logical
    clock (``keys``, ``now_ns``) has fired, in order of ``(due_ns, timer)``: due
    by then, and not cancelled before they were due."""
    rows = timers.join(clock, keys).filter((F.col("due_ns") <= F.col("now_ns")) & ~F.coalesce(F.col("cancelled_ns") < F.col("due_ns"), F.lit(False)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("due_ns", "timer")))


def rolling_count(df: DataFrame, keys: list[str], at: str, span: int) -> DataFrame:
    """Rows of each key in the ``span`` that ends with the row (``at``: a whole
    number, ties included), as ``rolling``.  A key's time is cut into chunks of
    a span; a row counts in its own chunk and is context in the next, so a key
    that holds most rows is spread over as many tasks as it has chunks."""
    chunk = F.floor(F.col(at) / span).cast("long")
    both = df.withColumns({"__chunk": F.explode(F.array(chunk, chunk + 1)), "__own": chunk})
    w = Window.partitionBy(*keys, "__chunk").orderBy(at).rangeBetween(-(span - 1), 0)
    return both.withColumn("rolling", F.count("*").over(w)).filter("__chunk = __own").drop("__chunk", "__own")
