"""Windows over ordered rows: half-life averages, count and threshold bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ewma(df: DataFrame, keys: list[str], value: str, half_life_ns: int) -> DataFrame:
    """``keys``, ``n`` and ``ewma`` at the last row, in order of ``(t, seq)``.

    The recursion ``v = d v + (1 - d) x`` with ``d = 2**(-dt / half_life)``
    unrolls to a weighted sum whose weights need only the gap before a row and
    the distance to the last one, so it is one window and one aggregation.
    """
    rows = df.withColumns(
        {"__gap": F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t", "seq")), "__left": F.max("t").over(Window.partitionBy(*keys)) - F.col("t")}
    )
    decay = lambda ns: F.pow(F.lit(2.0), -ns / F.lit(float(half_life_ns)))
    weight = F.when(F.col("__gap").isNull(), 1.0).otherwise(1 - decay(F.col("__gap"))) * decay(F.col("__left"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(value) * weight).alias("ewma"))


def event_count_bars(df: DataFrame, keys: list[str], extent: int, advance: int) -> DataFrame:
    """Bars that close every ``advance`` rows once ``extent`` rows are there,
    over the last ``extent`` rows: ``keys``, ``bar``, ``first_t``, ``close_t``,
    ``total`` of ``value``."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    last = order.rowsBetween(-(extent - 1), 0)
    rows = df.withColumns({"__rn": F.row_number().over(order), "first_t": F.min("t").over(last), "total": F.sum("value").over(last)})
    closes = (F.col("__rn") >= extent) & ((F.col("__rn") - extent) % advance == 0)
    return rows.filter(closes).select(*keys, ((F.col("__rn") - extent) / advance).cast("long").alias("bar"), "first_t", F.col("t").alias("close_t"), "total")


def threshold_bars(df: DataFrame, key: str, threshold: float, partitions: int | None = None) -> DataFrame:
    """Bars of one integer key that close when the sum of ``amount`` reaches
    the threshold; the sum then restarts at zero (nothing is carried over).
    ``key``, ``bar``, ``n``, ``total``, ``close_t``; an open last bar is left out.

    The restart makes this a sequential fold.  Rows stream through sorted by
    key and time; only the running bar is held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bar, n, total = None, 0, 0, 0.0
        for batch in batches:
            out: list[tuple] = []
            for k, t, amount in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    now, bar, n, total = k, 0, 0, 0.0
                n += 1
                total += amount
                if total >= threshold:
                    out.append((k, bar, n, total, t))
                    bar, n, total = bar + 1, 0, 0.0
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, kinds, strict=True)], [key, "bar", "n", "total", "close_t"])

    rows = df.select(F.col(key).cast("long").alias(key), "t", "seq", F.col("amount").cast("double").alias("amount"))
    dealt = rows.repartition(partitions, key) if partitions else rows.repartition(key)
    ordered = dealt.sortWithinPartitions(key, "t", "seq").select(key, "t", "amount")
    return ordered.mapInArrow(fold, f"{key} long, bar long, n long, total double, close_t long")


def fold_threshold(amounts: np.ndarray, threshold: float) -> list[int]:
    """Positions at which bars close (the plain rule, for tests)."""
    out, total = [], 0.0
    for k, a in enumerate(amounts):
        total += a
        if total >= threshold:
            out.append(k)
            total = 0.0
    return out
