"""Scores, quantiles and distances as aggregates and column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def log_loss(p: Column, y: Column, w: Column, floor: float = 1e-15) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - floor)), F.lit(floor))
    return F.sum(w * F.when(y == 1, -F.log(q)).otherwise(-F.log(1 - q))) / F.sum(w)


def brier(p: Column, y: Column, w: Column) -> Column:
    return F.sum(w * (p - y) * (p - y)) / F.sum(w)


def effective_size(w: Column) -> Column:
    """Kish: (sum of weights)^2 / sum of squares."""
    return F.pow(F.sum(w), 2) / F.sum(w * w)


def wilson(share: Column, n: Column, upper: bool) -> Column:
    """Bound of the 95% Wilson interval at an effective size."""
    z2 = Z95 * Z95
    half = Z95 * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    centre = share + z2 / (2 * n)
    return ((centre + half) if upper else (centre - half)) / (1 + z2 / n)


def reliability_bins(df: DataFrame, p: str, y: str, w: str, bins: int) -> DataFrame:
    """Equal-width bins with weight, mean prediction and mean outcome."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(at.alias("bin")).agg(
        F.sum(w).alias("weight"),
        (F.sum(F.col(w) * F.col(p)) / F.sum(w)).alias("mean_predicted"),
        (F.sum(F.col(w) * F.col(y)) / F.sum(w)).alias("mean_observed"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("weight") * F.abs(F.col("mean_predicted") - F.col("mean_observed"))) / F.sum("weight")).alias("ece"))


def hazen(values: Column, p: float) -> Column:
    """Quantile at position n p - 0.5 of the sorted array (not ``percentile``)."""
    v = F.array_sort(values)
    n = F.size(v)
    at = n * F.lit(float(p)) - 0.5
    low = F.floor(at).cast("int")
    frac = at - low
    inner = F.get(v, low) * (1 - frac) + F.get(v, low + 1) * frac
    return F.when(n == 0, None).when(at <= 0, F.get(v, F.lit(0))).when(at >= n - 1, F.get(v, n - 1)).otherwise(inner)


def nearest_rank(values: Column, percent: int) -> Column:
    """The ceil(n p / 100)-th smallest."""
    v = F.array_sort(values)
    return F.get(v, F.greatest(F.ceil(F.size(v) * F.lit(percent) / 100).cast("int") - 1, F.lit(0)))


def order_statistics(df: DataFrame, keys: list[str], value: str, hazens: dict[str, float], ranks: dict[str, int]) -> DataFrame:
    """Exact quantiles of a column by key: Hazen's (position n p - 0.5) and
    nearest ranks (the ceil(n p / 100)-th smallest).  Values are counted first,
    so what is ordered are the distinct ones, and no column is collected."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.withColumns({"__upto": F.sum("__n").over(order), "__all": F.sum("__n").over(Window.partitionBy(*keys))})

    def at(place: Column) -> Column:  # the value of a place, counted from 0
        inside = F.greatest(F.least(place, F.col("__all") - 1), F.lit(0))
        return F.max(F.when((F.col("__upto") - F.col("__n") <= inside) & (inside < F.col("__upto")), F.col("__v")))

    made = []
    for name, p in hazens.items():
        place = F.col("__all") * F.lit(float(p)) - 0.5
        low = F.floor(place).cast("long")
        part = F.max(F.when((place <= 0) | (place >= F.col("__all") - 1), F.lit(0.0)).otherwise(place - low))
        made.append((at(low) * (1 - part) + at(low + 1) * part).alias(name))
    for name, p in ranks.items():
        made.append(at(F.ceil(F.col("__all") * F.lit(p) / 100).cast("long") - 1).alias(name))
    return rows.groupBy(*keys).agg(*made)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def beta_mean(successes: Column, n: Column, a: float, b: float) -> Column:
    return (successes + a) / (n + a + b)


def beta_quantile(p: float, a: float, b: float) -> float:
    """Inverse of the regularised incomplete beta function, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if beta_cdf(mid, a, b) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def cumulative_incidence(df: DataFrame, keys: list[str], hazards: list[str]) -> DataFrame:
    """From cause-specific hazards per ``bucket``: survival before each bucket
    (a running product by logarithms) and cumulative incidence by cause."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    stay = F.lit(1.0) - sum((F.col(h) for h in hazards), F.lit(0.0))
    rows = df.withColumn("__log", F.when(stay > 0, F.log(stay)).otherwise(float("-inf")))
    before = F.coalesce(F.exp(F.sum("__log").over(order.rowsBetween(Window.unboundedPreceding, -1))), F.lit(1.0))
    rows = rows.withColumn("survival_before", before)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"cif_{h}": F.sum(F.col("survival_before") * F.col(h)).over(upto) for h in hazards}).drop("__log")


def adaptive_bins(df: DataFrame, p: str, y: str, w: str, bins: int) -> DataFrame:
    """Bins of equal weight: predictions in order fill a bin until it holds its
    share of the whole weight; equal predictions stay together.  ``bin``,
    ``weight``, ``mean_predicted``, ``mean_observed``.

    Filling starts anew with each bin, so it is a fold, over the distinct
    predictions only (aggregated first); one task holds one bin."""
    distinct = df.groupBy(F.col(p).cast("double").alias("p")).agg(F.sum(w).cast("double").alias("w"), F.sum(F.col(w) * F.col(y)).cast("double").alias("wy"))
    share = df.agg((F.sum(w).cast("double") / bins).alias("share"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, [0.0, 0.0, 0.0]
        out: list[tuple] = []
        for batch in batches:
            for q, weight, hit, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = [held[0] + weight, held[1] + weight * q, held[2] + hit]
                if held[0] >= target:
                    out.append((number, held[0], held[1] / held[0], held[2] / held[0]))
                    number, held = number + 1, [0.0, 0.0, 0.0]
        if held[0] > 0:
            out.append((number, held[0], held[1] / held[0], held[2] / held[0]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *[pa.float64()] * 3], strict=True)], ["bin", "weight", "mean_predicted", "mean_observed"])

    ordered = distinct.crossJoin(F.broadcast(share)).repartition(1).sortWithinPartitions("p").select("p", "w", "wy", "share")
    return ordered.mapInArrow(fill, "bin long, weight double, mean_predicted double, mean_observed double")
