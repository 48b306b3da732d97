"""Aggregates and window expressions over price paths.

A path is ordered by ``(t, seq)`` within its keys.  Measures follow the
catalogue: population skewness and kurtosis, uncentred realised variance,
a zero variance is missing (NULL), never 0.  A price that is not finite and
positive is no price: it counts as missing, and so do the returns on both its
sides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def path(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("t", "seq")


def valid_price(price: Column) -> Column:
    """The price if it is finite and positive, else NULL."""
    return F.when((price > 0) & (price < float("inf")), price)


def log_return(now: Column, before: Column) -> Column:
    return F.log(valid_price(now) / valid_price(before))


def relative(now: Column, before: Column) -> Column:
    """``now / before - 1`` of two prices."""
    return valid_price(now) / valid_price(before) - 1


def with_returns(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``r`` (log return from the row before), ``r1`` (the return before
    it) and ``next_r``."""
    w = path(keys)
    df = df.withColumn("r", log_return(F.col("price"), F.lag("price").over(w)))
    return df.withColumns({"r1": F.lag("r").over(w), "next_r": F.lead("r").over(w)})


def realized_variance() -> Column:
    return F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0))


def semivariance(up: bool) -> Column:
    keep = F.col("r") > 0 if up else F.col("r") < 0
    return F.sum(F.when(keep, F.col("r") * F.col("r")).otherwise(0.0))


def bipower_variation() -> Column:
    return F.lit(math.pi / 2) * F.coalesce(F.sum(F.abs(F.col("r")) * F.abs(F.col("r1"))), F.lit(0.0))


def jump_variation() -> Column:
    return F.greatest(realized_variance() - bipower_variation(), F.lit(0.0))


def autocorrelation() -> Column:
    """Lag-1 Pearson correlation; missing below three pairs or without variance."""
    pair = F.col("r").isNotNull() & F.col("r1").isNotNull()
    x, y = F.when(pair, F.col("r")), F.when(pair, F.col("r1"))
    # corr divides by zero on a constant side; the variances are tested first
    return F.when((F.count(x) >= 3) & (F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y))


def variance_ratio() -> Column:
    """Population variance of overlapping two-step returns over twice the one-step one."""
    base = F.var_pop("r")
    return F.when(base > 0, F.var_pop(F.col("r") + F.col("r1")) / (2 * base))


def skewness() -> Column:
    return F.when((F.count("r") >= 3) & (F.var_pop("r") > 0), F.skewness("r"))


def excess_kurtosis() -> Column:
    return F.when((F.count("r") >= 4) & (F.var_pop("r") > 0), F.kurtosis("r"))


def reversal(least_move: float) -> Column:
    """Mean of minus the sign times the next return after moves of that size."""
    moved = (F.abs(F.col("r")) >= least_move) & F.col("next_r").isNotNull()
    return F.avg(F.when(moved, -F.signum("r") * F.col("next_r")))


def parkinson(high: Column, low: Column) -> Column:
    """From one bar."""
    return F.sqrt(F.pow(log_return(high, low), 2) / (4 * math.log(2)))


def garman_klass(open_: Column, high: Column, low: Column, close: Column, tolerance: float = 1e-12) -> Column:
    """From one bar; a variance below minus the tolerance is missing."""
    v = 0.5 * F.pow(log_return(high, low), 2) - (2 * math.log(2) - 1) * F.pow(log_return(close, open_), 2)
    return F.when(v >= -tolerance, F.sqrt(F.greatest(v, F.lit(0.0))))


def _at() -> Column:
    return F.when(valid_price(F.col("price")).isNotNull(), F.struct("t", "seq"))


def first_price() -> Column:
    return F.min_by("price", _at())


def last_price() -> Column:
    return F.max_by("price", _at())


def with_extremes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the running ``peak`` and ``trough`` of the path."""
    so_far = path(keys).rowsBetween(Window.unboundedPreceding, 0)
    price = valid_price(F.col("price"))
    return df.withColumns({"peak": F.max(price).over(so_far), "trough": F.min(price).over(so_far)})


def maximum_drawdown() -> Column:
    return F.max((F.col("peak") - valid_price(F.col("price"))) / F.col("peak"))


def maximum_run_up() -> Column:
    return F.max((valid_price(F.col("price")) - F.col("trough")) / F.col("trough"))


def trend_slope(per_ns: Column | None = None) -> Column:
    """Least-squares slope of price on time since the path's start (``x``)."""
    return F.regr_slope("price", "x")
