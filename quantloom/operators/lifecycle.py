"""Order lifecycle (order-by-order feeds) and recovery of displayed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lifecycle_rates(orders: DataFrame, trades: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Placement, cancellation and modification rates and their ratios to
    aggressive trades.  ``orders``: ``keys``, ``action``, ``certified``; a
    window with an uncertified row (a gap in the feed) has no values."""
    count = lambda a: F.count_if(F.col("action") == a)
    per = orders.groupBy(*keys).agg(count("place").alias("p"), count("cancel").alias("c"), count("modify").alias("m"), F.bool_and("certified").alias("ok"))
    deals = trades.groupBy(*keys).agg(F.count("*").alias("deals"))
    rows = per.join(deals, keys, "left")
    value = lambda x: F.when(F.col("ok"), x)
    deals_or_none = F.nullif(F.coalesce("deals", F.lit(0)), F.lit(0))
    return rows.select(
        *keys,
        value(F.col("p") / seconds).alias("placement_rate_per_second"),
        value(F.col("c") / seconds).alias("cancellation_rate_per_second"),
        value(F.col("m") / seconds).alias("modification_rate_per_second"),
        value(F.col("c") / deals_or_none).alias("cancellation_to_trade_ratio"),
        value((F.col("p") + F.col("c") + F.col("m")) / deals_or_none).alias("quote_to_trade_ratio"),
        F.when(~F.col("ok"), "sequence_gap").alias("missing_reason"),
    )


def book_changes(books: DataFrame, keys: list[str], columns: list[str], session: str) -> DataFrame:
    """Adds ``<column>_change`` against the row before of the same session."""
    order = Window.partitionBy(*keys, session).orderBy("t", "seq")
    return books.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(order) for c in columns})


def depth_recovery(shocks: DataFrame, depths: DataFrame, key: str, horizon_ns: int) -> DataFrame:
    """``shocks``: ``shock_id``, ``key``, ``t``, ``pre``, ``post``; ``depths``:
    ``key``, ``t``, ``depth``.  First times within the horizon at which half
    and all of the lost depth is back, and the fraction back at the horizon.
    Depth that was not lost is missing."""
    later = depths.select(F.col(key), F.col("t").alias("dt"), "depth")
    within = (F.col("dt") > F.col("t")) & (F.col("dt") <= F.col("t") + horizon_ns)
    rows = shocks.filter("pre > post").join(later, key).filter(within)
    back = (F.col("depth") - F.col("post")) / (F.col("pre") - F.col("post"))
    first = lambda share: F.min(F.when(back >= share, F.col("dt") - F.col("t")))
    found = rows.groupBy("shock_id").agg(first(1.0).alias("displayed_depth_recovery_time_ns"), first(0.5).alias("book_half_life_ns"), F.max_by(back, "dt").alias("displayed_depth_replenishment_fraction"))
    return shocks.select("shock_id").join(found, "shock_id", "left")


def l3_levels(orders: DataFrame, keys: list[str], price: Column | str = "price") -> DataFrame:
    """Book levels from the open orders of an order-by-order feed: of each
    order its last event counts (``add`` and ``modify`` stand, ``delete``
    removes); quantity and number of orders by side and price."""
    newest = Window.partitionBy(*keys, "order_id").orderBy(F.desc("t"), F.desc("seq"))
    last = orders.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1 and action <> 'delete' and qty > 0")
    return last.groupBy(*keys, "side", price).agg(F.sum("qty").alias("qty"), F.count("*").alias("orders"))
