"""Trade-flow operators: sides, islands of trades, quotes and shocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.returns import valid_price
from quantloom.operators.joins import asof_backward, asof_forward


def side_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Count, quantity and notional of each aggressor side.  Quantities and
    notionals are decimals, so the sums are exact in any order."""
    out = {}
    for side in ("buy", "sell"):
        here = F.col("side") == side
        out[f"aggressive_{side}_count"] = F.count_if(here)
        out[f"aggressive_{side}_quantity"] = F.sum(F.when(here, F.col("qty")).otherwise(0))
        out[f"aggressive_{side}_notional"] = F.sum(F.when(here, F.col("price") * F.col("qty")).otherwise(0))
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in out.items()))


def imbalance(kind: str) -> Column:
    """(buy - sell) / (buy + sell) of ``side_totals``; nothing traded is missing."""
    buy, sell = F.col(f"aggressive_buy_{kind}").cast("double"), F.col(f"aggressive_sell_{kind}").cast("double")
    return (buy - sell) / F.nullif(buy + sell, F.lit(0.0))


def volume_at_price(df: DataFrame, keys: list[str]) -> DataFrame:
    """Signed quantity at each exact price, one row per price."""
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    return df.groupBy(*keys, "price").agg(F.sum(signed).alias("signed_volume_at_price"))


def islands(df: DataFrame, keys: list[str], breaks: Column) -> DataFrame:
    """Adds ``island``: a number that grows with each row (in order of
    ``(t, seq)``) where ``breaks`` holds; the first row starts island 1."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    start = df.withColumn("__start", F.coalesce(breaks, F.lit(True)).cast("int"))
    return start.withColumn("island", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__start")


def large_trade_clusters(df: DataFrame, keys: list[str], threshold: float, gap_ns: int) -> DataFrame:
    """Clusters of trades of at least ``threshold`` notional with gaps of at
    most ``gap_ns``; those of two trades or more count."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    large = df.filter(F.col("notional") >= threshold)
    grouped = islands(large, keys, F.col("t") - F.lag("t").over(order) > gap_ns)
    cluster = grouped.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.sum("notional").alias("notional")).filter("n >= 2")
    return cluster.groupBy(*keys).agg(
        F.count("*").alias("large_trade_cluster_count"), F.sum("n").alias("clustered_large_trade_count"), F.sum("notional").alias("clustered_large_trade_notional")
    )


def sweep_direction(df: DataFrame, keys: list[str], gap_ns: int, least: int) -> DataFrame:
    """Episodes are runs of one side with gaps of at most ``gap_ns``; of those
    with ``least`` prints, (buy - sell) / all."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    new = (F.lag("side").over(order) != F.col("side")) | (F.col("t") - F.lag("t").over(order) > gap_ns)
    episode = islands(df, keys, new).groupBy(*keys, "island", "side").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    up = F.sum(F.when(F.col("side") == "buy", 1).otherwise(-1))
    return episode.groupBy(*keys).agg(F.count("*").alias("episodes"), (up / F.count("*")).alias("trade_print_sweep_direction"))


def longest_side_run(df: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    run = islands(df, keys, F.lag("side").over(order) != F.col("side")).groupBy(*keys, "island").agg(F.count("*").alias("n"))
    return run.groupBy(*keys).agg(F.max("n").alias("longest_side_run"))


def interarrival_cv(df: DataFrame, keys: list[str]) -> DataFrame:
    """Population deviation over mean of the times between trades (3 or more trades)."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    gaps = df.withColumn("dt", (F.col("t") - F.lag("t").over(order)).cast("double"))
    cv = F.when((F.count("*") >= 3) & (F.avg("dt") > 0), F.stddev_pop("dt") / F.avg("dt"))
    return gaps.groupBy(*keys).agg(F.count("*").alias("n"), cv.alias("trade_interarrival_coefficient_of_variation"))


def order_flow_imbalance(quotes: DataFrame, keys: list[str]) -> DataFrame:
    """Best-quote order-flow imbalance: what the bid gained minus what the ask
    gained, summed over consecutive quotes.  ``bid``, ``bid_qty``, ``ask``,
    ``ask_qty``."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    was = {c: F.lag(c).over(order) for c in ("bid", "bid_qty", "ask", "ask_qty")}
    q = quotes.withColumns({f"__{c}": w for c, w in was.items()}).filter("__bid is not null")
    zero = F.lit(0.0)
    bid = F.when(F.col("bid") >= F.col("__bid"), F.col("bid_qty")).otherwise(zero) - F.when(F.col("bid") <= F.col("__bid"), F.col("__bid_qty")).otherwise(zero)
    ask = F.when(F.col("ask") <= F.col("__ask"), F.col("ask_qty")).otherwise(zero) - F.when(F.col("ask") >= F.col("__ask"), F.col("__ask_qty")).otherwise(zero)
    return q.groupBy(*keys).agg(F.sum(bid - ask).alias("top_of_book_ofi"))


def last_change(quotes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Time of the last row in which any of ``columns`` differs from the row before."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    marked = quotes.withColumn("__changed", F.when(changed, F.col("t")))
    return marked.groupBy(*keys).agg(F.max("__changed").alias("changed_t"), F.max("t").alias("last_t"))


def shock_response(shocks: DataFrame, mids: DataFrame, key: str, horizon_ns: int, tolerance_ns: int, max_age_ns: int) -> DataFrame:
    """For each trade (``t``, ``seq``, ``price``, ``sign``): the mid in force
    before it (no older than ``max_age_ns``) and the first mid from ``horizon``
    on, within the tolerance; impact and spreads relative to the first mid.
    ``mids``: ``key``, ``t``, ``mid``; a mid that is no valid price is no quote."""
    quote = mids.select(key, "t", valid_price(F.col("mid")).alias("value")).filter("value is not null")
    before = asof_backward(shocks, quote, key, max_age_ns).withColumnRenamed("value", "mid0").drop("value_t")
    due = before.withColumn("t0", F.col("t")).withColumn("t", F.col("t") + horizon_ns)
    after = asof_forward(due, quote, key, tolerance_ns).withColumnRenamed("value", "mid1").drop("value_t")
    sign, p, m0, m1 = F.col("sign"), F.col("price"), F.col("mid0"), F.col("mid1")
    effective, realized = 2 * sign * (p - m0) / m0, 2 * sign * (p - m1) / m0
    return after.withColumn("t", F.col("t0")).drop("t0").withColumns(
        {
            "trade_shock_midprice_impact": sign * (m1 - m0) / m0,
            "trade_effective_spread": effective,
            "trade_realized_spread": realized,
            "trade_adverse_selection_proxy": effective - realized,
        }
    )
