"""The driver's tables in the engine's roles (prices, trades, quotes, ...).

All times are nanoseconds since the epoch as BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.returns import valid_price

NS_PER_DAY = 86_400_000_000_000
NS_PER_HOUR = 3_600_000_000_000
NS_PER_MINUTE = 60_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ts: str) -> Column:
    """Nanoseconds of a zoneless timestamp (exact: the tables hold microseconds)."""
    return F.unix_micros(F.col(ts).cast("timestamp")) * 1000


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity``, ``t`` (ns), ``day``, ``seq``, ``price`` (NULL if it is not finite
    and positive): a price path per event type."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_type").alias("entity"),
        nanos("ts").alias("t"),
        F.floor(nanos("ts") / NS_PER_DAY).cast("long").alias("day"),
        F.col("event_id").alias("seq"),
        valid_price(F.col("value")).alias("price"),
    )


def user_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by user with the raw value, which is also an amount; whoever
    divides by it or takes its logarithm goes through ``valid_price``."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("user_id").alias("entity"), nanos("ts").alias("t"), F.floor(nanos("ts") / NS_PER_DAY).cast("long").alias("day"), F.col("event_id").alias("seq"), F.col("value").alias("price"), "event_type", "props"
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``instrument`` (supplier), ``day``, ``price``, ``qty``, ``side``."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_suppkey").alias("instrument"),
        F.col("l_partkey").alias("part"),
        F.floor(nanos("l_shipdate") / NS_PER_DAY).cast("long").alias("day"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.when(F.col("l_linestatus") == "F", "buy").otherwise("sell").alias("side"),
    )


def r6(column: Column | str, digits: int = 6) -> Column:
    """A double as results are compared: rounded, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def sql_round(column: Column | str, digits: int) -> Column:
    """The same rounded as the SQL equivalents do it, on the scaled double;
    ``F.round`` rounds the shortest decimal, which differs for values of many
    digits that end in a half (1024.2279296875 to nine digits)."""
    scaled = F.round((F.col(column) if isinstance(column, str) else column) * 10.0**digits)
    return scaled / 10.0**digits + F.lit(0.0)
