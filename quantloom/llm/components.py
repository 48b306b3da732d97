"""Connected components of a distributed edge table.

Alternating large-star and small-star steps.  Each step is an aggregation
(partial sums before the shuffle) and an equi-join that adaptive execution may
split where one node has very many edges; nothing but a convergence checksum of
two numbers reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(low, "a")
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(low.select("a", F.col("m").alias("b")))
        .filter("a <> b")
        .distinct()
    )


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges``: long columns ``a`` and ``b``, in any order, with repeats and
    loops allowed; rows with a null are ignored.  Returns ``node`` and
    ``component`` (smallest node of its component) for every node on an edge
    to another node.  No edges give no rows."""
    start = edges.dropna(subset=["a", "b"]).filter("a <> b")
    start = start.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(spark, start, "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or tuple(mark) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = tuple(mark)
        following = materialize(spark, _small_star(_large_star(now)), "edges")
        discard(spark, now)
        now = following
