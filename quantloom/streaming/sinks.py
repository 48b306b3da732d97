"""Streaming sinks: idempotent batches, partition layout, corrections, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYOUT = ("event_type", "venue", "utc_date", "hour", "dataset_version")


def with_layout(events: DataFrame, dataset_version: int = 1) -> DataFrame:
    seconds = F.timestamp_seconds(F.col("event_time_ns") / 1_000_000_000)
    return events.withColumns({"utc_date": F.to_date(seconds), "hour": F.hour(seconds), "dataset_version": F.lit(dataset_version)})


def append_partitions(events: DataFrame, path: str, dataset_version: int = 1) -> None:
    """Append in the partition layout, ZSTD, one file per partition and task."""
    rows = with_layout(events, dataset_version)
    rows.repartition(*LAYOUT).write.mode("append").partitionBy(*LAYOUT).option("compression", "zstd").parquet(path)


def write_stream(events: DataFrame, path: str, checkpoint: str, dataset_version: int = 1):
    """Micro-batches appended once each: a batch is written under its number
    and a batch that is there already is replaced, so a retry cannot double it."""

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = with_layout(batch, dataset_version)
        rows.write.mode("overwrite").partitionBy(*LAYOUT).option("compression", "zstd").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def corrected(base: DataFrame, corrections: DataFrame, keys: list[str], version: int) -> DataFrame:
    """A new dataset version: corrected rows replace those of the same key; the
    base is not changed."""
    kept = base.join(corrections.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(corrections).withColumn("dataset_version", F.lit(version))


def manifest(rows: DataFrame) -> DataFrame:
    """Count, time range and an order-free digest per partition."""
    digest = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(*[c for c in LAYOUT if c in rows.columns]).agg(
        F.count("*").alias("rows"), F.min("event_time_ns").alias("first_ns"), F.max("event_time_ns").alias("last_ns"), digest.alias("digest")
    )


def chained(log: DataFrame, order: str, content: list[str]) -> DataFrame:
    """Adds a hash of each record's content and the record before it, which is
    the one whose number is one less (records are numbered without a gap; one
    without a predecessor is chained to nothing).  An equi-join on the number,
    so a long log is spread over all tasks."""
    own = log.withColumn("own_hash", F.sha2(F.concat_ws("\u0001", *content), 256))
    keys = ["chain"] if "chain" in log.columns else []
    before = own.select(*keys, (F.col(order) + 1).alias(order), F.col("own_hash").alias("__before"))
    linked = own.join(before, [*keys, order], "left")
    record = F.sha2(F.concat_ws("\u0001", F.coalesce("__before", F.lit("")), "own_hash"), 256)
    return linked.withColumn("record_hash", record).select(*log.columns, "own_hash", "record_hash")


def chain_faults(log: DataFrame, order: str, content: list[str]) -> DataFrame:
    """Records whose hash is not that of their content and predecessor, or
    whose number does not follow."""
    again = chained(log.drop("own_hash", "record_hash"), order, content).select(*(["chain"] if "chain" in log.columns else []), order, F.col("record_hash").alias("__hash"))
    keys = ([*(["chain"] if "chain" in log.columns else []), order])
    return log.join(again, keys).filter("record_hash <> __hash").drop("__hash")


def sealed(fragments: DataFrame, keys: list[str], identity: list[str]) -> DataFrame:
    """One partition's fragments merged: a record that several fragments hold is
    kept once, and conflicting contents of one identity are an error column
    (``conflicts``), not a choice.  Order-free, so a retry gives the same."""
    content = [c for c in fragments.columns if c not in keys + identity]
    merged = fragments.groupBy(*keys, *identity).agg(F.min(F.struct(*content)).alias("__row"), (F.countDistinct(F.struct(*content)) - 1).alias("conflicts"))
    return merged.select(*keys, *identity, "__row.*", "conflicts")


def unverified(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Partitions whose count, time range or digest is not that of the
    manifest, or that only one of both has."""
    now = manifest(rows)
    keys = [c for c in LAYOUT if c in rows.columns]
    facts = ["rows", "first_ns", "last_ns", "digest"]
    old = known.select(*keys, *(F.col(c).alias(f"__{c}") for c in facts))
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return now.join(old, keys, "full_outer").filter(~same).select(*keys, "rows", F.col("__rows").alias("manifest_rows"))


def read_verified(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """A dataset, after every partition was found as its manifest says."""
    rows = spark.read.parquet(path)
    bad = unverified(rows, known).limit(1).collect()
    if bad:
        raise ValueError(f"partition is not as its manifest says: {bad[0].asDict()}")
    return rows


def log_scan(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of each stream and connection in their order, and the faults of
    the log: sequences that do not follow, and times that go back."""
    order = Window.partitionBy("stream_id", "connection_epoch").orderBy("record_sequence")
    marked = bronze.withColumns({"__gap": F.col("record_sequence") - F.lag("record_sequence").over(order), "__back": F.col("receive_wall_time_ns") < F.lag("receive_wall_time_ns").over(order)})
    fault = F.when(F.col("__gap") == 0, "duplicate_sequence").when(F.col("__gap") > 1, "sequence_gap").when(F.col("__back"), "time_regression")
    checked = marked.withColumn("fault", fault).drop("__gap", "__back")
    return checked.filter("fault is null").drop("fault"), checked.filter("fault is not null")


def append_new(spark: SparkSession, existing: DataFrame, rows: DataFrame, request_id: str) -> DataFrame:
    """Rows whose request is not there yet (idempotent append)."""
    return rows.join(existing.select(request_id).distinct(), request_id, "left_anti").dropDuplicates([request_id])
