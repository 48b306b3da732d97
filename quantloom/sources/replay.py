"""Recorded inputs: replay manifests (TOML), book recordings (JSON lines), and
feature rows written and read back."""

from __future__ import annotations

import hashlib
import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.schemas import BRONZE

#: One recorded line: a snapshot or a delta of a book.
RECORDED = (
    "kind string, source string, symbol string, generation int, event_unix_nanos long, sequence long, first_sequence long, last_sequence long, "
    "bids array<array<string>>, asks array<array<string>>"
)


def read_manifest(path: str, root: str) -> tuple[dict, list[dict]]:
    """Header and records of a replay manifest, after every input's digest and
    the whole size were found as stated.  Inputs are small by their own limit
    (``max_total_input_bytes``) and read by the driver."""
    with open(path, "rb") as f:
        manifest = tomllib.load(f)
    records, total = manifest.pop("record", []), 0
    if len(records) > manifest.get("max_records", len(records)):
        raise ValueError("more records than the manifest allows")
    out, last = [], {}
    for r in records:
        name = os.path.normpath(os.path.join(root, r["path"]))
        if not name.startswith(os.path.normpath(root) + os.sep):
            raise ValueError(f"{r['path']} is outside the inputs' folder")
        with open(name, "rb") as f:
            data = f.read()
        total += len(data)
        if hashlib.sha256(data).hexdigest() != r["sha256"]:
            raise ValueError(f"{r['path']} is not what the manifest was made of")
        if r["record_sequence"] <= last.get(r["stream_id"], 0):
            raise ValueError("record sequences must grow within a stream")
        last[r["stream_id"]] = r["record_sequence"]
        out.append(r | {"raw": data.decode()})
    if total > manifest.get("max_total_input_bytes", total):
        raise ValueError("more bytes of input than the manifest allows")
    return manifest, out


def bronze(spark: SparkSession, manifest: dict, records: list[dict], until_ns: int | None = None) -> DataFrame:
    """The manifest's records as bronze rows, up to a receive time."""
    rows = [
        (r["stream_id"], manifest["connection_epoch"], r["record_sequence"], r["receive_wall_time_ns"], manifest["venue"], manifest["market"], r["raw"])
        for r in records
        if until_ns is None or r["receive_wall_time_ns"] <= until_ns
    ]
    return spark.createDataFrame(rows, BRONZE)


def recorded_books(spark: SparkSession, path: str) -> DataFrame:
    """A recording's lines as events of ``order_book.replay``.  A line that is
    not of the schema fails the read."""
    rows = spark.read.schema(RECORDED).option("mode", "FAILFAST").json(path)
    levels = lambda c: F.transform(c, lambda x: F.struct(x[0].cast("double").alias("price"), x[1].cast("double").alias("qty")))
    last = F.coalesce("last_sequence", "sequence")
    return rows.select(
        F.concat_ws(":", "source", "symbol", F.col("generation").cast("string")).alias("instrument"), F.col("event_unix_nanos").alias("t"), last.alias("seq"), "kind",
        levels("bids").alias("bids"), levels("asks").alias("asks"), "first_sequence", last.alias("last_sequence"), F.lit(None).cast("long").alias("previous_sequence"),
    )


def round_trip(spark: SparkSession, rows: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Write feature rows (Parquet, or JSON lines as a log holds them) and read
    them back by the same schema; raises unless they are the same rows."""
    rows.write.format(kind).mode("errorifexists").save(path)
    back = spark.read.format(kind).schema(rows.schema).load(path)
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())
    if mark(back) != mark(rows):
        raise ValueError("what was read back is not what was written")
    return back


def with_receipts(events: DataFrame, catalogue: DataFrame, version: str) -> DataFrame:
    """Derivative events bound to the catalogue revision in force at their time
    and to the connector's version.  ``catalogue``: ``symbol``, ``revision``,
    ``valid_from_ns``, ``valid_to_ns``, ``known_at_ns``; of several revisions
    known at the event's receipt the newest counts; an event without one has a
    null revision."""
    c = catalogue.select(F.col("symbol").alias("__symbol"), "revision", "valid_from_ns", "valid_to_ns", "known_at_ns")
    inside = (F.col("event_time_ns") >= F.col("valid_from_ns")) & (F.col("valid_to_ns").isNull() | (F.col("event_time_ns") < F.col("valid_to_ns"))) & (F.col("known_at_ns") <= F.col("receive_wall_time_ns"))
    newest = events.join(c, (F.col("symbol") == F.col("__symbol")) & inside).groupBy("event_id").agg(F.max("revision").alias("catalogue_revision"))
    bound = events.join(newest, "event_id", "left").withColumn("connector_version", F.lit(version))
    return bound.withColumn("receipt", F.sha2(F.concat_ws("\u0001", "event_id", F.coalesce(F.col("catalogue_revision").cast("string"), F.lit("none")), "connector_version"), 256))


def aligned(baselines: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Evaluation rows with their baseline; raises if any row lacks one or has
    several."""
    per = rows.select(key).join(baselines.select(key, F.lit(1).alias("__one")), key, "left").groupBy(key).agg(F.count("__one").alias("n"))
    bad = per.filter("n <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"{key} {bad[0][key]} has {bad[0]['n']} baselines")
    return rows.join(baselines, key)
