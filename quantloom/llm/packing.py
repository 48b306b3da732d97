"""Operator 3: conflict-constrained best-fit packing.

Documents are packed into bins of ``capacity`` bytes.  A document longer than
a bin is cut: its full pieces are bins of their own, the rest is packed like
any document.  Documents are dealt evenly to shards of bounded size by a hash
of their id, rows that are equal in all that counts by their number too, so a
source, a group of copies or a row repeated for a third of all rows is spread
over all shards.  In a shard, longest first, a search starts at the
bin with the least sufficient residual and goes on to its successors until the
first compatible one: bins carry a bitmap of their sources (a plane for each
of the ``per_source`` documents a source may have in a bin) and of their
duplicate clusters (one document each).  If none is compatible a bin is opened.

Cases: a null or empty text needs no room and has no bin; a null source is a
source of its own; repeated rows are copies and go to different bins; equal
lengths are taken by doc_id; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import parts, read, sorted_groups

#: Bytes of a bin, documents of one source in a bin, documents of a shard.
CAPACITY, PER_SOURCE, SHARD = 16_384, 2, 4096


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[int]:
    """Bin of each document, taken in the given order."""
    plane: dict = {}
    cluster_bit: dict = {}
    for s in sources:
        plane.setdefault(s, len(plane) * per_source)
    base = len(plane) * per_source
    seen: set = set()
    for c in clusters:  # only a cluster with a second member can conflict
        if c in seen:
            cluster_bit.setdefault(c, 1 << (base + len(cluster_bit)))
        seen.add(c)
    bits: list[int] = []
    room: list[tuple[int, int]] = []  # (residual, bin), ordered
    out = []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        first = plane[source]
        mark = cluster_bit.get(cluster, 0)
        full = 1 << (first + per_source - 1) | mark
        at = bisect_left(room, (length, -1))
        while at < len(room) and bits[room[at][1]] & full:
            at += 1
        if at < len(room):
            residual, chosen = room.pop(at)
        else:
            residual, chosen = capacity, len(bits)
            bits.append(0)
        taken = bits[chosen]
        while taken >> first & 1:
            first += 1
        bits[chosen] = taken | 1 << first | mark
        if residual > length:
            insort(room, (residual - length, chosen))
        out.append(chosen)
    return out


def pack(spark: SparkSession, items: DataFrame, n_items: int, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """``items``: ``doc_id`` (long), ``length`` (long), ``source``, ``cluster``
    (long).  One row per piece: ``doc_id``, ``piece``, ``piece_start``,
    ``piece_length``, ``source``, ``bin_id`` (null for length 0)."""
    shards = parts(spark, n_items, SHARD)
    # Equal rows are interchangeable: they are counted and numbered, not moved.
    columns = ["doc_id", "length", "source", "cluster"]
    counted = items.groupBy(*columns).agg(F.count("*").alias("n"))
    numbered = counted.select(*columns, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "number"), F.lit(shards))
    rows = numbered.select(shard.alias("shard"), *columns)
    schema = "doc_id long, piece int, piece_start long, piece_length long, source string, bin_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["shard"]):
            length = group.column("length").to_numpy()
            ids = group.column("doc_id").fill_null(-(2**63)).to_numpy()
            sources, clusters = group.column("source").to_pylist(), group.column("cluster").to_pylist()
            rest = length % capacity
            whole = length // capacity
            order = [k for k in np.lexsort((ids, -rest)).tolist() if rest[k]]
            bins = best_fit([int(rest[k]) for k in order], [sources[k] for k in order], [clusters[k] for k in order], capacity, per_source)
            opened = max(bins, default=-1) + 1
            row = [np.array(order, np.int64)]
            piece = [whole[order]]
            size = [rest[order]]
            of_bin = [np.array(bins, np.int64)]
            long = np.flatnonzero(whole)
            if len(long):
                owner = np.repeat(long, whole[long])
                row.append(owner)
                piece.append(np.arange(len(owner)) - np.repeat(np.cumsum(whole[long]) - whole[long], whole[long]))
                size.append(np.full(len(owner), capacity))
                of_bin.append(opened + np.arange(len(owner)))
            none = np.flatnonzero(length == 0)
            row.append(none)
            piece.append(np.zeros(len(none), np.int64))
            size.append(np.zeros(len(none), np.int64))
            of_bin.append(np.full(len(none), -1))
            row, piece, size, of_bin = (np.concatenate(x).astype(np.int64) for x in (row, piece, size, of_bin))
            home = int(group.column("shard")[0].as_py())
            yield pa.RecordBatch.from_arrays(
                [
                    group.column("doc_id").combine_chunks().take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(piece * capacity),
                    pa.array(size),
                    group.column("source").combine_chunks().take(pa.array(row)),
                    pa.array((home << 32) + of_bin, mask=of_bin < 0),
                ],
                ["doc_id", "piece", "piece_start", "piece_length", "source", "bin_id"],
            )

    n = parts(spark, shards, 4, min(shards, spark.sparkContext.defaultParallelism))
    return rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, cluster: str | None = None) -> DataFrame:
    """Documents by bytes of text.  ``cluster`` names a column of duplicate
    clusters (such as a ``component_id``; a null stands for the text); without
    it copies of one text are a cluster."""
    of = F.xxhash64("text")
    if cluster is not None:
        of = F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster, F.lit("cluster"))).otherwise(of)
    items = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("length"),
        F.col("source").cast("string").alias("source"),
        of.alias("cluster"),
    )
    return pack(spark, items, docs.count(), capacity, per_source)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, read(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
