"""Operator 4: near-duplicate embeddings by iterative quantisation.

A rotation is learnt on a bounded sample so that the signs of the rotated
vectors make balanced 64-bit codes with little quantisation error.  The codes
are cut into disjoint substrings, each the key of one Hamming table; several
rotations give as many tables as the wanted recall needs at the threshold, and
substrings grow with the logarithm of the number of vectors.

Only codes travel to the tables.  Two vectors that share a key are candidates
if their whole codes differ in at most ``radius`` bits, and the first table in
which they share a key has the pair.  The vectors of a table's candidates alone
are fetched, and the same pairs are reranked by the cosine of the original
vectors in double precision.  A pair counts once, so numbers of links are exact
for the pairs found, and no pair leaves its task: a bucket returns counts and a
spanning forest.

Equal vectors are one node that stands for all its copies, so a vector that a
third of all rows hold is compared once.  A bucket above ``BLOCK`` rows is cut
into blocks, and every two blocks meet in a task of their own; none is capped.

Cases: a vector that is null, empty, zero, of another length than most, or
holds null or non-finite components links with nothing, is its own component
and is kept; repeated rows with one vec_id are vectors of their own; a row
without vec_id is returned with its links and, if it has no other component, a
null one (kept is then true); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.components import connected_components
from quantloom.llm.shared import discard, local_components, materialize, parts, read, small, sorted_groups
from quantloom.llm.vectors import matrix, usable

THRESHOLD, BITS, RECALL = 0.95, 64, 0.97
#: Rows the rotations are learnt on, rounds of learning, rows of a block.
SAMPLE, ROUNDS, BLOCK = 4096, 40, 4096
#: Pairs whose codes are compared at once.
AT_ONCE = 1 << 20


def learn_rotation(sample: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Matrix (dimensions x bits) whose product's signs are the code: principal
    directions times the rotation that brings the projections nearest to their
    own signs, found by alternating signs and an orthogonal fit."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    _, _, axes = np.linalg.svd(sample, full_matrices=True)
    wide = rng.standard_normal((dims, bits)) if bits > dims else np.eye(dims)[:, :bits]
    project = axes.T @ wide
    points = sample @ project
    turn, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds):
        signs = np.where(points @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(points.T @ signs)
        turn = left @ right
    return project @ turn


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, int]:
    """Substring bits, substrings of a code and rotations for ``n`` vectors: a
    substring of log2(n) - 4 bits or some more, and tables until a pair at the
    threshold (each bit differs with probability angle / pi) meets with
    probability ``recall``."""
    per_code = max(1, BITS // max(8, math.ceil(math.log2(max(n, 2))) - 4))
    width = BITS // per_code
    agree = (1 - math.acos(threshold) / math.pi) ** width
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree))
    return width, per_code, math.ceil(tables / per_code)


def radius(threshold: float, bits: int) -> int:
    """Differing bits that a pair at the threshold stays within (six standard
    deviations above the mean)."""
    p = math.acos(threshold) / math.pi
    return int(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def _codes(unit: np.ndarray, rotations: list[np.ndarray]) -> np.ndarray:
    """Codes (rows x rotations) of 64 bits."""
    out = [np.packbits(unit @ turn >= 0, axis=1, bitorder="little").view("<u8")[:, 0] for turn in rotations]
    return np.stack(out, axis=1).astype(np.uint64)


def _key(codes: np.ndarray, table: int, width: int, per_code: int) -> np.ndarray:
    """Key of each row in a table."""
    code = codes[:, table // per_code] >> np.uint64(table % per_code * width)
    return code & np.uint64((1 << width) - 1)


def _candidates(a: np.ndarray, b: np.ndarray, table: int, width: int, per_code: int, most: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``a``, row of ``b``) that share the table's key, differ in
    at most ``most`` bits, and share the key of no table before it."""
    rows = max(1, AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), rows):
        apart = np.zeros((min(rows, len(a) - at), len(b)), np.uint16)
        for r in range(a.shape[1]):
            apart += np.bitwise_count(a[at : at + rows, r, None] ^ b[None, :, r])
        i, j = np.nonzero(apart <= most)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for t in range(table):
            if not len(i):
                break
            new = _key(a[i], t, width, per_code) != _key(b[j], t, width, per_code)
            i, j = i[new], j[new]
        if len(i):
            yield i, j


def link(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """``vectors``: distinct ``node`` (long), ``copies`` (long), ``vec`` (array
    of double, unit length).  Returns degrees (``node``, ``n``: copies of the
    nodes linked to it) and edges (``a``, ``b``) that span the components."""
    n = vectors.count()
    width, per_code, n_rotations = plan(n, threshold, recall)
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").toArrow().column(0)
    fitted = matrix(sample)
    rotations = [learn_rotation(fitted, BITS, seed) for seed in range(n_rotations)] if n else []
    tables, most = n_rotations * per_code, radius(threshold, BITS * n_rotations)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = _codes(matrix(batch.column(2)), rotations).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), n_rotations).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], ["node", "copies", "codes"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = code_rows(batch.column(2))
            for t in range(tables):
                bucket = (t << 48) + _key(codes, t, width, per_code).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), *batch.columns], ["bucket", "node", "copies", "codes"])

    def code_rows(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)

    coded = materialize(spark, vectors.select("node", "copies", "vec").mapInArrow(encode, "node long, copies long, codes array<long>"), "codes")
    dealt = coded.mapInArrow(deal, "bucket long, node long, copies long, codes array<long>")
    # Only buckets above a block matter; they are few, and broadcast if that is so.
    sizes = materialize(spark, dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK), "large-buckets")
    with_size = dealt.join(small(sizes, sizes.count()), "bucket", "left")
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK).cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, mine).alias("lo"), F.greatest(o, mine).alias("hi"))
    )
    met = with_size.select("bucket", "node", "copies", "codes", mine.alias("block"), F.explode(others).alias("pair")).select(
        "bucket", "pair.lo", "pair.hi", "block", "node", "copies", "codes"
    )
    names = ["bucket", "lo", "hi"]

    def sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """Rows of the two blocks, and their candidate pairs."""
        codes, block = code_rows(group.column("codes").combine_chunks()), group.column("block").to_numpy()
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        return left, right, _candidates(codes[left], codes[right], group.column("bucket")[0].as_py() >> 48, width, per_code, most, lo == hi)

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, names):
            keep = np.zeros(group.num_rows, bool)
            left, right, pairs = sides(group)
            for i, j in pairs:
                keep[left[i]] = keep[right[j]] = True
            if keep.any():
                yield from group.filter(pa.array(keep)).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, names):
            node, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
            vec = matrix(group.column("vec"))
            left, right, pairs = sides(group)
            count, label = np.zeros(len(node)), np.arange(len(node))
            for i, j in pairs:
                i, j = left[i], right[j]
                near = np.concatenate([np.einsum("ij,ij->i", vec[i[at : at + 8192]], vec[j[at : at + 8192]]) for at in range(0, len(i), 8192)]) >= threshold
                i, j = i[near], j[near]
                count += np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                new = label[i] != label[j]
                if new.any():
                    label = local_components(len(node), np.concatenate([i[new], np.arange(len(node))]), np.concatenate([j[new], label]))
            some = np.flatnonzero((count > 0) | (label != np.arange(len(node))))
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(count[some].astype(np.int64)), pa.array(node[label[some]])], ["node", "n", "other"]
                )

    n_parts = parts(spark, n * tables, 100_000, spark.sparkContext.defaultParallelism)
    survivors = (
        met.repartition(n_parts, *names).sortWithinPartitions(*names).mapInArrow(survive, "bucket long, lo int, hi int, block int, node long, copies long, codes array<long>")
    )
    survivors = materialize(spark, survivors, "candidates")
    fetched = survivors.join(vectors.select("node", "vec"), "node")
    n_parts = parts(spark, survivors.count(), 20_000, spark.sparkContext.defaultParallelism)
    found = materialize(
        spark, fetched.repartition(n_parts, *names).sortWithinPartitions(*names).mapInArrow(compare, "node long, n long, other long"), "links"
    )
    for used in (coded, sizes, survivors):
        discard(spark, used)
    degrees = found.groupBy("node").agg(F.sum("n").alias("n"))
    return degrees, found.select(F.col("node").alias("a"), F.col("other").alias("b"))


def near_duplicates(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id``, ``n_links`` (other vectors found at the threshold or above),
    ``component_id`` and ``kept`` of every row."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", F.when(usable("embedding"), norm))
    common = rows.filter("norm > 0").groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 0
    good = F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")) & (F.size("embedding") == dims), F.lit(False))
    # -0.0 and 0.0 are one value; copies are told by all components.
    same = F.transform("embedding", lambda x: x + F.lit(0.0))
    marked = rows.select("vec_id", good.alias("good"), "norm", F.when(good, same).alias("vec"))
    marked = marked.withColumn("copy", F.when(F.col("good"), F.sha2(F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))), 256)))
    groups = marked.filter("good").groupBy("copy").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"), F.first("norm").alias("norm")
    )
    unit = F.transform("vec", lambda x: x / F.col("norm"))
    # A node is a number of its own: ids may be null or repeated.
    nodes = materialize(
        spark,
        groups.select("copy", "least", "copies", unit.alias("vec"), F.monotonically_increasing_id().alias("node")),
        "vectors",
    )
    degrees, edges = link(spark, nodes, threshold, recall)
    label = connected_components(spark, edges)
    classes = nodes.select("copy", "node", "least", "copies").join(degrees, "node", "left").join(label, "node", "left")
    classes = classes.withColumn("component", F.coalesce("component", "node"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(
        spark,
        classes.join(smallest, "component").select("copy", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"),
        "classes",
    )
    out = marked.select("vec_id", "copy").join(classes, "copy", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
#: All pairs, exactly; the operator finds each with the planned recall.
ORACLE_SQL = {
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
  AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), c AS (
  SELECT vec_id AS node, vec_id AS reached FROM embeddings
  UNION SELECT c.node, l.b FROM c JOIN l ON c.reached = l.a
), m AS (
  SELECT node, min(reached) AS component_id FROM c GROUP BY node
)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON vec_id = node
"""
}
