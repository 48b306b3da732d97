"""Operator 7: exact top-k by inner product over KD-trees, one per shard.

Components are quantised to ``floor(1024 * x)``.  The vectors are dealt to
shards of bounded size; each shard's KD-tree (median splits on the widest
side, tight bounding boxes) is built once and kept as one row of a table.
Queries are packed into blocks of bounded size, a row each, so neither queries
nor vectors reach the driver and the plan is the same for any number of them.
A task is a group of blocks with a group of shards, which meet by that key:
each block visits each shard once.  A traversal pops the node with the best
box-to-query bound, the sum of ``max(q * low, q * high)``, and stops when that
is below the k-th score found so far.  That score starts from the block's own
members (they are candidates too) and is passed on from shard to shard within
a task.  Each task returns k rows per query at most, and a window over the
query picks the best.

Scores are integers and exact: doubles hold them while they stay below 2**53,
otherwise Python's integers are used (a score beyond a long is clipped to it).

Cases: vectors that are null, empty, of another length than most, or hold null
or non-finite components, and rows without vec_id, take no part; a row that
repeats a query's vec_id is a candidate of its own; fewer than k candidates
give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.shared import materialize, parts, read, sorted_groups
from quantloom.llm.vectors import matrix, usable

K, SCALE = 10, 1024
#: Vectors of a shard, of a leaf, and queries of a block.
SHARD, LEAF, BLOCK = 4096, 64, 2048
#: Shards and blocks that a task holds at most (blocks stay, shards pass through).
SHARDS_EACH, BLOCKS_EACH = 4, 8


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points, and per node: range of that order, children (-1:
    none) and box (low and high corners side by side)."""
    order = np.arange(len(points))
    ranges, children, boxes = [], [], []
    todo = [(0, len(points), -1, 0)]
    while todo:
        a, b, parent, side = todo.pop()
        mine = len(ranges)
        if parent >= 0:
            children[parent][side] = mine
        some = points[order[a:b]]
        low, high = some.min(axis=0), some.max(axis=0)
        ranges.append((a, b))
        children.append([-1, -1])
        boxes.append(np.concatenate([low, high]))
        if b - a > leaf:
            # Split by rank, so equal values cannot make one side empty.
            by = np.argsort(some[:, int(np.argmax(high - low))], kind="stable")
            order[a:b] = order[a:b][by]
            mid = (a + b) // 2
            todo += [(mid, b, mine, 1), (a, mid, mine, 0)]
    return order, np.array(ranges), np.array(children), np.array(boxes)


def _bounds(queries: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Largest inner product a point of each box can have (queries x nodes)."""
    dims = queries.shape[1]
    zero = queries.dtype.type(0) if queries.dtype != object else 0
    return np.maximum(queries, zero) @ boxes[:, dims:].T + np.minimum(queries, zero) @ boxes[:, :dims].T


class Search:
    """Best candidates of a block of queries, kept from shard to shard."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, floor: list, k: int) -> None:
        self.queries, self.own, self.k = queries, own, k
        self.floor = list(floor)
        self.best: list[list] = [[] for _ in own]

    def visit(self, points, rows, ids, ranges, children, boxes) -> None:
        bounds = _bounds(self.queries, boxes)
        for q in range(len(self.own)):
            self._one(q, bounds[q].tolist(), points, rows, ids, ranges, children)

    def _one(self, q, bound, points, rows, ids, ranges, children) -> None:
        query, own, best, k = self.queries[q], self.own[q], self.best[q], self.k
        floor = self.floor[q]
        heap = [(-bound[0], 0)]
        while heap:
            top, node = heappop(heap)
            if floor is not None and -top < floor:
                break
            left, right = children[node]
            if left >= 0:
                heappush(heap, (-bound[left], left))
                heappush(heap, (-bound[right], right))
                continue
            a, b = ranges[node]
            scores = points[a:b] @ query
            if floor is None:
                some = range(b - a)
            else:
                some = np.flatnonzero(scores >= floor).tolist()
            for i in some:
                if rows[a + i] == own:
                    continue
                entry = (int(scores[i]), -ids[a + i])
                if len(best) < k:
                    best.append(entry)
                    if len(best) == k:
                        heapify(best)
                elif entry > best[0]:
                    heapreplace(best, entry)
                else:
                    continue
                if len(best) == k and (floor is None or best[0][0] > floor):
                    floor = best[0][0]
        self.floor[q] = floor


def _as_numbers(raw: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return raw.astype(np.float64)
    return np.array([[int(v) for v in row] for row in raw.tolist()], dtype=object).reshape(raw.shape)


def _kind(most: float) -> str:
    return next((k for k, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**62)) if most < top), "<f8")


def top_k(spark: SparkSession, embeddings: DataFrame, is_query, k: int = K) -> DataFrame:
    """For each row that ``is_query`` (a column expression) marks, its ``k``
    best other rows: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    source = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("vec_id").isNotNull() & usable("embedding"))
    common = source.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score long"
    if common is None:
        return spark.createDataFrame([], schema)
    dims = common["dims"]
    scaled = F.transform("embedding", lambda x: x * F.lit(float(SCALE)))
    rows = materialize(
        spark,
        source.filter(F.size("embedding") == dims).select("vec_id", "asks", scaled.alias("vec"), F.monotonically_increasing_id().alias("row")),
        "vectors",
    )
    n, n_queries, most = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")))).first()
    if not n:
        return spark.createDataFrame([], schema)
    most = float(most) + 1
    exact = most * most * dims < 2**53
    kind = _kind(most)
    shards = parts(spark, n, SHARD)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["shard"]):
            points = np.floor(matrix(group.column("vec")))
            order, ranges, children, boxes = build(points)
            row, ids = group.column("row").to_numpy()[order], group.column("vec_id").to_numpy()[order]
            packed = [row.astype("<i8"), ids.astype("<i8"), points[order].astype(kind), ranges.astype("<i4"), children.astype("<i4"), boxes.astype(kind)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["row", "ids", "points", "ranges", "children", "boxes"]
            )

    if not n_queries:
        return spark.createDataFrame([], schema)
    dealt = rows.select("vec_id", "vec", "row", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    n_parts = parts(spark, shards, 4, min(shards, spark.sparkContext.defaultParallelism))
    trees = materialize(
        spark,
        dealt.repartition(n_parts, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(plant, "row binary, ids binary, points binary, ranges binary, children binary, boxes binary"),
        "trees",
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["block"]):
            raw = np.floor(matrix(group.column("vec")))
            own, ids = group.column("row").to_numpy(), group.column("vec_id").to_numpy()
            floor = np.full(len(own), np.nan)
            if exact and len(own) > k:  # the block's members are candidates: a first bound
                scores = raw @ raw.T
                np.fill_diagonal(scores, -np.inf)
                floor = np.partition(scores, len(own) - k, axis=1)[:, len(own) - k]
            packed = [own.astype("<i8"), ids.astype("<i8"), raw.astype(kind), floor.astype("<f8")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.column("block").to_numpy()[:1]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["block", "row", "ids", "points", "floor"]
            )

    blocks = parts(spark, n_queries, BLOCK)
    asking = rows.filter("asks").select("vec_id", "vec", "row", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    n_parts = parts(spark, blocks, 4, min(blocks, spark.sparkContext.defaultParallelism))
    asks = materialize(
        spark,
        asking.repartition(n_parts, "block").sortWithinPartitions("block").mapInArrow(gather, "block long, row binary, ids binary, points binary, floor binary"),
        "blocks",
    )

    # Each group of shards meets each group of blocks under one key.
    shard_groups = parts(spark, shards, SHARDS_EACH, min(shards, spark.sparkContext.defaultParallelism))
    block_groups = parts(spark, blocks, BLOCKS_EACH)
    none = F.lit(None).cast("binary")
    shard_group = F.explode(F.sequence(F.lit(0), F.lit(shard_groups - 1)))
    block_group = F.explode(F.sequence(F.lit(0), F.lit(block_groups - 1)))
    payload = ["row", "ids", "points", "ranges", "children", "boxes", "floor"]
    left = asks.select(
        shard_group.alias("s"), F.pmod("block", F.lit(block_groups)).cast("int").alias("q"), F.lit(False).alias("tree"),
        *(c if c in asks.columns else none.alias(c) for c in payload),
    )
    right = trees.select(
        F.pmod(F.xxhash64("row"), F.lit(shard_groups)).cast("int").alias("s"), block_group.alias("q"), F.lit(True).alias("tree"),
        *(c if c in trees.columns else none.alias(c) for c in payload),
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[at].as_buffer(), kind)  # noqa: B023, E731
                key = batch.column("s")[at].as_py(), batch.column("q")[at].as_py()
                if key != task:
                    yield from map(answers, held)
                    task, held = key, []
                if not batch.column("tree")[at].as_py():
                    floor = [None if np.isnan(f) else int(f) for f in get("floor", "<f8").tolist()]
                    queries = _as_numbers(get("points", kind).reshape(-1, dims), exact)
                    held.append((Search(queries, get("row", "<i8").tolist(), floor, k), get("ids", "<i8").tolist()))
                    continue
                tree = (
                    _as_numbers(get("points", kind).reshape(-1, dims), exact),
                    get("row", "<i8").tolist(),
                    get("ids", "<i8").tolist(),
                    get("ranges", "<i4").reshape(-1, 2).tolist(),
                    get("children", "<i4").reshape(-1, 2).tolist(),
                    _as_numbers(get("boxes", kind).reshape(-1, 2 * dims), exact),
                )
                for state, _ in held:
                    state.visit(*tree)
        yield from map(answers, held)

    def answers(one: tuple[Search, list[int]]) -> pa.RecordBatch:
        state, query_ids = one
        found = [(q, entry) for q, best in enumerate(state.best) for entry in best]
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([state.own[q] for q, _ in found], pa.int64()),
                pa.array([query_ids[q] for q, _ in found], pa.int64()),
                pa.array([-e[1] for _, e in found], pa.int64()),
                pa.array([clip(e[0]) for _, e in found], pa.int64()),
            ],
            ["row", "query_id", "vec_id", "score"],
        )

    n_parts = parts(spark, shard_groups * block_groups, 1)
    met = left.unionByName(right).repartition(n_parts, "s", "q").sortWithinPartitions("s", "q", "tree")
    found = met.mapInArrow(search, "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op7_topk_search": op7_topk_search}
ORACLE_SQL = {
    "op7_topk_search": """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}
