"""Small helpers used by all operators of this subpackage.

Nothing here looks at data.  Intermediate tables are Parquet files below the
folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor
costs at most the stage that was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id) mod FOLDS that marks a held-out document.
FOLDS, HELD_OUT = 4, 2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is
    set; otherwise, on one machine only, a temporary folder set once."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quantloom-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.  Cuts the lineage
    and keeps the rows through the loss of any executor."""
    path = f"{shared_dir(spark)}/quantloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._quantloom_path = path
    return out


def discard(spark: SparkSession, df: DataFrame | None) -> None:
    """Delete a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(df, "_quantloom_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a table that may be broadcast (bounded samples, lists of large keys).
BROADCAST_ROWS = 100_000


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` marked for broadcast if its known number of rows allows it."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


class Kept(dict):
    """Results computed when first asked for.  What is kept is bounded in
    entries and in bytes of keys; a longer key is computed each time.  The
    results do not depend on it."""

    def __init__(self, entries: int, longest: int = 64) -> None:
        self.entries, self.longest = entries, longest

    def compute(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        found = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[key] = found
        return found


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one scan of one column, no Python)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def text_batches(spark: SparkSession, most: int = 2000) -> None:
    """Rows with texts reach Python at most so many at a time, so that a batch
    of long texts stays small on both sides (a session setting that is only
    ever lowered; results do not depend on it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def parts(spark: SparkSession, rows_or_bytes: float, per_part: float, least: int = 1) -> int:
    """Number of partitions so that each holds about ``per_part``."""
    return int(max(least, -(-rows_or_bytes // per_part)))


def binary_values(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of each key, from batches sorted by integer keys.
    At most one key's rows and one batch are held."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[at] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 joined by the given pairs: the smallest node of each
    node's component."""
    label = np.arange(n, dtype=np.int64)
    if not len(left):
        return label
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            return label
        label = new
