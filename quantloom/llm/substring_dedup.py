"""Operator 5: repeated passages by super-k-mer partitioning.

A document's windows of 13 words are cut into runs that share a minimiser (the
smallest hash of the 3-word sequences inside a window).  A run travels as one
packed string to the bucket of its minimiser, so equal windows always meet,
each word is sent three times instead of thirteen, and a bucket sorts
its windows and counts them exactly.

Skew: a 3-word sequence whose windows would fill a bucket (found by counting a
fixed share of all windows, so the more text the more is counted) is no
minimiser where a window has another; a window of such sequences alone goes to
the bucket of its own digest.  Equal windows meet whatever is found.  Windows are first compared within the unit of rows that a task holds.
Of equal windows in a unit only the one in the smallest doc_id is undecided
and travels, so a passage that a third of all documents share reaches its
bucket once per unit, not once per document.  A bucket returns ranges of
windows to remove; a document's ranges meet its text in one join on doc_id.

Words are runs of bytes other than ASCII white space, unchanged.  Equality of
windows is equality of the 64-bit hashes of all 13 words.

Cases: null text has no words; documents of fewer words than a window keep
all; a window that occurs twice in one document only is kept; rows that repeat
a doc_id never remove each other's words (they are told apart by their text);
rows without doc_id are kept whole and remove nothing; an empty table gives no
rows; other columns are untouched.  Bytes, not characters, make words, so text
that is not UTF-8 is handled like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.shared import binary_values, parts, read, sorted_groups, text_batches, text_bytes

WINDOW, MINIMISER = 13, 3
#: Text bytes a task compares at once; text bytes whose windows make a bucket.
UNIT, BUCKET = 4_000_000, 2_700_000
#: One in so many pieces of text of so many bytes is looked at for common sequences.
PIECES, PIECE = 32, 16_384
_U = np.uint64
_LAST = _U(0xFFFFFFFFFFFFFFFF)
_STEP, _MIX = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LETTER[_WHITE] = 0
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _STEP), ("down", _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _MIX
    return h ^ (h >> _U(32))


def tokenize(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end (bytes ``buf``, text k in
    ``offsets[k:k+2]``): starts, ends, 64-bit hashes, and for each text the
    number of its first word (with the total at the end)."""
    white = _WHITE[buf]
    start = ~white
    end = start.copy()
    solid = start.copy()
    start[1:] &= white[:-1]
    end[:-1] &= white[1:]
    inner = offsets[1:-1]
    at = inner[inner < len(buf)]
    start[at] = solid[at]
    at = inner[inner > 0] - 1
    end[at] = solid[at]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = np.zeros(len(starts), np.uint64)
    block = 1 << 20
    first = 0
    while first < len(starts):  # so many bytes at a time, whole words
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + block, "right")))
        a, b = int(starts[first]), int(ends[last - 1])
        up, down = _powers(max(block, b - a) + 1)
        terms = _LETTER[buf[a:b]] * up[: b - a]
        at = starts[first:last] - a
        hashes[first:last] = np.add.reduceat(terms, at) * down[at]
        first = last
    return starts, ends, _mixed(hashes), np.searchsorted(starts, offsets)


def _sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + hashes[j : j + n]
    return _mixed(out)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each position on."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _groups(at: np.ndarray, digest: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (by first word) sorted by digest, earlier positions first among
    equals, and where a group of equal windows starts."""
    order = np.argsort(digest, kind="stable")
    some = digest[order]
    new = np.ones(len(order), bool)
    new[1:] = some[1:] != some[:-1]
    same = np.flatnonzero(~new)
    a, b = at[order[same]], at[order[same - 1]]
    for j in range(window):  # equal digests must mean equal words
        new[same] |= hashes[a + j] != hashes[b + j]
    return order, np.flatnonzero(new)


def _ranges(flag: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each run of flags within one owner."""
    edge = np.ones(len(flag), bool)
    edge[1:] = (flag[1:] != flag[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(edge)
    size = np.diff(np.append(at, len(flag)))
    keep = flag[at]
    return at[keep], size[keep]


_SCHEMA = "bucket int, doc_id long, mark long, start int, n int, packed binary"


def _batch(bucket, doc_id, mark, start, n, packed) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket, pa.int32()),
            pa.array(doc_id, pa.int64()),
            pa.array(mark, pa.int64()),
            pa.array(start, pa.int32()),
            pa.array(n, pa.int32()),
            pa.array(packed, pa.binary()),
        ],
        ["bucket", "doc_id", "mark", "start", "n", "packed"],
    )


def text_mark(text: bytes) -> int:
    """Tells texts of one doc_id apart; the same as ``_mark`` in SQL."""
    digest = xxhash.xxh64_intdigest(text, 42)
    return digest - (1 << 64) if digest >> 63 else digest


def _mark() -> F.Column:
    return F.xxhash64("text")


def _minimisers(hashes: np.ndarray, window: int, minimiser: int, common: np.ndarray) -> np.ndarray:
    """Of the window from each word on: the smallest hash of its sequences that
    are not ``common`` (sorted), or the largest number if all are."""
    values = _sequences(hashes, minimiser)
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        values[common[at] == values] = _LAST
    return _smallest(values, window - minimiser + 1)


def common_sequences(docs: DataFrame, window: int, minimiser: int, limit: int) -> np.ndarray:
    """Hashes of the sequences that would be the minimisers of more than about
    ``limit`` windows.  One in ``PIECES`` pieces of all texts is counted, by a
    hash of the document's id and the piece's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = []
            for doc_id, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                if doc_id is None or not text:
                    continue
                for k in range(-(-len(text) // PIECE)):
                    if xxhash.xxh32_intdigest(b"%d/%d" % (doc_id, k)) % PIECES == 0:
                        some.append(text[k * PIECE : (k + 1) * PIECE])
            if not some:
                continue
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in some])])
            _, _, hashes, first = tokenize(np.frombuffer(b"".join(some), np.uint8), offsets)
            here = np.arange(len(hashes))
            at = here[here + window <= np.repeat(first[1:], np.diff(first))] if len(here) else here
            least, n = np.unique(_minimisers(hashes, window, minimiser, np.zeros(0, np.uint64))[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(n)], ["least", "n"])

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "least long, n long")
    found = counted.groupBy("least").agg(F.sum("n").alias("n")).filter(F.col("n") * PIECES > limit).select("least").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def _scatter(rows: list[tuple[int, bytes]], n_buckets: int, window: int, minimiser: int, common: np.ndarray, repeated: bool) -> Iterator[pa.RecordBatch]:
    """One unit of rows: ranges decided here, and packed runs by bucket.
    ``repeated``: documents carry the marks of their texts."""
    rows.sort(key=lambda r: r[0])
    data = b"".join(t for _, t in rows)
    ids = np.array([i for i, _ in rows], np.int64)
    marks = np.array([text_mark(t) if repeated else 0 for _, t in rows], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
    starts, ends, hashes, first = tokenize(np.frombuffer(data, np.uint8), offsets)
    words = np.diff(first)
    of = np.repeat(np.arange(len(rows)), words)
    here = np.arange(len(hashes))
    at = here[here + window <= first[of + 1]] if len(here) else here
    if not len(at):
        return
    digest = _sequences(hashes, window)[at]
    order, group = _groups(at, digest, hashes, window)
    owner = of[at]
    least = np.repeat(owner[order[group]], np.diff(np.append(group, len(order))))
    decided = np.zeros(len(at), bool)
    decided[order] = ids[owner[order]] > ids[least]
    begin, size = _ranges(decided, owner)
    if len(begin):
        who = owner[begin]
        yield _batch(ids[who] % n_buckets, ids[who], marks[who], at[begin] - first[who], size, [None] * len(begin))
    least = _minimisers(hashes, window, minimiser, common)[at]
    open_ = ~decided
    alone = least == _LAST
    least[alone] = digest[alone]
    edge = np.ones(len(at), bool)
    edge[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | alone[1:]
    run = np.cumsum(edge) - 1
    undecided = np.flatnonzero(open_)
    if not len(undecided):
        return
    runs, head = np.unique(run[undecided], return_index=True)
    tail = np.append(head[1:], len(undecided)) - 1
    lo, hi = undecided[head], undecided[tail]
    bucket = ((least[lo] >> _U(7)) % _U(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    lo, hi, bucket = lo[by], hi[by], bucket[by]
    begin, end = starts[at[lo]].tolist(), ends[at[hi] + window - 1].tolist()
    who, word = owner[lo], at[lo] - first[owner[lo]]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    press = zstandard.ZstdCompressor(level=5)
    names, blobs = [], []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(lo)], strict=True):
        strings = [data[s:e] for s, e in zip(begin[a:b], end[a:b], strict=True)]
        docs, which = np.unique(who[a:b], return_inverse=True)
        body = b"".join(
            [
                np.array([b - a, len(docs)], "<i4").tobytes(),
                ids[docs].astype("<i8").tobytes(),
                marks[docs].astype("<i8").tobytes() if repeated else b"",
                which.astype("<i4").tobytes(),
                word[a:b].astype("<i4").tobytes(),
                np.array([len(s) for s in strings], "<i4").tobytes(),
                *strings,
            ]
        )
        names.append(int(bucket[a]))
        blobs.append(press.compress(body))
        if len(blobs) == 64:
            yield _batch(names, *[[None] * len(names)] * 4, blobs)
            names, blobs = [], []
    if blobs:
        yield _batch(names, *[[None] * len(names)] * 4, blobs)


def _gather(blobs: list[bytes], window: int, repeated: bool) -> pa.RecordBatch | None:
    """One bucket: ranges of windows that start in a smaller doc_id too."""
    ids, marks, word, sizes, body = [], [], [], [], []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, n_docs = np.frombuffer(raw, "<i4", 2).tolist()
        at = 8
        docs = np.frombuffer(raw, "<i8", n_docs, at)
        at += 8 * n_docs
        mark = np.frombuffer(raw, "<i8", n_docs, at) if repeated else np.zeros(n_docs, np.int64)
        at += 8 * n_docs * repeated
        which = np.frombuffer(raw, "<i4", n, at)
        word.append(np.frombuffer(raw, "<i4", n, at + 4 * n))
        sizes.append(np.frombuffer(raw, "<i4", n, at + 8 * n))
        body.append(memoryview(raw)[at + 12 * n :])
        ids.append(docs[which])
        marks.append(mark[which])
    ids, marks, word, sizes = (np.concatenate(x) for x in (ids, marks, word, sizes))
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    buf = np.frombuffer(b"".join(body), np.uint8)
    body.clear()
    _, _, hashes, first = tokenize(buf, offsets)
    run = np.repeat(np.arange(len(ids)), np.diff(first))
    here = np.arange(len(hashes))
    at = here[here + window <= first[run + 1]]
    digest = _sequences(hashes, window)[at]
    order, group = _groups(at, digest, hashes, window)
    run = run[at]
    owner = ids[run]
    least = np.repeat(np.minimum.reduceat(owner[order], group), np.diff(np.append(group, len(order))))
    gone = np.zeros(len(at), bool)
    gone[order] = owner[order] > least
    begin, size = _ranges(gone, run)
    if not len(begin):
        return None
    who = run[begin]
    none = [None] * len(begin)
    return _batch(np.zeros(len(begin), np.int32), ids[who], marks[who], word[who] + (at[begin] - first[who]), size, none)


def ids_repeat(docs: DataFrame) -> bool:
    """Whether any doc_id stands in two rows."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna()
    return bool(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count())


def repeated_ranges(spark: SparkSession, docs: DataFrame, repeated: bool, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """``doc_id``, ``mark`` and ``ranges`` (array of first window and number
    of windows) of the documents that share a window with a smaller doc_id.
    ``repeated``: doc_ids may repeat, so ``mark`` tells their texts apart;
    otherwise it is 0."""
    text_batches(spark)
    n = parts(spark, text_bytes(docs), BUCKET, 8)
    common = common_sequences(docs, window, minimiser, BUCKET // 12)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: list[tuple[int, bytes]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                if doc_id is None or not text:
                    continue
                if size and size + len(text) > UNIT:
                    yield from _scatter(unit, n, window, minimiser, common, repeated)
                    unit, size = [], 0
                unit.append((doc_id, text))
                size += len(text)
        if unit:
            yield from _scatter(unit, n, window, minimiser, common, repeated)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = batch.column(5).is_valid()
                decided = batch.filter(pa.compute.invert(whole))
                if decided.num_rows:
                    found.append(decided)
                yield batch.filter(whole)

        found: list[pa.RecordBatch] = []
        for group in sorted_groups(packed(), ["bucket"]):
            yield from found
            found.clear()
            out = _gather(group.column("packed").to_pylist(), window, repeated)
            if out is not None:
                yield out
        yield from found

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scatter, _SCHEMA)
    met = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, _SCHEMA)
    return met.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, changed_only: bool = False) -> DataFrame:
    """``docs`` with ``text`` as its kept words joined by one space (with
    ``changed_only``: left as it is where nothing is removed), and ``n_words``
    and ``n_removed`` (columns of these names are replaced)."""
    docs = docs.drop("n_words", "n_removed")
    names = docs.columns
    at = names.index("text")
    repeated = ids_repeat(docs)
    found = repeated_ranges(spark, docs, repeated, window).select(
        F.col("doc_id").alias("__ql_id"), F.col("mark").alias("__ql_mark"), F.col("ranges").alias("__ql_ranges")
    )
    same = F.col("doc_id").cast("long") == F.col("__ql_id")
    if repeated:
        same = same & (_mark() == F.col("__ql_mark"))
    joined = docs.join(found, same, "left").select(*names, "__ql_ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, ranges in zip(binary_values(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = 0
                if ranges:
                    cover = np.zeros(len(words) + 1, np.int32)
                    for r in ranges:
                        cover[r["start"]] += 1
                        cover[r["start"] + r["n"] + window - 1] -= 1
                    keep = np.cumsum(cover[:-1]) == 0
                    counts_all, words = len(words), [words[k] for k in np.flatnonzero(keep).tolist()]
                    gone = counts_all - len(words)
                texts.append(text if changed_only and not gone else b" ".join(words))
                counts.append(len(words) + gone)
                removed.append(gone)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"]
            )

    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = remove_repeats(spark, docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE_SQL = {
    "op5_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), s AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS passage FROM p
), f AS (
  SELECT passage, min(doc_id) AS first_doc FROM s WHERE i + 12 <= n GROUP BY passage
), g AS (
  SELECT DISTINCT s.doc_id, s.i + k AS i FROM s JOIN f USING (passage), range(13) t(k) WHERE s.i + 12 <= s.n AND first_doc < s.doc_id
), r AS (
  SELECT p.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY p.i), '') AS kept
  FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
}
