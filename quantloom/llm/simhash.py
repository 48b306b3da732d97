"""Operator 6: SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are made where the text is read.  Equal fingerprints are one node
with the smallest doc_id as its representative (aggregated before the
shuffle), so copies cost nothing further.  Of three parts of the 64 bits two
linked fingerprints share one whole, so the distinct fingerprints are dealt
three times, each time by the leading bits of another part: as many times
whatever the input.  In a shard the fingerprints are sorted by Gray rank;
groups of neighbours factor out the bits all their members share, groups of
groups do the same above them, and a search passes from the root down, adding
the differences in the bits each node fixes and leaving a whole group as soon
as they are too many.  What a shard returns is a spanning forest of the links
it found, never the pairs; components are then joined by large-star/small-star.
A shard above ``CROWDED`` fingerprints is cut into blocks, and every two blocks
meet in a task of their own.

Cases: null text has no words, and no words give fingerprint 0, which links
like any other; fewer words than a shingle give one shingle of all; repeated
rows share node and component; a row without doc_id gets the component of its
fingerprint; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.components import connected_components
from quantloom.llm.shared import binary_values, discard, local_components, materialize, parts, read, small, sorted_groups, text_batches, text_bytes

SHINGLE, BITS_APART, SEED = 3, 2, 42
#: Fingerprints wanted in a shard, and more than which a shard is cut; children of a node.
SHARD, CROWDED, FANOUT = 16_384, 131_072, 8
#: Similar documents: fingerprint words, shard size, bits searched in a band,
#: recall planned at the threshold; bytes of text of a block in the exact check.
WIDE, WIDE_SHARD, BAND, RECALL, BLOCK = 6, 65_536, 20, 0.9999, 8 << 20
#: Queries searched at once, and (query, node) pairs held at once.
AT_ONCE, FRONTIER = 2048, 1 << 18
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle.  Words are runs of bytes other than ASCII white
    space; A-Z are lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)], np.uint64)


_PLANES = np.arange(8, dtype=np.uint64)[None, :, None]
_LANES = np.uint64(0x0101010101010101)


def simhash(hashes: np.ndarray, n_words: int = 1) -> list[int]:
    """A bit is 1 if it is set in over half the hashes; further words of 64
    bits come from mixing the same hashes."""
    if not len(hashes):
        return [0] * n_words
    sums = np.zeros((n_words, 8, 8), np.int64)
    for first in range(0, len(hashes), 32_640):
        some = hashes[first : first + 32_640]
        words = np.stack([some if k == 0 else mixed(some, k) for k in range(n_words)])
        # A plane holds every eighth bit; its eight bytes count up to 255 hashes at once.
        lanes = np.add.reduceat((words[:, None] >> _PLANES) & _LANES, np.arange(0, len(some), 255), axis=2)
        sums += lanes.astype("<u8").view(np.uint8).reshape(n_words, 8, -1, 8).sum(axis=2, dtype=np.int64)
    bits = (2 * sums > len(hashes)).transpose(0, 2, 1).reshape(n_words, 64)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: bytes | None, shingle: int = SHINGLE, n_words: int = 1) -> list[int]:
    """SimHash of 64 bits a word; a repeated shingle counts each time."""
    return simhash(shingle_hashes(text, shingle), n_words)


def set_fingerprint(text: bytes | None, shingle: int, n_words: int) -> list[int]:
    """SimHash of the distinct shingles and, as one word more, a digest of
    their set."""
    distinct = np.unique(shingle_hashes(text, shingle))
    return [*simhash(distinct, n_words), xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes(), SEED)]


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from each hash."""
    h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index over distinct fingerprints in Gray order.  ``levels[0]`` is the
    top; a level holds each node's shared mask and the bits under it."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        codes = codes[self.order]
        self.fanout = fanout
        self.levels = [(np.full(len(codes), ALL), codes)]
        while len(self.levels[0][0]) > 1:
            mask, code = self.levels[0]
            at = np.arange(0, len(mask), fanout)
            shared = np.bitwise_and.reduceat(mask & code, at) | np.bitwise_and.reduceat(mask & ~code, at)
            self.levels.insert(0, (shared, code[at] & shared))

    def search(self, queries: np.ndarray, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, position in the indexed array) of at most ``apart``
        differing bits, so many at a time that memory stays bounded."""
        mask, code = self.levels[0]
        root = np.bitwise_count((queries ^ code[0]) & mask[0]).astype(np.int64)
        start = np.flatnonzero(root <= apart)
        todo = [(0, start, np.zeros(len(start), np.int64), root[start])]
        while todo:
            depth, query, node, sum_ = todo.pop()
            if depth == len(self.levels) - 1:
                if len(query):
                    yield query, self.order[node]
                continue
            if len(query) * self.fanout > FRONTIER and len(query) > 1:
                half = len(query) // 2
                todo += [(depth, query[half:], node[half:], sum_[half:]), (depth, query[:half], node[:half], sum_[:half])]
                continue
            (above, _), (mask, code) = self.levels[depth], self.levels[depth + 1]
            child = node[:, None] * self.fanout + np.arange(self.fanout)
            inside = child < len(mask)
            width = inside.sum(axis=1)
            parent, child = np.repeat(node, width), child[inside]
            query = np.repeat(query, width)
            more = np.bitwise_count((queries[query] ^ code[child]) & mask[child] & ~above[parent])
            sum_ = np.repeat(sum_, width) + more
            keep = sum_ <= apart
            todo.append((depth + 1, query[keep], child[keep], sum_[keep]))


def _shard_links(codes: np.ndarray, words: np.ndarray, ids: np.ndarray, indexed: np.ndarray, asking: np.ndarray, apart: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of ids, of the links between the ``indexed``
    and the ``asking`` rows of a shard: at most ``apart`` bits between the
    ``codes`` and at most ``limit`` between the whole ``words``."""
    index = GrayIndex(codes[indexed])
    label = np.arange(len(codes))
    for at in range(0, len(asking), AT_ONCE):
        some = asking[at : at + AT_ONCE]
        for q, hit in index.search(codes[some], apart):
            q, hit = some[q], indexed[hit]
            new = label[q] != label[hit]  # else already known to be joined
            q, hit = q[new], hit[new]
            if words.shape[1] > 1:
                near = np.zeros(len(q), np.int64)
                for k in range(words.shape[1]):
                    near += np.bitwise_count(words[q, k] ^ words[hit, k])
                q, hit = q[near <= limit], hit[near <= limit]
            if len(q):
                q, hit = label[q], label[hit]
                label = local_components(len(codes), np.concatenate([q, np.arange(len(label))]), np.concatenate([hit, label]))
    linked = np.flatnonzero(label != np.arange(len(label)))
    return ids[linked], ids[label[linked]]


def _log2(x: float) -> int:
    return max(0, math.ceil(math.log2(max(x, 1))))


def whole_tables(n_nodes: int, apart: int) -> tuple[int, list[np.ndarray]]:
    """Key bits and, for each of ``apart + 1`` parts of the 64 bits, the order
    of bits that brings the part to the front."""
    part = 64 // (apart + 1)
    key = min(part, _log2(n_nodes / SHARD))
    return key, [np.roll(np.arange(64), -k * part) for k in range(apart + 1 if key else 1)]


def band_tables(n_nodes: int, similarity: float, recall: float = RECALL) -> tuple[int, list[np.ndarray]]:
    """Key bits and, for each band, the bits of the key and then those that are
    searched.  There are so many bands that a pair of the similarity (each bit
    differs with the probability of ``bits_apart``) agrees in a band's key and
    differs in at most ``BITS_APART`` of its other bits with probability
    ``recall`` in one of them (a little less where bands overlap)."""
    key = _log2(n_nodes / WIDE_SHARD)
    p = bits_apart(similarity)
    meet = (1 - p) ** key * sum(math.comb(BAND, k) * p**k * (1 - p) ** (BAND - k) for k in range(BITS_APART + 1))
    bands, width = math.ceil(math.log(1 - recall) / math.log(1 - meet)), key + BAND
    rng = np.random.default_rng(64)
    order = np.concatenate([rng.permutation(64 * WIDE) for _ in range(-(-bands * width // (64 * WIDE)) + 1)])
    out, at = [], 0
    while len(out) < bands:  # runs of shuffled bits, none twice in a band
        run = order[at : at + width]
        at += width
        if len(set(run.tolist())) == width:
            out.append(run)
        if at + width > len(order):
            order, at = np.concatenate([order[at:], rng.permutation(64 * WIDE)]), 0
    return key, out


def links(spark: SparkSession, nodes: DataFrame, key: int, tables: list[np.ndarray], n_nodes: int, apart: int = BITS_APART, limit: int = BITS_APART) -> DataFrame:
    """``nodes``: ``rep`` (long) and ``words`` (array of longs, the bits of the
    fingerprint), distinct.  Each of ``tables`` lists bits of the fingerprint;
    the first ``key`` of them make the shard, all are indexed with radius
    ``apart``, and pairs of at most ``limit`` differing bits in all are kept.
    Pairs ``a``, ``b`` of reps that span the same components as all links."""

    def words_of(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = words_of(batch.column(1))
            bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
            for k, order in enumerate(tables):
                code = np.zeros((len(words), 64), np.uint8)
                code[:, : len(order)] = bits[:, order]
                code = np.packbits(code, axis=1).view(">u8").ravel().astype(np.uint64)
                home = (code >> np.uint64(64 - key)).astype(np.int64) if key else np.zeros(len(code), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((k << 40) + home), pa.array(code.view(np.int64)), *batch.columns], ["shard", "code", "rep", "words"])

    dealt = nodes.select("rep", "words").mapInArrow(deal, "shard long, code long, rep long, words array<long>")
    sizes = materialize(spark, dealt.groupBy("shard").agg(F.count("*").alias("size")).filter(F.col("size") > CROWDED), "crowded-shards")
    with_size = dealt.join(small(sizes, sizes.count()), "shard", "left")
    blocks = F.coalesce(F.ceil(F.col("size") / CROWDED).cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, mine).alias("lo"), F.greatest(o, mine).alias("hi")))
    met = with_size.select("shard", "code", "rep", "words", mine.alias("block"), F.explode(others).alias("pair"))
    met = met.select("shard", "pair.lo", "pair.hi", "block", "code", "rep", "words")
    names = ["shard", "lo", "hi"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, names):
            block, lo, hi = group.column("block").to_numpy(), group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            indexed, asking = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            if not len(indexed) or not len(asking):
                continue
            words, code = words_of(group.column("words").combine_chunks()), group.column("code").to_numpy().view(np.uint64)
            a, b = _shard_links(code, words, group.column("rep").to_numpy(), indexed, asking, apart, limit)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = parts(spark, n_nodes * len(tables), 50_000, spark.sparkContext.defaultParallelism)
    return met.repartition(n, *names).sortWithinPartitions(*names).mapInArrow(join, "a long, b long")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, n_words: int = 1, of: Callable = fingerprint) -> DataFrame:
    """``doc_id`` (long) and ``words`` (what ``of`` returns, 64 bits to a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [of(t, shingle, n_words) for t in binary_values(batch.column(1))]
            flat = np.array([w for c in codes for w in c], np.uint64).view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), len(codes[0])).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "words"])

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, words array<long>")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, apart: int = BITS_APART) -> DataFrame:
    """``doc_id``, ``fp`` (64 bits as a long) and ``component_id`` (smallest
    doc_id reachable over links of at most ``apart`` differing bits) of every
    row of ``docs``."""
    rows = materialize(spark, fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(spark, rows.groupBy("words").agg(F.min("doc_id").alias("rep")), "nodes")
    n_nodes = nodes.count()
    edges = materialize(spark, links(spark, nodes.dropna(), *whole_tables(n_nodes, apart), n_nodes, apart, apart), "links")
    found = _classes(spark, rows, nodes, edges)
    return found.select("doc_id", F.col("words")[0].alias("fp"), "component_id")


def _classes(spark: SparkSession, rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the component of their node; ``edges`` are used up."""
    label = connected_components(spark, edges)
    discard(spark, edges)
    of = nodes.join(label, F.col("rep") == F.col("node"), "left").select("words", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(of, "words").select("doc_id", "words", "component_id")


def bits_apart(similarity: float) -> float:
    """Share of bits in which two sets of the similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bits_limit(similarity: float, n_bits: int) -> int:
    """Differing bits that a pair of the similarity stays within.  The
    majorities of very few shingles differ in up to a quarter more than
    expected (3/16 for 4 of 5), so four standard deviations are added to that."""
    p = 1.25 * bits_apart(similarity)
    return int(n_bits * p + 4 * (n_bits * p * (1 - p)) ** 0.5)


def exact_links(sets: list[np.ndarray], words: np.ndarray, limit: int, similarity: float, label: np.ndarray | None = None, first: int = 1) -> np.ndarray:
    """For each set the first member of its component, over pairs of at most
    ``limit`` differing bits whose intersection is at least ``similarity`` of
    the union.  Sets from ``first`` on are compared with all before them.
    Pairs that are already joined (by ``label`` or through others) are not
    compared."""
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(tokens.max(initial=-1)) + 1, bool)
    label = np.arange(len(sets)) if label is None else label.copy()
    for k in range(max(first, 1), len(sets)):
        if not size[k]:
            continue
        near = label[:k] != label[k]
        near &= np.minimum(size[:k], size[k]) / np.maximum(size[:k], size[k]) >= similarity
        left = np.flatnonzero(near)
        left, at_once = left[np.bitwise_count(words[left] ^ words[k]).sum(axis=1, dtype=np.int64) <= limit], 1
        mine = tokens[ends[k] - size[k] : ends[k]]
        mark[mine] = True
        while len(left := left[label[left] != label[k]]):
            some, left = left[:at_once], left[at_once:]
            shared = np.array([np.count_nonzero(mark[tokens[ends[j] - size[j] : ends[j]]]) for j in some.tolist()])
            for j in some[shared / (size[some] + size[k] - shared) >= similarity].tolist():
                low, high = sorted((label[j], label[k]))
                label[label == high] = low
            at_once = min(2 * at_once, 1024)
        mark[mine] = False
    return label


def verified(spark: SparkSession, docs: DataFrame, label: DataFrame, shingle: int, limit: int, similarity: float) -> DataFrame:
    """Of the candidates' components ``label`` (``node``, ``component``), the
    links that hold exactly, as pairs that span the same components as all of
    them.

    A component of over ``BLOCK`` bytes of text is cut into blocks.  Each block
    is compared within itself; then one document of each group found in a block
    is compared with the first block, which joins what belongs together; at
    last every document outside the component's largest group is compared with
    all blocks.  So two documents that never meet are in one group already, no
    task holds more than about two blocks, and the work for a large group of
    similar documents grows with its size, not with its square."""
    member = label.unionByName(label.select(F.col("component").alias("node"), "component")).distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    bytes_of = text.select("node", F.octet_length("text").cast("long").alias("n"))
    in_blocks = lambda rows: rows.groupBy("component").agg(F.ceil(F.greatest(F.sum("n"), F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = in_blocks(bytes_of.join(member, "node"))
    member = materialize(spark, member.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "members")
    keys = ["component", "part", "other"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            probe = group.column("probe").to_numpy()
            order = np.argsort(probe, kind="stable")  # those that are compared come last
            ids = group.column("node").to_numpy()[order]
            texts = binary_values(group.column("text"))
            sets = [np.unique(shingle_hashes(texts[k], shingle)) for k in order.tolist()]
            words = np.array([simhash(s, WIDE) for s in sets], np.uint64)
            _, place, known = np.unique(group.column("known").to_numpy()[order], return_index=True, return_inverse=True)
            first = exact_links(sets, words, limit, similarity, place[known], int((~probe).sum()))
            linked = np.flatnonzero(first != place[known])
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[first[linked]])], ["a", "b"])

    text_batches(spark)
    n = parts(spark, text_bytes(docs), 2 * BLOCK, spark.sparkContext.defaultParallelism)

    def links_of(rows: DataFrame) -> DataFrame:
        dealt = rows.join(text, "node").select(*keys, "node", "known", "probe", "text")
        return materialize(spark, dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(check, "a long, b long"), "links")

    def dealt(rows: DataFrame, part, other, probe: bool) -> DataFrame:
        return rows.select("node", "component", part.alias("part"), other.alias("other"), "known", F.lit(probe).alias("probe"))

    none = F.lit(0)
    links = links_of(dealt(member.withColumn("known", F.col("node")), F.col("block"), none, True))
    large = member.filter("blocks > 1")
    if not large.limit(1).count():
        return links

    def groups(edges: DataFrame) -> DataFrame:
        found = connected_components(spark, edges).withColumnsRenamed({"node": "__node", "component": "__known"})
        return materialize(spark, large.join(found, F.col("node") == F.col("__node"), "left").select(*large.columns, F.coalesce("__known", "node").alias("known")), "groups")

    known = groups(links)
    bridge = dealt(known.filter("block = 0"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)), none, False)
    links = links.unionByName(links_of(bridge.unionByName(dealt(known.filter("block > 0 and node = known"), F.col("block"), none, True))))
    known = groups(links)
    counted = known.groupBy("component", "known").agg(F.count("*").alias("n"))
    largest = counted.groupBy("component").agg(F.max_by("known", F.struct("n", "known")).alias("largest"))
    outside = known.join(largest, "component").filter("known <> largest").drop("largest")
    rest = in_blocks(outside.join(bytes_of, "node")).withColumnRenamed("blocks", "parts")
    part, every = F.pmod(F.xxhash64("node"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    probes = dealt(outside.join(rest, "component"), part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), True)
    return links.unionByName(links_of(probes.unionByName(dealt(known.join(rest, "component"), every, F.col("block"), False))))


def similar_documents(spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id`` and ``component_id`` over links of at least ``similarity``
    (shared part of all distinct shingles).  Pairs are looked for by
    fingerprints of ``WIDE`` words, indexed by bands (see ``band_tables``: their
    keys grow with the number of documents, and their number with the keys),
    and each is then checked on the shingles themselves (their
    64-bit hashes); equal sets are one node."""
    limit = bits_limit(similarity, 64 * WIDE)
    rows = materialize(spark, fingerprints(docs, shingle, WIDE, set_fingerprint), "fingerprints")
    nodes = materialize(spark, rows.groupBy("words").agg(F.min("doc_id").alias("rep")), "nodes")
    known, n_nodes = nodes.dropna().select("rep", F.slice("words", 1, WIDE).alias("words")), nodes.count()
    maybe = materialize(spark, links(spark, known, *band_tables(n_nodes, similarity), n_nodes, BITS_APART, limit), "candidates")
    label = connected_components(spark, maybe)
    discard(spark, maybe)
    edges = materialize(spark, verified(spark, docs, label, shingle, limit, similarity), "links")
    return _classes(spark, rows, nodes, edges).select("doc_id", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLE_SQL: dict[str, str] = {}
