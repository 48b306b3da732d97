"""Operator 10: SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are concatenated and indexed with a suffix array.
Every piece of the vocabulary is binary-searched in it, all pieces side by
side, one character deeper per round; the range of each piece gives all its
occurrences.  Occurrences are the edges of a lattice; they are sorted by word
and end position and relaxed from left to right.

The model is a byte-pair one, so the path wanted is not the cheapest but the
one that merging yields.  A prefix has exactly one last piece ``t`` such that
the last piece ``s`` of the rest may stand beside it, that is, merging ``s+t``
gives back ``s`` and ``t``; relaxing keeps that edge.  So the identifiers equal
the library's.  A character without a piece is an edge of its own, which
decodes through its bytes.

``encode`` keeps all columns and adds ``ids``; ``decode`` turns identifiers
into the text again.  Null and empty texts have no identifiers and decode to
the empty text.  Repeated rows are encoded each.  A byte that is not UTF-8 is
read as U+FFFD.  The codec is reversible but for what the model itself joins:
U+2581 decodes to a space.

What is indexed are the distinct words that a worker does not keep from earlier
batches; the identifiers do not depend on what it keeps.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import piece_model
from quantloom.llm.piece_model import SPACE, decoded
from quantloom.llm.shared import binary_values, read

#: Words of at most so many bytes whose identifiers a worker keeps, and characters indexed at once.
CACHE, LONGEST_KEPT = 800_000, 64
INDEXED = 600_000
_WORD = re.compile(rb" +[^ ]*|[^ ]+")
_SPACE = SPACE.encode()
_PAIRS = 1_000_000


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (code points) in the order of their first ``depth``
    characters: prefix doubling."""
    rank = text.astype(np.int64)
    order = np.argsort(text.astype(np.uint16) if text.max(initial=0) < 65_536 else text, kind="stable")
    width = 1
    while width < depth:
        follow = np.zeros(len(rank), np.int64)
        follow[:-width] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2 if width > 1 else 0x110002) + follow
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])])
        width *= 2
    return order


class Codec:
    """Encoder and decoder of one model; keeps words and piece pairs it met."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        m = self.model = piece_model.PieceModel(data)
        self.names = sorted(m.ids)
        self.piece_ids = np.array([m.ids[p] for p in self.names], np.int64)
        self.lengths = np.array([len(p) for p in self.names], np.int64)
        self.letters = np.zeros((m.longest, len(self.names)), np.uint32)
        for k, p in enumerate(self.names):
            self.letters[: len(p), k] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        self.fits: dict[int, bool] = {}
        self.words: dict[bytes, bytes] = {}
        size = len(m.pieces)
        self.out = [p.replace(SPACE, " ").encode() for p in m.pieces]
        for i, b in m.byte_of.items():
            self.out[i] = bytes([b])
        self.base = size + 0x110000

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and index of every occurrence of every piece in ``text``."""
        order = suffix_array(text, self.model.longest)
        padded = np.concatenate([text, np.zeros(self.model.longest + 1, np.uint32)])
        alive = np.arange(len(self.names))
        low = np.zeros(len(alive), np.int64)
        high = np.full(len(alive), len(text), np.int64)
        starts, found = [], []
        for depth in range(self.model.longest):
            want = self.letters[depth, alive]
            bounds = []
            for strict in (False, True):
                lo, hi = low.copy(), high.copy()
                while (open_ := lo < hi).any():
                    mid = (lo + hi) >> 1
                    char = padded[order[np.minimum(mid, len(text) - 1)] + depth]
                    right = (char <= want) if strict else (char < want)
                    lo = np.where(open_ & right, mid + 1, lo)
                    hi = np.where(open_ & ~right, mid, hi)
                bounds.append(lo)
            low, high = bounds
            ended = (self.lengths[alive] == depth + 1) & (low < high)
            for k, a, b in zip(alive[ended].tolist(), low[ended].tolist(), high[ended].tolist(), strict=True):
                starts.append(order[a:b])
                found.append(np.full(b - a, k, np.int64))
            keep = (self.lengths[alive] > depth + 1) & (low < high)
            alive, low, high = alive[keep], low[keep], high[keep]
            if not len(alive):
                break
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)

    def _beside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces (or lone characters) may stand side by side."""
        key = left * self.base + right
        some, where = np.unique(key, return_inverse=True)
        known = self.fits
        if len(known) > _PAIRS:
            known.clear()
        answers = np.zeros(len(some), bool)
        for n, k in enumerate(some.tolist()):
            fit = known.get(k)
            if fit is None:
                a, b = divmod(k, self.base)
                # A character without a piece merges with nothing.
                fit = known[k] = max(a, b) >= len(self.names) or self.model.beside(self.names[a], self.names[b])
            answers[n] = fit
        return answers[where]

    def _index(self, words: list[str]) -> list[bytes]:
        """Identifiers (little-endian 32-bit) of each word."""
        joined = "\0".join(words) + "\0"
        text = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        # The separator is not in any piece; a zero character in a word is one edge of its own.
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        word_at = np.repeat(np.arange(len(words)), sizes + 1)
        start, piece = self._edges(text)
        covered = np.zeros(len(text), bool)
        covered[start[self.lengths[piece] == 1]] = covered[first + sizes] = True
        alone = np.flatnonzero(~covered)
        start = np.concatenate([start, alone])
        code = np.concatenate([piece, len(self.names) + text[alone].astype(np.int64)])
        size = np.concatenate([self.lengths[piece], np.ones(len(alone), np.int64)])
        at = start - first[word_at[start]]
        end = at + size
        # Only one edge to a position is kept, so the order of those with one end does not matter.
        by = np.argsort(end.astype(np.uint16) if end.max(initial=0) < 65_536 else end, kind="stable")
        start, code, size, at, end = start[by], code[by], size[by], at[by], end[by]
        last = np.full(len(text) + 1, -1, np.int64)  # at a position: the piece that ends there
        back = np.zeros(len(text) + 1, np.int64)
        cuts = np.searchsorted(end, np.arange(1, int(end.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, c, n = start[a:b], code[a:b], size[a:b]
            ok = at[a:b] == 0
            more = np.flatnonzero(~ok & (last[s] >= 0))
            ok[more] = self._beside(last[s[more]], c[more])
            last[s[ok] + n[ok]] = c[ok]
            back[s[ok] + n[ok]] = n[ok]
        # Walk back from all word ends at once.
        here = (first + sizes)[sizes > 0]
        owner = np.flatnonzero(sizes > 0)
        taken = []
        while len(here):
            taken.append((owner, here, last[here]))
            here = here - back[here]
            keep = here > first[owner]
            owner, here = owner[keep], here[keep]
        if not taken:
            return [b""] * len(words)
        owner, here, codes = (np.concatenate(x) for x in zip(*taken, strict=True))
        by = np.argsort(here)  # positions grow with the words
        owner, codes = owner[by], codes[by]
        ids, spread = self._identifiers(codes)
        owner = np.repeat(owner, spread)
        cuts = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        raw = ids.astype("<i4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _identifiers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of pieces and lone characters, and how many each has."""
        known = codes < len(self.names)
        spread = np.ones(len(codes), np.int64)
        ids = np.zeros(len(codes), np.int64)
        ids[known] = self.piece_ids[codes[known]]
        if known.all():
            return ids, spread
        parts: list[list[int]] = []
        for c in codes[~known].tolist():
            parts.append([self.model.byte_ids[b] for b in chr(c - len(self.names)).encode()])
        spread[~known] = [len(p) for p in parts]
        out = np.repeat(ids, spread)
        out[np.repeat(~known, spread)] = [i for p in parts for i in p]
        return out, spread

    def split(self, text: bytes) -> list[bytes]:
        """The text cut where no piece reaches across; with its leading space."""
        if not text:
            return []
        text = b" " + text.replace(_SPACE, b" ")
        if not self.model.cuts:
            return [text]
        if not self.model.lines:
            return _WORD.findall(text)
        out: list[bytes] = []
        for k, line in enumerate(text.split(b"\n")):
            if k:
                out.append(b"\n")
            if b"  " in line or line[-1:] == b" " or (k and line[:1] == b" "):
                out += _WORD.findall(line)
            elif k:
                head, *rest = line.split(b" ")
                if head:
                    out.append(head)
                out += [b" " + w for w in rest]
            else:
                out += [b" " + w for w in line.split(b" ")[1:]]
        return out

    def learn(self, words: set[bytes]) -> None:
        """Encode words that are not kept yet, so many characters at a time."""
        if len(self.words) + len(words) > CACHE:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        at = 0
        while at < len(new):
            size, end = 0, at
            while end < len(new) and (size < INDEXED or end == at):
                size += len(new[end])
                end += 1
            some = new[at:end]
            codes = self._index([decoded(w).replace(" ", SPACE) for w in some])
            self.words.update(zip(some, codes, strict=True))
            at = end
        self.passing = [w for w in new if len(w) > LONGEST_KEPT]

    def encode_batch(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Identifiers of each text as little-endian 32-bit numbers.  Texts are
        taken so many bytes at a time; a longer one is taken alone."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size < 8_000_000 or end == at):
                size += len(texts[end] or b"")
                end += 1
            cut = [self.split(t or b"") for t in texts[at:end]]
            self.learn({w for words in cut for w in words})
            one = self.words.__getitem__
            for words in cut:
                yield b"".join(map(one, words))
            for w in self.passing:
                del self.words[w]
            at = end

    def decode(self, ids: bytes) -> bytes:
        """The text of identifiers: pieces joined, less the leading space."""
        out = self.out
        joined = b"".join([out[i] for i in np.frombuffer(ids, "<i4").tolist()])
        return joined[1:] if joined[:1] == b" " else joined


_WORKER: dict[str, Codec] = {}


def codec(data: bytes) -> Codec:
    """This worker's codec of the model."""
    if "codec" not in _WORKER or _WORKER["codec"].data != data:
        _WORKER["codec"] = Codec(data)
    return _WORKER["codec"]


def _with(docs: DataFrame, name: str, kind: T.DataType, source: str, model_path: str | None, convert) -> DataFrame:
    docs = docs.drop(name)
    data = piece_model.load(model_path or piece_model.default_path())
    names, at = docs.columns, docs.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(data)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, convert(tool, batch.column(at))], [*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def encode(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int; a column of that name is replaced) to rows
    with a string column ``text``."""

    def convert(tool: Codec, column: pa.Array) -> pa.Array:
        rows = [np.frombuffer(r, "<i4") for r in tool.encode_batch(binary_values(column))]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))

    return _with(docs, "ids", T.ArrayType(T.IntegerType()), "text", model_path, convert)


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """Adds ``decoded`` (string) to rows with an array column ``ids``; bytes
    that are not UTF-8 become U+FFFD."""

    def convert(tool: Codec, column: pa.Array) -> pa.Array:
        out = []
        for ids in column.to_pylist():
            out.append(tool.decode(np.array(ids or [], "<i4").tobytes()).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return _with(rows, "decoded", T.StringType(), "ids", model_path, convert)


def op10_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the identifiers as
    little-endian 32-bit numbers), decoded_sha256 (of the text decoded from
    them) and round_trip (whether that is the text, U+2581 read as a space)."""
    data = piece_model.load(piece_model.default_path())
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(data)
        for batch in batches:
            texts = binary_values(batch.column(1))
            counts, ids_hash, text_hash, same = [], [], [], []
            for text, ids in zip(texts, tool.encode_batch(texts), strict=True):
                back = tool.decode(ids)
                counts.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(back).hexdigest())
                same.append(back == (text or b"").replace(_SPACE, b" "))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash), pa.array(same)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


QUERIES = {"op10_sentencepiece_codec": op10_sentencepiece_codec}
ORACLE_SQL: dict[str, str] = {}
