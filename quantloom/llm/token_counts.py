"""Operator 8: token counts by heap-and-linked-list byte-pair merging.

Each text is cut where no piece of the vocabulary can reach across (before a
space that follows another character, and around line breaks); each part is
merged with a heap of adjacent pairs over a linked list, lowest rank first and
leftmost among equals.  The count is the number of initial symbols minus the
number of merges; identifiers are never made.  Parts recur, so a worker keeps
the counts of the short parts it met last (a cache of bounded entries of
bounded length; results do not depend on it).

Nulls and empty texts count 0 tokens and 0 bytes.  A byte that is not UTF-8
counts as U+FFFD, as the library reads it.  Repeated rows and rows with
a null id are counted each.  Extra columns are ignored by the query and kept by
``count_tokens``.  Long texts are handled part by part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm import piece_model
from quantloom.llm.piece_model import decoded
from quantloom.llm.shared import Kept, binary_values, read

#: Parts of at most 64 bytes whose counts a worker keeps.
CACHE = 500_000
LIMIT = 4096
_PART = re.compile(rb" +[^ ]*|[^ ]+")
_SPACE = piece_model.SPACE.encode()


class _Part(Kept):
    """Count of a part that merges cannot leave, spaces as U+2581."""

    def __init__(self, model: piece_model.PieceModel, entries: int = CACHE) -> None:
        super().__init__(entries)
        self.model = model

    def compute(self, part: str) -> int:
        return self.model.count(part)


class _Bare(Kept):
    """Count of a piece of a line, as bytes."""

    def __init__(self, model: piece_model.PieceModel) -> None:
        super().__init__(CACHE)
        self.model = model
        self.part = _Part(model, CACHE // 2)

    def compute(self, word: bytes) -> int:
        return sum(map(self.part.__getitem__, self.model.safe_parts(decoded(word).replace(" ", piece_model.SPACE)))) if word else 0


class _Spaced(_Bare):
    """The same for a word with one space before it, the space left out."""

    def compute(self, word: bytes) -> int:
        text = decoded(word)
        if text.isalpha():  # few cuts inside a word, and fewer that save time
            return self.model.count(piece_model.SPACE + text)
        return sum(map(self.part.__getitem__, self.model.safe_parts(piece_model.SPACE + text)))


_WORKER: dict = {}


def _state(data: bytes) -> tuple[_Bare, _Spaced]:
    if _WORKER.get("data") != data:
        model = piece_model.PieceModel(data)
        _WORKER.update(data=data, bare=_Bare(model), spaced=_Spaced(model))
    return _WORKER["bare"], _WORKER["spaced"]


def count_text(text: bytes, bare: _Bare, spaced: _Spaced) -> int:
    """Tokens of one text.  ``bare`` and ``spaced`` keep the counts of parts."""
    if not text:
        return 0
    model = bare.model
    if _SPACE in text:
        text = text.replace(_SPACE, b" ")
    if not model.cuts:
        return model.count(decoded(b" " + text).replace(" ", piece_model.SPACE))
    lines = text.split(b"\n") if model.lines else [text]
    total = len(lines) - 1
    one = spaced.__getitem__
    for k, line in enumerate(lines):
        if b"  " in line or line[:1] == b" " or line[-1:] == b" ":
            total += sum(map(bare.__getitem__, _PART.findall(b" " + line if k == 0 else line)))
            continue
        words = line.split(b" ")
        if k:
            total += bare[words[0]]
            del words[0]
        total += sum(map(one, words))
    return total


def count_tokens(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``docs`` with a string column ``text``: its columns and ``n_tokens`` (a
    column of that name is replaced)."""
    docs = docs.drop("n_tokens")
    data = piece_model.load(model_path or piece_model.default_path())
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare, spaced = _state(data)
        for batch in batches:
            counts = [count_text(t, bare, spaced) if t else 0 for t in binary_values(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*names, "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs)
    # The text is dropped again beside the counts; only numbers leave the stage.
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE_SQL: dict[str, str] = {}
