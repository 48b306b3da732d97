"""Operator 9: language identification with a string kernel.

The kernel of two texts is the number of n-grams of one to three bytes (letters
lower-cased, other ASCII one gap class, a text followed by gaps) that both hold,
whatever their counts, divided by the geometric mean of the texts' own numbers.
N-grams that occur in no landmark are left out of all three numbers.  Landmarks are a few documents
of each language; through them (Nystroem) one-versus-rest kernel ridge
regression is a small linear problem.  All documents are scored in batches by
one product of their presence matrix with the folded weights.

Fitted on a bounded sample of rows of any length: of each language at most
``SAMPLE`` documents with text by a hash of doc_id, the first of them
landmarks; none is held out, and only text and language are read.  The sample
is drawn by a threshold on the hash, so no task holds a language.  Learning and
scoring read whole texts.

Cases: null text and text without a letter give ``und`` and score 0; no
labelled document gives ``und`` for all; null languages are not learnt; rows
without doc_id are scored and not learnt from; of several texts with one doc_id
and language the least is learnt from; repeated rows score alike; ties
go to the language first in the alphabet; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.shared import binary_values, discard, held_out, materialize, read, small, text_batches

#: Documents of a language in the sample, landmarks in all.
SAMPLE, LANDMARKS = 800, 160
RIDGE, SHARPNESS = 1e-2, 3.0
#: Texts and bytes of text in a batch.
ROWS, BYTES = 256, 2_000_000
UNKNOWN = "und"

_CLASS = np.zeros(256, np.int32)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)
_N = 155
_CODES = _N + _N**2 + _N**3
_LETTER = re.compile(r"[^\W\d_]")


def _codes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n of 1 to 3: codes of the n-grams of all texts, and whose they are.
    A text is read as if gaps followed it, so what it holds does not depend on
    the text after it."""
    c = _CLASS[np.frombuffer(b"  ".join(texts) + b"  ", np.uint8)]
    sizes = np.array([len(t) + 2 for t in texts])
    whose = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    last = np.cumsum(sizes) - 1  # of each text's two gaps the second
    yield c, whose
    two = _N + c[:-1] * _N + c[1:]
    two[last[:-1]] = _N
    yield two, whose[:-1]
    three = _N + _N**2 + (c[:-2] * _N + c[1:-1]) * _N + c[2:]
    for at in (last[:-1] - 1, last[:-1]):
        three[at] = _N + _N**2
    yield np.append(three, _N + _N**2).astype(three.dtype), whose[:-1]


def presence(texts: list[bytes], place: np.ndarray, width: int) -> np.ndarray:
    """Which of the numbered n-grams each text holds (0 or 1)."""
    out = np.zeros((len(texts), width), np.float32)
    flat = out.reshape(-1)
    for codes, whose in _codes(texts):
        at = place[codes]
        known = at >= 0
        flat[whose[known].astype(np.int64) * width + at[known]] = 1
    return out


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text.decode("utf-8", "replace")) is not None


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < ROWS and (end == at or size + len(texts[end]) <= BYTES):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


@dataclass
class Model:
    """Languages, the n-grams that count, their weights (n-grams x languages), offsets."""

    languages: list[str]
    known: np.ndarray
    weights: np.ndarray
    offset: np.ndarray | float = 0.0

    def place(self) -> np.ndarray:
        out = np.full(_CODES, -1, np.int32)
        out[self.known] = np.arange(len(self.known), dtype=np.int32)
        return out

    def predict(self, texts: list[bytes], place: np.ndarray) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        held = presence(texts, place, len(self.known))
        size = np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))
        margin = (held @ self.weights) / size + self.offset
        likely = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        best = margin.argmax(axis=1)
        names = [self.languages[b] for b in best.tolist()]
        scores = likely[np.arange(len(texts)), best].astype(float).tolist()
        for k, text in enumerate(texts):
            if not has_letter(text):
                names[k], scores[k] = UNKNOWN, 0.0
        return names, scores


def landmarks_basis(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that occur in a landmark (given as its codes) and the
    landmarks' unit presence vectors."""
    known = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
    held = np.zeros((len(grams), len(known)), np.float32)
    for k, some in enumerate(grams):
        held[k, np.searchsorted(known, some)] = 1
    return known, held / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))


def solve(kernel: np.ndarray, among: np.ndarray, target: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the landmarks (landmarks x languages) and offsets: Nystroem features
    ``kernel @ among**-1/2``, ridge regression of +1/-1 on them, each language
    weighted alike."""
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    features = np.hstack([features, np.ones((len(features), 1))])
    share = 1 / np.maximum(target.sum(axis=0), 1)
    weight = (target @ share)[:, None]
    gram = features.T @ (weight * features) + ridge * np.eye(features.shape[1]) * weight.sum() / len(features)
    found = np.linalg.solve(gram, features.T @ (weight * (2 * target - 1)))
    return root @ found[:-1], found[-1]


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """``docs``: ``doc_id``, ``text``, ``lang``; held-out rows are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    known = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") > 0))
    # Half as many again as wanted of each language, then the first of them.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    sizes = known.groupBy("lang").agg((F.lit(1.5 * sample) / F.approx_count_distinct("doc_id", 0.02)).alias("share")).toArrow()
    empty = Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    if not sizes.num_rows:
        return empty
    shares = small(spark.createDataFrame(sizes), sizes.num_rows)
    some = known.select("doc_id", "lang", place.alias("place")).join(shares, "lang").filter("place < share").select("doc_id", "lang", "place").distinct()
    drawn = some.toPandas().sort_values(["lang", "place", "doc_id"])
    drawn["place"] = drawn.groupby("lang").cumcount() + 1
    picked = drawn[drawn["place"] <= sample]
    wanted = small(spark.createDataFrame(pa.Table.from_pandas(picked, preserve_index=False)), len(picked))
    text = known.select("doc_id", "lang", "text")
    chosen = text.join(wanted, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.first("place").alias("place"), F.min("text").alias("text"))
    chosen = materialize(spark, chosen, "language-sample")
    languages = sorted(set(picked["lang"]))
    each = max(1, landmarks // len(languages))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.unique(np.concatenate([c for c, _ in _codes([t])])).astype(np.int32) for t in binary_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(held, pa.list_(pa.int32()))], ["lang", "place", "grams"])

    marks = chosen.filter(F.col("place") <= each).select("lang", "place", "text").mapInArrow(grams, "lang string, place long, grams array<int>")
    lists = marks.orderBy("lang", "place").select("grams").toArrow().column(0)
    known_grams, unit = landmarks_basis([np.array(row.values) for row in lists])
    model = Model(languages, known_grams, np.zeros((len(known_grams), len(languages)), np.float32))

    def kernel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = model.place()
        for batch in batches:
            texts = binary_values(batch.column(1))
            for a, b in batches_of(texts):
                held = presence(texts[a:b], place, len(known_grams))
                rows = (held @ unit.T) / np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.astype(np.float32).ravel()), len(unit)).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["lang", "kernel"])

    got = chosen.select("lang", "text").mapInArrow(kernel_rows, "lang string, kernel array<float>").toArrow()
    kernel = got.column("kernel").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, len(unit))
    target = (np.array(got.column("lang").to_pylist(), object)[:, None] == np.array(languages, object)[None]).astype(float)
    discard(spark, chosen)
    of_landmark, offset = solve(kernel, (unit @ unit.T).astype(float), target)
    weights = unit.T.astype(float) @ of_landmark
    return Model(languages, known_grams, weights.astype(np.float32), offset)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (columns of these names
    are replaced)."""
    docs = docs.drop("lang_pred", "lang_score")
    text_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = model.place()
        for batch in batches:
            texts = [t or b"" for t in binary_values(batch.column(at))]
            found, scores = [], []
            for a, b in batches_of(texts):
                f, s = model.predict(texts[a:b], place)
                found += f
                scores += s
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "lang_score"]
            )

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(spark, docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
