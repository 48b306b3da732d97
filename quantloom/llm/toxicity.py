"""Operator 1: toxicity after noisy-channel deobfuscation.

A character model (trigrams with back-off) is counted over all texts.  A token
that may be disguised (letters mixed with look-alikes or separators, look-alikes
only, a letter twice or more in a row, letters set apart by white space) becomes
a lattice: a look-alike may be each of its letters or itself, a separator or a
repetition may be dropped, each at a cost.  A Viterbi search finds the path that
the character model and the costs make likeliest; the restored words replace the
token.  Where clean text looks the same, the token keeps its plain reading and
gets the restored one besides: look-alikes at its edges that may be punctuation,
letters that are only doubled, and letters with white space between them.
Numbers (digits with their usual signs) stay numbers.  All other tokens have one
path only, themselves.

The classifier is a logistic regression on the presence of restored words and
of their beginnings.  It is fitted on a bounded sample of labelled rows (at
most ``SAMPLE`` of each class, by a hash of doc_id, weighted back to the
classes' true sizes), never on held-out ones.  Only the text is an input.

Cases: null and empty texts get the score of a text without evidence; rows
without doc_id are scored and never learnt from; a doc_id labelled twice is
toxic if either says so, and of several texts of one doc_id the least is
learnt from; null labels are not used; no labels at all give score
0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.shared import Kept, binary_values, discard, held_out, materialize, read, text_batches

#: Labelled rows of each class that the classifier is fitted on; features kept.
SAMPLE, FEATURES = 8192, 1024
THRESHOLD = 0.3
#: Tokens of at most 64 characters whose features a worker keeps.
CACHE = 200_000

#: Look-alikes of letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "2": "z", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "#": "h"}
SEPARATORS = " .-_*'~^,/\\"
#: Costs, in nats: a look-alike, a character read as a gap, a dropped separator, a dropped repetition.
SUBSTITUTE, GAP, DROP, REPEAT = 1.0, 5.0, 1.0, 1.0

_EDGE = ".,;:?!\"')]}>|*&%#$~-_=/\\"
_FRONT = "\"'([{<|*&%#~-_=/\\.,;:?"
#: Of these the look-alikes, which a token is also read with.
_SOFT = "$!|("
_SOFT_SET = frozenset(_SOFT)
_HARD_EDGE, _HARD_FRONT = "".join(set(_EDGE) - set(_SOFT)), "".join(set(_FRONT) - set(_SOFT))
_NUMBER = re.compile(r"[$€#(|+!]?\d[\d.,:/()+-]*(?:!+|[|$€+])?")
_DOUBLE, _TRIPLE = re.compile(r"([^\W\d_])\1"), re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(rf"(?<!\S)[{re.escape(_FRONT)}]*(\S(?:\s+\S(?!\S))+\s+\S)[{re.escape(_EDGE)}]*(?!\S)")
_CLASSES = 28
_BYTE_CLASS = np.zeros(256, np.int32)
_BYTE_CLASS[ord("a") : ord("z") + 1] = _BYTE_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_BYTE_CLASS[128:] = 27


def _class(char: str) -> int:
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 if char.isalpha() else 0


def trigram_counts(texts: list[bytes | None]) -> np.ndarray:
    """Counts of the classes of three bytes in a row, a gap around each text."""
    total = np.zeros(_CLASSES**3, np.int64)
    for at in range(0, len(texts), 512):
        joined = b"  ".join(t or b"" for t in texts[at : at + 512])
        c = _BYTE_CLASS[np.frombuffer(b"  " + joined + b"  ", np.uint8)]
        total += np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=_CLASSES**3)
    return total


def language_model(spark: SparkSession, docs: DataFrame) -> np.ndarray:
    """Log-probability of a character's class after two others, from counts
    over all texts (a table of fixed size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CLASSES**3, np.int64)
        for batch in batches:
            total += trigram_counts(binary_values(batch.column(0)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["code", "n"])

    text_batches(spark)
    counted = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(_CLASSES**3)
    total[counted.column("code").to_numpy()] = counted.column("n").to_numpy()
    return smoothed(total)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Trigram probabilities backed off to bigrams and those to unigrams."""
    three = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + _CLASSES)
    p2 = (two + 10 * p1) / (two.sum(axis=1, keepdims=True) + 10)
    return np.log((three + 10 * p2[None]) / (three.sum(axis=2, keepdims=True) + 10))


def _choices(char: str, repeated: bool) -> list[tuple[str, float]]:
    """Readings of an observed character: a letter, nothing or a gap.
    ``repeated``: it follows its like in a run."""
    if char.isalpha():
        return [(char, 0.0), ("", REPEAT)] if repeated else [(char, 0.0)]
    out = [(letter, SUBSTITUTE) for letter in LEET.get(char, "")]
    if char in SEPARATORS:
        out += [("", DROP), (" ", 0.0 if char == " " else GAP)]
    else:
        out += [(" ", GAP)]
        if repeated:
            out += [("", REPEAT)]
    return out


def _repeats(token: str, least: int = 3) -> list[bool]:
    """Whether each character follows its like in a run of ``least`` or more."""
    out: list[bool] = []
    for run in (list(g) for _, g in groupby(token)):
        out += [len(run) >= least and k > 0 for k in range(len(run))]
    return out


def restore(token: str, model: list, least: int = 3) -> list[str]:
    """Words of the likeliest path through the token's lattice, in which runs
    of ``least`` may shrink.  ``model``: nested lists of log-probabilities by
    class."""
    # A state keeps its score and its last letter with a pointer to the one before.
    beam: dict = {(0, 0): (0.0, None)}
    for char, repeated in zip(token, _repeats(token, least), strict=True):
        following: dict = {}
        choices = [(letter, cost, _class(letter) if letter else -1) for letter, cost in _choices(char, repeated)]
        for (c0, c1), (score, back) in beam.items():
            row = model[c0][c1]
            for letter, cost, c in choices:
                if c < 0:
                    state, value, out = (c0, c1), score - cost, back
                elif c == 0 and c1 == 0:
                    state, value, out = (0, 0), score - cost, back
                else:
                    state, value, out = (c1, c), score - cost + row[c], (letter, back)
                if state not in following or value > following[state][0]:
                    following[state] = (value, out)
        beam = following
    _, back = max(((score + (model[c0][c1][0] if c1 else 0.0), back) for (c0, c1), (score, back) in beam.items()), key=lambda x: x[0])
    letters = []
    while back is not None:
        letter, back = back
        letters.append(letter)
    return "".join(reversed(letters)).split()


def _score(word: str, model: list) -> float:
    """Log-probability of a word's letters and of the gap after it."""
    c0 = c1 = 0
    total = 0.0
    for char in word:
        c = _class(char)
        total += model[c0][c1][c]
        c0, c1 = c1, c
    return total + model[c0][c1][0]


def _single(core: str, model: list) -> list[str]:
    """``restore(core, model, 2)`` of letters without a run of three.  The
    lattice of few doubled letters has few paths, which are compared as such."""
    places = [m.start() for m in _DOUBLE.finditer(core)]
    if len(places) > 3:
        return restore(core, model, 2)
    paths = [(0.0, core)]
    for at in reversed(places):
        paths += [(cost + REPEAT, word[:at] + word[at + 1 :]) for cost, word in paths]
    return [max(paths, key=lambda path: _score(path[1], model) - path[0])[1]]


def _ends(edge: str) -> list[str]:
    """Beginnings of an edge that end between unlike characters: the first
    four, and all of it."""
    out, at = [""], 0
    for _, run in groupby(edge):
        at += len(list(run))
        out.append(edge[:at])
    return [*out[:5], *out[5:][-1:]]


def _core_readings(core: str, model: list) -> list[str]:
    """Words of a token without punctuation around it."""
    if not _DOUBLE.search(core):
        return [core] if core.isalpha() else restore(core, model)
    if core.isalpha() and not _TRIPLE.search(core):
        return [core, *_single(core, model)]
    return restore(core, model) + restore(core, model, 2)


def readings(token: str, model: list) -> list[str]:
    """Words that a lower-case token stands for."""
    core = token.rstrip(_EDGE).lstrip(_FRONT)
    if core.isalpha() or any(map(str.isalpha, core)):
        out = _core_readings(core, model)
        if not _SOFT_SET.isdisjoint(token):
            start = token.index(core)
            before, after = token[:start], token[start + len(core) :]
            before, after = before[len(before.rstrip(_SOFT)) :], after[: len(after) - len(after.lstrip(_SOFT))]
            if before or after:
                for front in _ends(before[::-1]):
                    for back in _ends(after):
                        if front or back:
                            out = out + _core_readings(front[::-1] + core + back, model)
        return list(dict.fromkeys(out))
    whole = token.rstrip(_HARD_EDGE).lstrip(_HARD_FRONT)
    if len(whole) < 3 or len(set(whole) & LEET.keys()) < 2 or _NUMBER.fullmatch(whole):
        return []
    return list(dict.fromkeys(restore(whole, model) + restore(whole, model, 2)))


def spaced_words(text: str, model: list) -> list[str]:
    """Words spelt with white space between their letters."""
    out = []
    for m in _SPACED.finditer(text):
        letters = sum(map(str.isalpha, m[1]))
        if letters >= 3 or letters and letters + sum(c in LEET for c in m[1]) >= 3:
            out += restore(" ".join(m[1].split()), model) + readings("".join(m[0].split()), model)
    return list(dict.fromkeys(out))


def word_features(word: str) -> list[str]:
    """The word and its beginnings of four to six letters."""
    return ["=" + word, *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


class Reader:
    """Features of texts; keeps what the disguised tokens it met last stand
    for.  With ``chosen`` (feature to index) only those features are reported."""

    def __init__(self, model: np.ndarray, chosen: dict[str, int] | None = None) -> None:
        self.model, self.chosen = model.tolist(), chosen
        #: First letters of all words that can have a chosen feature.
        self.stems = None if chosen is None else {f.removeprefix("=")[:4] for f in chosen}
        self.tokens = Kept(CACHE)
        self.tokens.compute = lambda token: self._of(readings(token, self.model))

    def _of(self, words: list[str]) -> tuple:
        if self.chosen is None:
            return tuple({f for w in words for f in word_features(w)})
        return tuple({self.chosen[f] for w in words if w[:4] in self.stems for f in word_features(w) if f in self.chosen})

    def features(self, raw: bytes | None) -> set:
        text = (raw or b"").decode("utf-8", "replace").lower()
        out: set = set()
        kept, stems, doubled = self.tokens, self.stems, _DOUBLE.search
        for token in set(text.split()):
            if token.isalpha() and not doubled(token):  # its only reading is itself
                if stems is None or token[:4] in stems:
                    out.update(self._of([token]))
            elif some := kept[token]:
                out.update(some)
        words = spaced_words(text, self.model)
        if words:
            out.update(self._of(words))
        return out


@dataclass
class Classifier:
    """What scoring needs: character model, features with weights, intercept."""

    model: np.ndarray
    chosen: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -np.inf

    def score(self, found: set[int]) -> float:
        z = self.intercept + sum(self.weights[list(found)]) if found else self.intercept
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def logistic_regression(rows: list[list[int]], y: np.ndarray, weight: np.ndarray, width: int, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on binary features (given as index lists),
    by accelerated gradient descent."""
    sizes = np.array([len(r) for r in rows])
    index = np.fromiter((k for r in rows for k in r), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(rows)), sizes)
    weight = weight / weight.mean()
    bound = float(((sizes + 1) * weight).max() * 0.25 * 0.5 + ridge / len(rows))
    w = np.zeros(width + 1)
    ahead, t = w.copy(), 1.0
    decay = np.full(width + 1, ridge / len(rows))
    decay[width] = 0
    slope = np.empty(width + 1)
    for _ in range(rounds):
        z = np.bincount(owner, ahead[index], len(rows)) + ahead[width]
        off = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        slope[:width], slope[width] = np.bincount(index, off[owner], width), off.sum()
        step = ahead - (slope + decay * ahead) / bound
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = step + (old - 1) / t * (step - w), step
    return w[:width], float(w[width])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Character model over all of ``docs``; classifier on a bounded sample."""
    model = language_model(spark, docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = materialize(spark, known, "labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.filter("toxic = 1").orderBy(*by).limit(sample).unionByName(known.filter("toxic = 0").orderBy(*by).limit(sample))
    picked = spark.createDataFrame(some.toArrow())  # 2 * sample ids at most
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Of rows that repeat a doc_id the least text is learnt from.
    rows = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            found = [sorted(reader.features(t)) for t in binary_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    rows = materialize(spark, rows.select("toxic", "text").mapInArrow(extract, "toxic int, found array<string>"), "sample")
    discard(spark, known)
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic or n_toxic == n:
        p = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1) if sizes else 0.0
        return Classifier(model, intercept=float(np.log(p / (1 - p))) if p else -np.inf)
    each = rows.select("toxic", F.explode("found").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    gain = _gain(F.col("a"), F.col("n"), float(n_toxic), float(n))
    best = each.filter("a >= 2 or n - a >= 2").orderBy(F.desc(gain), "feature").limit(FEATURES).collect()
    chosen = {r["feature"]: k for k, r in enumerate(best)}
    wanted = F.array(*[F.lit(f) for f in chosen]) if chosen else F.array().cast("array<string>")
    design = rows.select("toxic", F.array_intersect("found", wanted).alias("found")).toArrow()
    discard(spark, rows)
    y = design.column("toxic").to_numpy().astype(float)
    columns = [[chosen[f] for f in r] for r in design.column("found").to_pylist()]
    weight = np.where(y == 1, sizes[1] / n_toxic, sizes[0] / (n - n_toxic))
    weights, intercept = logistic_regression(columns, y, weight, len(chosen))
    return Classifier(model, chosen, weights, intercept)


def _gain(a, n, toxic: float, total: float):
    """Log-likelihood ratio of a feature's presence against the label."""

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    b, rest = n - a, total - toxic
    inside = part(a, n * toxic / total) + part(b, n * rest / total)
    return inside + part(toxic - a, (total - n) * toxic / total) + part(rest - b, (total - n) * rest / total)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``docs`` with ``toxic_score`` (a column of that name is replaced)."""
    docs = docs.drop("toxic_score")
    text_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(classifier.model, classifier.chosen)
        for batch in batches:
            scores = [classifier.score(reader.features(t)) for t in binary_values(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*names, "toxic_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(spark, docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
