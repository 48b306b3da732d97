"""The pipeline's stages on small tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert {r["doc_id"] for r in rows} <= whole
        docs = spark.createDataFrame(rows, docs.schema) if rows else docs.limit(0)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in docs.collect()}


ORDINARY = ["the quick brown fox jumps over the lazy dog", "a bird sings in the old tree near our house", "rain falls softly on the hills while we sleep"]
FOREIGN = ["der schnelle braune fuchs springt über den hund", "ein vogel singt im alten baum bei unserem haus", "regen fällt leise auf die hügel während wir schlafen"]


@pytest.fixture
def corpus(spark, tmp_path):
    """Rows whose fate in each stage is known, and their labels."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(240):
        base, lang = (ORDINARY, "en") if i % 2 else (FOREIGN, "de")
        words = " ".join(rng.choice(base) for _ in range(3)).split() + ["%s%d" % (rng.choice("bcdfg"), rng.randrange(10**6)) for _ in range(12)]
        rng.shuffle(words)
        if i % 8 == 0:
            words[3] = rng.choice(["moron", "m0r0n", "idiot"])
        rows.append((i, " ".join(words), lang, "s%d" % (i % 5), 0))
        labels.append((i, 1, int(i % 8 == 0)))
    shared = " ".join("passage%d" % k for k in range(40))
    own = lambda k: " ".join("%s%dq" % (w, k) for w in "alpha beta gamma delta sun moon".split())
    long = [f"{ORDINARY[0]} word{k}" for k in range(30)]
    rows += [(1000, None, "en", None, None), (1001, "", "en", "x", 0), (1002, "12 345 .. 678", None, "x", 1), (1003, "you stupid m o r o n and idiot", "en", "x", 2)]
    rows += [(1010, " ".join(long), "en", "x", 1), (1011, " ".join(long), "en", "y", 1), (1012, " ".join([*long[:-1], "changed"]), "en", "z", 1)]
    rows += [(1020, f"{own(1)} {shared} {ORDINARY[1]}", "en", "x", 1), (1021, f"{own(2)} {shared} {ORDINARY[2]}", "en", "x", 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)


def test_each_stage_decides_as_it_should(spark, corpus):
    docs, sf_dir = corpus
    stage = dict(corpus_pipeline.STAGES)
    every = {r["doc_id"] for r in docs.collect()}
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert ids(stage["toxicity"](spark, docs, sf_dir)) == every - set(range(0, 240, 8)) - {1003}
    assert ids(stage["language"](spark, docs, sf_dir)) == every - {1000, 1001, 1002}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert ids(stage["language"](spark, unlabelled, sf_dir)) == every - {1000, 1001, 1002}
    assert ids(stage["simhash"](spark, docs, sf_dir)) == every - {1001, 1011, 1012}
    texts = {r["doc_id"]: r["text"] for r in stage["substring"](spark, docs.filter("doc_id >= 1000"), sf_dir).collect()}
    assert set(texts) == {*range(1000, 1004), 1010, 1012, 1020, 1021} and texts[1012] == "changed"
    assert "passage7" in texts[1020] and "passage" not in texts[1021] and "alpha2q" in texts[1021] and texts[1000] is None
    packed = stage["packing"](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == every
    assert {r["doc_id"] for r in packed if r["bin_id"] is None} == {1000, 1001}
    a, b = ([r["bin_id"] for r in packed if r["doc_id"] == k] for k in (1010, 1011))
    assert not set(a) & set(b)


def test_stages_of_awkward_rows(spark, documents):
    docs = documents.drop("score")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() > 0, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
