"""Operators 1, 2, 3 and 9 on small rows."""

import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm import chat_format, language_id, packing, toxicity

WORDS = {"en": "the quick brown fox jumps over lazy dog while rain falls softly".split(), "de": "der schnelle braune fuchs springt über den faulen hund während".split()}


def corpus(spark, n=240, bad=("moron", "idiot")):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang]) for _ in range(rng.randrange(15, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), lang if i % 9 else None))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def model():
    text = " ".join(["moron idiot loser stupid trash worthless"] * 50).encode()
    return toxicity.smoothed(toxicity.trigram_counts([text])).tolist()


def test_restoring():
    m = model()
    for seen, want in (("m0r0n", "moron"), ("$tup1d", "stupid"), ("iiidiooot", "idiot"), ("l.o.s.e.r", "loser"), ("w0rthl3ss", "worthless"), ("1d10t", "idiot"), ("trash", "trash")):
        assert toxicity.readings(seen, m) == [want]
    assert toxicity.spaced_words("you l o s e r! yes", m) == ["loser"]
    assert toxicity.readings("555-1234", m) == [] and toxicity.readings("the###", m) == ["the"]


def test_restoring_at_edges_and_over_any_blanks():
    text = " ".join(["idiot ass stupid shit bad cunt a the lass hello mood"] * 50).encode()
    m = toxicity.smoothed(toxicity.trigram_counts([text])).tolist()
    for seen, want in (("a$$", "ass"), ("|diot", "idiot"), ("(unt", "cunt"), ("(a$$!),", "ass"), ("5#!7", "shit"), ("@$$", "ass"), ("stuupid", "stupid"), ("sstuup1d!", "stupid"), ("hello!", "hello"), ("(mood", "mood")):
        assert want in toxicity.readings(seen, m), seen
    for seen in ("455", "$455", "(555)", "10:30", "1,000.50", "50!", "!!!", "$", "--", ""):
        assert toxicity.readings(seen, m) == [], seen
    for seen, want in (("you b a d one", "bad"), ("i  d i\to t", "idiot"), ("s\nt\nu\np\ni\nd", "stupid"), ("so (i d i o t), yes", "idiot"), ("1 d 1 0 t", "idiot")):
        assert want in toxicity.spaced_words(seen, m), seen
    assert toxicity.spaced_words("a mood 1 2 3 4", m) == []


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="abdeilorst", max_size=14))
def test_doubled_letters_are_decoded_as_by_the_lattice(word):
    if toxicity._DOUBLE.search(word) and not toxicity._TRIPLE.search(word):
        m = model()
        a, b = toxicity._single(word, m), toxicity.restore(word, m, 2)
        paths = [toxicity._score(x[0], m) - (len(word) - len(x[0])) for x in (a, b)]
        assert a == b or np.isclose(*paths)


def test_long_tokens_take_linear_time():
    m = model()
    token = "ab1c9" * 30_000
    assert "".join(toxicity.restore(token, m))
    reader = toxicity.Reader(toxicity.smoothed(toxicity.trigram_counts([b"moron"])))
    reader.features(("x1" * 5000 + " m0r0n").encode())
    assert list(reader.tokens) == ["m0r0n"]  # long tokens are not kept


def test_regression_against_newton_steps():
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(200)]
    x = np.array([[k in r for k in range(6)] for r in rows], float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, 0, 0] - 0.5)))).astype(float)
    weight = rng.random(200) + 0.5
    w, b = toxicity.logistic_regression(rows, y, weight, 6, rounds=3000)
    design, share = np.hstack([x, np.ones((200, 1))]), weight / weight.mean()
    decay = np.array([1.0] * 6 + [0.0])
    beta = np.zeros(7)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = (design * (share * p * (1 - p))[:, None]).T @ design + np.diag(decay)
        beta -= np.linalg.solve(hessian, design.T @ (share * (p - y)) + decay * beta)
    assert np.allclose([*w, b], beta, atol=2e-3)


def test_repeated_ids_and_ties_in_toxicity(spark):
    docs, labels = corpus(spark)
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.lit("~ "), "text")))
    a = toxicity.fit(spark, docs, labels)
    b = toxicity.fit(spark, twice.repartition(7), labels.unionByName(labels))
    c = toxicity.fit(spark, twice.coalesce(1), labels)
    assert b.chosen == c.chosen == a.chosen and np.allclose(b.weights, c.weights)
    same = toxicity.score(docs.limit(1).unionByName(docs.limit(1)), a).collect()
    assert same[0]["toxic_score"] == same[1]["toxic_score"]


def test_restoring_is_the_best_path():
    """The beam holds every state, so it finds what trying all paths finds."""
    m = model()

    def every(token):
        best = None
        todo = [(0.0, (0, 0), "", 0)]
        repeats = toxicity._repeats(token)
        while todo:
            score, (c0, c1), text, at = todo.pop()
            if at == len(token):
                score += m[c0][c1][0] if c1 else 0.0
                best = max(best or (score, text), (score, text))
                continue
            for letter, cost in toxicity._choices(token[at], repeats[at]):
                c = toxicity._class(letter) if letter else -1
                if c < 0:
                    todo.append((score - cost, (c0, c1), text, at + 1))
                elif c == 0 and c1 == 0:
                    todo.append((score - cost, (0, 0), text, at + 1))
                else:
                    todo.append((score - cost + m[c1 and c0 or c0][c1][c], (c1, c), text + letter, at + 1))
        return best[1].split()

    for token in ("m0r0n", "1d1ot", "l-o-5er", "$cum", "ooo0p"):
        assert toxicity.restore(token, m) == every(token)


def test_toxicity_learns_and_never_from_held_out(spark, empty):
    docs, labels = corpus(spark)
    classifier = toxicity.fit(spark, docs, labels)
    odd = spark.createDataFrame([(900, "a m0r0n here", None), (901, None, None), (902, "", None), (903, "the lazy dog", None)], "doc_id long, text string, toxic_score string")
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(odd, classifier).collect()}
    assert got[900] > 0.5 > got[903] and got[901] == got[902] and all(0 <= s <= 1 for s in got.values())
    held = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(spark, docs, held)
    assert again.chosen == classifier.chosen and np.allclose(again.weights, classifier.weights)
    assert zlib.crc32(b"5") == spark.range(1).select(F.crc32(F.lit(5).cast("string"))).first()[0]
    nothing = toxicity.fit(spark, empty, labels.limit(0))
    assert toxicity.score(empty, nothing).count() == 0 and nothing.score(set()) == 0.0


def test_language(spark, documents, empty):
    docs, _ = corpus(spark)
    fitted = language_id.fit(spark, docs)
    assert fitted.languages == ["de", "en"]
    got = [r for r in language_id.predict(docs, fitted).collect() if r["lang"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["lang_score"] <= 1 for r in got)
    cases = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language_id.predict(documents, fitted).collect()}
    assert len(cases) == 11 and all(cases[k] == ("und", 0.0) for k in (3, 4, 6, 9)) and cases[1][0] == "en"
    none = language_id.fit(spark, empty)
    assert {r["lang_pred"] for r in language_id.predict(documents, none).collect()} == {"und"}


def test_language_sample_of_one_hot_language(spark, monkeypatch):
    """A language that holds most rows, and a doc_id that holds many, are sampled like any other."""
    rows = [(i, f"the quick brown fox {i}", "en") for i in range(900)] + [(5000, "the lazy dog", "en")] * 600 + [(2000 + i, f"der schnelle fuchs {i}", "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(12)
    fitted = language_id.fit(spark, docs, sample=50, landmarks=10)
    assert fitted.languages == ["de", "en"]
    again = language_id.fit(spark, docs.repartition(3), sample=50, landmarks=10)
    assert (again.known == fitted.known).all() and np.allclose(again.weights, fitted.weights)


def grams(t):
    t = "".join(chr(c + 500) for c in language_id._CLASS[np.frombuffer(t + b"    ", np.uint8)])
    return {t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - 3 + (n == 3))}


TEXTS = [b"Hello there", b"hello world", b"\xc3\xa9t\xc3\xa9", b"", b"zz", b"a"]


def test_kernel_is_the_count_of_shared_grams():
    alone = [np.unique(np.concatenate([c for c, _ in language_id._codes([t])])) for t in TEXTS]
    known, unit = language_id.landmarks_basis(alone)
    place = np.full(language_id._CODES, -1, np.int32)
    place[known] = np.arange(len(known))
    together = language_id.presence(TEXTS, place, len(known))
    assert (together > 0).tolist() == (unit > 0).tolist()  # whatever stands beside a text
    for a, x in enumerate(TEXTS):
        for b, y in enumerate(TEXTS):
            want = len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y)))
            assert np.isclose(float(unit[a] @ unit[b]), want, atol=1e-6)


def test_landmarks_give_dense_ridge_regression():
    """With every row a landmark the result is that of the whole kernel."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(14, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kernel = x @ x.T + 0.05 * np.eye(14)
    target = np.eye(2)[rng.integers(0, 2, 14)]
    weights, offset = language_id.solve(kernel, kernel, target, ridge=0.1)
    share = target @ (1 / target.sum(axis=0))
    ridge = 0.1 * share.sum() / 14
    # The same problem over the kernel itself: min sum s (y - K a - b)^2 + ridge (a K a + b^2).
    wide = np.hstack([kernel, np.ones((14, 1))])
    penalty = np.zeros((15, 15))
    penalty[:14, :14], penalty[14, 14] = kernel, 1
    dense = np.linalg.solve(wide.T @ (share[:, None] * wide) + ridge * penalty, wide.T @ (share[:, None] * (2 * target - 1)))
    assert np.allclose(kernel @ weights + offset, wide @ dense, atol=1e-6)


def test_language_ties_and_long_texts(spark):
    same = language_id.Model(["a", "b"], np.array([1]), np.zeros((1, 2), np.float32))
    assert same.predict([b"word"], same.place()) == (["a"], [0.5])
    rows = [(i, ("der schnelle braune fuchs " * 1500 if i % 2 else "the quick brown fox ") + str(i), "de" if i % 2 else "en") for i in range(40)]
    rows += [(1, "aaa", "de"), (None, "xyz abc", "fr")]
    fitted = language_id.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert fitted.languages == ["de", "en"]  # however long all documents of a language are
    got = language_id.predict(spark.createDataFrame([(1, "der fuchs"), (2, "the fox")], "doc_id long, text string"), fitted).collect()
    assert [r["lang_pred"] for r in got] == ["de", "en"]


TEXT = st.text(alphabet=st.sampled_from(list("ab\\#<>/: \nturn")), max_size=30)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
def test_chat_round_trip(turns):
    formatted, mask = chat_format.format_turns(turns)
    assert chat_format.parse_turns(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_probe_and_repeated_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", None), (2, None, None, "x")]
    messages = chat_format.conversation_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_format.format_paths(messages, chat_format.reply_paths(spark, messages))
    got = {r["tree"]: chat_format.parse_turns(r["formatted"]) for r in out.collect()}
    assert got == {"1": [("user", "a"), ("assistant", "b"), ("assistant", "b")], "none": [("user", "")], "2": [("", "x")]}
    probe = [("user", chat_format.PROBE_TEXT), ("assistant", chat_format.PROBE_TEXT)]
    assert chat_format.parse_turns(chat_format.format_turns(probe)[0]) == probe


def test_repeated_nodes_and_empty_tables(spark):
    rows = [("a", 1, None, 1.0, "user", "q"), ("a", 2, 1, 1.0, "assistant", "x"), ("a", 2, 1, 3.0, "assistant", "w"), ("a", 2, 1, 3.0, "assistant", "w")]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    paths = chat_format.reply_paths(spark, nodes, None)
    assert [(r["leaf"], r["rank"], r["path_score"], r["path"]) for r in paths.collect()] == [(2, 1, 4.0, [1, 2])]
    out = chat_format.format_paths(nodes.withColumn("formatted", F.lit(1)), paths).collect()
    assert [chat_format.parse_turns(r["formatted"]) for r in out] == [[("user", "q"), ("assistant", "w")]]
    assert chat_format.reply_paths(spark, nodes.limit(0)).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, tree int, node int")
    assert chat_format.conversation_messages(none).count() == 0


def test_reply_paths_against_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for tree in ("a", "b"):
        rows += [(tree, k, None if k == 0 else rng.randrange(max(0, k - 4), k), float(rng.randrange(5))) for k in range(25)]
    rows += [("chain", k, k - 1 if k else None, 1.0) for k in range(21)]
    rows += [("lost", 1, 99, 1.0), ("lost", 2, 1, None), ("self", 1, 1, 2.0), ("cycle", 1, 2, 1.0), ("cycle", 2, 1, 1.0), ("cycle", 3, 2, 1.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    want = set()
    for tree in {r[0] for r in rows} - {"cycle"}:
        mine = {r[1]: r for r in rows if r[0] == tree}
        up = {n: r[2] if r[2] in mine and r[2] != n else None for n, r in mine.items()}
        for leaf in set(mine) - set(filter(None.__ne__, up.values())):
            path = [leaf]
            while up[path[0]] is not None:
                path.insert(0, up[path[0]])
            want.add((tree, tuple(path), sum(mine[n][3] or 0.0 for n in path)))
    got = chat_format.reply_paths(spark, nodes, None).collect()
    assert {(r["tree"], tuple(r["path"]), r["path_score"]) for r in got} == want and len(got) == len(want)
    best = chat_format.reply_paths(spark, nodes).collect()
    assert all(r["path_score"] == max(w[2] for w in want if w[0] == r["tree"] and w[1][0] == r["root"]) for r in best)


def plain_best_fit(items, capacity, per_source):
    bins, out = [], []
    for length, source, cluster in items:
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= length and b["sources"].count(source) < per_source and cluster not in b["clusters"]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "sources": [], "clusters": []})
        bins[k]["room"] -= length
        bins[k]["sources"].append(source)
        bins[k]["clusters"].append(cluster)
        out.append(k)
    return out


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from("aab"), st.integers(0, 6)), max_size=40), st.integers(1, 3))
def test_best_fit_is_the_tightest_compatible(items, per_source):
    got = packing.best_fit([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], 20, per_source)
    assert got == plain_best_fit(items, 20, per_source)


def test_packing_keeps_every_byte(spark, documents, empty):
    out = packing.pack_documents(spark, documents, capacity=300).collect()
    size = {}
    for r in documents.collect():
        size.setdefault(r["doc_id"], []).append(len((r["text"] or "").encode()))
    room = {}
    for r in out:
        if r["bin_id"] is None:
            assert r["piece_length"] == 0
        else:
            room[r["bin_id"]] = room.get(r["bin_id"], 0) + r["piece_length"]
    assert max(room.values()) <= 300
    for doc_id, sizes in size.items():
        assert sum(r["piece_length"] for r in out if r["doc_id"] == doc_id) == sum(sizes)
    assert packing.pack_documents(spark, empty).count() == 0


def test_shards_keep_conflicts_apart_and_split_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    rng = random.Random(4)
    rows = [(i, "w" * rng.randrange(1, 90) + str(i % 40), "hot" if i % 3 else "s%d" % (i % 7), i % 25) for i in range(300)]
    rows += [(7, "same text", "hot", 7)] * 150
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, component_id long")
    for cluster in (None, "component_id"):
        out = packing.pack_documents(spark, docs, capacity=300, cluster=cluster).collect()
        assert len(out) == 450 and len({r["bin_id"] >> 32 for r in out if r["doc_id"] == 7}) > 5
        text = {}
        for i, t, _, c in rows:
            text.setdefault((i, len(t)), (t, c))
        bins = {}
        for r in out:
            bins.setdefault(r["bin_id"], []).append(r)
        for some in bins.values():
            assert sum(r["piece_length"] for r in some) <= 300
            sources = [r["source"] for r in some]
            assert all(sources.count(x) <= packing.PER_SOURCE for x in sources)
            marks = [text[r["doc_id"], r["piece_length"]][cluster is not None] for r in some]
            assert len(set(marks)) == len(marks)
