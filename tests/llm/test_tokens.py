"""Operators 8 and 10 against the library."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quantloom.llm import piece_model, sentencepiece_codec, token_counts  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=str(PATH))
MODEL = piece_model.PieceModel(piece_model.load(str(PATH)))
CODEC = sentencepiece_codec.Codec(piece_model.load(str(PATH)))
CASES = ["", " ", "  ", "a", " a", "a ", "\n", "\n\n a \n b", "x  ▁y", "▁" * 25 + " a", "é\x00😀 \t z", "<s></s> <0x41> <unk>", "a\r\nb  c", "    " * 9 + "x", "日本語 テキスト　x"]


def count(text):
    return token_counts.count_text(text.encode(), token_counts._Bare(MODEL), token_counts._Spaced(MODEL))


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    want = LIBRARY.encode(text)
    assert count(text) == len(want)
    ids = next(iter(CODEC.encode_batch([text.encode()])))
    assert np.frombuffer(ids, "<i4").tolist() == want
    assert CODEC.decode(ids).decode() == text.replace("▁", " ")


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet=st.sampled_from(list("abcdehinorstu .,\n▁é0<>😀")), max_size=60))
def test_any_text(text):
    want = LIBRARY.encode(text)
    assert count(text) == len(want)
    assert np.frombuffer(next(iter(CODEC.encode_batch([text.encode()]))), "<i4").tolist() == want


def test_suffix_array_orders_suffixes():
    text = np.frombuffer("banana\0bandana\0".encode("utf-32-le"), np.uint32)
    order = sentencepiece_codec.suffix_array(text, 16)
    suffixes = [tuple(text[k : k + 16]) for k in order]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(len(text)))


def test_frames(documents, empty):
    got = token_counts.count_tokens(documents).collect()
    assert all(r["n_tokens"] == len(LIBRARY.encode(r["text"] or "")) for r in got) and len(got) == 12
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(documents)).collect()
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in coded)
    assert token_counts.count_tokens(empty).count() == 0 and sentencepiece_codec.encode(empty).count() == 0


def test_clashing_names_are_replaced(documents):
    again = token_counts.count_tokens(token_counts.count_tokens(documents))
    assert again.columns.count("n_tokens") == 1


def test_cold_and_warm_caches_agree(monkeypatch):
    texts = [c.encode() for c in CASES] + [b"word " * 50, b"x" * 300 + b" word", b"ab\xff\xfe c", b"\xe6\x97 x"] * 2
    warm = [bytes(i) for i in CODEC.encode_batch(texts)]
    cold = [next(iter(sentencepiece_codec.Codec(CODEC.data).encode_batch([t]))) for t in texts]
    assert [bytes(i) for i in CODEC.encode_batch(texts)] == warm == cold
    assert all(len(w) <= sentencepiece_codec.LONGEST_KEPT for w in CODEC.words)
    monkeypatch.setattr(sentencepiece_codec, "CACHE", 3)  # emptied all the time
    assert [bytes(i) for i in sentencepiece_codec.Codec(CODEC.data).encode_batch(texts)] == warm


def test_bytes_that_are_not_utf8():
    for raw in (b"ab\xff\xfe c", b"\xe6\x97 x", b"a\xe6\x97\xa5\xe6 b", b"\xf0\x9f\x98", b"\xed\xa0\x80 z"):
        want = LIBRARY.encode(raw)
        assert np.frombuffer(next(iter(CODEC.encode_batch([raw]))), "<i4").tolist() == want
        bare, spaced = token_counts._Bare(MODEL), token_counts._Spaced(MODEL)
        assert token_counts.count_text(raw, bare, spaced) == len(want)
        token_counts.count_text(b"y" * 5000, bare, spaced)
        assert all(len(k) <= 64 for kept in (bare, spaced, bare.part) for k in kept)
