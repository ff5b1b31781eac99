from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from plain import docs_of  # noqa: E402

from landflux.llm import pieces  # noqa: E402

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(Path(MODEL).read_bytes())


def odd_texts():
    rng = random.Random(1)
    texts = ["", " ", "  ", "   x  y   ", "Hello  world\n\tfoo ▁bar <s> é漢\x00 ", "a" * 3000, "ab" * 300, " \n \n\n  def f(x):\n", "▁▁",
             "😀👍🏽 漢字かな", "xyzzy" * 100 + "==" * 50, " " * 33, "\r\n\r\n", "<0x41>", "</s><unk>", "ﬁ①Å​　﻿", "x" * 50_000]
    return texts + ["".join(rng.choice("abcdehinorst  \n.▁é漢") for _ in range(rng.randint(1, 80))) for _ in range(1500)]


def test_encoding_equals_the_library(vocabulary, library):
    texts = odd_texts()
    flat, ends = pieces.Encoder(vocabulary).encode(texts)
    got = [flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    assert got == library.encode(texts, num_threads=1)


def test_decoding_equals_the_library(vocabulary, library):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert vocabulary.decode(ids) == library.decode(ids)


def test_round_trip_on_frames(spark, library):
    texts = [*odd_texts()[:200], None]
    both = pieces.decode(pieces.encode(docs_of(spark, texts, ids="clash", decoded="clash"), MODEL), MODEL).collect()
    assert len(both) == len(texts)
    for r in both:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode(text) and r.decoded == library.decode(library.encode(text))


def test_decoding_of_ids_that_are_no_text(spark, library):
    rows = [(1, [3 + 0xC3, 3 + 0x28, 259]), (2, None), (3, []), (4, [3 + 0xFF] * 3)]
    frame = spark.createDataFrame(rows, "n int, ids array<int>")
    got = {r.n: r.decoded for r in pieces.decode(frame, MODEL).collect()}
    assert got == {n: library.decode(ids or []) for n, ids in rows}


def test_empty_table(spark):
    assert pieces.decode(pieces.encode(docs_of(spark, []), MODEL), MODEL).count() == 0


def test_words_are_forgotten_in_time(vocabulary, library, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_WORDS", 50)
    encoder = pieces.Encoder(vocabulary)
    for at in range(17, 1000, 40):
        texts = odd_texts()[at : at + 40]
        flat, ends = encoder.encode(texts)
        assert flat.tolist() == [i for ids in library.encode(texts) for i in ids]


def test_many_merges_of_a_round_equal_the_sequential_order(library, vocabulary):
    """Few letters make many equal and overlapping pairs, joined words many new ones."""
    rng = random.Random(7)
    encoder = pieces.Encoder(vocabulary)
    letters = ["ab", "abc", "aeinst", "=-", "01", "abcdefghijklmnopqrstuvwxyz", "aA1_ ", "é世 a\n", "th e"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 300))) for some in letters for _ in range(100)]
    texts += ["".join(rng.choices(["the", "ing", "tion", "un", "and", "in"], k=rng.randint(1, 60))) for _ in range(200)]
    flat, ends = encoder.encode(texts)
    for text, start, end in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert flat[start:end].tolist() == library.encode(text)


@pytest.mark.parametrize("unit", ["a", "ab", "=", "the"])
def test_a_very_long_word_takes_few_rounds(library, vocabulary, unit, monkeypatch):
    rounds = []
    merges = pieces.Vocabulary._merges
    monkeypatch.setattr(pieces.Vocabulary, "_merges", lambda *given: rounds.append(1) or merges(*given))
    word = unit * 50_000
    flat, _ = pieces.Encoder(vocabulary).encode([word])
    assert flat.tolist() == library.encode(word)
    assert len(rounds) < 50


def test_no_python_call_for_each_character(vocabulary, library):
    """Characters and remembered words are handled by arrays; only a new word takes a call of its own."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdehinorst", k=30)) for _ in range(2000)]
    texts = [" ".join(words), " ".join(words[::-1])] * 2
    encoder, calls = pieces.Encoder(vocabulary), []
    sys.setprofile(lambda frame, event, arg: event == "call" and calls.append(1))
    try:
        flat, ends = encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert len(calls) < 3 * len(words)
    assert [flat[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == library.encode(texts)


def test_nothing_to_encode(vocabulary):
    for texts in ([], [None], ["", None]):
        flat, ends = pieces.Encoder(vocabulary).encode(texts)
        assert len(flat) == 0 and ends.tolist() == [0] * len(texts)
