"""SentencePiece encoding against the library."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest_llm import corpus, frame, plain

from roundcast.llm.pieces import SPACE, Merges, PieceEncoder, encode_pieces, vocabulary


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(vocabulary())


def library(encoder, text):
    return encoder.model.encode(text, add_bos=True, add_eos=True)


def own(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_random_texts_as_the_library(encoder):
    rng = random.Random(7)
    model = encoder.model
    pieces = [model.id_to_piece(k).replace(SPACE, " ") for k in range(259, model.get_piece_size())]
    for k in range(6000):
        text = (
            lambda: "".join(rng.choices("abcdeiotnrs  \n\t" + SPACE + ".é漢🙂0<>", k=rng.randint(0, 40))),
            lambda: "".join(rng.choices(pieces, k=rng.randint(1, 12))),
            lambda: " " * rng.randint(0, 60) + rng.choice(pieces) + " " * rng.randint(0, 60) + rng.choice(pieces),
            lambda: "".join(rng.choices("aehtn", k=rng.randint(1, 60))),
        )[k % 4]()
        assert own(encoder, text) == library(encoder, text), repr(text)


def test_every_piece_and_odd_texts(encoder):
    model = encoder.model
    for k in range(0, model.get_piece_size(), 7):
        text = model.id_to_piece(k)
        assert own(encoder, text) == library(encoder, text)
    for text in ("", " ", "  ", "<s>", "</s> x", "<0x0A>", "\x00", "\r\n\r\n", "　", SPACE, "a" + SPACE + " b", "🙂" * 9, "é", "�"):
        assert own(encoder, text) == library(encoder, text)


def test_long_texts_take_linear_time(encoder):
    for text in ("ab" * 200_000, "漢字" * 100_000, " " * 300_000 + "x", "\n" * 200_000, "word  " * 100_000):
        assert own(encoder, text) == library(encoder, text)


def test_backtracking_leaves_dead_ends():
    # "abc" is longer than "ab", but nothing goes on from it to the end
    merges = Merges(["a", "b", "c", "d", "bc", "bcd", "ab", "abc"], [0, 0, 0, 0, -1.0, -2.0, -3.0, -4.0])
    assert [merges.texts[k] for k in merges.tokens("abcd")] == ["a", "bcd"]
    assert [merges.texts[k] for k in merges.tokens("abc")] == ["abc"]


def test_models_that_are_not_understood():
    with pytest.raises(ValueError):
        Merges(["a", "b", "ab", "ba"], [0, 0, -1.0, -1.0])


def test_rows(spark, encoder):
    rows = corpus(5, 30)
    got = plain(encode_pieces(frame(spark, rows)), "doc_id", "n_tokens", "ids", "decoded")
    want = []
    for d, text in rows:
        ids = library(encoder, text or "")
        want.append((d, len(ids), bytearray(np.array(ids, "<u4").tobytes()), encoder.model.decode(ids)))
    assert got == sorted(want, key=repr)
    assert encode_pieces(frame(spark, [])).collect() == []
