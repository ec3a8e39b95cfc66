import os
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import piece_codec
from strandline.llm.piece_codec import Codec

MODEL = os.path.join(public_tokenizers.path(""), "piece_bpe_32k.model")
PARTS = list("abZétheinr.,1\n\t ▁") + ["  ", "    ", "中", "😀", "İ", "\x85", "\x00", "the", "tion", "====", "----", "</s>"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return Codec(MODEL)


def ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


@settings(max_examples=500, deadline=None)
@given(text=st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_encode(own, library, text):
    assert ids(own.encode([text])[0]) == library.encode(text)


def test_pairs_of_pieces(own, library):
    r = random.Random(3)
    texts = ["".join(r.choice(own.pieces) for _ in range(r.randint(1, 4))) for _ in range(5000)]
    assert [ids(x) for x in own.encode(texts)] == library.encode(texts)


def test_decode_of_any_ids(own, library):
    r = random.Random(4)
    lists = [[r.randrange(0, 300 if r.random() < 0.5 else 32_000) for _ in range(r.randint(0, 9))] for _ in range(3000)]
    assert [own.decode(x) for x in lists] == library.decode(lists)


def test_forgetting_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 3)
    texts = ["some words and more words", "other words, again", "some words"]
    for _ in range(3):
        assert [ids(x) for x in own.encode(texts)] == library.encode(texts)


def test_tables(odd_docs, no_docs, plain, library):
    got = piece_codec.decode(piece_codec.encode(odd_docs, MODEL), MODEL)
    assert set(got.columns) == {*odd_docs.columns, "ids"}
    want = sorted(str((i, library.encode(t or "") + [2], library.decode(library.encode(t or "") + [2]))) for i, t in plain)
    assert sorted(str((r.doc_id, r.ids, r.text)) for r in got.collect()) == want
    assert piece_codec.decode(piece_codec.encode(no_docs, MODEL), MODEL).count() == 0
