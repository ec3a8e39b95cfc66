import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import packing, rans, token_files
from strandline.llm.token_units import Encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = list("abZé'st.,1\n\t ") + ["  ", "\n\n", "中", "😀", "İ", "Σ", "\x85", "\x1c", "!!", "'ll", " the", "  "]


def path(name):
    return os.path.join(public_tokenizers.path(""), name)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path(name))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4")


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    return Encoder(path(request.param)), library(request.param)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=4))
def test_words_give_the_library_ids(pair, texts):
    own, want = pair
    assert own.encode(texts) == [want(t).tobytes() for t in texts]


LETTERS = list("aßÿÀÉéñÞþµªº×÷İıŁǅﬁσς") + ["\u0301", "e\u0301", "\u0338", "</w>", "Ġ", "'S", "'", "'re"]
CLOSING = list(".,!$%*<>=-_/\"") + ["%%%", "'.", ".'", "=" * 40, "\n", " ", " ", " ", "7"]


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(LETTERS + CLOSING), max_size=30).map("".join), max_size=4))
def test_letters_and_marks_give_the_library_ids(pair, texts):
    own, want = pair
    assert own.encode(texts) == [want(t).tobytes() for t in texts]


class Counting:
    def __init__(self, tokenizer, log):
        self.tokenizer, self.log = tokenizer, log

    def encode_batch_fast(self, texts, **more):
        self.log += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


@pytest.mark.parametrize("name", FILES)
def test_new_words_go_to_the_library_together(name):
    own, want = Encoder(path(name)), library(name)
    asked = []
    own._tokenizer, own._plain = Counting(own._tokenizer, asked), Counting(getattr(own, "_plain", None), asked)
    stems = ["".join("aeiou"[int(d)] + "ñbé"[int(d) % 3] for d in np.base_repr(k, 5)) for k in range(1000)]
    texts = [" ".join(["so", *stems[k::2], *[w + "%%%" for w in stems[k::2]], *[w + "," for w in stems]]) for k in (0, 1)]
    assert own.encode(texts) == [want(t).tobytes() for t in texts]
    assert len(asked) <= 20


def test_forgetting_changes_nothing(pair, monkeypatch):
    own, want = pair
    monkeypatch.setattr("strandline.llm.token_units.REMEMBERED", 5)
    texts = ["some words, and more words.\nNext line", "other words here; again words", "some words"]
    for _ in range(3):
        assert own.encode(texts) == [want(t).tobytes() for t in texts]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000, 65_536, 65_537, 140_000])
@pytest.mark.parametrize("spread", [1, 50_000])
def test_rans_round_trip(n, spread):
    ids = np.random.default_rng(n).zipf(1.3, n).astype(np.uint64) % spread
    ids = ids.astype(np.uint32)
    lengths = np.array([n], dtype=np.uint32)
    data = rans.encode(ids, np.array([-5]), np.array([True]), lengths, 9)
    got, keys, known, tokens, before = rans.decode(data)
    assert (got == ids).all() and keys[0] == -5 and known[0] and tokens[0] == n and before == 9


def test_rans_sees_damage():
    ids = np.arange(70_000, dtype=np.uint32) % 97
    data = bytearray(rans.encode(ids, np.array([1]), np.array([True]), np.array([70_000], dtype=np.uint32), 0))
    for at in (10, 60, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((rans.Damaged, zlib.error)):
            rans.decode(bytes(bad))


@pytest.mark.parametrize("segment", [1, 1000, 1 << 21])
def test_files_in_order(odd_docs, plain, segment):
    want = library(FILES[0])
    segments = token_files.write(odd_docs, path(FILES[0]), end_id=1, segment=segment)
    starts = {r.shard: r.shard_start for r in token_files.shard_starts(segments).collect()}
    got = sorted(token_files.read(segments).collect(), key=lambda r: starts[r.shard] + r.start_in_shard)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert starts[r.shard] + r.start_in_shard == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    ids = lambda t: np.append(want(t or ""), 1).astype("<u4").tobytes()
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in got) == sorted((i or -1, ids(t)) for i, t in plain)


def test_files_empty(no_docs):
    segments = token_files.write(no_docs, path(FILES[0]), end_id=1)
    assert token_files.read(segments).count() == 0


@pytest.mark.parametrize("windows, fan_in", [(2, 2), (64, 64)])
def test_packing(odd_docs, plain, windows, fan_in, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    want = library(FILES[1])
    pieces, moves = packing.pack(odd_docs.repartition(5), path(FILES[1]), 1, capacity=64, open_windows=windows)
    rows = packing.place(pieces, moves).collect()
    docs, windows_ = {}, {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        docs.setdefault((r.doc_id or -1, r.doc_tokens), []).append((r.start, r.length))
        windows_.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows_.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(want(t or "")) + 1 for _, t in plain)
    assert sum(r.length for r in rows) == total
    assert len(windows_) * 64 - total <= 64 * (3 + len(windows_) // 50)
    long = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == 6)
    assert b"".join(x for _, x in long) == np.append(want(dict(plain)[6]), 1).astype("<u4").tobytes()


def test_packing_empty(no_docs):
    pieces, moves = packing.pack(no_docs, path(FILES[1]), 1)
    assert packing.place(pieces.withColumn("c", F.crc32("ids")).drop("ids"), moves).count() == 0
