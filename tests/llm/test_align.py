"""Alignment against a brute-force version over single bytes."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest
import public_tokenizers

from strandline.llm import align
from strandline.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    def a_tokens(text):
        from strandline.llm.align import _byte_level

        byte = _byte_level()
        return [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def b_tokens(text):
        def raw(i):
            return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

        return [(i, raw(i)) for i in b.encode(text)]

    return a_tokens, b_tokens


def brute(texts, sides):
    """Per text (n_a, n_b, n_groups, n_links, groups, links)."""
    out = []
    for text in texts:
        a, b = (f(text) for f in sides) if text else ([], [])
        want = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            out.append((0, 0, 0, 0, "", []))
            continue
        owners = []
        for tokens in (a, b):
            owner = []
            for k, (_, raw) in enumerate(tokens):
                owner += [k] * len(raw)
            owners.append(owner)
        pairs = sorted(set(zip(*owners)))
        links = [(a[i][0], b[j][0]) for i, j in pairs]
        groups, ga, gb, last = [], [], [], (-1, -1)
        ends = [set(accumulate(len(r) for _, r in t)) for t in (a, b)]
        both = ends[0] & ends[1]
        for at, (i, j) in enumerate(zip(*owners), 1):
            if i != last[0]:
                ga.append(str(a[i][0]))
            if j != last[1]:
                gb.append(str(b[j][0]))
            last = (i, j)
            if at in both:
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        out.append((len(a), len(b), len(groups), len(links), ";".join(groups), links))
    return out


def with_counts(found):
    corpus = Counter(pair for f in found for pair in f[5])
    top = {}
    for (_, b), n in corpus.items():
        top[b] = max(n, top.get(b, 0))
    return [(*f[:5], sum(corpus[p] == top[p[1]] for p in f[5]), sum(corpus[p] for p in f[5])) for f in found]


ODD = [
    None, "", " ", "a", "née Straße", "中文字 😀 é", "two  spaces   three", "\n\n\ttabs\r\n", "<|endoftext|> </s> <0x0A> <s>",
    "▁ looks like a space", "a▁b", "\x00 nul", " leading and trailing ", "x" * 300, "1234567890 " * 20, "don't WON'T I'll", "ﬁ ligature ́",
]


def texts(seed, n):
    r = random.Random(seed)
    marks = ["the", " ", "  ", "tion", "é", "\n", "un", "ing", "😀", "1", ".", "''", "Ünder", "　", "ß", "abc", "ER"]
    return ["".join(r.choice(marks) for _ in range(r.randrange(1, 60))) for _ in range(n)]


def test_aligner(sides):
    some = ODD + texts(1, 300)
    got = list(align.aligner(A, B).align([t or "" for t in some]))
    for text, want, have in zip(some, brute(some, sides), got):
        assert have[:5] == want[:5], text
        links = Counter(a << 32 | b for a, b in want[5])
        assert dict(zip(have[5].tolist(), have[6].tolist())) == dict(links)


def test_cut_texts(sides, monkeypatch):
    """Long texts in stretches, and encoded word by word, give what one piece gives."""
    some = [t * 5 for t in texts(2, 20)] + ["", "one"]
    monkeypatch.setattr(align, "AT_ONCE", 50)
    monkeypatch.setattr(align, "LONG_TEXT", 100)
    for want, have in zip(brute(some, sides), align.aligner(A, B).align(some)):
        assert have[:5] == want[:5]
        assert int(have[6].sum()) == want[3]


def test_table(spark, odd_docs, plain, sides):
    got = align.count_links(align.align(odd_docs, A, B)).collect()
    want = with_counts(brute([t for _, t in plain], sides))
    rows = sorted(map(repr, ((i, *w) for (i, _), w in zip(plain, want))))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got) == rows


def test_link_counts(spark, odd_docs, plain, sides):
    corpus = Counter(p for f in brute([t for _, t in plain], sides) for p in f[5])
    got = align.link_counts(align.align(odd_docs, A, B)).collect()
    assert {(r.a_id, r.b_id): r.links for r in got} == dict(corpus)


def test_empty(spark, no_docs):
    assert align.count_links(align.align(no_docs, A, B)).count() == 0


def test_query(spark, sf_dir, sides):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = with_counts(brute([r.text for r in docs], sides))
    got = {r.doc_id: r for r in QUERIES["op11_align"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r, w in zip(docs, want):
        mine = got[r.doc_id]
        digest = hashlib.sha256(w[4].encode()).hexdigest() if w[4] else ""
        assert (mine.n_a, mine.n_b, mine.n_groups, mine.n_links, mine.groups_sha256, mine.n_best, mine.count_sum) == (*w[:4], digest, *w[5:])
