import hashlib
from collections import Counter, defaultdict

import pytest

from strandline.llm.exact_dedup import drop_copies, drop_rows, find_copies


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


@pytest.mark.parametrize("prefix", [1, 256])
def test_matches_brute_force(odd_docs, plain, prefix):
    got = find_copies(odd_docs, digest_all=True, prefix=prefix).collect()
    groups = expected(plain)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(plain)
    for r in got:
        ids = groups[sha[r.text_sha256]]
        assert r.group_size == len(ids)
        assert r.keep_id == max(ids, key=lambda i: (i is not None, i or 0))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_unique_texts_are_not_digested(odd_docs):
    by_id = {r.doc_id: r for r in find_copies(odd_docs).collect()}
    assert by_id[6].text_sha256 and by_id[12].text_sha256 is None


def test_drop_keeps_columns_and_one_row_a_text(odd_docs, plain):
    got = drop_copies(odd_docs)
    assert got.columns == odd_docs.columns
    rows = got.collect()
    assert sorted(r.text or "" for r in rows) == sorted(expected(plain))
    assert {r.doc_id for r in rows if r.text == "one text"} == {2}


def test_drop_rows(spark, odd_docs):
    gone = spark.createDataFrame([(1,), (None,), (99,)], "doc_id long")
    assert {r.doc_id for r in drop_rows(odd_docs, gone, "doc_id", ["doc_id"]).collect()} == set(range(2, 16))


def test_empty(no_docs):
    assert find_copies(no_docs).count() == 0
    assert drop_copies(no_docs).count() == 0
