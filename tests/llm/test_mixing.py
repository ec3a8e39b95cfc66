"""Mixing against its rule by sorting, and its targets against hand-made ones."""

import hashlib
import re
from itertools import groupby

import pytest

from strandline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """(doc_id, source, size, source_size, target, taken) by sorting every source."""
    sized = [(i, s, len(WORD.findall(t or "")), int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:15], 16)) for i, s, t in rows]
    sources = sorted({r[1] for r in sized}, key=lambda s: (s is None, s or ""))
    total = {s: sum(r[2] for r in sized if r[1] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    free, target = set(sources), {}
    while free:
        rest = share * sum(total.values()) - sum(target.values())
        level = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if level[s] > most * total[s]}
        target |= {s: most * total[s] for s in above}
        free -= above
        if not above:
            target |= level
            break
    out = []
    order = sorted(sized, key=lambda r: (sources.index(r[1]), r[3], r[2], r[0] is None, r[0] or 0))
    for s, group in groupby(order, key=lambda r: r[1]):
        whole = int(target[s] // total[s]) if total[s] else 0
        upto = 0
        for i, _, n, _ in group:
            upto += n
            out.append((i, s, n, total[s], target[s], n * (whole + (upto - n / 2 < target[s] - whole * total[s]))))
    return out


def rows_of(df):
    return sorted((repr((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken)) for r in df.collect()))


def same(df, rows, **how):
    # rows that are alike in id and size may change places
    got, want = rows_of(df), sorted(map(repr, brute(rows, **how)))
    assert got == want


def test_odd(spark, odd_docs):
    same(mixing.mix(odd_docs), [(r.doc_id, r.source, r.text) for r in odd_docs.collect()])


def test_empty(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0


@pytest.mark.parametrize("share,most", [(0.3, 2.0), (1.5, 2.0), (2.5, 2.0), (3.0, 4.0)])
def test_sources(spark, share, most):
    """Hot, small, empty and missing sources."""
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "w " * (i % 11)) for i in range(900)]
    rows += [(1000, "zero", ""), (1001, "zero", None), (1002, None, "a b c"), (1003, None, "d"), (1004, "", "x " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mix(df, share=share, most=most)
    same(mixed, rows, share=share, most=most)
    assert rows_of(mixing.mix(df.repartition(7), share=share, most=most)) == rows_of(mixed)


def test_repeated_rows(spark):
    """A third of all rows is one row many times: its copies count one by one, and the target is met."""
    rows = [(7, "a", "one two")] * 300 + [(i, "a", "x y z") for i in range(100)] + [(i, "b", "w") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, share=0.8).groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r.target) <= 2 for r in got)


def test_one_bucket(spark, monkeypatch):
    """Budgets nest: what a smaller one takes, a larger one takes as well."""
    rows = [(i, "a", "x " * (i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = [{r.doc_id for r in mixing.mix(df, share=s).collect() if r.copies} for s in (0.2, 0.5, 0.9)]
    assert taken[0] < taken[1] < taken[2]


def test_words(spark):
    text = " a\tb\x0bc\x0c\x0d d e f \x1cg xx "
    got = spark.createDataFrame([(text,), (None,), ("",), ("   ",), ("xxx",)], "t string").select(mixing.words("t").alias("n"))
    assert [r.n for r in got.collect()] == [len(WORD.findall(text)), 0, 0, 0, 1]
