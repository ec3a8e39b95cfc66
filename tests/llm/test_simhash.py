import random
import re

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash
from strandline.llm.components import components

from .conftest import prose


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "A", "a b c", "a b c d", "A b\x0bC\xa0d e", prose(5, 400), "İ Σ é É x y z", "x " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def roots(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shard", [2, 20, 10_000])
def test_links_connect_exactly_what_is_near(spark, shard):
    r = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 12)):  # chains and clouds of near ones, also just beyond the radius
            x ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 6)))
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    got = simhash.near(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), shard=shard).collect()
    back = {s: u for s, u in zip(signed, fps)}
    want = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4]
    assert roots([(back[g.u], back[g.v]) for g in got], fps) == roots(want, fps)


def test_a_dense_group_leaves_few_links(spark):
    fps = [sum(1 << b for b in c) for c in ((i, j) for i in range(40) for j in range(i))]
    assert len(fps) == 780
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert simhash.near(df).count() <= 3 * 40 * len(fps) / 20


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)]
    got = {x.u: x.root for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots([(a, b) for a, b in links if a != b], nodes)


def test_cluster(spark, odd_docs, no_docs, plain):
    got = simhash.cluster(odd_docs).collect()
    fps = [(i, simhash.fingerprint(t or "")) for i, t in plain]
    nodes = {f for _, f in fps}
    root = roots([(a, b) for a in nodes for b in nodes if (a ^ b).bit_count() <= 4], nodes)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(str((i, f, least.get(root[f]))) for i, f in fps)
    assert sorted(str((r.doc_id, r.fp % (1 << 64), r.component)) for r in got) == want
    assert simhash.cluster(no_docs).count() == 0


def test_one_of_each_group_stays(odd_docs, no_docs):
    left = simhash.drop_near_copies(odd_docs)
    assert left.columns == odd_docs.columns
    rows = left.collect()
    assert 1 in {r.doc_id for r in rows} and not {2, 15} & {r.doc_id for r in rows}
    assert {r.text for r in rows if r.doc_id == 5} == {"another text under the same id"}
    assert simhash.drop_near_copies(no_docs).count() == 0
