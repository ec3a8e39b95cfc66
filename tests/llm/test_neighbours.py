import numpy as np

from strandline.llm import neighbours
from strandline.llm.neighbours import nearest


def brute(ids, vectors, q, k):
    d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
    d[ids == q] = np.inf
    best = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
    return list(zip(ids[best].tolist(), d[best].tolist()))


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_and_scores(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = answers(nearest(df, "id % 10 = 0"))
    assert set(got) == {int(i) for i in ids if i % 10 == 0}
    hits = 0
    for q, found in got.items():
        want = brute(ids, vectors, q, 10)
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert found == sorted(found, key=lambda f: (f[2], f[1]))
        hits += len({i for i, _ in want} & {i for _, i, _ in found})
        true = dict(zip(ids.tolist(), np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1)).tolist()))
        assert all(s == true[i] for _, i, s in found)
    assert hits >= 0.9 * 10 * len(got)


def test_hot_vector_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "shards_for", lambda n: 3)
    r = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0], "a") for i in range(100)] + [(i, r.normal(size=3).tolist(), "b") for i in range(100, 160)]
    odd = [(200, None, ""), (201, [], ""), (202, [0.0, 0.0, 0.0], ""), (203, [1.0, float("nan"), 0.0], ""), (204, [1.0, None, 0.0], "")]
    odd += [(205, [float("inf"), 0.0, 0.0], ""), (None, [1.0, 2.0, 3.0], ""), (300, [5.0, 5.0], ""), (50, [1.0, 2.0, 3.0], "again")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, shard string")
    got = answers(nearest(df, "id in (0, 50, 120, 200, 202, 203, 300)"))
    assert set(got) == {0, 50, 120}
    assert [i for _, i, _ in got[0]] == list(range(1, 11)) and {s for _, _, s in got[0]} == {0.0}
    assert [i for _, i, _ in got[50]] == list(range(10))
    pairs = nearest(df.filter("vec_id in (100, 101, 102)"), "true")
    assert {q: len(a) for q, a in answers(pairs).items()} == {100: 2, 101: 2, 102: 2}
    assert nearest(df.limit(0), "true").count() == 0
    assert nearest(df.filter("vec_id = 300"), "true").count() == 0
