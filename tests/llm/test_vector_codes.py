"""Metric-tree rounds against plain comparison of every part with every entry."""

import numpy as np
import pytest

from strandline.llm import vector_codes
from strandline.llm.vector_codes import Balls


def nearest(points, book):
    return ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)


def brute(vectors, books):
    n, (parts, k, width) = len(vectors), books.shape
    cut = vectors.reshape(n, parts, width)
    codes = np.stack([nearest(cut[:, p], books[p]) for p in range(parts)], axis=1)
    errors = sum(((cut[:, p] - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(parts))
    return codes, errors


def refined(vectors, books):
    codes, _ = brute(vectors, books)
    cut, out = vectors.reshape(len(vectors), *books.shape[::2]), books.copy()
    for p in range(len(books)):
        for e in range(books.shape[1]):
            mine = cut[codes[:, p] == e, p]
            if len(mine):
                out[p, e] = mine.sum(axis=0) // len(mine)
    return out


def shapes():
    r = np.random.default_rng(3)
    yield "normal", r.normal(size=(700, 16)) * 256
    yield "clusters", (r.integers(0, 5, (900, 4)).repeat(4, axis=1) + r.normal(size=(900, 16)) * 0.05) * 256
    yield "hot copy", np.concatenate([np.full((500, 16), 77), r.normal(size=(300, 16)) * 256])
    yield "few values", r.integers(-1, 2, (800, 16)) * 256
    yield "one", np.full((1, 16), -3)
    yield "all alike", np.full((300, 16), 5)
    yield "wide parts", r.normal(size=(300, 64)) * 100


@pytest.mark.parametrize("name,vectors", list(shapes()))
def test_balls(name, vectors):
    vectors, parts = np.floor(vectors).astype(np.int64), 4
    tree = Balls.load(Balls.build(vectors, parts).dump())
    cut = vectors.reshape(len(vectors), parts, -1)
    books = np.ascontiguousarray(cut[:20].transpose(1, 0, 2))
    for _ in range(3):
        codes, errors = brute(vectors, books)
        got_codes, got_errors = tree.codes(books)
        assert (got_codes == codes).all() and (got_errors == errors).all()
        n, sums = tree.totals(books)
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = cut[codes[:, p] == e, p]
                assert n[p, e] == len(mine) and (sums[p, e] == mine.sum(axis=0)).all()
        books = refined(vectors, books)


def test_balls_hold_their_points():
    """Every ball covers the points below it, and caches their number and sum."""
    vectors = np.floor(np.random.default_rng(1).normal(size=(500, 8)) * 256).astype(np.int64)
    tree = Balls.build(vectors, 2)

    def below(node):
        if tree.left[node] < 0:
            return tree.row[tree.start[node] : tree.start[node] + tree.count[node]].tolist()
        return below(tree.left[node]) + below(tree.right[node])

    for node in range(tree.used):
        points = tree.points[below(node)]
        assert len(points) == tree.count[node] and (points.sum(axis=0) == tree.sums[node]).all()
        assert np.sqrt(((points - tree.center[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-6
    assert sorted(below(0)) == list(range(500)) and sorted(below(1)) == list(range(500, 1000))


def test_whole_balls_are_owned():
    """Far clusters are settled by their balls: no point is compared."""
    r = np.random.default_rng(5)
    vectors = (np.arange(4000) % 4 * 100_000)[:, None] + r.integers(0, 100, (4000, 4))
    _, single = Balls.build(vectors, 1).walk(vectors[None, :4])
    assert not single


def test_table(spark, monkeypatch):
    r = np.random.default_rng(9)
    rows = [(i % 150, (r.normal(size=32)).tolist(), i % 3 if i % 5 else None, 1, "x") for i in range(400)]
    bad = [None, [], [None] * 32, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1.0] * 16, [1.0] * 5]
    rows += [(500 + k, v, 1, 1, "x") for k, v in enumerate(bad)] + [(None, [0.5] * 32, None, 1, "x")] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, error int, tree string").repartition(5)
    blocks, books = vector_codes.trained(df, parts=4, entries=10)
    got = vector_codes.with_label_error(vector_codes.encode(blocks, books)).collect()
    kept = [x for x in rows if x[1] and len(x[1]) == 32 and None not in x[1] and np.isfinite(x[1]).all()]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    vectors = np.floor(256 * np.array([x[1] for x in kept])).astype(np.int64)
    want = np.ascontiguousarray(vectors[:10].reshape(10, 4, 8).transpose(1, 0, 2))
    for _ in range(2):
        want = refined(vectors, want)
    assert (books == want).all()
    codes, errors = brute(vectors, want)
    total = {}
    for x, e in zip(kept, errors):
        total[x[2]] = total.get(x[2], 0) + int(e)
    expected = [(x[0], x[2], c.tolist(), int(e), total[x[2]]) for x, c, e in zip(kept, codes, errors)]
    expected += [(500 + k, 1, None, None, total[1]) for k, v in enumerate(bad) if v in ([], [1.0] * 16, [1.0] * 5)]
    assert sorted(map(repr, expected)) == sorted(repr((x.vec_id, x.label, x.codes, x.error, x.label_error)) for x in got)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    blocks, books = vector_codes.trained(df)
    assert vector_codes.with_label_error(vector_codes.encode(blocks, books)).count() == 0
    assert books.size == 0
