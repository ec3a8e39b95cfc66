"""Vector codes by codebooks per part, refined with metric trees (anchors hierarchies) over the parts.

Vectors become integers and are cut into equal parts.  A block of vectors holds one
tree for each part position.  Trees are built middle-out: about the root of
n anchors claim the points of a ball (a new anchor is the point farthest from its
anchor, and takes only points that the triangle bound lets it take), anchors are
merged pair by pair into the upper balls, and each anchor's ball is split in
the same way below.  Every ball caches its number of points and their sum.

A round walks all trees of a block at once, level by level.  A ball inherits the
list of codebook entries that may be nearest to a point of its parent, drops those
that the triangle bound rules out, and ends the walk when one is left: then
its cached sum and count go to that entry as a whole.  Only points of leaves with
several entries left are compared one by one, in integers.

The trees are built once and written; a round reads them, and brings one sum for each
entry and task to the shuffle.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from strandline.llm.shared import stage
from strandline.operators.joins import lookup_join

#: Steps of an integer in a unit of a component.
SCALE = 256
#: Vectors in a block, and points in a ball that is not split.
BLOCK, LEAF = 4096, 12
#: Largest integer of a component: squared distances must stay exact.
LARGEST = 1 << 26
#: Pairs of points and entries that are compared at once.
PAIRS = 1 << 20


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., starts[1], ...: all positions of the ranges in a row."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=-1))


class Balls:
    """The trees of one block, all part positions together; tree p has its root in node p."""

    FIELDS = ("points", "row", "left", "right", "start", "count", "sums", "radius")

    def __init__(self, **fields: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, fields[name])
        self.center = self.sums / self.count[:, None]

    @classmethod
    def build(cls, vectors: np.ndarray, parts: int) -> "Balls":
        """``vectors``: rows of integers whose number is a multiple of ``parts``."""
        n = len(vectors)
        width = vectors.shape[1] // parts
        points = vectors.reshape(n, parts, width).transpose(1, 0, 2).reshape(n * parts, width).astype(np.float64)
        room = parts + 4 * len(points)
        tree = cls.__new__(cls)
        tree.points, tree.row, tree.used = points, np.arange(n * parts), parts
        tree.left, tree.right = np.full((2, room), -1)
        tree.start, tree.count = np.zeros((2, room), np.int64)
        tree.sums, tree.radius, tree.center = np.zeros((room, width)), np.zeros(room), np.zeros((room, width))
        tree.start[:parts], tree.count[:parts] = np.arange(parts) * n, n
        tree._measure(np.arange(parts))
        open_balls = np.arange(parts)
        while len(open_balls := open_balls[(tree.count[open_balls] > LEAF) & (tree.radius[open_balls] > 0)]):
            anchors = 1 << np.round(np.log2(tree.count[open_balls]) / 2).astype(int)
            open_balls = np.concatenate([tree._split(open_balls[anchors == k], int(k)) for k in np.unique(anchors)])
        for name in ("left", "right", "start", "count", "sums", "radius", "center"):
            setattr(tree, name, getattr(tree, name)[: tree.used].copy())
        return tree

    def _measure(self, nodes: np.ndarray) -> None:
        """Sum, center and radius of balls that hold their points in one range."""
        sizes = self.count[nodes]
        inside, begin = self.points[self.row[_ranges(self.start[nodes], sizes)]], _offsets(sizes)
        self.sums[nodes] = np.add.reduceat(inside, begin)
        self.center[nodes] = self.sums[nodes] / sizes[:, None]
        far = _length(inside - np.repeat(self.center[nodes], sizes, axis=0))
        self.radius[nodes] = np.maximum.reduceat(far, begin)

    def _split(self, balls: np.ndarray, k: int) -> np.ndarray:
        """Split balls by ``k`` anchors each and merge those upwards; returns the anchors' balls."""
        sizes = self.count[balls]
        begin, places = _offsets(sizes), _ranges(self.start[balls], sizes)
        which = np.repeat(np.arange(len(balls)), sizes)
        rows = self.row[places]
        mine = self.points[rows]
        anchors = np.empty((len(balls), k, mine.shape[1]))
        anchors[:, 0] = mine[begin]
        owner = np.zeros(len(mine), np.int64)
        near = _length(mine - anchors[which, 0])
        for i in range(1, k):
            far = np.flatnonzero(near == np.repeat(np.maximum.reduceat(near, begin), sizes))
            at = np.empty(len(balls), np.int64)
            at[which[far[::-1]]] = far[::-1]
            new = anchors[:, i] = mine[at]
            # A point nearer to its anchor than half the way between the anchors stays.
            half = _length(anchors[:, :i] - new[:, None]) / 2
            open_to = np.flatnonzero(near > half[which, owner])
            there = _length(mine[open_to] - new[which[open_to]])
            won = there < near[open_to]
            taken = open_to[won]
            owner[taken], near[taken] = i, there[won]
        key = which * k + owner
        order = np.argsort(key, kind="stable")
        self.row[places] = rows[order]
        found, first, counts = np.unique(key[order], return_index=True, return_counts=True)
        nodes = np.arange(self.used, self.used + len(found))
        self.used += len(found)
        self.start[nodes], self.count[nodes] = places[first], counts
        self._measure(nodes)
        slots = np.full((len(balls), k), -1)
        slots[found // k, found % k] = nodes
        self._merge(balls, slots)
        return nodes

    def _merge(self, balls: np.ndarray, slots: np.ndarray) -> None:
        """Join the two balls of a group that make the smallest ball, until the group's own is made."""
        groups, k = slots.shape
        alive = slots >= 0
        center, radius = self.center[slots], self.radius[slots]
        size = _length(center[:, :, None] - center[:, None]) + radius[:, :, None] + radius[:, None]
        size[~(alive[:, :, None] & alive[:, None])] = np.inf
        size[:, np.arange(k), np.arange(k)] = np.inf
        many = alive.sum(axis=1)
        for _ in range(k - 1):
            g = np.flatnonzero(many > 1)
            if not len(g):
                return
            i, j = np.divmod(size[g].reshape(len(g), -1).argmin(axis=1), k)
            a, b = slots[g, i], slots[g, j]
            last = many[g] == 2
            up = balls[g].copy()
            up[~last] = np.arange(self.used, self.used + int((~last).sum()))
            self.used += int((~last).sum())
            self.left[up], self.right[up] = a, b
            new = up[~last]
            x, y = a[~last], b[~last]
            self.count[new] = self.count[x] + self.count[y]
            self.sums[new] = self.sums[x] + self.sums[y]
            self.center[new] = self.sums[new] / self.count[new, None]
            self.radius[new] = np.maximum(
                _length(self.center[new] - self.center[x]) + self.radius[x], _length(self.center[new] - self.center[y]) + self.radius[y]
            )
            slots[g, i] = up
            alive[g, j] = False
            many[g] -= 1
            to = _length(self.center[slots[g]] - self.center[up][:, None]) + self.radius[slots[g]] + self.radius[up][:, None]
            to[~alive[g]] = np.inf
            to[np.arange(len(g)), i] = np.inf
            size[g, i], size[g, :, i] = to, to
            size[g, j], size[g, :, j] = np.inf, np.inf

    # -- as bytes -------------------------------------------------------------
    def dump(self) -> bytes:
        out = io.BytesIO()
        kinds = {"sums": np.int64, "radius": np.float64}
        np.savez(out, **{f: getattr(self, f).astype(kinds.get(f, np.int32)) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> "Balls":
        with np.load(io.BytesIO(raw)) as fields:
            return cls(**{f: fields[f] for f in cls.FIELDS})

    # -- a round --------------------------------------------------------------
    def walk(self, books: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], list[tuple[np.ndarray, np.ndarray]]]:
        """Balls with their part position and one entry, and single points (places in ``row``) with theirs.

        ``books``: entries of each part position.  Ties go to the lower entry.
        """
        parts, k, _ = books.shape
        entries = books.astype(np.float64)
        owned, single = [], []
        # Of equal entries only the first can be nearest.
        lists = [np.sort(np.unique(b, axis=0, return_index=True)[1]) for b in books]
        nodes = part = np.arange(parts)
        sizes, options = np.array([len(x) for x in lists]), np.concatenate(lists)
        while len(nodes):
            begin = _offsets(sizes)
            away = _length(np.repeat(self.center[nodes], sizes, axis=0) - entries[np.repeat(part, sizes), options])
            reach = np.minimum.reduceat(away, begin) + 2 * self.radius[nodes]
            keep = away <= np.repeat(reach + 1e-9 * (1 + reach), sizes)
            sizes, options = np.add.reduceat(keep, begin), options[keep]
            begin = _offsets(sizes)
            one, leaf = sizes == 1, self.left[nodes] < 0
            owned.append((nodes[one], part[one], options[begin[one]]))
            if len(rest := np.flatnonzero(leaf & ~one)):
                single += self._compare(books, nodes[rest], part[rest], begin[rest], sizes[rest], options)
            down = np.flatnonzero(~one & ~leaf)
            nodes, part = np.concatenate([self.left[nodes[down]], self.right[nodes[down]]]), np.tile(part[down], 2)
            options = np.tile(options[_ranges(begin[down], sizes[down])], 2)
            sizes = np.tile(sizes[down], 2)
        return owned, single

    def _compare(self, books, nodes, part, begin, sizes, options) -> list[tuple[np.ndarray, np.ndarray]]:
        """Every point of some leaves with every entry left, in batches of about PAIRS."""
        places = _ranges(self.start[nodes], self.count[nodes])
        leaf = np.repeat(np.arange(len(nodes)), self.count[nodes])
        many = sizes[leaf]
        batch = np.cumsum(many) // PAIRS
        out = []
        for cut in np.split(np.arange(len(places)), np.flatnonzero(np.diff(batch)) + 1):
            at, n = leaf[cut], many[cut]
            entry = options[_ranges(begin[at], n)]
            point = np.repeat(self.points[self.row[places[cut]]].astype(np.int64), n, axis=0)
            squared = ((point - books[np.repeat(part[at], n), entry]) ** 2).sum(axis=1)
            least = np.flatnonzero(squared == np.repeat(np.minimum.reduceat(squared, _offsets(n)), n))
            of = np.repeat(np.arange(len(cut)), n)[least]
            chosen = np.empty(len(cut), np.int64)
            chosen[of[::-1]] = entry[least[::-1]]
            out.append((places[cut], chosen))
        return out

    def totals(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the points of every entry: (parts, entries) and (parts, entries, width)."""
        parts, k, width = books.shape
        n, sums = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        per = self.count[0]
        owned, single = self.walk(books)
        for nodes, part, entry in owned:
            key = part * k + entry
            np.add.at(n, key, self.count[nodes])
            np.add.at(sums, key, self.sums[nodes].astype(np.int64))
        for places, entry in single:
            rows = self.row[places]
            key = rows // per * k + entry
            np.add.at(n, key, 1)
            np.add.at(sums, key, self.points[rows].astype(np.int64))
        return n.reshape(parts, k), sums.reshape(parts, k, width)

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every part (vectors, parts), and the squared distance of every vector to its entries."""
        parts, per = len(books), int(self.count[0])
        code = np.empty(len(self.points), np.int64)
        owned, single = self.walk(books)
        for nodes, _, entry in owned:
            while len(nodes):  # down to the balls that hold their points
                leaf = self.left[nodes] < 0
                places = _ranges(self.start[nodes[leaf]], self.count[nodes[leaf]])
                code[self.row[places]] = np.repeat(entry[leaf], self.count[nodes[leaf]])
                nodes, entry = (
                    np.concatenate([self.left[nodes[~leaf]], self.right[nodes[~leaf]]]),
                    np.tile(entry[~leaf], 2),
                )
        for places, entry in single:
            code[self.row[places]] = entry
        away = self.points.astype(np.int64) - books[np.repeat(np.arange(parts), per), code]
        errors = (away * away).sum(axis=1).reshape(parts, per).sum(axis=0)
        return code.reshape(parts, per).T, errors


def trained(
    vectors: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """Staged blocks of vectors with their trees, and the codebooks (parts, entries, width of a part).

    Components become floor(256 * x).  Left out: vectors that are NULL or hold NULL or
    non-finite components.  The codebooks start as the parts of the vectors with the ``entries`` smallest ids
    (NULL ids last, equal ids by vector) among those whose length is that of the first with a positive multiple
    of ``parts``; vectors of another length stay without a code.  With fewer vectors there
    are fewer entries.  ``rounds``: every part goes to its nearest entry (ties to the lower), then entries become the
    floored mean of their parts; unused ones stay.  Components beyond ``LARGEST`` / 256 are an error.
    """
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = (
        vectors.select(
            F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
        )
        .filter("vector is not null")
        .filter(~odd)
    )
    by = [F.col("id").asc_nulls_last(), F.col("vector")]
    head = valid.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0)).orderBy(*by).limit(1).collect()
    dim = len(head[0].vector) if head else 0
    coded = (F.size("vector") == dim) & F.lit(dim > 0)
    firsts = [r.vector for r in valid.filter(coded).orderBy(*by).limit(entries).collect()]
    width = dim // parts
    books = np.floor(SCALE * np.array(firsts, dtype=np.float64).reshape(len(firsts), parts, width)).astype(np.int64)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))

    rows = valid.select("id", "label", F.when(coded, F.col("vector")).alias("vector"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = StructType().add("ids", ArrayType(kinds["id"])).add("labels", ArrayType(kinds["label"])).add("tree", "binary")

    def run(batches):
        def block(parts_of: list[tuple[pa.Array, pa.Array, np.ndarray | None]], tree: bytes | None) -> pa.RecordBatch:
            def listed(k: int) -> pa.Array:
                values = pa.concat_arrays([p[k] for p in parts_of])
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

            return pa.RecordBatch.from_arrays([listed(0), listed(1), pa.array([tree], pa.binary())], names=["ids", "labels", "tree"])

        waiting, held = [], 0
        for batch in batches:
            vector = batch.column("vector")
            there = vector.is_valid()
            if not (bare := batch.filter(pa.compute.invert(there))).num_rows == 0:
                yield block([(bare.column("id"), bare.column("label"), None)], None)
            full = batch.filter(there)
            if full.num_rows:
                flat = full.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                whole = np.floor(SCALE * flat)
                if np.abs(whole).max() > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST // SCALE}")
                waiting.append((full.column("id"), full.column("label"), whole.astype(np.int64)))
                held += full.num_rows
            if held >= BLOCK:
                yield block(waiting, Balls.build(np.concatenate([w[2] for w in waiting]), parts).dump())
                waiting, held = [], 0
        if waiting:
            yield block(waiting, Balls.build(np.concatenate([w[2] for w in waiting]), parts).dump())

    blocks = stage(rows.mapInArrow(run, schema), "balls")
    if books.size:
        for _ in range(rounds):
            books = _refined(blocks, books)
    return blocks, books


def _refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; parts x entries rows come to the driver."""
    parts, k, width = books.shape
    schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(width))

    def run(batches):
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            for raw in batch.column("tree"):
                more, add = Balls.load(raw.as_py()).totals(books)
                n += more
                sums += add
        part, entry = np.nonzero(n)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry])]
        columns += [pa.array(sums[part, entry, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    found = blocks.filter("tree is not null").select("tree").mapInArrow(run, schema).groupBy("part", "entry")
    out = books.copy()
    for r in found.agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).collect():
        out[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def encode(blocks: DataFrame, books: np.ndarray, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """One row per vector: id, label, codes (array of int, one per part) and error (squared distance to its entries, in
    integer steps); both are NULL for vectors of another length."""
    kinds = {f.name: f.dataType.elementType for f in blocks.schema.fields if f.name != "tree"}
    schema = StructType().add(id_col, kinds["ids"]).add(label_col, kinds["labels"]).add("codes", ArrayType(IntegerType())).add("error", "long")

    def run(batches):
        for batch in batches:
            for k, raw in enumerate(batch.column("tree")):
                ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
                if raw.is_valid:
                    found, errors = Balls.load(raw.as_py()).codes(books)
                    edges = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                    codes = pa.ListArray.from_arrays(pa.array(edges), pa.array(found.astype(np.int32).ravel()))
                    errors = pa.array(errors)
                else:
                    codes, errors = pa.nulls(len(ids), pa.list_(pa.int32())), pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, labels, codes, errors], names=[id_col, label_col, "codes", "error"])

    return blocks.mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the sum of errors of its label; NULL labels are one label."""
    coded = stage(coded, "coded")
    sums = coded.groupBy(label_col).agg(F.sum("error").alias("label_error"))
    return lookup_join(coded, sums, label_col, null_safe=True)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same with every part compared with every entry."""
    assign = """a{i} AS MATERIALIZED (
      SELECT r, p, v, e, d FROM (
        SELECT q.r, q.p, q.v, c.e, list_sum(list_transform(range(1, len(q.v) + 1), lambda j: (q.v[j] - c.v[j]) * (q.v[j] - c.v[j])))::BIGINT AS d
        FROM part q JOIN c{i} c ON q.p = c.p)
      QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)"""
    update = """m{i} AS (
      SELECT p, e, list(m ORDER BY j) AS v FROM (
        SELECT p, e, j, floor(sum(v[j])::DOUBLE / count(*))::BIGINT AS m FROM a{h}, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY p, e, j)
      GROUP BY p, e),
    c{i} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{h} c LEFT JOIN m{i} m ON c.p = m.p AND c.e = m.e)"""
    steps = [assign.format(i=0)]
    for i in range(1, rounds + 1):
        steps += [update.format(i=i, h=i - 1), assign.format(i=i)]
    return f"""WITH kept AS (
      SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
      FROM embeddings WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    part AS MATERIALIZED (
      SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p)),
    c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM part WHERE r <= {entries}),
    {", ".join(steps)},
    coded AS (SELECT r, string_agg(lpad(hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
    book AS (SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS s FROM (SELECT p, e, array_to_string(v, ',') AS x FROM c{rounds}))
    SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256
    FROM kept JOIN coded USING (r), book"""
