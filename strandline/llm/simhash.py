"""SimHash near duplicates by vantage-point trees over Hamming distance.

Equal fingerprints collapse to one class first.  The 64 bits are cut into three
segments; two fingerprints that differ in at most r bits differ in at most
r // 3 bits of some segment.  Each segment has a vantage-point tree over its own
Hamming distance (a pseudo-metric of the whole fingerprint, so the triangle
inequality holds).  A fingerprint is stored in the one shard that the tree leads
to, and queries every shard that its ball of radius r // 3 overlaps; branches
outside the triangle bounds are pruned.  A shard compares full fingerprints
exactly and reduces its links to stars, so that a dense group of n fingerprints
leaves n links and not their pairs.  Components join the stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.llm.exact_dedup import drop_rows
from strandline.llm.shared import sampled, stage, text_of

SEED = 42
WORDS = 4
RADIUS = 4
#: Fingerprints a shard should hold; sets the depth of the trees.
SHARD = 1500
#: Deepest tree: 2^14 - 1 vantage points a segment, sent to every task.
DEPTH = 14
#: Fingerprints sampled for each shard to choose vantage points; at most 2^19 in all.
SAMPLE = 32
#: Queries compared at once inside a shard.
BLOCK = 512

SEGMENTS = [np.uint64(((1 << 22) - 1) << 42), np.uint64(((1 << 21) - 1) << 21), np.uint64((1 << 21) - 1)]


# -- fingerprints ---------------------------------------------------------------
def fingerprint(text: str, words: int = WORDS) -> int:
    """Bitwise majority of the XXH64 of all word shingles; A-Z lower-cased, ASCII white space between words."""
    import xxhash

    cut = text.encode().lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not cut:
        return 0
    joined = b" ".join(cut)
    if len(cut) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, cut), np.int64, len(cut)) + 1
        end = np.cumsum(size)
        start = end - size
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(start[: len(cut) - words + 1].tolist(), (end[words - 1 :] - 1).tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at : at + 8192], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id, text_hash and fp (the 64 bits as a signed long) of every row; NULL text counts as empty, whose fp is 0."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(found.view(np.int64))],
                names=["id", "text_hash", "fp"],
            )

    schema = rows.select("id", "text_hash").schema.add("fp", "long")
    return rows.mapInArrow(run, schema)


# -- trees ----------------------------------------------------------------------
def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def build(sample: np.ndarray, depth: int, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and inner radii of a tree in heap order."""
    nodes = (1 << depth) - 1
    points, radii = np.zeros(nodes, dtype=np.uint64), np.zeros(nodes, dtype=np.int16)
    random = np.random.default_rng(SEED)
    held: list[np.ndarray | None] = [None] * (2 * nodes + 1)
    held[0] = sample
    for node in range(nodes):
        own = held[node]
        held[node] = None
        if len(own) == 0:
            points[node], radii[node] = random.integers(0, 1 << 64, dtype=np.uint64), 10
        else:
            # of a few candidates the one whose inner radius splits most evenly
            best = None
            for point in random.choice(own, size=min(4, len(own)), replace=False):
                d = distance(own & mask, point & mask)
                radius = int(np.median(d))
                for r in (radius - 1, radius):
                    skew = abs(int((d <= r).sum()) * 2 - len(own))
                    if best is None or skew < best[0]:
                        best = (skew, point, r)
            points[node], radii[node] = best[1], best[2]
        inner = distance(own & mask, points[node] & mask) <= radii[node]
        held[2 * node + 1], held[2 * node + 2] = own[inner], own[~inner]
    return points, radii


def home(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, mask: np.uint64) -> np.ndarray:
    points, radii = tree
    node = np.zeros(len(fps), dtype=np.int64)
    for _ in range(depth):
        outer = distance(fps & mask, points[node] & mask) > radii[node]
        node = 2 * node + 1 + outer
    return node - ((1 << depth) - 1)


def overlaps(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, mask: np.uint64, r: int):
    """(row, leaf) for every leaf that may hold a point within r of the row."""
    points, radii = tree
    row, node = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
    for _ in range(depth):
        d = distance(fps[row] & mask, points[node] & mask).astype(np.int16)
        inner, outer = d - r <= radii[node], d + r > radii[node]
        row, node = np.concatenate([row[inner], row[outer]]), np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
    return row, node - ((1 << depth) - 1)


# -- links inside shards ----------------------------------------------------------
class Stars:
    """Links of one shard, merged to one star per connected set."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up.setdefault(p, p)
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def compare(members: np.ndarray, queries: np.ndarray, radius: int, stars: Stars) -> None:
    """Link every query to the members within the radius: to its first, and each of these to the next."""
    for at in range(0, len(queries), BLOCK):
        block = queries[at : at + BLOCK]
        for m_at in range(0, len(members), 1 << 16):
            part = members[m_at : m_at + (1 << 16)]
            q, m = np.nonzero(distance(block[:, None], part[None, :]) <= radius)
            if not len(q):
                continue
            first = np.r_[True, q[1:] != q[:-1]]
            a = np.where(first, block[q], part[np.r_[0, m[:-1]]])
            pairs = np.unique(np.stack([a, part[m]], axis=1), axis=0)
            for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
                stars.link(x, y)


def near(classes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (u, v: long) that connect all fingerprints ``fp`` within ``radius`` bits; ``fp`` must be distinct."""
    spark = classes.sparkSession
    n = classes.count()
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, n / shard))))))
    want = SAMPLE << depth
    sample = sampled(classes.select("fp"), F.col("fp"), want, n)
    points = np.array([r.fp for r in sample.collect()], dtype=np.int64).view(np.uint64)
    points = np.sort(points)
    r = radius // len(SEGMENTS)
    trees = spark.sparkContext.broadcast([build(points, depth, m) for m in SEGMENTS])

    def spread(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                for k, mask in enumerate(SEGMENTS):
                    base = k << DEPTH
                    own = home(part, trees.value[k], depth, mask) + base
                    row, leaf = overlaps(part, trees.value[k], depth, mask, r)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([own, leaf + base]).astype(np.int32)),
                            pa.array(np.concatenate([np.zeros(len(own), bool), np.ones(len(row), bool)])),
                            pa.array(np.concatenate([part, part[row]]).view(np.int64)),
                        ],
                        names=["shard", "asks", "fp"],
                    )

    def search(batches):
        shard_now, members, sealed = None, [], None
        stars = Stars()

        def closing():
            pairs = stars.links()
            a = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["u", "v"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(fps)]):
                if a == b:
                    continue
                if shards[a] != shard_now:
                    if stars.up:
                        yield closing()
                    shard_now, members, sealed, stars = shards[a], [], None, Stars()
                if not asks[a]:
                    members.append(fps[a:b])
                    continue
                if sealed is None:
                    sealed = np.sort(np.concatenate(members)) if members else np.zeros(0, np.uint64)
                compare(sealed, fps[a:b], radius, stars)
        if stars.up:
            yield closing()

    spread_rows = classes.select("fp").mapInArrow(spread, "shard int, asks boolean, fp long")
    dealt = spread_rows.repartition("shard").sortWithinPartitions("shard", "asks")
    return dealt.mapInArrow(search, "u long, v long")


def cluster(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """One row per row: id, fp (long), component: the smallest id reachable over links of at most ``radius`` bits.

    Also text_hash, and kept: true for the component's row that stays (smallest id,
    then text hash; rows that repeat both stay together).  NULL text counts as empty;
    empty texts share fingerprint 0 and link like any other.  A NULL id is larger
    than all others.  An empty table gives an empty result.
    """
    rows = stage(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("least")), "classes")
    roots = components(near(classes, radius))
    of = classes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of = stage(of, "roots")
    least = of.groupBy("root").agg(F.min("least").alias("first"))
    named = stage(of.select("fp", "root").join(least, "root").select("fp", "first"), "named")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), "text_hash", "fp", F.col("first.id").alias("component"), kept.alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the kept row of each component (see ``cluster``)."""
    gone = stage(cluster(docs, id_col, text_col).filter("not kept").select(id_col, "text_hash"), "near-gone")
    named = docs.withColumn("__hash", F.xxhash64(text_of(text_col)))
    left = drop_rows(named, gone.withColumnRenamed("text_hash", "__hash"), id_col, [id_col, "__hash"])
    return left.select(*docs.columns)
