"""Alignment of two tokenizers over the bytes of each text, by interval coalescing.

All tokens of both tokenizers are intervals on one byte axis.  They are lexsorted
by start; where a start reaches the running maximum of the ends, nothing earlier
reaches over and a group begins.  Overlaps are expanded inside the groups, as the
pairs (links) of an A and a B token that share a byte.

Link counts over the corpus come from blocks of texts: a block brings each of its
distinct id pairs once to the shuffle, with its number of links, and gets the
corpus count of each back.  What a pair costs is the number of blocks, and a task
holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructType

from strandline.llm.piece_codec import SPACE, codec
from strandline.llm.shared import stage
from strandline.llm.token_units import chunks, encoder

#: Characters of a block; an empty text counts as ROW.
BLOCK_CHARS, ROW = 4_000_000, 40
#: Tokens that are sorted at once; longer texts are cut where tokens of both sides end.
AT_ONCE = 1_000_000
#: Longer texts are encoded word by word instead of by the library as a whole.
LONG_TEXT = 200_000

_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}


def _byte_level() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """A: a byte-level vocabulary applied to space + text.  B: a piece model, which adds the space itself."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b_path = encoder(a_path), b_path
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names, byte = Tokenizer.from_file(a_path), _byte_level()
        entries = [names.id_to_token(i) or "" for i in range(names.get_vocab_size())]
        self.a_bytes = [bytes(byte[c] for c in e) if all(c in byte for c in e) else e.encode() for e in entries]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # Ids as text with what may follow: A in a group, A at its end, B in a group, B at its end.
        self.words = np.array(
            [f"{i}{sep}" for n, seps in ((self.n_a, ",|"), (self.n_b, ",;")) for sep in seps for i in range(n)], dtype=object
        )

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids of A and B; none if the text is empty or the bytes of either side are not those of space + text."""
        full = [t for t in texts if t]
        short = [t for t in full if len(t) <= LONG_TEXT]
        a_ids = iter(self.a.encode([" " + t for t in full]))
        b_ids = iter(self.b.encode(short, num_threads=1))
        nothing = np.zeros(0, np.int64)
        out = []
        for t in texts:
            if not t:
                out.append((nothing, nothing))
                continue
            a = np.frombuffer(next(a_ids), "<u4").astype(np.int64)
            if len(t) <= LONG_TEXT:
                b = np.array(next(b_ids), dtype=np.int64)
            else:
                b = np.frombuffer(codec(self.b_path).encode([t])[0], np.int32).astype(np.int64)
            raw = b" " + t.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw
            same = same and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
            out.append((a, b) if same else (nothing, nothing))
        return out

    def parts(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The text itself, or stretches of about AT_ONCE tokens that end where both sides end."""
        if len(a) + len(b) <= AT_ONCE:
            yield a, b
            return
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        step = len(both) // ((len(a) + len(b)) // AT_ONCE + 1) + 1
        cuts = np.append(both[step - 1 : -1 : step], both[-1])
        at = bt = 0
        for x, y in zip(np.searchsorted(a_end, cuts) + 1, np.searchsorted(b_end, cuts) + 1):
            yield a[at:x], b[bt:y]
            at, bt = x, y

    def coalesce(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per part the number of groups and the groups as text; and all links as (part, id of A * n_b + id of B)."""
        a, b = (np.concatenate(x) for x in zip(*parts))
        many_a, many_b = (np.array([len(p[k]) for p in parts]) for k in (0, 1))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
        start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
        of_b = np.repeat([False, True], [len(a), len(b)])
        order = np.lexsort((of_b, start))
        reach = np.maximum.accumulate(end[order])
        begins = np.ones(len(order), bool)
        begins[1:] = start[order][1:] >= reach[:-1]
        group = np.cumsum(begins) - 1
        of_b = of_b[order]
        a_group, b_group = group[~of_b], group[of_b]

        # groups as text: A tokens of each group, then its B tokens
        n = int(group[-1]) + 1
        a_upto, b_upto = (np.cumsum(np.bincount(g, minlength=n)) for g in (a_group, b_group))
        line = np.empty(len(order), np.int64)
        a_last, b_last = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
        line[np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group]] = a + self.n_a * a_last
        line[np.arange(len(b)) + a_upto[b_group]] = 2 * self.n_a + b + self.n_b * b_last
        pieces = self.words[line].tolist()
        bounds = np.concatenate([[0], np.cumsum(many_a + many_b)])
        texts = ["".join(pieces[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        a_bounds = np.concatenate([[0], np.cumsum(many_a)])
        groups = np.diff(np.append(a_group, n)[a_bounds])

        # links: every A token with the B tokens from the one that holds its first byte to the one that holds its last
        low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        many = high - low
        left = np.repeat(np.arange(len(a)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many - low, many)
        part = np.repeat(np.arange(len(parts)), many_a)[left]
        return groups, texts, part, a[left] * self.n_b + b[right]

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text: tokens of A and of B, groups, links, groups as text, and its id pairs (A << 32 | B) with their links."""
        found = [[0, 0, 0, 0, [], [], []] for _ in texts]
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

        def settle() -> None:
            groups, lines, part, pair = self.coalesce([w[1:] for w in waiting])
            bits = (self.n_a * self.n_b).bit_length()
            both, times = np.unique(part << bits | pair, return_counts=True)
            edges = np.searchsorted(both, np.arange(len(waiting) + 1) << bits)
            both &= (1 << bits) - 1
            pairs = both // self.n_b << 32 | both % self.n_b
            for k, (i, a, b) in enumerate(waiting):
                cut = slice(edges[k], edges[k + 1])
                mine = found[i]
                for slot, n in enumerate((len(a), len(b), int(groups[k]), int(times[cut].sum()))):
                    mine[slot] += n
                mine[4].append(lines[k])
                mine[5].append(pairs[cut])
                mine[6].append(times[cut])
            waiting.clear()

        held = 0
        for i, (a, b) in enumerate(self.encode(texts)):
            if not len(a):
                continue
            for x, y in self.parts(a, b):
                waiting.append((i, x, y))
                held += len(x) + len(y)
                if held >= AT_ONCE:
                    settle()
                    held = 0
        if waiting:
            settle()
        for n_a, n_b, n_groups, n_links, lines, pairs, times in found:
            yield n_a, n_b, n_groups, n_links, "".join(lines)[:-1], *summed(pairs, times)


def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their times."""
    if len(keys) == 1:
        return keys[0], times[0]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, at, np.concatenate(times))
    return found, out


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _schema(id_kind: DataType, id_col: str) -> StructType:
    schema = StructType().add(id_col, id_kind).add("block", LongType())
    for name in _NUMBERS:
        schema = schema.add(name, LongType())
    return schema.add("groups", StringType()).add("pairs", ArrayType(LongType())).add("times", ArrayType(LongType()))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A staged table with a row for every text, and one for every block of texts.

    Rows of texts: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``
    (``a1,a2|b1;a3|b2,b3``: ids in order), and their distinct id pairs (``pairs``, A << 32 | B)
    with the links of each (``times``).  Rows of blocks have NULL ``groups`` and hold the
    pairs of all their texts.

    A text that is NULL, empty or not given back byte by byte by both tokenizers has no
    tokens: zeros and empty ``groups``.  Ids may be NULL or repeat; every row
    is aligned for itself.  Long texts are cut where tokens of both sides end.  Other
    columns are not looked at.  An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    schema = _schema(rows.schema["__id"].dataType, id_col)
    names, id_kind = schema.names, None

    def run(batches):
        nonlocal id_kind
        own = aligner(a_path, b_path)
        first = TaskContext.get().partitionId() << 32
        block, weight, pairs, times = first, 0, [], []

        def batch_of(ids, found: list[tuple], groups: list) -> pa.RecordBatch:
            n = len(found)
            columns = [ids, pa.array([block] * n, pa.int64())]
            columns += [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            columns += [pa.array(groups, pa.string()), _lists([f[5] for f in found]), _lists([f[6] for f in found])]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def close() -> pa.RecordBatch:
            keys, n = summed(pairs, times)
            pairs.clear()
            times.clear()
            return batch_of(pa.nulls(1, id_kind), [(0, 0, 0, int(n.sum()), None, keys, n)], [None])

        for batch in batches:
            ids, id_kind, at = batch.column("__id"), batch.column("__id").type, 0
            for part in chunks([t or "" for t in batch.column("__text").to_pylist()]):
                found = list(own.align(part))
                yield batch_of(ids.slice(at, len(part)), found, [f[4] for f in found])
                at += len(part)
                keys, n = summed([f[5] for f in found], [f[6] for f in found])
                pairs.append(keys)
                times.append(n)
                weight += sum(map(len, part)) + ROW * len(part)
                if weight >= BLOCK_CHARS:
                    yield close()
                    block, weight = block + 1, 0
        if pairs:
            yield close()

    return stage(rows.mapInArrow(run, schema), "aligned")


def link_counts(alignment: DataFrame) -> DataFrame:
    """Per id pair: ``pair``, ``a_id``, ``b_id``, its links in the corpus, and whether no A id has more links with this B id."""
    pairs = _pairs(alignment).groupBy("pair").agg(F.sum("times").alias("links"))
    ids = {"a_id": F.shiftright("pair", 32), "b_id": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))}
    counts = stage(pairs.withColumns(ids), "pair-links")
    # One row for each id of B: as many as its vocabulary has, whatever the corpus.
    highest = counts.groupBy("b_id").agg(F.max("links").alias("highest"))
    best = (F.col("links") == F.col("highest")).alias("best")
    return counts.join(F.broadcast(highest), "b_id").select("pair", "a_id", "b_id", "links", best)


def _pairs(alignment: DataFrame) -> DataFrame:
    """Block, pair and its links in the block."""
    zipped = F.explode(F.arrays_zip("pairs", "times")).alias("p")
    return alignment.filter("groups is null").select("block", zipped).select("block", F.col("p.pairs").alias("pair"), "p.times")


def count_links(alignment: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """Rows of texts with ``n_best`` (links whose pair has the most links of its B id) and ``count_sum``
    (over all links, the corpus-wide links of their pair).

    ``keep``: the columns to return beside them; by default all but the block and the pairs.
    """
    inner = ["block", "pairs", "times"]
    texts = alignment.filter("groups is not null")
    keep = keep or {c: F.col(c) for c in alignment.columns if c not in inner}
    left = texts.select(*inner, *[v.alias(k) for k, v in keep.items()])
    known = _pairs(alignment).drop("times").join(link_counts(alignment).select("pair", "links", "best"), "pair")
    known = known.select(F.col("block").alias("of"), "pair", "links", "best")
    names = list(keep)
    schema = left.select(*names).schema.add("n_best", "long").add("count_sum", "long")

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        pair, links = known["pair"].to_numpy(), known["links"].to_numpy()
        best = known["best"].to_numpy().astype(np.int64)
        order = np.argsort(pair)
        lists = texts["pairs"].combine_chunks()
        offsets = lists.value_lengths().to_numpy(zero_copy_only=False)
        at = order[np.searchsorted(pair, lists.flatten().to_numpy(zero_copy_only=False), sorter=order)]
        times = texts["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.cumsum(offsets)])
        out = texts.select(names)
        for name, value in (("n_best", times * best[at]), ("count_sum", times * links[at])):
            upto = np.concatenate([[0], np.cumsum(value)])
            out = out.append_column(name, pa.array(upto[edges[1:]] - upto[edges[:-1]], pa.int64()))
        return out

    return left.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, schema)
