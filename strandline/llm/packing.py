"""Bounded-space online packing of token sequences.

Each partition cuts full sequences off its documents and places what is left of
each document best-fit into one of a fixed number of open windows; when none
fits, the fullest is emitted and a new one opened.  The windows open at the end
are merged across partitions in rounds of bounded groups.  Token ids are written
once, where they were made; merging moves only window numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import stage, text_of
from strandline.llm.token_units import ENCODER_CHARS, chunks, encoder

CAPACITY = 2048
OPEN_WINDOWS = 64
#: Partitions whose leftover windows one task merges in a round.
FAN_IN = 64

_ROWS = "window long, used long, doc_id long, start long, length long, doc_tokens long, offset long, ids binary"
_MOVES = "window long, target long, shift long, used long, open boolean"


class Windows:
    """A fixed number of open windows, placed best-fit."""

    def __init__(self, capacity: int, most: int, first: int):
        self.capacity, self.most, self.next = capacity, most, first
        self.used: dict[int, int] = {}

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset for a piece of at most the capacity."""
        room = self.capacity - length
        fits = [(u, -w) for w, u in self.used.items() if u <= room]
        if fits:
            at, w = max(fits)
            w = -w
        else:
            if len(self.used) >= self.most:
                del self.used[max(self.used.items(), key=lambda x: (x[1], -x[0]))[0]]
            at, w = 0, self.fresh()
        self.used[w] = at + length
        if self.used[w] == self.capacity:
            del self.used[w]
        return w, at


def _pack_partition(tokenizer: str, end_id: int, capacity: int, most: int):
    def run(batches):
        windows = Windows(capacity, most, TaskContext.get().partitionId() << 32)
        tail = np.array([end_id], dtype="<u4").tobytes()
        codec = encoder(tokenizer)
        names = ["window", "used", "doc_id", "start", "length", "doc_tokens", "offset", "ids"]
        types = [pa.int64()] * 7 + [pa.binary()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            done = 0
            for part in chunks(texts, ENCODER_CHARS):
                rows = []
                for key, found in zip(keys[done : done + len(part)], codec.encode(part)):
                    raw = found + tail
                    n = len(raw) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        w, at = (windows.fresh(), 0) if length == capacity else windows.place(length)
                        rows.append((w, None, key, start, length, n, at, raw[4 * start : 4 * (start + length)]))
                done += len(part)
                yield batch_of(rows)
        if windows.used:
            yield batch_of([(w, u, None, None, None, None, None, None) for w, u in sorted(windows.used.items())])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
) -> tuple[DataFrame, DataFrame]:
    """(pieces, moves): every id of every text, end id included, in exactly one piece.

    pieces: window, doc_id, start, length, doc_tokens, offset, ids (little-endian
    32-bit), written to the shared folder.  moves: window, target, shift for
    the windows that were merged; see ``place``.  NULL text counts as empty (the
    end id alone); a NULL id stays NULL; repeated rows are packed each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    written = stage(rows.mapInArrow(_pack_partition(tokenizer, end_id, capacity, open_windows), _ROWS), "packed")
    pieces = written.filter("used is null").drop("used")
    left = written.filter("used is not null").select("window", "used")
    return pieces, _merge(left, capacity, open_windows)


def _merge_group(capacity: int, most: int, level: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        windows = Windows(capacity, most, 1 << 62 | level << 56 | int(key[0]) << 24)
        rows = []
        for w, used in pdf.sort_values(["used", "window"], ascending=[False, True])[["window", "used"]].itertuples(index=False):
            rows.append((w, *windows.place(int(used)), int(used)))
        return pd.DataFrame(
            [(w, t, s, windows.used.get(t, 0), t in windows.used) for w, t, s, _ in rows],
            columns=["window", "target", "shift", "used", "open"],
        )

    return run


def _merge(left: DataFrame, capacity: int, most: int) -> DataFrame:
    """window, target, shift after all rounds.  A group has at most FAN_IN times ``most`` windows."""
    spark = left.sparkSession
    groups = (left.agg(F.max(F.shiftright("window", 32))).first()[0] or 0) + 1
    moves, level = None, 0
    member = F.shiftright("window", 32)
    while moves is None or groups > 1:
        grouped = left.withColumn("g", (member / FAN_IN).cast("long"))
        found = stage(grouped.groupBy("g").applyInPandas(_merge_group(capacity, most, level), _MOVES), "pack-moves")
        step = found.select("window", "target", "shift")
        if moves is None:
            moves = step
        else:
            nxt = step.select(F.col("window").alias("target"), F.col("target").alias("t2"), F.col("shift").alias("s2"))
            moves = stage(
                moves.join(nxt, "target", "left").select(
                    "window", F.coalesce("t2", "target").alias("target"), (F.col("shift") + F.coalesce("s2", F.lit(0))).alias("shift")
                ),
                "pack-moves",
            )
        left = found.filter("open").groupBy(F.col("target").alias("window")).agg(F.max("used").alias("used"))
        member = F.expr("shiftright(window, 24) & 4294967295")
        groups = -(-groups // FAN_IN)
        level += 1
    return moves


def place(pieces: DataFrame, moves: DataFrame) -> DataFrame:
    """Pieces, or any columns of them with window and offset, at their final sequence_id and offset."""
    moved = pieces.join(moves, "window", "left")
    return moved.select(
        *[c for c in pieces.columns if c not in ("window", "offset")],
        F.coalesce("target", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0).cast("long"))).alias("offset"),
    )
