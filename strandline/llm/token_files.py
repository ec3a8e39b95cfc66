"""Token ids of documents in files of range-coded segments, in ascending document order.

One range shuffle of the texts orders the documents; a task then encodes its
range document by document and closes a segment (``rans``) at about two million
ids, so that memory is bounded by a segment and the longest text.  Segments are
binary values in Parquet files: Spark commits them as a whole, lost tasks
are written anew, and a reader takes them in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import rans
from strandline.llm.shared import stage, text_of
from strandline.llm.token_units import ENCODER_CHARS, chunks, encoder

#: Ids after which a segment is closed.
SEGMENT = 1 << 21

_SEGMENTS = "shard long, seq long, docs long, tokens long, data binary"
_DOCS = "doc_id long, shard long, start_in_shard long, n_tokens long, ids binary"


def write(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT
) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the segments; returns the written table.

    Columns: shard, seq (order of segments), docs, tokens, data.  NULL text counts
    as empty and has the end id alone; a NULL id sorts first and stays NULL; rows
    with one id follow each other in the order of their text's hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches):
        shard = TaskContext.get().partitionId()
        tail = np.array([end_id], dtype="<u4").tobytes()
        codec = encoder(tokenizer)
        ids: list[bytes] = []
        names: list[int | None] = []
        size = seq = before = 0

        def close():
            nonlocal ids, names, size, seq, before
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.uint32)
            known = np.array([x is not None for x in names])
            keys = np.array([x or 0 for x in names], dtype=np.int64)
            data = rans.encode(np.frombuffer(b"".join(ids), "<u4"), keys, known, lengths, before)
            row = pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((shard, pa.int64()), (seq, pa.int64()), (len(names), pa.int64()), (size, pa.int64()), (data, pa.binary()))],
                names=["shard", "seq", "docs", "tokens", "data"],
            )
            seq, before = seq + 1, before + size
            ids, names, size = [], [], 0
            return row

        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            done = 0
            for part in chunks(texts, ENCODER_CHARS):
                for key, found in zip(keys[done : done + len(part)], codec.encode(part)):
                    ids.append(found + tail)
                    names.append(key)
                    size += len(found) // 4 + 1
                    if size >= segment:
                        yield close()
                done += len(part)
        if names:
            yield close()

    return stage(ordered.select("doc_id", "text").mapInArrow(run, _SEGMENTS), "token-files")


def read(segments: DataFrame) -> DataFrame:
    """Documents of written segments: doc_id, shard, start_in_shard, n_tokens, ids (little-endian 32-bit).

    A damaged block raises ``rans.Damaged``.
    """

    def run(batches):
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                ids, keys, known, lengths, before = rans.decode(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                raw = ids.astype("<u4").tobytes()
                for a in range(0, len(keys), 1000):
                    b = min(a + 1000, len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[a:b], pa.int64(), mask=~known[a:b]),
                            pa.array([shard] * (b - a), pa.int64()),
                            pa.array(starts[a:b] + before, pa.int64()),
                            pa.array(lengths[a:b].astype(np.int64)),
                            pa.array([raw[4 * s : 4 * e] for s, e in zip(starts[a:b], ends[a:b])], pa.binary()),
                        ],
                        names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
                    )

    return segments.select("shard", "data").mapInArrow(run, _DOCS)


def shard_starts(segments: DataFrame) -> DataFrame:
    """Ids before each shard: one row per shard, i.e. per task that wrote."""
    totals = segments.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("shard_start"))
