"""SentencePiece merge-type encoding by a prefix table, and decoding.

Byte-pair encoding gives every prefix of a text one last token, and an encoding is
right exactly when each pair of neighbours is one the merges could have left
side by side.  So the table holds, per prefix, the one matched piece that is
compatible with the last token of what stands before it; ids are then read
backwards.  Matches come from an automaton over the vocabulary, and pair tests
are remembered.  Work is linear in the text, whatever its merges.

Pieces of equal score (runs of spaces in public models) have no order that the
pair test could follow; a word that holds two spaces in a row is merged directly.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from strandline.llm.shared import text_of
from strandline.llm.token_units import chunks

SPACE = "▁"
#: Words, and stretches of words, that a worker remembers; beyond, it forgets the half that came last.
REMEMBERED = 500_000
_CODECS: dict[str, "Codec"] = {}


class Codec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        special = self.control | set(self.byte_of) | {self.unknown}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = [model.get_score(i) for i in range(size)]
        # Rank of each piece as a merge, 0 for single characters, which no merge makes.
        merged = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: (-self.score[i], i))
        self.rank = [0] * size
        for r, i in enumerate(merged, 1):
            self.rank[i] = r
        self.split: list[tuple[int, int] | None] = [None] * size
        tied = {self.score[i] for i, j in zip(merged, merged[1:]) if self.score[i] == self.score[j]}
        self.tied = {i for i in merged if self.score[i] in tied}
        self.plain_only = any(set(self.pieces[i]) != {SPACE} for i in self.tied)
        for i in merged:
            self.split[i] = self._last_merge(self.pieces[i])
        # Pieces that merging their own characters does not give back never appear.
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or self.split[i] is not None:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.by_word = not any(SPACE in p[1:].lstrip(SPACE) or (SPACE in p[1:] and p[0] != SPACE) for p in self.ids)
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._runs: dict[str, bytes] = {}
        self._joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    # -- merges ---------------------------------------------------------------
    def merge(self, text: str) -> list[tuple[str, tuple[str, str] | None]]:
        """Direct merging: best score first, leftmost among equals.  Symbols with their last merge."""
        sym: list[str | None] = list(text)
        how: list[tuple[str, str] | None] = [None] * len(sym)
        prev, nxt = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(sym) and (i := self.ids.get(sym[a] + sym[b])) is not None:
                heapq.heappush(queue, (-self.score[i], a, b, sym[a] + sym[b]))

        for a in range(len(sym) - 1):
            offer(a, a + 1)
        while queue:
            _, a, b, both = heapq.heappop(queue)
            if sym[a] is None or sym[b] is None or nxt[a] != b or sym[a] + sym[b] != both:
                continue
            how[a] = (sym[a], sym[b])
            sym[a], sym[b] = both, None
            nxt[a] = nxt[b]
            if nxt[a] < len(sym):
                prev[nxt[a]] = a
            offer(prev[a], a)
            offer(a, nxt[a])
        return [(s, h) for s, h in zip(sym, how) if s is not None]

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        whole = self.merge(piece)
        if len(whole) != 1:
            return None
        left, right = whole[0][1]
        if left not in self.ids or right not in self.ids:
            return None
        return self.ids[left], self.ids[right]

    def _compatible(self, a: int, b: int) -> bool:
        """Could merging leave piece ``a`` directly before piece ``b``?

        Undo the merges of both sides, latest first.  At each step the pieces that
        meet at the border must not form a piece that would have been merged
        before the merge undone last: a strictly better rank, or the same rank
        when it stands further left, which holds if the undone one was on the right.
        """
        rank, split, pieces, ids = self.rank, self.split, self.pieces, self.ids
        limit = 1 << 60  # ranks below it would have been merged across the border
        while True:
            both = ids.get(pieces[a] + pieces[b])
            if both is not None and rank[both] < limit:
                return False
            if rank[a] > rank[b]:
                undo_left = True
            elif rank[b] > 0:
                undo_left = False
            elif rank[a] > 0:
                undo_left = True
            else:
                return True
            if undo_left:
                limit, a = rank[a], split[a][1]
            else:
                limit, b = rank[b] + 1, split[b][0]

    # -- encoding -------------------------------------------------------------
    def _run(self, text: str) -> bytes:
        """Ids of a stretch whose characters are all in the vocabulary."""
        n_chars = len(text)
        last, size = [-1] * n_chars, [0] * n_chars
        pairs = self._pairs
        for end, (piece, n) in self.automaton.iter(text):
            if size[end]:
                continue  # found already: it is unique
            start = end - n
            if start >= 0:
                if not size[start]:
                    continue
                key = last[start] << 32 | piece
                known = pairs.get(key)
                if known is None:
                    known = pairs[key] = self._compatible(last[start], piece)
                if not known:
                    continue
            last[end], size[end] = piece, n
        out, at = [], n_chars - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return array("i", out).tobytes()

    def _bytes(self, char: str) -> list[int]:
        raw = char.encode()
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]

    def _stretches(self, text: str) -> list[str]:
        """``text`` cut where no piece holds the two characters in a row: no merge ever crosses there."""
        joins, out, start = self._joins, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joins:
                out.append(text[start:i])
                start = i
        out.append(text[start:])
        return out

    def word(self, text: str) -> bytes:
        if SPACE * 2 in text or self.plain_only:
            out = array("i")
            for s, _ in self.merge(text):
                out.extend([self.ids[s]] if s in self.ids else self._bytes(s))
            return out.tobytes()
        runs, out = self._runs, []
        for part in self._stretches(text):
            found = runs.get(part)
            if found is None:
                known = len(part) > 1 or part in self.ids  # a character of no piece stands alone
                found = runs[part] = self._run(part) if known else array("i", self._bytes(part)).tobytes()
            out.append(found)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as native 32-bit integers, without begin or end ids."""
        words = self._words
        for cache in (words, self._runs, self._pairs):
            if len(cache) > REMEMBERED:
                for key in list(islice(reversed(cache), REMEMBERED // 2)):
                    del cache[key]
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            text = SPACE + text.replace(" ", SPACE)
            parts = text.split(SPACE)[1:] if self.by_word else [text[1:]]
            if "" in parts and self.by_word:
                parts = list(_joined(parts))
            try:
                out.append(b"".join(map(words.__getitem__, parts)))
            except KeyError:
                for p in parts:
                    if p not in words:
                        words[p] = self.word(SPACE + p)
                out.append(b"".join(map(words.__getitem__, parts)))
        return out

    # -- decoding -------------------------------------------------------------
    def decode(self, ids: list[int]) -> str:
        """The library's decode: bytes joined, control pieces dropped, the added first space taken off."""
        byte_of, control = self.byte_of, self.control
        out: list[str] = []
        raw = bytearray()
        bare = True  # nothing but control pieces so far
        for i in ids:
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
                bare = False
            if i in control:
                continue
            piece = " ⁇ " if i == self.unknown else self.pieces[i]
            if bare and i != self.unknown and piece.startswith(SPACE):
                piece = piece[1:]
            bare = False
            out.append(piece)
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out).replace(SPACE, " ")


def _joined(parts: list[str]) -> Iterator[str]:
    """Words with the spaces of a run before them, but for the first of the run."""
    spaces = ""
    for p in parts[:-1]:
        if p:
            yield spaces + p
            spaces = ""
        else:
            spaces += SPACE
    yield spaces + parts[-1]


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\N{REPLACEMENT CHARACTER}")
            at += 1
    return "".join(out)


def codec(path: str) -> Codec:
    """The codec of this worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _rows(batch: pa.RecordBatch, name: str, column: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, kind)], names=[*batch.schema.names, name])


def encode(docs: DataFrame, model: str, end_id: int | None = 2, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` but the text, and ``ids`` (array of int) of each whole text.

    NULL text counts as empty: the end id alone, or no id.  A column that has the
    name of ``ids_col`` is replaced.
    """
    keep = [c for c in docs.columns if c not in (ids_col, text_col)]
    rows = docs.select(*keep, text_of(text_col).alias("__text"))
    schema = docs.select(*keep).schema.add(ids_col, ArrayType(IntegerType()))

    def run(batches):
        tail = [] if end_id is None else [end_id]
        own = codec(model)
        end = array("i", tail).tobytes()
        for batch in batches:
            rest = batch.select(keep)
            at = 0
            for part in chunks(batch.column("__text").to_pylist()):
                ids = [x + end for x in own.encode(part)]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays(
                    [*rest.slice(at, len(part)).columns, lists], names=[*rest.schema.names, ids_col]
                )
                at += len(part)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns and the decoded text of ``ids_col``; NULL ids give NULL, unknown ids an error."""
    keep = [c for c in encoded.columns if c != text_col]
    schema = encoded.select(*keep).schema.add(text_col, "string")

    def run(batches):
        own = codec(model)
        for batch in batches:
            ids = batch.column(ids_col)
            texts = [None if x is None else own.decode(x) for x in (v.as_py() for v in ids)]
            yield _rows(batch, text_col, texts, pa.string())

    return encoded.select(*keep).mapInArrow(run, schema)
