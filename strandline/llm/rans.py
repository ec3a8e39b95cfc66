"""Static range asymmetric numeral system over numpy lanes.

A segment holds whole documents.  One frequency table per segment is shared by
its blocks.  A block interleaves 64 lanes and can be decoded alone; inside it, a
checkpoint every 256 steps holds the lane states and the place in the word
stream, so that all stretches between checkpoints are decoded side by side.
State: 64 bits, at least 2^31; it gives away 32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"SLR1"
LANES = 64
STEPS = 1024
STRIDE = 256
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sBBHIIQQIIII")
_BLOCK = np.dtype([("tokens", "<u4"), ("words", "<u4"), ("ids_crc", "<u4"), ("words_crc", "<u4")])


class Damaged(ValueError):
    """A segment that fails its checksums."""


def table(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Bits of precision and frequencies that add up to 2^bits, each at least 1."""
    bits = max(12, int(len(counts)).bit_length() + 3)
    whole = 1 << bits
    freq = np.maximum(1, counts.astype(np.float64) * whole / counts.sum()).astype(np.int64)
    over = int(freq.sum()) - whole
    if over > 0:
        spare = freq - 1
        freq -= spare * over // spare.sum()
        over = int(freq.sum()) - whole
        most = np.argsort(-freq, kind="stable")[:over]
        freq[most] -= 1
    elif over < 0:
        freq[int(np.argmax(freq))] -= over
    return bits, freq


def _symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, the place of each id among them, and their counts."""
    if int(ids.max()) >= 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), dtype=np.uint32)
    place[symbols] = np.arange(len(symbols), dtype=np.uint32)
    return symbols, place[ids], counts[symbols]


def _shape(n: int) -> tuple[int, int, int]:
    """Blocks, steps and stride for n tokens."""
    if n >= LANES * STEPS:
        return -(-n // (LANES * STEPS)), STEPS, STRIDE
    steps = max(1, -(-n // LANES))
    stride = min(STRIDE, steps)
    return 1, -(-steps // stride) * stride, stride


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 6)


def encode(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, doc_tokens: np.ndarray, before: int) -> bytes:
    """A segment of documents: ids of all tokens, and per document id, whether it has one, tokens."""
    n = len(ids)
    symbols, index, counts = _symbols(ids)
    bits, freq = table(counts)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    freq = freq.astype(np.uint64)
    blocks, steps, stride = _shape(n)
    filler = int(np.argmax(counts))
    grid = np.full(blocks * steps * LANES, filler, dtype=np.uint32)
    grid[:n] = index
    # All lanes of a step side by side.
    grid = np.ascontiguousarray(grid.reshape(blocks, steps, LANES).transpose(1, 0, 2))

    state = np.full((blocks, LANES), LOW, dtype=np.uint64)
    words = np.empty((steps, blocks, LANES), dtype=np.uint32)
    gave = np.empty((steps, blocks, LANES), dtype=bool)
    marks = np.zeros((blocks, steps // stride, LANES), dtype=np.uint64)
    room, shift, low32 = np.uint64(63 - bits), np.uint64(bits), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        f, c = freq[grid[t]], cum[grid[t]]
        full = np.greater_equal(state, f << room, out=gave[t])
        words[t] = state
        np.right_shift(state, low32, out=state, where=full)
        q = state // f
        state += (q << shift) - q * f + c
        if t % stride == 0:
            marks[:, t // stride] = state

    words, gave = (np.ascontiguousarray(x.transpose(1, 0, 2)) for x in (words, gave))
    at = np.zeros((blocks, steps // stride), dtype="<u4")
    given = gave.reshape(blocks, steps // stride, -1).sum(axis=2)
    at[:, 1:] = np.cumsum(given, axis=1)[:, :-1]
    info = np.zeros(blocks, dtype=_BLOCK)
    streams = []
    for b in range(blocks):
        stream = words[b][gave[b]].astype("<u4").tobytes()
        part = ids[b * steps * LANES : (b + 1) * steps * LANES].astype("<u4").tobytes()
        info[b] = (len(part) // 4, len(stream) // 4, zlib.crc32(part), zlib.crc32(stream))
        streams.append(stream)
    gaps = np.diff(symbols.astype("<u4"), prepend=np.uint32(0))
    index_part = _pack(doc_ids.astype("<i8")) , _pack(known.astype("u1")), _pack(doc_tokens.astype("<u4"))
    docs = b"".join(struct.pack("<I", len(p)) + p for p in index_part)
    freqs = b"".join(struct.pack("<I", len(p)) + p for p in (_pack(gaps), _pack(freq.astype("<u4"))))
    head = _HEAD.pack(MAGIC, 1, bits, LANES, steps, stride, n, before, len(doc_ids), len(symbols), blocks, len(docs) + len(freqs))
    body = docs + freqs + info.tobytes() + at.tobytes() + marks.astype("<u8").tobytes() + b"".join(streams)
    return head + struct.pack("<I", zlib.crc32(head + body[: len(docs) + len(freqs)])) + body


def _parts(buf: memoryview, at: int, k: int) -> tuple[list[bytes], int]:
    out = []
    for _ in range(k):
        (size,) = struct.unpack_from("<I", buf, at)
        out.append(zlib.decompress(buf[at + 4 : at + 4 + size]))
        at += 4 + size
    return out, at


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """ids, doc ids, known, tokens per document, tokens before the segment in its file."""
    buf = memoryview(data)
    magic, version, bits, lanes, steps, stride, n, before, n_docs, n_symbols, blocks, meta = _HEAD.unpack_from(buf, 0)
    at = _HEAD.size + 4
    (crc,) = struct.unpack_from("<I", buf, _HEAD.size)
    if magic != MAGIC or version != 1 or crc != zlib.crc32(bytes(buf[: _HEAD.size]) + bytes(buf[at : at + meta])):
        raise Damaged("header, document index or frequency table")
    (ids_, known_, tokens_), at = _parts(buf, at, 3)
    (gaps_, freq_), at = _parts(buf, at, 2)
    symbols = np.cumsum(np.frombuffer(gaps_, "<u4"), dtype=np.uint64).astype(np.uint32)
    freq = np.frombuffer(freq_, "<u4").astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slots = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq.astype(np.int64))

    pieces = steps // stride
    info = np.frombuffer(buf, _BLOCK, blocks, at)
    at += info.nbytes
    marks_at = np.frombuffer(buf, "<u4", blocks * pieces, at).reshape(blocks, pieces).astype(np.int64)
    at += blocks * pieces * 4
    state = np.frombuffer(buf, "<u8", blocks * pieces * lanes, at).reshape(blocks * pieces, lanes).copy()
    at += blocks * pieces * lanes * 8
    words = np.frombuffer(buf, "<u4", int(info["words"].sum(dtype=np.int64)), at)
    starts = np.concatenate([[0], np.cumsum(info["words"].astype(np.int64))])
    for b in range(blocks):
        if zlib.crc32(words[starts[b] : starts[b + 1]].tobytes()) != info["words_crc"][b]:
            raise Damaged(f"words of block {b}")
    place = (marks_at + starts[:blocks, None]).reshape(-1)
    out = np.empty((stride, blocks * pieces, lanes), dtype=np.uint32)
    mask, shift, low32 = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
    for t in range(stride):
        slot = state & mask
        s = slots[slot]
        out[t] = s
        state = freq[s] * (state >> shift) + slot - cum[s]
        need = state < LOW
        seen = np.cumsum(need, axis=1)
        take = (place[:, None] + seen - 1)[need]
        state[need] = (state[need] << low32) | words[take].astype(np.uint64)
        place = place + seen[:, -1]
    ids = symbols[out.transpose(1, 0, 2).reshape(-1)[:n]]
    for b in range(blocks):
        part = ids[b * steps * lanes : (b + 1) * steps * lanes].astype("<u4").tobytes()
        if len(part) // 4 != info["tokens"][b] or zlib.crc32(part) != info["ids_crc"][b]:
            raise Damaged(f"ids of block {b}")
    return ids, np.frombuffer(ids_, "<i8"), np.frombuffer(known_, "u1").astype(bool), np.frombuffer(tokens_, "<u4"), before
