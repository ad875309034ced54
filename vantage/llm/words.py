"""Words and word windows of Arrow text columns as numpy arrays, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: White space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that one numpy pass takes; a longer document makes a pass of its own.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pa.array([], pa.large_string()) if len(column) == 0 else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes of text and ``SLICE_ROWS`` rows at most, one row at least."""
    for batch in batches:
        _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            stop = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
            stop = min(max(stop, row + 1), row + SLICE_ROWS, batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop


@dataclass
class Words:
    """Words of consecutive documents: byte spans, the document of each, and 64-bit hashes."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(raw: np.ndarray, at: np.ndarray) -> Words:
        n, docs = len(raw), len(at) - 1
        if n == 0:
            none = np.zeros(0, np.int64)
            return Words(raw, none, none, none, np.zeros(docs, np.int64), np.zeros(docs, np.int64))
        space = SPACE[raw]
        edge = np.empty(n, bool)
        edge[1:], edge[0] = space[:-1], True
        begin = at[:-1]
        edge[begin[begin < n]] = True
        starts = np.flatnonzero(edge & ~space)
        edge[:-1], edge[-1] = space[1:], True
        stop = at[1:]
        edge[stop[stop > 0] - 1] = True
        ends = np.flatnonzero(edge & ~space) + 1
        counts = np.diff(np.searchsorted(starts, at))
        return Words(raw, starts, ends, np.repeat(np.arange(docs), counts), counts, np.cumsum(counts) - counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word: its bytes as digits of a polynomial modulo 2**64, then mixed."""
        if len(self.starts) == 0:
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        powers = np.full(int(lengths.max()), BASE)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        out = np.empty(len(lengths), np.uint64)
        for a in range(0, len(lengths), 1 << 17):  # bounds what the byte-wise arrays take
            size = lengths[a : a + (1 << 17)]
            flat, stop = gather_index(self.starts[a : a + (1 << 17)], size)
            digits = self.raw[flat].astype(np.uint64)
            digits += np.uint64(1)
            flat = np.arange(len(flat))
            flat -= np.repeat(stop - size, size)
            digits *= powers[flat]
            out[a : a + (1 << 17)] = np.add.reduceat(digits, stop - size)
        return mix(out)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word index) and hashes of every window of ``k`` words inside one document."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out *= BASE
            out += hashes[j : j + n]
        keep = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return keep, mix(out[keep])


def gather_index(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the spans ``starts[i] .. starts[i] + lengths[i]`` one after the other, and where each ends."""
    stop = np.cumsum(lengths)
    index = np.arange(stop[-1] if len(stop) else 0)
    return index + np.repeat(starts - (stop - lengths), lengths), stop


def string_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans as an Arrow binary array."""
    index, stop = gather_index(starts, ends - starts)
    offsets = np.zeros(len(starts) + 1, np.int64)
    offsets[1:] = stop
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[index].tobytes())])
