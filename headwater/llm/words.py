"""Words and word shingles of Arrow string columns, vectorised over the UTF-8 bytes.

A word is a maximal run of bytes that are digits, a-z or not ASCII, after lower-casing. No Python string is made
per word; hashes are 64 bits wide. Work goes in pieces of about a megabyte, so memory does not depend on how many
or how long the texts of a batch are (one very long text is one piece; its cost is about twelve bytes a byte).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
SHINGLE = 5

_WORD = np.zeros(256, np.uint8)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = 1
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    n = 0

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = max(n, PIECE + 4096)
            cls.up, cls.down = _powers(_BASE, cls.n), _powers(pow(_BASE, -1, 1 << 64), cls.n)
        return cls.up, cls.down


def as_strings(column: pa.Array) -> pa.Array:
    """A plain string array; null texts become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` text bytes, or one row."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, offsets from 0."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes of all texts
    start: np.ndarray  # of each word in data
    end: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray  # of each text's words

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def words(texts: pa.Array, ascii_only: bool = False) -> Words:
    """Words of each text. Lower-casing is Unicode's, or that of A-Z alone."""
    data, at = buffers(texts if ascii_only else pc.utf8_lower(texts))
    if ascii_only:
        data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1] & 1
        last[:-1] &= ~inside[1:] & 1
        edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.searchsorted(start, at)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # blocks of words that span about a megabyte
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE, "right")))
        low, high = int(start[i]), int(end[j - 1])
        up, down = _Powers.get(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return Words(data, start, end, mix(out), offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, offsets by text). A text with fewer words, but some, has one: all of them."""
    n = np.diff(offsets)
    sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = int(ends[-1])
    rows = np.repeat(np.arange(len(n)), sizes)
    at = np.arange(total) - ends[rows] + offsets[:-1][rows]
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    factor = 1
    stop = offsets[1:][rows]
    for j in range(k):
        factor = factor * _BASE & _MASK
        out += np.where(at + j < stop, padded[at + j], np.uint64(0)) * np.uint64(factor)
    return mix(out), ends


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches sorted by them; holds one run and one batch at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        columns = [table[k].to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        at = 0
        for cut in cuts.tolist():
            yield table.slice(at, cut - at)
            at = cut
        held = table.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
