"""Benchmark decontamination by item-sized SimHash windows.

Every benchmark item is a weighted multiset of hashed 5-word shingles with a 64-bit SimHash fingerprint. Windows of a
document are as long as an item (in shingles). A window of weighted Jaccard similarity >= 0.8 to an item holds at
least 2 * 0.8 / 1.8 of its shingles among those of the benchmark, so windows below that count need no fingerprint
(an exact bound, not a sample). The others are looked up in a multi-index: the fingerprint is cut into four blocks of
16 bits; within a Hamming radius of 19 some block differs in at most four bits, and the index lists the items under
every such block value, so no item within the radius is missed. Candidates are verified on the exact weighted shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import words as W
from headwater.llm.shared import tidy

THRESHOLD = 0.8
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
#: Items per index: its four lists then take about 10 MB each. More items are matched block after block.
ITEMS = 1024

_BITS = np.arange(64, dtype=np.uint64)


def _within(bits: int, most: int) -> np.ndarray:
    """Every value of so many bits with at most ``most`` ones."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.int64)


def _pack(positive: np.ndarray) -> np.ndarray:
    return (positive.astype(np.uint64) << _BITS).sum(-1, dtype=np.uint64)


class Index:
    """Fingerprints and shingles of up to ``ITEMS`` items."""

    def __init__(self, rows: list[tuple[int, str]]):
        w = W.words(pa.array([t or "" for _, t in rows], pa.string()))
        s, at = W.shingles(w.hash, w.offsets)
        keep = [i for i in range(len(rows)) if at[i + 1] > at[i]]
        self.ids = [rows[i][0] for i in keep]
        own = [s[at[i] : at[i + 1]] for i in keep]
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.sets = [np.unique(x, return_counts=True) for x in own]
        self.vocabulary = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.prints = np.array([_pack(self.signs(x).sum(0, dtype=np.int32) > 0) for x in own], np.uint64)
        near = _within(BLOCK_BITS, RADIUS // BLOCKS)
        self.lists = []
        for b in range(BLOCKS):
            value = ((self.prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)
            under = (value[:, None] ^ near).ravel()
            items = np.repeat(np.arange(len(value), dtype=np.int32), len(near))
            order = np.argsort(under, kind="stable")
            self.lists.append((np.searchsorted(under[order], np.arange((1 << BLOCK_BITS) + 1)), items[order]))

    @staticmethod
    def signs(shingles: np.ndarray) -> np.ndarray:
        return ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * np.int8(2) - np.int8(1)

    def has(self, shingles: np.ndarray) -> np.ndarray:
        out = self.filter[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.vocabulary, shingles[maybe]), len(self.vocabulary) - 1)
        out[maybe] = self.vocabulary[at] == shingles[maybe]
        return out

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) within the radius."""
        windows, items = [], []
        for b, (ends, listed) in enumerate(self.lists):
            value = ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = ends[value + 1] - ends[value]
            w = np.repeat(np.arange(len(prints)), n)
            place = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + ends[value][w]
            windows.append(w)
            items.append(listed[place])
        code = np.unique(np.concatenate(windows) * len(self.ids) + np.concatenate(items))
        w, i = code // len(self.ids), code % len(self.ids)
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[close], i[close]

    def matches(self, s: np.ndarray, hit: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Item -> (similarity, first shingle, shingles) of the best window of one document."""
        n, best = len(s), {}
        held = np.concatenate([[0], np.cumsum(hit)])
        starts, lengths, sizes = [], [], []
        for size in np.unique(self.sizes).tolist():
            length = min(size, n)
            if length < THRESHOLD * size:
                continue
            need = THRESHOLD / (1 + THRESHOLD) * (size + length)
            found = np.flatnonzero(held[length:] - held[: n + 1 - length] >= need - 1e-9)
            starts.append(found)
            lengths.append(np.full(len(found), length))
            sizes.append(np.full(len(found), size))
        start, length, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, sizes))
        for low in range(0, len(start), 4096):
            a, k, z = start[low : low + 4096], length[low : low + 4096], size[low : low + 4096]
            first, last = int(a.min()), int((a + k).max())
            sums = np.zeros((last - first + 1, 64), np.int32)
            np.cumsum(self.signs(s[first:last]), axis=0, out=sums[1:], dtype=np.int32)
            w, i = self.lookup(_pack(sums[a + k - first] - sums[a - first] > 0))
            same = self.sizes[i] == z[w]
            for x, item in zip(w[same].tolist(), i[same].tolist(), strict=True):
                values, counts = np.unique(s[a[x] : a[x] + k[x]], return_counts=True)
                own, weights = self.sets[item]
                _, p, q = np.intersect1d(values, own, True, True)
                both = int(np.minimum(counts[p], weights[q]).sum())
                likeness = both / (int(k[x]) + int(z[x]) - both)
                if likeness >= THRESHOLD - 1e-9 and likeness > best.get(item, (0.0,))[0]:
                    best[item] = (likeness, int(a[x]), int(k[x]))
        return best


def _scan(index):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        least = THRESHOLD * own.sizes.min()
        for batch in batches:
            out = []
            for piece in W.pieces(batch, "text"):
                w = W.words(W.as_strings(piece.column("text")))
                s, at = W.shingles(w.hash, w.offsets)
                hit = own.has(s)
                held = np.concatenate([[0], np.cumsum(hit)])
                n = held[at[1:]] - held[at[:-1]]
                for d in np.flatnonzero((n > 0) & (n >= least)).tolist():
                    for item, (likeness, first, size) in own.matches(s[at[d] : at[d + 1]], hit[at[d] : at[d + 1]]).items():
                        last = min(first + size + W.SHINGLE - 2, int(w.offsets[d + 1] - w.offsets[d]) - 1)
                        out.append((piece.column("id")[d].as_py(), own.ids[item], likeness, first, last))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "first_word", "last_word"])

    return scan


def _indexes(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[Index]:
    """The items in blocks of at most ``ITEMS``."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null or t is not null")
    total = items.count()
    blocks = max(1, -(-total // (ITEMS // 2)))  # hash blocks come out uneven
    for b in range(blocks):
        rows = [(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toLocalIterator()]
        for at in range(0, len(rows), ITEMS):
            index = Index(rows[at : at + ITEMS])
            if index.ids:
                yield index


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, first_word, last_word): the best window of each document and item that match.

    The items are a stated query set: they go to the executors in blocks of at most ``ITEMS``, each against all
    documents. Null, empty and word-less texts match nothing; null ids of items and documents stay null in the matches.
    Repeated rows give repeated matches, one per item and document; ties keep the first window. A very long text is one
    piece, whose windows are looked at in blocks. Ids are cast to long. An empty table on either side gives no rows. Items of one to
    four words match only texts of just these words. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema, out = "doc_id long, item_id long, similarity double, first_word long, last_word long", None
    for index in _indexes(benchmark, item_col, item_text):
        found = source.mapInArrow(tidy(_scan(spark.sparkContext.broadcast(index))), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _without(index, text_col: str):
    scan = _scan(index)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text_col)], ["id", "text"])
            ok = np.ones(batch.num_rows, bool)
            for found in scan(iter([own])):
                ok[found.column("doc_id").to_numpy()] = False
            yield batch.filter(pa.array(ok))

    return keep


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows in whose text no benchmark item was found, with all their columns; ids play no part, so null and repeated ones need no care.

    Null, empty and word-less texts stay. A very long text is one piece, whose windows are looked at in blocks. Column names may clash with any of
    the operator's own, as rows pass as they are. An empty table gives none, and with an empty benchmark all rows stay.
    """
    out = docs
    for index in _indexes(benchmark, "item_id", "text"):
        out = out.mapInArrow(tidy(_without(docs.sparkSession.sparkContext.broadcast(index), text_col)), docs.schema)
    return out
