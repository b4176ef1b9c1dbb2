"""Substring deduplication by sliding sentence spans.

Sentences end at . ! ? or a line break; one of more than twelve words counts as several. It is cut before words whose
hash is the least among the ``REACH`` words on either side, so that an edit or another beginning of the sentence moves
few cuts, and from each such cut on, until the next, every twelve words. From each sentence on, the shortest run of at
least two sentences and sixteen words is hashed (128 bits). Each document sends every distinct run once; a run that more
documents have is kept by the least key and is repeated in the others, as is any later place of a run in its own
document. Sentences that repeated runs cover are removed.

A document's key is its id, followed by a hash of its text where the id is null or comes with different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import words as W
from headwater.llm.shared import bounded, cut, tidy

LEAST_SENTENCES, LEAST_WORDS, LONGEST = 2, 16, 12
REACH = 4

_STOP = np.zeros(256, np.uint8)
_STOP[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = 1
#: Keys: id (a null one: one more than the greatest) times _TEXTS, plus what tells texts of that id apart.
_KEY, _TEXTS, _NO_ID = "decimal(38,0)", 2**62, 2**63


def _runs(texts: pa.Array):
    """(byte offsets of texts, byte starts of sentences, offsets of sentences by text, h1, h2, length in sentences of each run; 0: no run)."""
    w = W.words(texts, ascii_only=True)
    n = len(w.start)
    _, at = W.buffers(texts)
    stops = np.concatenate([[0], np.cumsum(_STOP[w.data], dtype=np.int64)])
    new = np.zeros(n, bool)
    new[w.offsets[:-1][np.diff(w.offsets) > 0]] = True
    new[1:] |= stops[w.start[1:]] > stops[w.end[:-1]]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    inside, size = np.arange(n) - np.repeat(first, sizes), np.repeat(sizes, sizes)
    least = (size > LONGEST) & (inside >= REACH)
    for k in range(1, REACH + 1):
        least[k:] &= w.hash[k:] < w.hash[:-k]
        least[:-k] &= (w.hash[:-k] <= w.hash[k:]) | (inside[:-k] + k >= size[:-k])
    new |= least
    first = np.flatnonzero(new)
    new |= (np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))) % LONGEST == 0
    first = np.flatnonzero(new)  # word with which a sentence begins
    offsets = np.searchsorted(first, w.offsets)
    edges = np.append(first, n)
    # The run from sentence i ends before the sentence in which word first[i] + LEAST_WORDS lies, or later.
    end = np.maximum(np.searchsorted(edges, first + LEAST_WORDS), np.arange(len(first)) + LEAST_SENTENCES)
    limit = np.repeat(offsets[1:], np.diff(offsets))
    ok = end <= limit
    end = np.minimum(end, len(first))
    words_at, words_to = first, edges[end]
    up, down = W._Powers.get(n + 1)
    hashes = []
    for seed in (1, 2):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(W.mix(w.hash + np.uint64(seed)) * up[:n], out=sums[1:])
        hashes.append(W.mix((sums[words_to] - sums[words_at]) * down[words_at]).view(np.int64))
    starts = w.start[first] if n else np.zeros(0, np.int64)
    return at, starts, offsets, *hashes, np.where(ok, end - np.arange(len(first)), 0)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            keys = piece.column("key")
            _, _, offsets, h1, h2, size = _runs(W.as_strings(piece.column("text")))
            doc = np.repeat(np.arange(len(keys)), np.diff(offsets))
            place = np.arange(len(h1)) - offsets[:-1][doc]
            keep = size > 0
            rows = np.flatnonzero(keep)
            _, one = np.unique(np.stack([doc[rows], h1[rows], h2[rows]]), axis=1, return_index=True) if len(rows) else (None, rows)
            rows = rows[one]
            yield pa.RecordBatch.from_arrays([pa.array(h1[rows]), pa.array(h2[rows]), keys.take(pa.array(doc[rows])), pa.array(place[rows].astype(np.int32))], ["h1", "h2", "key", "place"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            texts = W.as_strings(piece.column("text"))
            data, _ = W.buffers(texts)
            at, starts, offsets, h1, h2, size = _runs(texts)
            out, total, removed = [], [], []
            for d, places in enumerate(piece.column("places").to_pylist()):
                low, high = int(offsets[d]), int(offsets[d + 1])
                elsewhere = {(h1[low + p], h2[low + p]) for p in places or ()}
                gone, seen = np.zeros(high - low, bool), set()
                for i in np.flatnonzero(size[low:high]).tolist():
                    key = (h1[low + i], h2[low + i])
                    if key in elsewhere or key in seen:
                        gone[i : i + size[low + i]] = True
                    seen.add(key)
                total.append(high - low)
                removed.append(int(gone.sum()))
                begin, end = int(at[d]), int(at[d + 1])
                if removed[-1]:
                    cuts = np.append(starts[low:high], end)
                    kept = [data[begin : cuts[0]]] if not gone[0] else []
                    kept += [data[cuts[i] : cuts[i + 1]] for i in np.flatnonzero(~gone).tolist()]
                    out.append(b"".join(x.tobytes() for x in kept).decode("utf-8", "replace"))
                else:
                    out.append(data[begin:end].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_sentences", "n_removed"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): the key is one for each distinct id and text, in order of ids, null ids last.

    Ids with different texts are looked for first, so that keys of all others end in zeros, which shuffle small.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = source.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    several = cut(hashed.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("doc_id", F.lit(True).alias("several")))
    rank = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(_NO_ID)).cast("decimal(20,0)"))
    own = F.when(F.col("several") | F.col("doc_id").isNull(), F.shiftrightunsigned(F.xxhash64("text"), 2)).otherwise(F.lit(0))
    key = rank * F.lit(str(_TEXTS)).cast("decimal(19,0)") + own.cast("decimal(19,0)")
    return source.join(bounded(several), "doc_id", "left").select("doc_id", key.cast(_KEY).alias("key"), "text")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text without repeated sentences, n_sentences, n_removed), one row per row of ``docs``.

    The first place of a run is in the document with the least id. Rows that share an id and the text count as one
    document (the same text twice under one id is not a repeat); different texts of an id are documents of their own,
    in order of their hashes, and so are those of null ids, which come last. Null text: empty.
    Texts under two sentences or sixteen words have no runs and stay as they are. A very long text is one piece, whose arrays take
    some twelve bytes a byte. Ids are cast to long. Other columns, whatever their names, are not read. An empty table gives none.
    Common runs are pre-aggregated before the shuffle; the join back is left to AQE's splitting of hot keys.
    """
    source = _keyed(docs, id_col, text_col)
    spans = source.select("key", "text").mapInArrow(tidy(_spans), f"h1 long, h2 long, key {_KEY}, place int")
    first = spans.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("h1", "h2", "least")
    places = spans.join(first, ["h1", "h2"]).where("key > least").groupBy("key").agg(F.collect_set("place").alias("places"))
    return source.join(places, "key", "left").mapInArrow(tidy(_rebuild), "doc_id long, text string, n_sentences long, n_removed long")
