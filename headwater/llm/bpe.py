"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import words as W
from headwater.llm.shared import fresh, tidy

#: Longer texts are encoded in parts of about so many characters.
PART = 1 << 16
#: Between a letter, digit or mark of ASCII and a space no match of the pattern can reach across, and neither side's matches change.
SAFE = re.compile(r"[!-~](?= )")


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts that are encoded one by one with the same ids; a stretch without a safe boundary stays whole."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encode(enc, text: str) -> np.ndarray:
    return np.array([i for p in parts(text) for i in enc.encode_ordinary(p)], "<u4") if len(text) > PART else np.array(enc.encode_ordinary(text), "<u4")


def decode(enc, ids: np.ndarray) -> bytes:
    """The raw bytes of the ids, which may begin or end inside a character."""
    return enc.decode_bytes(ids.tolist())


def bpe(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False, with_decoded: bool | None = None
) -> DataFrame:
    """The columns ``keep`` and n_tokens, ids_sha256, decoded_sha256; with ``with_ids`` also ids and, unless that is off, decoded (binary).

    ids are little-endian 32-bit integers. The rank file is read once per Python worker from a path that every executor has.
    Null text: empty (no ids). Control strings in a text are ordinary text. A very long text is encoded in parts. Equal texts have
    equal results; repeated rows give repeated rows; ids of any type pass. An empty table gives none. A kept column that has the name of
    one of the operator's own gives way to it; other clashes do no harm.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    more = [("ids", with_ids), ("decoded", with_ids if with_decoded is None else with_decoded)]
    added += [T.StructField(k, T.BinaryType()) for k, wanted in more if wanted]
    own = {f.name.lower() for f in added}
    text = fresh(docs, "_text")
    source = docs.select(*[F.col(f"`{k}`") for k in keep if k.lower() not in own], F.col(text_col).cast("string").alias(text))
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.binary(), "decoded": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for piece in W.pieces(batch, text, 4 * W.PIECE):
                out: dict[str, list] = {f.name: [] for f in added}
                for value in piece.column(text):
                    ids = encode(enc, value.as_py() or "")
                    raw, back = ids.tobytes(), decode(enc, ids)
                    row = {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(raw).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest(), "ids": raw, "decoded": back}
                    for k, column in out.items():
                        column.append(row[k])
                kept = piece.drop_columns([text])
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, kinds[k]) for k, v in out.items())], [*kept.schema.names, *out])

    return source.mapInArrow(tidy(run), T.StructType([*source.drop(text).schema.fields, *added]))
