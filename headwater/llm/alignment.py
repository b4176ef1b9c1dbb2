"""Alignment of two tokenizers' tokens over the same bytes.

Each text is encoded twice; offsets are running sums of the tokens' byte lengths. Ends that both have cut the text into groups
(``intersect1d``, labels by ``searchsorted``), and ranges that overlap are links (``searchsorted`` and ``repeat``).

Both tokenizers start anew at a space after any other character than white space: the byte-level pattern cannot reach across one, and no piece of
the other vocabulary holds a space after something else (which is checked; otherwise texts are taken whole). So a text is a row of
segments, each of which is encoded and aligned on its own, once a block however often it stands there. A block is some texts;
its distinct segments are encoded one after another, as one long text, and one pass of array operations aligns them all, as each ends at a common cut.

How many documents of the corpus hold a pair of ids is counted in two salted stages from one row per block and pair. The counts
go back to the blocks that asked for them, pair by pair, and meet the block's documents, which have only the numbers of their pairs by then, in a
cogroup: nothing is broadcast, whatever the number of pairs. Texts are encoded once, as all uses of the blocks read one shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm import words as W
from headwater.llm.bpe import encode
from headwater.llm.shared import fresh, tidy

#: Text bytes of a block, or one text; tokens of the first kind that are linked at once, or one group.
BLOCK, STEP = 8 << 20, 1 << 18
#: Characters that are encoded in one call, or one segment.
CHUNK = 1 << 16
SALTS = 16


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Tokenizers:
    first: Callable[[str], np.ndarray]  # ids of a space and the text
    second: Callable[[str], np.ndarray]  # ids of the text; the library adds the space
    first_bytes: list[bytes]
    second_bytes: list[bytes]
    apart: bool = True  # whether both start anew at spaces

    def __post_init__(self) -> None:
        self.first_size, self.second_size = (np.array([len(x) for x in v], np.int64) for v in (self.first_bytes, self.second_bytes))
        most = max(len(self.first_bytes), len(self.second_bytes))
        self.named = [f"{i}{mark}".encode() for mark in (",", "|", ";", "") for i in range(most)]
        self.most = most


@lru_cache(maxsize=1)
def tokenizers(byte_level_path: str, pieces_path: str, pattern: str) -> Tokenizers:
    """Both, from a byte-level vocabulary with merges (JSON) and a SentencePiece model.

    The byte-level one runs in tiktoken: its ranks are the file's ids, as long as those are in the order of the merges, which is checked.
    """
    import sentencepiece
    import tiktoken

    with open(byte_level_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    vocabulary = {k: i for k, i in model["vocab"].items() if all(c in letters for c in k)}
    special = {i for k, i in model["vocab"].items() if k not in vocabulary}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if [model["vocab"][a + b] for a, b in merges] != sorted(model["vocab"][a + b] for a, b in merges):
        raise ValueError("the merges are not in the order of the ids")
    merged = {a + b for a, b in merges}
    ranks = {bytes(letters[c] for c in k): i for k, i in vocabulary.items() if len(k) == 1 or k in merged}
    first_bytes = [b""] * (max([*vocabulary.values(), *special]) + 1)
    for k, i in ranks.items():
        first_bytes[i] = k
    enc = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces_path)

    def piece(i: int) -> bytes:
        name = sp.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if sp.is_byte(i) else name.replace("▁", " ").encode()

    apart = not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())) and sp.decode(sp.encode("a  b  ")) == "a  b  "
    return Tokenizers(lambda text: encode(enc, " " + text), lambda text: np.array(sp.encode(text), "<u4"), first_bytes, [piece(i) for i in range(sp.get_piece_size())], apart)


Ids = tuple[np.ndarray, np.ndarray]


def tokens(both: Tokenizers, text: str) -> Ids | None:
    """Ids of a space and the text by either tokenizer; None where one of them does not give the bytes back."""
    a, b, whole = both.first(text), both.second(text), b" " + text.encode("utf-8", "surrogatepass")
    same = all(b"".join([names[i] for i in ids.tolist()]) == whole for ids, names in ((a, both.first_bytes), (b, both.second_bytes)))
    return (a, b) if same else None


def _alone(name: str) -> bool:
    """Whether a segment cannot be followed by another one in one call: a space after it would not begin a new token."""
    return not name or name[-1].isspace()


def encode_segments(both: Tokenizers, names: list[str]) -> tuple[Ids, Ids, np.ndarray]:
    """(ids of all segments by the first tokenizer, how many each has), the same by the second, and which are given back byte by byte; the others have none."""
    found: list[list[np.ndarray]] = [[], []]
    counts: list[list[np.ndarray]] = [[], []]
    good: list[np.ndarray] = []

    def put(ids: Ids, n: tuple[np.ndarray, np.ndarray], ok: np.ndarray) -> None:
        for k in (0, 1):
            found[k].append(ids[k])
            counts[k].append(n[k])
        good.append(ok)

    def one(name: str) -> None:
        got = tokens(both, name)
        ids = got or (np.zeros(0, "<u4"), np.zeros(0, "<u4"))
        put(ids, (np.array([len(ids[0])]), np.array([len(ids[1])])), np.array([got is not None]))

    def many(part: list[str]) -> None:
        got = tokens(both, " ".join(part)) if len(part) > 1 else None
        if got is not None:
            ends = np.cumsum([1 + len(name.encode("utf-8", "surrogatepass")) for name in part])
            n = []
            for ids, size in zip(got, (both.first_size, both.second_size), strict=True):
                own = np.cumsum(size[ids])
                last = np.searchsorted(own, ends)
                if not np.array_equal(own[last], ends):
                    break
                n.append(np.diff(np.concatenate([[0], last + 1])))
            else:
                put(got, (n[0], n[1]), np.ones(len(part), bool))
                return
        for name in part:
            one(name)

    part: list[str] = []
    length = 0
    for name in names:
        single = not both.apart or _alone(name)
        if single or length > CHUNK:
            many(part)
            part, length = [], 0
        if single:
            one(name)
        else:
            part.append(name)
            length += len(name) + 1
    many(part)
    none = np.zeros(0, np.int64)
    (a, b), (n_a, n_b) = ([np.concatenate([none, *v]).astype(np.int64) for v in x] for x in (found, counts))
    return (a, n_a), (b, n_b), np.concatenate([np.zeros(0, bool), *good])


def segments(text: str, apart: bool = True) -> list[str]:
    """The text cut before each space that follows anything but white space, without those spaces; a space and the text is what they are of."""
    if not apart:
        return [text]
    out, begin = [], True
    for part in text.split(" "):
        if begin:
            out.append(part)
        else:
            out[-1] += " " + part
        begin = part != "" and not part[-1].isspace()
    if len(out) > 1 and not out[-1]:  # a last space belongs to what is before it: the second library adds none to an empty text
        out.pop()
        out[-1] += " "
    return out


@dataclass
class Aligned:
    """Segments one after another: ids, the segment (``text``) and the group of each token, and byte ranges."""

    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    start_a: np.ndarray
    start_b: np.ndarray

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in a, place in b) of overlapping tokens, in order of a, some groups at a time."""
        at = 0
        while at < len(self.a):
            # Whole groups only: a group's tokens overlap none of another's.
            end = int(np.searchsorted(self.group_a, self.group_a[min(at + STEP, len(self.a)) - 1], "right"))
            low = np.searchsorted(self.ends_b, self.start_a[at:end], "right")
            n = np.searchsorted(self.start_b, self.ends_a[at:end], "left") - low
            i = np.repeat(np.arange(at, end), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            yield i, j
            at = end


def align(first: Ids, second: Ids, size_a: np.ndarray, size_b: np.ndarray) -> Aligned:
    """Of segments (ids, number of each) whose tokens of either kind have the same bytes in all."""
    (a, n_a), (b, n_b) = first, second
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # no token is empty
    text_a, text_b = (np.repeat(np.arange(len(n)), n) for n in (n_a, n_b))
    return Aligned(a, b, text_a, text_b, np.searchsorted(cuts, ends_a, "left"), np.searchsorted(cuts, ends_b, "left"), ends_a, ends_b, ends_a - size_a[a], ends_b - size_b[b])


def _group_names(x: Aligned, both: Tokenizers, texts: int) -> tuple[np.ndarray, list[bytes]]:
    """(groups of each segment, their ids written as ``a1,a2|b1;a3|b2``)."""
    groups = int(x.group_a[-1]) + 1 if len(x.group_a) else 0
    n_a, n_b = (np.bincount(g, minlength=groups) for g in (x.group_a, x.group_b))
    before_a, before_b = np.cumsum(n_a), np.cumsum(n_b) - n_b
    name = np.empty(len(x.a) + len(x.b), np.int64)
    last_a = np.zeros(len(x.a), bool)
    last_b, final_b = np.zeros(len(x.b), bool), np.zeros(len(x.b), bool)
    if groups:
        last_a[before_a - 1] = True
        last_b[np.cumsum(n_b) - 1] = True
        final_b[:-1] = x.text_b[1:] != x.text_b[:-1]
        final_b[-1] = True
    # A group's tokens of the first kind come after all of the groups before, those of the second kind after them.
    name[np.arange(len(x.a)) + before_b[x.group_a]] = x.a + both.most * last_a
    name[np.arange(len(x.b)) + before_a[x.group_b]] = x.b + both.most * np.where(final_b, 3, np.where(last_b, 2, 0))
    sizes = np.bincount(x.text_a, minlength=texts) + np.bincount(x.text_b, minlength=texts)
    written, at, named = [], 0, [both.named[i] for i in name.tolist()]
    for n in sizes.tolist():
        written.append(b"".join(named[at : at + n]))
        at += n
    own = np.zeros(groups, np.int64)
    own[x.group_a] = x.text_a
    return np.bincount(own, minlength=texts) if groups else np.zeros(texts, np.int64), written


@dataclass
class Block:
    """What a block's documents are without the corpus: numbers and digests, and of each document its pairs (places in ``pairs``) and how often."""

    numbers: np.ndarray  # (documents, 4): tokens of either kind, groups, links
    digests: list[str]
    pairs: np.ndarray  # first id * size of the second vocabulary + second id, ascending
    documents: np.ndarray  # of the block that hold each pair
    place: list[np.ndarray]
    times: list[np.ndarray]


def _summed(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, empty ones 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, 0)])
    return total[begins + sizes] - total[begins]


def _cut(both: Tokenizers, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct segments, number of the segment at each place of all texts, how many each text has); empty texts have none."""
    if both.apart:
        parts = pc.split_pattern(texts, " ")
        held = parts.flatten().dictionary_encode()
        names, code = held.dictionary.to_pylist(), held.indices.to_numpy()
        sizes = parts.value_lengths().to_numpy().astype(np.int64)
    else:
        held = texts.dictionary_encode()
        names, code, sizes = held.dictionary.to_pylist(), held.indices.to_numpy(), np.ones(len(texts), np.int64)
    code = code.astype(np.int64)
    # Texts with white space before a space, or at either end, are cut one by one.
    odd = np.fromiter(map(_alone, names), bool, len(names))[code]
    begins = np.cumsum(sizes) - sizes
    again = np.flatnonzero(_summed(odd.astype(np.int64), begins, sizes) > 0)
    if len(again):
        number = {name: i for i, name in enumerate(names)}
        rows = np.split(code, begins[1:])
        for i in again.tolist():
            text = texts[i].as_py()
            rows[i] = np.array([number.setdefault(p, len(number)) for p in segments(text, both.apart)] if text else [], np.int64)
        names, code, sizes = list(number), np.concatenate([np.zeros(0, np.int64), *rows]), np.fromiter(map(len, rows), np.int64, len(rows))
    return names, code, sizes


def read_block(both: Tokenizers, texts: pa.Array) -> Block:
    """``texts``: strings, without nulls."""
    names, code, sizes = _cut(both, texts)
    used, flat = np.unique(code, return_inverse=True)
    first, other, good = encode_segments(both, [names[i] for i in used.tolist()])
    n = len(used)
    begins = np.cumsum(sizes) - sizes
    # A text that one of the tokenizers does not give back has no tokens, and its segments count only where other texts have them.
    whole = _summed((~good[flat]).astype(np.int64), begins, sizes) == 0
    flat, sizes = flat[np.repeat(whole, sizes)], np.where(whole, sizes, 0)
    begins = np.cumsum(sizes) - sizes
    kept = np.bincount(flat, minlength=n) > 0
    first, other = ((ids[np.repeat(kept, m)], np.where(kept, m, 0)) for ids, m in (first, other))
    x = align(first, other, both.first_size, both.second_size)
    groups, written = _group_names(x, both, n)
    second = len(both.second_bytes)
    found, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in x.links():
        found.append(x.a[i] * second + x.b[j])
        of.append(x.text_a[i])
    pairs, link = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.concatenate(of)
    links = np.bincount(owner, minlength=n)
    each = np.stack([np.bincount(x.text_a, minlength=n), np.bincount(x.text_b, minlength=n), groups, links], 1).astype(np.int64)
    numbers = _summed(each[flat], begins, sizes)
    ends, named = (begins + sizes).tolist(), [written[i] for i in flat.tolist()]
    digests = [hashlib.sha256(b";".join(named[i:j])).hexdigest() if j > i else "" for i, j in zip(begins.tolist(), ends, strict=True)]
    # Each document's pairs: its distinct segments' links, as many times as they stand there.
    first = np.searchsorted(owner, np.arange(n))
    place, times, documents = [], [], np.zeros(len(pairs), np.int64)
    for d in range(len(sizes)):
        own, often = np.unique(flat[begins[d] : begins[d] + sizes[d]], return_counts=True)
        count = links[own]
        which = np.repeat(np.arange(len(own)), count)
        at = link[np.arange(len(which)) - (np.cumsum(count) - count)[which] + first[own][which]]
        p, inverse = np.unique(at, return_inverse=True)
        place.append(p)
        times.append(np.bincount(inverse, often[which], len(p)).astype(np.int64))
        documents[p] += 1
    return Block(numbers, digests, pairs, documents, place, times)


def align_tokenizers(docs: DataFrame, byte_level_path: str, pieces_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_links: pairs of token occurrences whose byte ranges overlap; the count of an id pair is the number of documents that hold it linked;
    count_sum: sum of the counts over the links; n_best: links whose count is the highest of their first id's pairs, ties included; the
    digest is of the groups' ids as ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and those that a tokenizer does not give back byte
    by byte, have no tokens: zeros and an empty digest. Control strings in a text are ordinary text. Each row is a document of its own:
    repeated rows count each, and null and repeated ids of any type pass. A very long text is a block of its own, linked part by part.
    An empty table gives none. Other columns, whatever their names, are not read. The vocabulary files are read once per Python worker
    from paths that every executor has.
    """
    kind = docs.schema[id_col].dataType
    ident, text = fresh(docs, "_id"), fresh(docs, "_text")
    source = docs.select(F.col(id_col).alias(ident), F.col(text_col).cast("string").alias(text))
    load = lambda: tokenizers(byte_level_path, pieces_path, pattern)
    fields = lambda *names: [T.StructField(k, T.LongType()) for k in names]
    binary = [T.StructField(k, T.BinaryType()) for k in ("place", "times", "pairs", "documents")]
    own, digest, numbers = T.StructField(ident, kind), T.StructField("groups_sha256", T.StringType()), fields("n_a", "n_b", "n_groups", "n_links")
    shape = T.StructType([*fields("block"), own, *numbers, digest, *binary])
    result = T.StructType([own, *numbers, *fields("n_best", "count_sum"), digest])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each block, the block's pairs with its first one."""
        both, block = load(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in W.pieces(batch, text, BLOCK):
                block += 1
                got = read_block(both, W.as_strings(piece.column(text)))
                n = piece.num_rows
                rest = [None] * (n - 1)
                binary = lambda values: pa.array([v.astype("<u4").tobytes() for v in values], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, block)), piece.column(ident), *(pa.array(got.numbers[:, k]) for k in range(4)), pa.array(got.digests, pa.string()),
                        binary(got.place), binary(got.times), pa.array([got.pairs.astype("<i8").tobytes(), *rest], pa.binary()), pa.array([got.documents.astype("<u4").tobytes(), *rest], pa.binary()),
                    ],
                    shape.names,
                )

    def pairs_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, documents of the block that hold them)."""
        at = int(np.flatnonzero(table["pairs"].is_valid().to_numpy())[0])
        return np.frombuffer(table["pairs"][at].as_py(), "<i8"), np.frombuffer(table["documents"][at].as_py(), "<u4").astype(np.int64)

    def asked(table: pa.Table) -> pa.Table:
        """Per pair of ids: the documents of the block that hold it linked."""
        second = len(load().second_bytes)
        pair, n = pairs_of(table)
        return pa.table({"block": pa.array(np.full(len(pair), table["block"][0].as_py()), pa.int64()), "a": pair // second, "b": pair % second, "n": n})

    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        pair, _ = pairs_of(table)
        at = np.searchsorted(pair, answers["a"].to_numpy() * len(load().second_bytes) + answers["b"].to_numpy())
        count, top = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        count[at], top[at] = answers["docs"].to_numpy(), answers["top"].to_numpy()
        place, times = ([np.frombuffer(v, "<u4") for v in table[k].to_pylist()] for k in ("place", "times"))
        sizes = np.fromiter(map(len, place), np.int64, len(place))
        place, times = (np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (place, times))
        begins = np.cumsum(sizes) - sizes
        best, total = (pa.array(_summed(times * v[place], begins, sizes)) for v in (top, count))
        columns = [table[k] for k in (ident, "n_a", "n_b", "n_groups", "n_links")] + [best, total, table["groups_sha256"]]
        return pa.Table.from_arrays(columns, result.names)

    blocks = source.mapInArrow(tidy(encoded), shape)
    pairs = blocks.groupBy("block").applyInArrow(asked, "block long, a long, b long, n long")
    salted = pairs.groupBy("a", "b", F.pmod("block", F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = salted.groupBy("a", "b").agg(F.sum("n").alias("docs"))
    # A first id has no more pairs than the second vocabulary has ids.
    most = F.max("docs").over(Window.partitionBy("a"))
    known = counts.select("a", "b", "docs", (F.col("docs") == most).alias("top"))
    answers = pairs.select("block", "a", "b").join(known, ["a", "b"]).select("block", "a", "b", "docs", "top")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, result).withColumnRenamed(ident, id_col)
