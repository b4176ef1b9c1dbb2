"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed 5-word shingles. Equal sets are one class from the start. Every class has a signature
of 96 minimum hashes, its embedded tokens. A path starts at each of a few independent runs; a record follows those of
its tokens whose hash with the path falls under a threshold, so records that share a chosen token share the child.
Buckets of at most ``LIMIT`` records are brute-forced; larger ones are split again. A large bucket that splitting does not
part, as most of it are near copies of one text, gets a centre (``dense``): the links of its core are counted by their
differences from the centre, and the core leaves the bucket. What is left at the last depth is compared block by block.

Recall: at similarity s a pair shares each token with chance s, so with a mean of ``BRANCH`` chosen shared tokens at
s = 0.8 the branching process of one run dies out with chance q = exp(-BRANCH (1 - q)); runs repeat until
q ** runs <= 1 - TARGET. A pair that meets in several buckets counts in the least of them only.

Links are verified exactly on the shingle sets. Pairs never leave a task: each bucket yields, per record, its number
of links and the least record that it is connected to. Records are numbered classes, so null and repeated ids do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm import dense
from headwater.llm import words as W
from headwater.llm.dense import matrix as _matrix
from headwater.llm.shared import bounded, components, cut, fresh, tidy

THRESHOLD = 0.8
TOKENS = 96
BRANCH = 3.0
TARGET = 0.999
LIMIT = 1536
DEPTH = 3
#: A child bucket that keeps this share of its parent, and still has no centre: splitting stops.
STUCK = 0.85
#: Matching tokens that a pair at the threshold has but for a chance under 1e-4 (four standard deviations).
LEAST_TOKENS = int(TOKENS * THRESHOLD - 4 * math.sqrt(TOKENS * THRESHOLD * (1 - THRESHOLD)))

_RNG = np.random.default_rng(20_240_229)
_A = _RNG.integers(1, 2**63, TOKENS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64)


def runs_needed(branch: float = BRANCH, target: float = TARGET) -> int:
    q = 0.0
    for _ in range(500):
        q = math.exp(-branch * (1 - q))
    return max(1, math.ceil(math.log(1 - target) / math.log(q)))


def _signature(members: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, 2**64 - 1, np.uint64)
    for at in range(0, len(members), 2048):  # bounded for very long texts
        out = np.minimum(out, ((members[at : at + 2048, None] * _A) + _B).min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    w = W.words(texts)
    s, at = W.shingles(w.hash, w.offsets)
    for i in range(len(at) - 1):
        yield np.unique(s[at[i] : at[i + 1]])


def _key(members: np.ndarray) -> tuple[int, int]:
    if not len(members):
        return 0, 0
    return int(members.sum().view(np.int64)), int(W.mix(members + np.uint64(len(members))).sum().view(np.int64))


_SKETCH = "id long, h long, n long, k1 long, k2 long, sig binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            n, k1, k2, sig = [], [], [], []
            for members in _sets(W.as_strings(piece.column("text"))):
                a, b = _key(members)
                n.append(len(members))
                k1.append(a)
                k2.append(b)
                sig.append(_signature(members).tobytes() if len(members) else None)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), piece.column("h"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())],
                ["id", "h", "n", "k1", "k2", "sig"],
            )


def _split(level: int, runs: int):
    """Follow the chosen tokens: from a run's root at level 1, from the record's path below."""
    chance = np.uint64(min(1.0, BRANCH / (THRESHOLD * TOKENS)) * (2**64 - 1))
    place = W.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                tokens = W.mix(_matrix(b.column("sig"), np.uint32).astype(np.uint64) + place)
                rep = b.column("rep").to_numpy()
                if level == 1:
                    roots = [(np.full(len(rep), r + 1, np.uint64), np.zeros(len(rep), np.int64)) for r in range(runs)]
                else:
                    roots = [(b.column("path").to_numpy().view(np.uint64), b.column("m").to_numpy())]
                for path, parent in roots:
                    h = W.mix(tokens ^ W.mix(path * np.uint64(0xD1342543DE82EF95) + np.uint64(level))[:, None])
                    i, j = np.nonzero(h < chance)
                    child = W.mix(h[i, j] + np.uint64(1)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(rep[i]), pa.array(parent[i])], ["path", "rep", "parent"])

    return follow


def _seen_before(lists: list[np.ndarray], leaf: int) -> np.ndarray:
    """Whether two records also share a lesser leaf: there their pair counts."""
    m = len(lists)
    sizes = np.fromiter((len(x) for x in lists), np.int64, m)
    flat, row = np.concatenate(lists), np.repeat(np.arange(m), sizes)
    row, flat = row[flat < leaf], flat[flat < leaf]
    values, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    return dense.shared(row, col, n, m) > 0


def _facing(g: pa.Table) -> np.ndarray | None:
    """In a cell of two blocks only pairs across them count; None: all pairs."""
    side = g["side"].to_numpy()
    return side[:, None] != side[None, :] if g["ci"][0].as_py() != g["cj"][0].as_py() else None


_CELL = ["leaf", "ci", "cj"]
_KEPT = [*_CELL, "side", "rep", "n", "copies", "leaves", "core", "centres"]
_KINDS = "leaf long, ci int, cj int, side int, rep long, n long, copies long, leaves array<long>, core long, centres array<long>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: the records that have a partner whose signature agrees enough, where this bucket decides."""
    for g in W.grouped(batches, _CELL):
        m = g.num_rows
        if m < 2:
            continue
        sig, n = _matrix(g["sig"], np.uint32), g["n"].to_numpy()
        ok = np.zeros((m, m), bool)
        for i in range(m - 1):
            near = (sig[i + 1 :] == sig[i]).sum(1) >= LEAST_TOKENS
            ok[i, i + 1 :] = near & (np.minimum(n[i + 1 :], n[i]) >= THRESHOLD * np.maximum(n[i + 1 :], n[i]) - 1e-9)
        ok |= ok.T
        facing = _facing(g)
        if facing is not None:
            ok &= facing
        done = dense.settled(g["core"].to_numpy(), dense.lists(g["centres"]))
        if done is not None:
            ok &= ~done
        if not ok.any():
            continue
        ok &= ~_seen_before(dense.lists(g["leaves"]), g["leaf"][0].as_py())
        hit = ok.any(1)
        if hit.any():
            yield from g.select(_KEPT).filter(pa.array(hit)).to_batches()


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the rows that asked for them, once each (``row``), whatever number of equal texts there are."""
    seen: set[int] = set()
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            keep, sets = [], []
            k1, k2, rows = (piece.column(k).to_pylist() for k in ("k1", "k2", "row"))
            for i, members in enumerate(_sets(W.as_strings(piece.column("text")))):
                if rows[i] not in seen and _key(members) == (k1[i], k2[i]):
                    seen.add(rows[i])
                    keep.append(i)
                    sets.append(members.tobytes())
            out = piece.drop_columns(["text", "k1", "k2", "row"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sets, pa.binary())], [*out.schema.names, "members"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket and record: links that count here, and the least record linked directly or through others."""
    for g in W.grouped(batches, _CELL):
        _, first = np.unique(g["rep"].to_numpy(), return_index=True)
        g = g.take(pa.array(np.sort(first)))
        m = g.num_rows
        if m < 2:
            continue
        rep, n, copies = g["rep"].to_numpy(), g["n"].to_numpy(), g["copies"].to_numpy()
        both = dense.overlaps([np.frombuffer(x, np.uint64) for x in g["members"].to_pylist()])
        # 4 / 5 of the union; products of whole numbers are exact in either type
        exact = np.float32 if n.max() < 1 << 20 else np.float64
        links = 9 * both.astype(exact) >= 4 * np.add.outer(n, n).astype(exact)
        np.fill_diagonal(links, False)
        facing = _facing(g)
        if facing is not None:
            links &= facing
        if not links.any():
            continue
        root = dense.roots(links, rep)
        done = dense.settled(g["core"].to_numpy(), dense.lists(g["centres"]))
        if done is not None:
            links &= ~done
        links &= ~_seen_before(dense.lists(g["leaves"]), g["leaf"][0].as_py())
        has = (root != rep) | links.any(1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rep[has]), pa.array(root[has]), pa.array(links.sum(1)[has].astype(np.int64)), pa.array((links @ copies)[has].astype(np.int64))],
            ["rep", "root", "texts", "docs"],
        )


_SET = ["k1", "k2", "n"]
_FOUND = "rep long, root long, texts long, docs long"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): a row is known by its id and a hash of its text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _joined(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketch: id, h, k1, k2, n, sig; named: k1, k2, n, rep, root, id, h, copies, texts, docs): see ``ngram_jaccard_join``."""
    runs = runs_needed()
    sketch = cut(source.mapInArrow(tidy(_sketch), _SKETCH))
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "h"))
    grouped = sketch.where("n > 0").groupBy(*_SET).agg(least.alias("x"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    members = cut(grouped.select(*_SET, "x.id", "x.h", "copies", "sig", F.monotonically_increasing_id().alias("rep")))

    def sets_of(rows: DataFrame, then=None, schema: str | None = None, beside=None) -> DataFrame:
        """``rows`` (with rep), joined with ``beside`` if given, and their shingle sets; or what ``then`` makes of these in the same worker."""
        known = members.select("rep", F.coalesce("id", F.lit(0)).alias("id0"), "h", "k1", "k2")
        asked = cut(known.join(bounded(rows), "rep").withColumn("row", F.monotonically_increasing_id()))
        texts = source.select(F.coalesce("id", F.lit(0)).alias("id0"), "h", "text").join(bounded(asked), ["id0", "h"]).drop("id0", "h")
        texts = texts if beside is None else texts.join(beside, "centre")
        if then is not None:
            return texts.mapInArrow(tidy(_with_sets, then), schema)
        kept = texts.drop("text", "k1", "k2", "row").schema
        return texts.mapInArrow(tidy(_with_sets), kept.add("members", "binary"))

    # Paths, level by level: only buckets that are still too large go on, without the cores of their centres.
    level, leaves, rows = 1, None, members.select("rep", "sig")
    core, measured = None, None
    while True:
        followed = cut(rows.mapInArrow(tidy(_split(level, runs)), "path long, rep long, parent long"))
        sizes = cut(followed.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        dealt = cut(followed.join(sizes, "path").select("path", "rep", "parent", "m"))
        large = dealt.where(F.col("m") > LIMIT)
        found = None if large.isEmpty() else dense.centres(large, members, sets_of, _signature, level)
        if found is not None:
            paths, middles = found
            more = dense.measured(large, paths, middles, members, sets_of)
            best = more.where(f"likeness >= {dense.CORE}").groupBy("rep").agg(F.min(F.struct((-F.col("likeness")).alias("d"), "centre"))["centre"].alias("core"))
            best = best if core is None else best.join(core.select("rep"), "rep", "left_anti").unionByName(core)
            core, measured = cut(best), more if measured is None else measured.unionByName(more)
            # Only the buckets of these centres change.
            few = bounded(paths.select("path").distinct())
            own = dealt.join(few, "path", "left_semi").drop("m")
            settled = own.join(core, "rep").join(bounded(paths.withColumnRenamed("centre", "core")), ["path", "core"]).select("path", "rep")
            left = cut(own.join(settled, ["path", "rep"], "left_anti"))
            again = left.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
            dealt = cut(dealt.join(few, "path", "left_anti").unionByName(left.join(again, "path")))
        final = (F.col("m") <= LIMIT) | F.lit(level == DEPTH) | (F.col("m") > STUCK * F.col("parent")) & (F.col("parent") > 0)
        done = dealt.where(final).select("path", "rep", "m")
        leaves = done if leaves is None else leaves.unionByName(done)
        rest = dealt.where(~final)
        if level == DEPTH or rest.isEmpty():
            break
        rows = members.select("rep", "sig").join(bounded(rest), "rep").select("rep", "sig", "path", "m")
        level += 1

    own = leaves.groupBy("rep").agg(F.array_sort(F.collect_set("path")).alias("leaves"))
    info = own.join(members.select("rep", "n", "copies", "sig"), "rep")
    none = F.array().cast("array<long>")
    if measured is None:
        info = info.select("*", F.lit(-1).cast("long").alias("core"), none.alias("centres"))
    else:
        # A record measured twice for one centre (at two levels) counts once.
        measured = cut(measured.dropDuplicates(["rep", "centre"]))
        cores = measured.groupBy("rep").agg(F.array_sort(F.collect_set("centre")).alias("centres")).join(core, "rep", "left")
        cores = cut(cores.select("rep", F.coalesce("core", F.lit(-1)).alias("core"), "centres"))
        info = info.join(cores, "rep", "left").withColumn("core", F.coalesce("core", F.lit(-1))).withColumn("centres", F.coalesce("centres", none))
    blocks = F.ceil(F.col("m") / LIMIT).cast("int")
    side = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    cells = (
        leaves.dropDuplicates(["path", "rep"]).withColumn("side", side).withColumn("other", F.explode(others))
        .select(F.col("path").alias("leaf"), F.least("side", "other").alias("ci"), F.greatest("side", "other").alias("cj"), "side", "rep")
    )
    full = cells.join(info, "rep").select(*_KEPT, "sig")
    near = cut(full.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(tidy(_candidates), _KINDS))
    links = sets_of(near).repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(tidy(_verify), _FOUND)
    found = cut(links if measured is None else links.unionByName(dense.count_links(measured, cores)))

    counts = found.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    named = members.drop("sig").join(counts.join(roots, "rep", "full_outer"), "rep", "left")
    return sketch, named.select(*_SET, "rep", F.coalesce("root", "rep").alias("root"), "id", "h", "copies", "texts", "docs")


def _winners(named: DataFrame) -> DataFrame:
    """(root, class_id, class_h): of each component, the least id (null: last) and its text's hash."""
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "h"))
    return named.groupBy("root").agg(least.alias("x")).select("root", F.col("x.id").alias("class_id"), F.col("x.h").alias("class_h"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, class_id, n_links, n_text_links, set_id).

    class_id: least id connected through links of Jaccard similarity >= 0.8; n_links: other documents linked
    directly, exact copies included; n_text_links: other shingle sets linked; set_id: least id with the same set.
    Null, empty and word-less texts have no shingles: no links, a class of their own. Texts of one to four words are one
    shingle. Repeated rows count as copies of each other. Null and repeated ids are no hindrance: each row is linked by its
    text; class_id and set_id are null where every document they stand for has a null id. Ids are cast to long. Very long
    texts are taken piece by piece. An empty table gives none. Other columns, whatever their names, are not read.
    """
    sketch, named = _joined(_source(docs, id_col, text_col))
    named = named.join(_winners(named), "root").select(*_SET, F.col("id").alias("set_id"), "class_id", "copies", "texts", "docs")
    out = sketch.select("id", *_SET).join(named, _SET, "left")
    alone = F.col("copies").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("docs", F.lit(0)), F.lit(0)).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        F.when(alone, F.col("id")).otherwise(F.col("set_id")).alias("set_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class stays: the one of the least id (null ids last, then by a hash of the text).

    All columns are returned, whatever their names. Rows without any word stay. Rows that repeat an id and a text are
    one document's: one of them stays. Of different texts under one id each is judged by its own class.
    """
    sketch, named = _joined(_source(docs, id_col, text_col))
    named = cut(named.join(_winners(named), "root"))
    own = sketch.where("n > 0").select("id", "h", *_SET).join(named.select(*_SET, "class_id", "class_h"), _SET)
    same = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))
    judged = cut(own.groupBy("id", "h").agg(F.max(same).alias("stays"), F.count(F.lit(1)).alias("n")))
    i, h = fresh(docs, "_near_id"), fresh(docs, "_near_hash")
    known = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias(i), F.xxhash64(F.col(text_col).cast("string")).alias(h))
    # A null id stands as 0 with another hash, so that both are plain keys.
    null = F.when(F.col("id").isNull(), F.xxhash64("h")).otherwise(F.col("h"))
    known = known.withColumn(h, F.when(F.col(id_col).isNull(), F.xxhash64(h)).otherwise(F.col(h)))
    keyed = judged.select(F.coalesce("id", F.lit(0)).alias(i), null.alias(h), "stays", "n")
    kept = known.join(bounded(keyed.where("not stays").select(i, h)), [i, h], "left_anti")
    again = cut(keyed.where("stays and n > 1").select(i, h))
    if not again.isEmpty():
        once = kept.join(bounded(again), [i, h], "left_semi").dropDuplicates([i, h])
        kept = kept.join(bounded(again), [i, h], "left_anti").unionByName(once)
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns])
