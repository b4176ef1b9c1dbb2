"""Dense groups of a similarity join: thousands of different, nearly equal sets, counted by their differences from a centre.

Splitting a bucket on shared tokens never parts near copies, and comparing all of them in every bucket is quadratic many
times over. Such a group gets a centre p: the shingles that at least half of a few sampled members have. With the removed
shingles A = p - x and the added ones B = x - p, for any two sets

    |x & y| = |p| - |Ax| - |Ay| + |Dx & Dy|,  D = A + B,

so with s(x) = 9 |Ax| + 4 |x| the pair is linked (Jaccard >= 0.8) exactly where 9 |Dx & Dy| >= s(x) + s(y) - 9 |p|. Pairs with
s(x) + s(y) <= 9 |p| are linked whatever their differences are: they are counted from a histogram of s, never listed. Only the
others are compared, on the small sets D, block by block in order of s; blocks that cannot hold a link are left out.

Members within 0.2 of the centre are its core, those within 0.4 its ring: by the triangle inequality of the Jaccard distance a
core member has no link beyond the ring. A record is in the core of one centre at most. The pairs of a core member with
the core and ring of its centre are settled here, and nowhere else (``settled``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm import words as W
from headwater.llm.shared import bounded, cut, tidy

#: Members of a large bucket that are looked at, how alike (share of signature) and how many of them show a dense group.
PICKS, ALIKE, DENSE = 32, 0.5, 8
CORE, RING = 0.8, 0.6
#: Agreement of signatures under which a ring member falls by chance only (three standard deviations under ``RING``).
LEAST_AGREEMENT = 0.45
#: Members of a block of a centre's members, in order of s.
BLOCK = 512
#: Shingles of centres that may be broadcast: 16 MB.
BROADCAST_SHINGLES = 2_000_000


def matrix(column, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[at[i] : at[i + 1]] for i in range(len(column))]


def shared(row: np.ndarray, col: np.ndarray, n: np.ndarray, m: int, chunk: int = 4096) -> np.ndarray:
    """Number of columns that two rows have in common, from the columns that at least two rows have."""
    out = np.zeros((m, m), np.float32)
    keep = n[col] > 1
    row, col = row[keep], col[keep]
    rank = np.cumsum(n > 1) - 1
    col = rank[col]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = min(chunk, max(64, (1 << 21) // max(m, 1)))  # 8 MB
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [low, low + width])
        a = np.zeros((m, width), np.float32)
        a[row[i:j], col[i:j] - low] = 1
        out += a @ a.T
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a few hundred sets."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(flat):
        return np.zeros((len(sets), len(sets)), np.float32)
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    return shared(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), col, count, len(sets))


def roots(links: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Least record of each record's component within the bucket, by shortcutting minimum labels."""
    order = np.argsort(rep, kind="stable")
    label = np.empty(len(rep), np.int64)
    label[order] = np.arange(len(rep))
    i, j = np.nonzero(links)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    return rep[order[label]]


def settled(core: np.ndarray, centres: list[np.ndarray]) -> np.ndarray | None:
    """Pairs that a centre has settled: it is the core centre of one and among the centres of the other. None: no pair."""
    known = np.unique(core[core >= 0])
    if not len(known):
        return None
    own = (core[:, None] == known).astype(np.float32)
    near = np.zeros_like(own)
    for i, c in enumerate(centres):
        near[i] = np.isin(known, c)
    out = own @ near.T > 0
    return out | out.T


# Centres.


def _medoids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per large bucket: the picked record that most picks are near, and these, if they are ``DENSE`` at least."""
    for batch in batches:
        path, centre, rep = [], [], []
        for p, picks in zip(batch.column("path").to_pylist(), batch.column("picks").to_pylist(), strict=True):
            sig = np.stack([np.frombuffer(x["sig"], np.uint32) for x in picks])
            near = np.stack([(sig == x).mean(1) >= ALIKE for x in sig])
            best = int(near.sum(1).argmax())
            if near[best].sum() >= DENSE:
                for i in np.flatnonzero(near[best]).tolist():
                    path.append(p)
                    centre.append(picks[best]["rep"])
                    rep.append(picks[i]["rep"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (path, centre, rep)], ["path", "centre", "rep"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for centre, members in zip(batch.column("centre").to_pylist(), batch.column("members").to_pylist(), strict=True):
            tokens = np.frombuffer(members, np.int64)
            for at in range(0, len(tokens), 1 << 16):
                own = tokens[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), centre)), pa.array(own)], ["centre", "token"])


def _signed(signature: Callable[[np.ndarray], np.ndarray]):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for centre, tokens in zip(batch.column("centre").to_pylist(), lists(batch.column("tokens")), strict=True):
                own = np.sort(tokens.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array([centre]), pa.array([own.tobytes()]), pa.array([len(own)]), pa.array([signature(own).tobytes()])], ["centre", "middle", "size", "csig"])

    return signed


def centres(large: DataFrame, members: DataFrame, sets_of: Callable[..., DataFrame], signature: Callable[[np.ndarray], np.ndarray], level: int) -> tuple[DataFrame, DataFrame] | None:
    """(path, centre) and (centre, middle, size, csig) of the dense groups in ``large`` (path, rep); None if there is none.

    Picks are the records of least hash in each of ``PICKS`` bins, the same whatever the bucket, so the buckets of one
    group mostly agree on a centre; equal centres are one. No bucket is ever collected.
    """
    order = F.xxhash64(F.lit("pick"), "rep")
    picked = large.groupBy("path", F.pmod(order, F.lit(PICKS)).alias("bin")).agg(F.min(F.struct(order.alias("h"), "rep")).alias("x"))
    picked = members.select("rep", "sig").join(bounded(cut(picked.select("path", "x.h", "x.rep"))), "rep")
    picked = picked.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("h", "rep", "sig"))).alias("picks"))
    found = picked.mapInArrow(tidy(_medoids), "path long, centre long, rep long")
    # A centre is another one at another level, as its picks are.
    found = cut(found.withColumn("centre", F.shiftrightunsigned(F.xxhash64(F.lit(level), "centre"), 1)))
    if found.isEmpty():
        return None
    own = found.select("centre", "rep").distinct()
    half = own.groupBy("centre").agg(F.count(F.lit(1)).alias("picks"))
    tokens = sets_of(own, _spread, "centre long, token long").groupBy("centre", "token").agg(F.count(F.lit(1)).alias("n"))
    tokens = tokens.join(half, "centre").where("2 * n >= picks").groupBy("centre").agg(F.collect_list("token").alias("tokens"))
    middles = cut(tokens.mapInArrow(tidy(_signed(signature)), "centre long, middle binary, size long, csig binary"))
    same = cut(middles.groupBy(F.sha2("middle", 256).alias("k")).agg(F.min("centre").alias("one"), F.collect_list("centre").alias("all")).select("one", F.explode("all").alias("centre")))
    paths = found.select("path", "centre").distinct().join(same, "centre").select("path", F.col("one").alias("centre"))
    return cut(paths), cut(middles.join(same.where("one = centre").select("centre"), "centre"))


# Members.


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            near = (matrix(batch.column("sig"), np.uint32) == matrix(batch.column("csig"), np.uint32)).mean(1) >= LEAST_AGREEMENT
            yield batch.select(["rep", "centre"]).filter(pa.array(near))


_MEASURED = "centre long, rep long, n long, copies long, removed long, size long, likeness double, diff binary"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, removed, likeness, diff = [], [], [], []
        for i, (mine, middle) in enumerate(zip(batch.column("members").to_pylist(), batch.column("middle").to_pylist(), strict=True)):
            x, p = np.frombuffer(mine, np.uint64), np.frombuffer(middle, np.uint64)
            d = np.setxor1d(x, p, assume_unique=True)
            both = (len(x) + len(p) - len(d)) // 2
            if 5 * both >= 3 * (len(x) + len(p) - both):
                keep.append(i)
                removed.append(len(p) - both)
                likeness.append(both / (len(x) + len(p) - both))
                diff.append(d.tobytes())
        own = batch.select(["centre", "rep", "n", "copies", "size"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*(own.column(k) for k in ("centre", "rep", "n", "copies")), pa.array(removed, pa.int64()), own.column("size"), pa.array(likeness, pa.float64()), pa.array(diff, pa.binary())],
            ["centre", "rep", "n", "copies", "removed", "size", "likeness", "diff"],
        )


def measured(large: DataFrame, paths: DataFrame, middles: DataFrame, members: DataFrame, sets_of: Callable[..., DataFrame]) -> DataFrame:
    """Core and ring of each centre among the records of its buckets: each record against each centre once, exactly."""
    total = middles.agg(F.sum("size")).first()[0] or 0
    small = (lambda df: F.broadcast(df)) if total <= BROADCAST_SHINGLES else (lambda df: df)
    pairs = cut(large.select("path", "rep").join(bounded(paths), "path").select("rep", "centre").distinct())
    near = members.select("rep", "sig").join(bounded(pairs), "rep").join(small(middles.select("centre", "csig")), "centre").select("rep", "centre", "sig", "csig").mapInArrow(tidy(_close), "rep long, centre long")
    rows = members.select("rep", "n", "copies").join(bounded(cut(near)), "rep")
    return cut(sets_of(rows, _measure, _MEASURED, small(middles.select("centre", "middle", "size"))))


# Counting.


def _blocks(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of each value of s of a centre: some values share a block, or one value has several."""
    n = g["total"].to_numpy()
    first, parts = np.empty(len(n), np.int64), np.maximum(1, -(-n // BLOCK))
    block, held = 0, 0
    for i in range(len(n)):
        if held and held + n[i] > BLOCK:
            block, held = block + 1, 0
        first[i] = block
        if parts[i] > 1:
            block, held = block + int(parts[i]), 0
        else:
            held += int(n[i])
    return first, parts


def _certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per centre and s: where its members go, and how many records a core or free member of this s is surely linked to."""
    for g in W.grouped(batches, ["centre"]):
        s, bound = g["s"].to_numpy(), 9 * g["size"][0].as_py()
        first, parts = _blocks(g)
        upto = np.searchsorted(s, bound - s, "right")
        sums = {k: np.concatenate([[0], np.cumsum(g[k].to_numpy())])[upto] for k in ("core_texts", "core_docs", "free_texts", "free_docs")}
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (g["centre"].to_numpy(), s, first, parts, *sums.values())], ["centre", "s", "first", "parts", *sums]
        )


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks that may hold a link which is not certain, or one of a core member with a member of another core."""
    for g in W.grouped(batches, ["centre"]):
        s, bound = g["s"].to_numpy(), 9 * g["size"][0].as_py()
        first, parts = _blocks(g)
        at = np.repeat(np.arange(len(s)), parts)
        block = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        low, high = np.minimum.reduceat(s[at], head), np.maximum.reduceat(s[at], head)
        widest = np.maximum.reduceat(g["widest"].to_numpy()[at], head)
        core = np.add.reduceat(g["core_texts"].to_numpy()[at], head) > 0
        other = np.add.reduceat(g["others"].to_numpy()[at], head) > 0
        number = block[head]
        for i in range(len(number)):
            may = low[i] + low[i:] - bound <= 9 * np.minimum(widest[i], widest[i:])
            open_ = (high[i] + high[i:] > bound) & (core[i] | core[i:]) | core[i] & other[i:] | other[i] & core[i:]
            j = i + np.flatnonzero(may & open_)
            ci, cj, own = np.full(len(j), number[i]), number[j], np.full(len(j), g["centre"][0].as_py())
            apart = cj != ci
            out = [np.concatenate([x, x[apart]]) for x in (own, ci, cj)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*out, np.concatenate([ci, cj[apart]]))], ["centre", "ci", "cj", "block"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell and record: links that are not certain, and the least record connected through them."""
    for g in W.grouped(batches, ["centre", "ci", "cj"]):
        m, p = g.num_rows, g["centre"][0].as_py()
        if m < 2:
            continue
        s, core, bound = g["s"].to_numpy(), g["core"].to_numpy(), 9 * g["size"][0].as_py()
        diff = [np.frombuffer(x, np.uint64) for x in g["diff"].to_pylist()]
        mine, free = core == p, core < 0
        other = ~mine & ~free
        over = np.add.outer(s, s - bound).astype(np.int32)  # s is bounded by a text's length
        links = 9 * overlaps(diff) >= over
        here = (mine[:, None] & (mine | free)[None, :]) & (over > 0)
        if other.any():
            names, place = np.unique(core[other], return_inverse=True)
            near = np.stack([np.isin(names, c) for c in lists(g["centres"])])
            first = (near & (names < p))[:, place]  # then the other's centre decides
            here[:, other] |= mine[:, None] & ~first
        links &= here | here.T
        if g["ci"][0].as_py() != g["cj"][0].as_py():
            block = g["block"].to_numpy()
            links &= block[:, None] != block[None, :]
        np.fill_diagonal(links, False)
        has = links.any(1)
        if has.any():
            rep, copies = g["rep"].to_numpy(), g["copies"].to_numpy()
            root = roots(links, rep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[has]), pa.array(root[has]), pa.array(links.sum(1)[has].astype(np.int64)), pa.array((links @ copies)[has].astype(np.int64))], ["rep", "root", "texts", "docs"]
            )


def count_links(rows: DataFrame, core: DataFrame) -> DataFrame:
    """(rep, root, texts, docs) of all settled pairs. ``rows``: ``measured``; ``core``: (rep, core, centres)."""
    own = F.col("core") == F.col("centre")
    free = F.col("core") < 0
    rows = cut(rows.join(core, "rep").withColumn("s", 9 * F.col("removed") + 4 * F.col("n")))
    some = lambda kind, value: F.sum(F.when(kind, value).otherwise(0))
    classes = cut(rows.groupBy("centre", "s").agg(
        F.first("size").alias("size"), F.count(F.lit(1)).alias("total"), F.max(F.length("diff") / 8).cast("long").alias("widest"),
        some(own, 1).alias("core_texts"), some(own, F.col("copies")).alias("core_docs"), some(free, 1).alias("free_texts"), some(free, F.col("copies")).alias("free_docs"),
        some(~own & ~free, 1).alias("others"),
    ))
    ordered = classes.repartition("centre").sortWithinPartitions("centre", "s")
    sure = cut(ordered.mapInArrow(tidy(_certain), "centre long, s long, first long, parts long, core_texts long, core_docs long, free_texts long, free_docs long"))
    cells = cut(ordered.mapInArrow(tidy(_cells), "centre long, ci long, cj long, block long"))
    hub = lambda kind: F.min(F.when(kind, F.struct("s", "rep")))
    hubs = cut(rows.groupBy("centre").agg(hub(own).alias("inner"), hub(free).alias("outer")))

    placed = cut(rows.join(sure, ["centre", "s"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))))
    bound = 9 * F.col("size")
    self_ = own & (2 * F.col("s") <= bound)
    texts = F.when(own, F.col("core_texts") + F.col("free_texts") - self_.cast("long")).when(free, F.col("core_texts")).otherwise(F.lit(0))
    docs = F.when(own, F.col("core_docs") + F.col("free_docs") - F.when(self_, F.col("copies")).otherwise(0)).when(free, F.col("core_docs")).otherwise(F.lit(0))
    # A certain link of anyone implies one to the core's least s, or to the least s beside the core.
    to: Callable[[str], Column] = lambda k: F.when(F.col("s") + F.col(f"{k}.s") <= bound, F.col(f"{k}.rep"))
    joined = placed.join(bounded(hubs), "centre").where(own | free).select("rep", texts.alias("texts"), docs.alias("docs"), to("inner").alias("a"), F.when(own, to("outer")).alias("b"))
    linked = joined.where("texts > 0")
    certain = linked.select("rep", F.coalesce("a", "b", "rep").alias("root"), "texts", "docs")
    more = linked.where("b is not null").select("rep", F.col("b").alias("root"), F.lit(0).cast("long").alias("texts"), F.lit(0).cast("long").alias("docs"))

    full = placed.select("centre", "block", "rep", "s", "size", "copies", "core", "centres", "diff").join(cells, ["centre", "block"])
    compared = full.repartition("centre", "ci", "cj").sortWithinPartitions("centre", "ci", "cj").mapInArrow(tidy(_compare), "rep long, root long, texts long, docs long")
    return certain.unionByName(more).unionByName(compared)
