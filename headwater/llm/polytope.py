"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A hash function turns the unit vector by three rounds of random signs and a fast Hadamard transform and names the nearest
of the 2d signed axes. ``HASHES`` of them give a bucket; ``TABLES`` tables are independent. A vector stands in its own bucket of
each table and also asks in the ``PROBES`` next likely ones, in order of the squared gaps between its largest coordinates.
Two vectors meet where one's own bucket is the own or an asked bucket of the other; at cosine 0.95 and 64 components that
misses about one pair in five thousand in all tables, at 0.97 hardly any.

Pairs that meet first pass an exact bound: the distance of 16 turned and rounded coordinates, which travel with the bucket rows
as two longs, cannot exceed that of the whole vectors. What passes is verified in double precision on the vectors.

Thousands of near copies of one vector share their buckets. A bucket with over ``DENSE`` vectors yields a centre, and
the vectors within half the threshold's angle of it are its core: by the triangle inequality all pairs of a core are linked.
So they are counted, never listed, and only pairs of different cores, or with a vector of no core, are joined.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.shared import bounded, components, cut, tidy

THRESHOLD = 0.95
HASHES = 3
TABLES = 10
PROBES = 2
#: Axes of each hash function that probes choose from.
CHOICES = 3
SKETCH = 16
#: A rounded coordinate is in 1/360: under 0.36 of a unit vector's, larger ones are cut, which only shortens distances.
SCALE = 360
#: Own buckets of the first two tables with more vectors than this are looked at for a centre; so many of them are looked at, and so many have to be near each other.
DENSE, PICKS, ALIKE = 64, 32, 8
#: Tables in which cores are looked for.
CORE_TABLES = 3


@lru_cache(maxsize=16)
def _signs(width: int, table: int) -> np.ndarray:
    """(hashes, 3, width) of -1 and 1; table -1 turns the sketch."""
    return np.random.default_rng([31, width, table + 1]).choice([-1.0, 1.0], (1 if table < 0 else HASHES, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of each row (a power of two long)."""
    n, width = x.shape
    h = 1
    while h < width:
        v = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([v[:, :, :1] + v[:, :, 1:], v[:, :, :1] - v[:, :, 1:]], 2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, table: int, probes: int = PROBES) -> np.ndarray:
    """(n, 1 + probes) buckets of unit vectors, the own one first, then the likeliest others."""
    width = x.shape[1]
    axes, gaps = [], []
    for signs in _signs(width, table):
        y = rotate(x, signs)
        size = np.abs(y)
        top = np.argsort(-size, axis=1, kind="stable")[:, :CHOICES]
        size = np.take_along_axis(size, top, 1)
        axes.append(2 * top + (np.take_along_axis(y, top, 1) > 0))
        gaps.append((size[:, :1] - size) ** 2)
    codes, costs = [], []
    for choice in itertools.product(range(min(CHOICES, width)), repeat=HASHES):
        code, cost = np.zeros(len(x), np.int64), np.zeros(len(x))
        for a, g, i in zip(axes, gaps, choice, strict=True):
            code, cost = code * (2 * width) + a[:, i], cost + g[:, i]
        codes.append(code)
        costs.append(cost)
    code, cost = np.stack(codes, 1), np.stack(costs, 1)
    cost[:, 0] = -1  # ties never displace the own bucket
    return np.take_along_axis(code, np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes], 1)


def sketches(x: np.ndarray) -> np.ndarray:
    """(n, 2) longs: sixteen rounded coordinates of the turned vector, a byte each."""
    y = rotate(x, _signs(x.shape[1], -1)[0])[:, :SKETCH]
    return np.ascontiguousarray(np.clip(np.rint(y * SCALE), -127, 127).astype(np.int8)).view(np.int64)


def _within(cosine: float) -> int:
    """The largest squared distance of two sketches whose vectors have this cosine at least."""
    return math.floor((math.sqrt(2 - 2 * cosine) * SCALE + math.sqrt(SKETCH)) ** 2)


def _distance(a: str, b: str) -> Column:
    """Squared distance of two sketches, byte by byte in generated code."""
    total: Column | None = None
    for half in ("s1", "s2"):
        for byte in range(8):
            x, y = (F.shiftright(F.shiftleft(F.col(f"{side}.{half}"), 56 - 8 * byte), 56) for side in (a, b))
            total = (x - y) * (x - y) if total is None else total + (x - y) * (x - y)
    return total


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by length; null, zero and empty vectors and those with a null or non-finite component are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become nan
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    at = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        x = flat[at[rows][:, None] + np.arange(size)]
        most = np.abs(x).max(1)
        good = np.isfinite(most) & (most > 0)
        x = x[good] / most[good, None]  # squares neither overflow nor vanish
        yield rows[good], x / np.sqrt((x * x).sum(1))[:, None]


def _padded(x: np.ndarray) -> np.ndarray:
    width = max(SKETCH, 1 << (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


_CODED = "code long, rid long, core long, own boolean, s1 long, s2 long"


def _coded(tables: range, probes: int, step: int = 4096):
    """Rows of the buckets of each vector; vectors of another length have other buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                for rows, x in units(batch.column("vec")):
                    size = x.shape[1]
                    x = _padded(x)
                    sketch, kept = sketches(x), batch.select(["rid", "core"]).take(pa.array(rows))
                    for table in tables:
                        found = buckets(x, table, probes) * TABLES + table
                        # 64 components and the like stay readable; other lengths are told apart by a hash.
                        found = found ^ np.int64(np.uint64(size * 0x9E3779B97F4A7C15 & (2**63 - 1)) & np.uint64(0x7FFFFF0000000000))
                        for i in range(found.shape[1]):
                            n = len(rows)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(found[:, i]), kept.column("rid"), kept.column("core"), pa.array(np.full(n, i == 0)), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                                ["code", "rid", "core", "own", "s1", "s2"],
                            )

    return run


def _codes(vectors: DataFrame, tables: range, probes: int) -> DataFrame:
    return vectors.select("rid", "core", "vec").mapInArrow(tidy(_coded(tables, probes)), _CODED)


def _cosines(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of pairs of valid vectors, in double precision; vectors of different lengths have none."""
    out = np.full(len(a), -2.0)
    left, right = {}, {}
    for side, column in ((left, a), (right, b)):
        for rows, x in units(column):
            side[x.shape[1]] = rows, x
    for size in left.keys() & right.keys():
        (i, x), (j, y) = left[size], right[size]
        both, p, q = np.intersect1d(i, j, assume_unique=True, return_indices=True)
        out[both] = (x[p] * y[q]).sum(1)
    return out


def _verified(least: float, keep: list[str], step: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                yield batch.select(keep).filter(pa.array(_cosines(batch.column("va"), batch.column("vb")) >= least))

    return run


# Centres.


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per large bucket: the mean of the picks that are near the pick which most are near, if they are ``ALIKE`` at least."""
    for batch in batches:
        rid, size, vec = [], [], []
        for code, m, picks in zip(*(batch.column(k).to_pylist() for k in ("code", "m", "picks")), strict=True):
            by_length = [x for _, x in units(pa.array(picks, pa.list_(pa.float64())))]
            x = max(by_length, key=len)
            near = x @ x.T >= THRESHOLD
            best = near.sum(1).argmax()
            if near[best].sum() >= ALIKE:
                rid.append(code)
                size.append(m)
                vec.append(x[near[best]].mean(0))
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(size, pa.int64()), pa.array(vec, pa.list_(pa.float64()))], ["rid", "m", "vec"])


def _centres(vectors: DataFrame) -> DataFrame | None:
    """(rid, m, vec, core) of the centres of large buckets; None if no bucket is large. At most ``PICKS`` vectors of a bucket meet."""
    own = _codes(vectors, range(2), 0).select("code", "rid")
    large = cut(own.groupBy("code").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > DENSE))
    if large.isEmpty():
        return None
    order = F.xxhash64(F.lit("pick"), "rid")
    members = own.join(bounded(large), "code")
    picked = members.groupBy("code", "m", F.pmod(order, F.lit(PICKS)).alias("bin")).agg(F.min(F.struct(order.alias("h"), "rid"))["rid"].alias("rid"))
    picked = vectors.select("rid", "vec").join(bounded(cut(picked.select("code", "m", "rid"))), "rid")
    picked = picked.groupBy("code", "m").agg(F.sort_array(F.collect_list(F.struct("rid", F.col("vec").cast("array<double>").alias("vec"))))["vec"].alias("picks"))
    return cut(picked.mapInArrow(tidy(_middles), "rid long, m long, vec array<double>").withColumn("core", F.lit(-1).cast("long")))


def _cores(vectors: DataFrame, threshold: float) -> DataFrame | None:
    """(rid, core): vectors within half the threshold's angle of a centre, each given to the largest bucket's; None if there are none."""
    found = _centres(vectors)
    if found is None:
        return None
    least = math.cos(math.acos(threshold) / 2) + 1e-9
    asked, own = _codes(found, range(CORE_TABLES), PROBES), _codes(vectors, range(CORE_TABLES), 0)
    near = asked.alias("c").join(own.alias("x"), (F.col("c.code") == F.col("x.code")) & (_distance("c", "x") <= _within(least)))
    near = cut(near.select(F.col("c.rid").alias("centre"), F.col("x.rid").alias("rid")).distinct())
    full = vectors.select("rid", F.col("vec").alias("va")).join(near, "rid").join(found.select(F.col("rid").alias("centre"), "m", F.col("vec").alias("vb")), "centre")
    inside = full.select("rid", "centre", "m", "va", "vb").mapInArrow(tidy(_verified(least, ["rid", "centre", "m"])), "rid long, centre long, m long")
    return cut(inside.groupBy("rid").agg(F.min(F.struct((-F.col("m")).alias("m"), "centre"))["centre"].alias("core")))


# Links.


def _meeting(own: DataFrame, every: DataFrame, within: int, more: Column | None = None) -> DataFrame:
    """(a, b) of the vectors that meet in a bucket and pass the exact bound, a < b, perhaps several times. AQE splits hot buckets."""
    a, b = F.col("x.rid"), F.col("y.rid")
    on = (F.col("x.code") == F.col("y.code")) & (~F.col("y.own") & (a != b) | (a < b)) & (_distance("x", "y") <= within)
    on = on if more is None else on & more
    return own.alias("x").join(every.alias("y"), on).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _apart(own: DataFrame, every: DataFrame, within: int) -> DataFrame:
    """Pairs of different cores in one bucket, joined core by core, so that no two of one core are ever looked at."""
    kinds = own.select("code", F.col("core").alias("one")).distinct()
    asked = every.select("code", F.col("core").alias("other")).distinct()
    both = cut(kinds.join(asked, "code").where("one <> other"))
    left = own.withColumnRenamed("core", "one").join(both, ["code", "one"]).select("code", "other", "rid", "own", "s1", "s2")
    right = every.join(both.select("code", F.col("other").alias("core")).distinct(), ["code", "core"]).select("code", "core", "rid", "own", "s1", "s2")
    return _meeting(left, right, within, F.col("x.other") == F.col("y.core"))


def links(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame | None]:
    """((a, b) of all verified links that no core settles, (rid, core) or None). ``vectors``: (rid, vec), checkpointed, rid unique."""
    plain = vectors.select("rid", "vec", F.lit(-1).cast("long").alias("core"))
    core, within = _cores(plain, threshold), _within(threshold)
    if core is None:
        met = _meeting(_codes(plain, range(TABLES), 0), _codes(plain, range(TABLES), PROBES), within)
    else:
        known = vectors.join(bounded(core), "rid", "left").select("rid", "vec", F.coalesce("core", F.lit(-1)).alias("core"))
        own, every = _codes(known, range(TABLES), 0), _codes(known, range(TABLES), PROBES)
        free, inside = F.col("core") < 0, F.col("core") >= 0
        met = _meeting(own.where(free), every, within).unionByName(_meeting(own.where(inside), every.where(free), within))
        met = met.unionByName(_apart(own.where(inside), every.where(inside), within))
    pairs = cut(met.distinct())
    full = pairs.join(vectors.select(F.col("rid").alias("a"), F.col("vec").alias("va")), "a").join(vectors.select(F.col("rid").alias("b"), F.col("vec").alias("vb")), "b")
    return cut(full.select("a", "b", "va", "vb").mapInArrow(tidy(_verified(threshold, ["a", "b"])), "a long, b long")), core


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept).

    n_links: other vectors linked directly; component_id: least id reachable by links; kept: whether that is the vector's own.
    Null, empty and zero vectors and those with a null or non-finite component have no links and are kept; vectors of different lengths are
    never linked. Very long vectors are padded to a power of two. Each row is a vector of its own: repeated rows link with each
    other, and rows with one id have one component_id each by their own links. A null id takes part; component_id is null where
    all ids of a component are, and the row is kept then. Ties cannot occur: the least id decides. An empty table gives
    none. Other columns, whatever their names, are not read.
    """
    kind = rows.schema[vec_col].dataType
    part = kind.elementType if isinstance(kind, T.ArrayType) else None
    vec = F.col(vec_col) if isinstance(part, (T.FloatType, T.DoubleType)) else F.col(vec_col).cast("array<double>")
    source = cut(rows.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("rid"), vec.alias("vec")))
    found, core = links(source.select("rid", "vec"), threshold)
    both = found.select(F.col("a").alias("rid")).unionByName(found.select(F.col("b").alias("rid")))
    counts, edges = both.groupBy("rid").agg(F.count(F.lit(1)).alias("n")), found
    if core is not None:
        sizes = core.groupBy("core").agg((F.count(F.lit(1)) - 1).alias("n"), F.min("rid").alias("least"))
        settled = cut(core.join(bounded(cut(sizes)), "core").select("rid", "n", "least"))
        counts = counts.unionByName(settled.select("rid", "n")).groupBy("rid").agg(F.sum("n").alias("n"))
        edges = edges.unionByName(settled.where("rid <> least").select(F.col("rid").alias("a"), F.col("least").alias("b")))
    roots = components(edges).withColumnRenamed("node", "rid")
    named = source.select("id", "rid").join(counts.join(roots, "rid", "full_outer"), "rid", "left")
    named = cut(named.select("id", "rid", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "root"))
    least = named.where("root is not null or n_links > 0").groupBy(F.coalesce("root", "rid").alias("root")).agg(F.min("id").alias("least"))
    alone = named.where("root is null and n_links = 0").select("id", "n_links", F.col("id").alias("component_id"))
    joined = named.where("root is not null or n_links > 0").withColumn("root", F.coalesce("root", "rid")).join(least, "root")
    out = alone.unionByName(joined.select("id", "n_links", F.col("least").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
