"""Cutting lineage, connected components and deterministic row choices shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.session import set_checkpoint_folder

#: Rows of long identifiers that may be broadcast after they were counted: under 10 MB as a hash table.
BROADCAST_ROWS = 100_000


def tidy(*steps: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The steps one after another in one Python worker, which then gives its free memory back: workers live on through later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        try:
            yield from batches
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; an error on a cluster whose session names none."""
    set_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted and is small; as it is otherwise (then joins shuffle)."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(key: Column) -> Column:
    """Rows kept away from learning."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of the graph of ``edges`` (a, b longs): the root is the least node of the component.

    Alternating large-star and small-star rounds on checkpointed edges: each keeps the number of edges, and the
    depth falls geometrically. Neighbourhoods are never collected; each step is a min per node and a join, which AQE
    can split. Nothing comes to the driver but two sums a round.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(linked.select("a", F.col("m").alias("b")))
        now = cut(small.where("a <> b").distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
