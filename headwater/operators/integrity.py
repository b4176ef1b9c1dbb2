"""Reference, duplicate, null, checksum and range checks; seeded order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dangling(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children whose non-null key has no parent; a null key is unknown, not dangling."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (partial aggregation keeps hot keys cheap)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def null_profile(df: DataFrame, column: Column) -> list[Column]:
    """Aggregates: rows, known values, unknown values."""
    return [F.count(F.lit(1)).alias("n"), F.count(column).alias("n_known"), F.count(F.when(column.isNull(), 1)).alias("n_null")]


def checksum_mismatch(content: Column, listed: Column) -> Column:
    """True, false, or null where either side is unknown."""
    return F.sha2(content, 256) != F.lower(listed)


def clip(df: DataFrame, lon: str, lat: str, box: tuple[float | None, float | None, float | None, float | None]) -> DataFrame:
    """Rows inside the box (min_lon, max_lon, min_lat, max_lat), bounds inclusive; a null bound does not clip.

    Plain range predicates, so they reach the Parquet scan.
    """
    for name, low, high in ((lon, box[0], box[1]), (lat, box[2], box[3])):
        if low is not None:
            df = df.where(F.col(name) >= low)
        if high is not None:
            df = df.where(F.col(name) <= high)
    return df


def seeded_key(column: Column, seed: int) -> Column:
    """An order that depends on the value and the seed only, never on partitions or row order."""
    return F.md5(F.concat_ws("-", column.cast("string"), F.lit(str(seed))))


def seeded_sample(df: DataFrame, column: str, seed: int, k: int) -> DataFrame:
    """The k rows that come first in the seeded order (top-k per partition, then a merge)."""
    return df.withColumn("_key", seeded_key(F.col(column), seed)).orderBy("_key", column).limit(k).drop("_key")


def margins(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates over several sets of the dimensions in one shuffle, with ``margin``: bit by bit, first dimension first, whether it is summed over.

    A dimension that is summed over is null; ``margin`` tells that apart from a null value. Sums of one scan are partial before the shuffle.
    """
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(F.grouping_id(*dims).alias("margin"), *aggregates)
