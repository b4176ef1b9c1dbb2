"""Raster grids in the ASCII form (a header of cell size and corner, then a line of numbers a row), as points of Spark rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The header's names; the last one may be missing. Fixed values.
HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


class BadGrid(ValueError):
    """A grid whose header or rows do not fit together."""


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, x, y, value): the cells of one or more grids, with the middle of each cell; cells without data have a null value.

    Lines come from Spark's own text reader, so any store will do and a large grid is read in parts: a line's number is its place
    within its part of the file and the number of lines in the parts before. Only those counts, one a part, are gathered per file. Row 0 is
    the northernmost. A header that lacks a name, a row of another length or another number of rows is an error.
    """
    part = ["file", "start"]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")
    )
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy(*part).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = lines.join(parts, part).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), F.split(F.trim("value"), r"\s+").alias("words"))
    # The header is the first lines that start with a letter; six at most.
    named = F.col("words")[0].rlike("^[A-Za-z]")
    head = placed.where((F.col("line") < len(HEADER)) & named)
    wanted = [F.max(F.when(F.lower(F.col("words")[0]) == h, F.col("words")[1])).try_cast("double").alias(h) for h in HEADER]
    head = head.groupBy("file").agg(F.count(F.lit(1)).alias("head"), *wanted)
    asked = lambda ok, what: F.when(ok, F.lit(None)).otherwise(F.raise_error(F.concat(F.lit(f"{what} in "), "file")))
    complete = F.lit(True)
    for h in HEADER[:-1]:
        complete = complete & F.col(h).isNotNull()
    rows = placed.where((F.col("line") >= len(HEADER)) | ~named).where(F.col("words") != F.array(F.lit("")))
    rows = rows.join(head, "file", "left").withColumn("row", F.col("line") - F.col("head"))
    fits = complete & (F.size("words") == F.col("ncols")) & (F.col("row") < F.col("nrows"))
    rows = rows.where(asked(fits, "a row that does not fit the header").isNull())
    cells = rows.select("file", "row", F.posexplode("words").alias("col", "text"), *HEADER)
    value = F.col("text").cast("double")
    x = F.col("xllcorner") + (F.col("col") + 0.5) * F.col("cellsize")
    y = F.col("yllcorner") + (F.col("nrows") - F.col("row") - 0.5) * F.col("cellsize")
    return cells.select("file", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), x.alias("x"), y.alias("y"), F.when(F.col("nodata_value").isNull() | (value != F.col("nodata_value")), value).alias("value"))


def write_grid(cells: DataFrame, folder: str, cols: int, rows: int, corner: tuple[float, float], size: float, nodata: float = -9999.0, tall: int = 256) -> None:
    """A grid from (row, col, value) as tiles of ``tall`` rows, each a grid file of its own with its own corner; missing and null cells get ``nodata``.

    A task holds a tile's lines, never the grid.
    """
    if not (cols > 0 and rows > 0 and size > 0 and tall > 0):
        raise BadGrid("a grid has cells of some size")
    spark = cells.sparkSession
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))))
    known = cells.where(F.col("value").isNotNull()).groupBy(F.col("row").cast("long").alias("row")).agg(entries.alias("held"))
    every = spark.range(rows).select(F.col("id").alias("row"), F.floor(F.col("id") / tall).alias("tile")).join(known, "row", "left")
    numbers = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.coalesce(F.try_element_at("held", c), F.lit(float(nodata))).cast("string"))
    body = every.select("tile", (F.col("row") + len(HEADER)).alias("line"), F.array_join(numbers, " ").alias("value"))
    tiles = spark.range(-(-rows // tall)).select(F.col("id").alias("tile"))
    own = F.least(F.lit(tall), F.lit(rows) - F.col("tile") * tall)
    low = F.lit(float(corner[1])) + F.lit(float(size)) * (rows - F.col("tile") * tall - own)
    values = (F.lit(cols), own, F.lit(float(corner[0])), low, F.lit(float(size)), F.lit(float(nodata)))
    lines = F.array(*[F.concat_ws(" ", F.lit(h), v.cast("string")) for h, v in zip(HEADER, values, strict=True)])
    head = tiles.select("tile", F.posexplode(lines).alias("line", "value")).select("tile", F.col("line").cast("long").alias("line"), "value")
    ordered = head.unionByName(body).repartition("tile").sortWithinPartitions("tile", "line")
    ordered.select("tile", "value").write.mode("overwrite").partitionBy("tile").text(folder)


def sample(points: DataFrame, cells: DataFrame, x: str, y: str, corner: tuple[float, float], size: float, name: str = "value") -> DataFrame:
    """``points`` with the value of the cell that each is in, null outside: a join by cell; lower and left edges belong to a cell."""
    at: Callable[[str, int], Column] = lambda c, axis: F.floor((F.col(c) - corner[axis]) / size)
    held = cells.select(at("x", 0).alias("_col"), at("y", 1).alias("_row"), F.col("value").alias(name))
    return points.withColumn("_col", at(x, 0)).withColumn("_row", at(y, 1)).join(held, ["_col", "_row"], "left").drop("_col", "_row")
