"""Point and line sources named by a data source's ``format`` and ``raw_path``, and the sinks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.sources import grid, shapes

#: Formats that are read; any other is refused by name.
FORMATS = ("csv", "geojson", "shapefile", "ascii_grid")
_FEATURE = "struct<type: string, geometry: struct<type: string, coordinates: variant>, properties: variant>"


class UnsupportedFormat(ValueError):
    """A source or sink format that there is no reader or writer for here."""


def read_source(spark: SparkSession, fmt: str | None, path: str | None, schema: str | None = None) -> DataFrame:
    """Rows of one data source. CSV has a header and the given schema; malformed rows raise. The others: ``read_geojson``, ``shapes.read_shapes``, ``grid.read_grid``."""
    if not path:
        raise ValueError("the source has no raw_path")
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV source needs a schema: columns are never guessed")
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    if fmt == "geojson":
        return read_geojson(spark, path)
    if fmt == "shapefile":
        return shapes.read_shapes(spark, path)
    if fmt == "ascii_grid":
        return grid.read_grid(spark, path)
    raise UnsupportedFormat(f"format {fmt!r}; expected one of {', '.join(FORMATS)}")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(kind, coordinates, properties) of each feature; the last two are variants.

    A file is one FeatureCollection, or one feature a line (which Spark splits, however long the file is).
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    by_line = lines.where(~F.col("value").rlike(r'^\s*\{.*"Feature".*\}\s*,?\s*$')).limit(1).isEmpty()
    if by_line:
        features = lines.select(F.from_json(F.regexp_replace("value", r",\s*$", ""), _FEATURE).alias("f"))
    else:
        text = spark.read.text(path, wholetext=True)
        features = text.select(F.explode(F.from_json("value", f"struct<features: array<{_FEATURE}>>")["features"]).alias("f"))
    return features.select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def feature(kind: str, coordinates: Column, **properties: Column) -> Column:
    """One GeoJSON feature as text; null properties stay there as null."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties"),
        ),
        {"ignoreNullFields": "false"},
    )


def write_metrics(df: DataFrame, folder: str, experiment: str = "experiment") -> None:
    """JSON lines, one directory per experiment, so that a run replaces its own results only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy(experiment).json(folder)


def write_table(df: DataFrame, folder: str, experiment: str = "experiment") -> None:
    """CSV with a header, one directory per experiment."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy(experiment).csv(folder)


def write_routes(df: DataFrame, folder: str, kind: str, coordinates: Column, properties: dict[str, Column], experiment: str = "experiment") -> None:
    """GeoJSON features, one a line, one directory per experiment."""
    out = df.select(F.col(experiment), feature(kind, coordinates, **properties).alias("value"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(experiment).text(folder)


def latex_table(df: DataFrame, limit: int = 1000) -> str:
    """A result table for a paper: at most ``limit`` rows (more are refused), numbers as they are, special characters escaped."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for one LaTeX table")
    plain = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"} | {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"})
    cells = [[str(c).translate(plain) for c in df.columns], *[["--" if v is None else str(v).translate(plain) for v in r] for r in rows]]
    body = [" & ".join(r) + r" \\" for r in cells]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", body[0], r"\hline", *body[1:], r"\end{tabular}"])
