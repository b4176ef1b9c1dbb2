"""Data inventory: which files are there, told from directory metadata only."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The sub-directories of a data directory and the placeholder that does not count.
SUBDIRECTORIES = ("raw", "interim", "processed")
PLACEHOLDER = ".gitkeep"


def listing(spark: SparkSession, data_dir: str | Path) -> DataFrame:
    """(directory, name, present): a row per entry, and a row with null name for a directory that is empty or missing."""
    rows: list[tuple[str, str | None, bool]] = []
    for sub in (*SUBDIRECTORIES, "manifests"):
        here = Path(data_dir) / sub
        there = here.is_dir()
        rows += [(sub, e.name, True) for e in os.scandir(here)] if there else []
        rows.append((sub, None, there))
    return spark.createDataFrame(rows, "directory string, name string, present boolean")


def counts(entries: DataFrame) -> DataFrame:
    """(directory, present, n): entries but for the placeholder; among manifests only names ending in .yaml."""
    wanted = F.when(F.col("directory") == "manifests", F.col("name").endswith(".yaml")).otherwise(F.col("name") != PLACEHOLDER)
    return entries.groupBy("directory").agg(F.bool_or("present").alias("present"), F.count(F.when(wanted, 1)).alias("n"))


def all_empty(per_directory: DataFrame) -> DataFrame:
    """One row: whether every existing data directory is empty; true if none exists."""
    held = per_directory.where(F.col("present") & F.col("directory").isin(*SUBDIRECTORIES))
    return held.agg(F.coalesce(F.bool_and(F.col("n") == 0), F.lit(True)).alias("all_empty"))


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(name, directory) of the entries of a folder in any store that Spark knows; none if the folder is missing.

    Directory metadata only, listed by the driver: no file is opened.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = [(e.getPath().getName(), bool(e.isDirectory())) for e in fs.listStatus(path)] if fs.exists(path) else []
    return spark.createDataFrame(rows, "name string, directory boolean")


def manifest_report(spark: SparkSession, manifests: DataFrame, raw_glob: str) -> DataFrame:
    """``compare_manifests`` against the files of a glob; their content is hashed on the executors."""
    files = spark.read.format("binaryFile").load(raw_glob).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("actual"))
    return compare_manifests(manifests, files)


def compare_manifests(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (filename, checksum_sha256) against files (filename, actual SHA-256): ok, differs, absent or unlisted."""
    status = (
        F.when(F.col("actual").isNull(), "absent").when(F.col("listed").isNull(), "unlisted")
        .when(F.lower("checksum_sha256") == F.col("actual"), "ok").otherwise("differs")
    )
    return manifests.withColumn("listed", F.lit(True)).join(files, "filename", "full_outer").withColumn("status", status).drop("listed")
