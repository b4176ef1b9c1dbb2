"""Session and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC) and AQE; everything else is the cluster's."""
    builder = (
        SparkSession.builder.master(master)
        .appName("headwater")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # a checkpoint goes when nothing refers to it any more
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's own reader, so any file system that Spark knows will do."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written stages: the one that the session names in spark.checkpoint.dir.

    Where none is named, a local session gets one of its own; on a cluster that is an error, as executors share no local disk.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="headwater-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete written files, in any store that Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
