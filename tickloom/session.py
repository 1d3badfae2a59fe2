"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "tickloom") -> SparkSession:
    """A session for tests and the local bench; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.ui.retainedExecutions", "20")
        .getOrCreate()
    )


_folders: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _folders[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table once into the shared folder and read it back.

    Later queries scan the written columns instead of repeating the lineage, and a lost executor loses nothing.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

