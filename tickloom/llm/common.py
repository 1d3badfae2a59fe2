"""Helpers shared by the corpus operators: reading tables, batch size, written intermediate tables, byte words."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import checkpoint_dir

# bytes.split() without arguments cuts at exactly these six characters: 0x20 and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"
# Words of letters and digits: every other ASCII byte becomes a space, A-Z become a-z, bytes from 0x80 stay.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
# Rows in one Arrow batch: texts may be long, and a batch of every column is held in a Python worker at once.
BATCH_ROWS = 256
# Spark's option to delete a query's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path may be any that Spark can read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def parked(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to a new folder under the shared checkpoint folder and read it back.

    It cuts the lineage, so that a lost executor repeats one scan and not the work before it.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")  # else its shuffle files stay until the driver collects garbage
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.parked_at = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete parked tables whose last reader has been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.parked_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return raw(text).lower().split()


def plain_words(text: str | None) -> list[bytes]:
    """Words of a-z, 0-9 and non-ASCII characters after lower-casing A-Z, as UTF-8."""
    return raw(text).translate(_PLAIN).split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of `size` words joined by a space, repeats included; fewer words give the whole sequence, none nothing."""
    line = b" ".join(words)
    if len(words) <= size:
        return [line] if words else []
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[size:]] + [len(line)]
    return [line[a:b] for a, b in zip(starts, ends)]
