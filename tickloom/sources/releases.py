"""Releases of snapshots: rows are staged in a folder of their own attempt and become visible by one manifest row.

A path holds ``rows/attempt=.../`` for every staged write and ``manifest/``. Readers take the attempts that the manifest names,
so a job that dies half-way, a refused release and the partitions of a replaced snapshot are never met. One job at a
time writes to a path; any number may read. CSV files don't tell an empty text from a missing one; both are read as null.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.sources.sinks import PREDICTION_FIELDS, content_signature

MANIFEST = "number long, snapshot_id string, as_of date, created_at timestamp, signature string, rows long, whole boolean, attempt string"
PUBLISHED, UNCHANGED, OLDER = "published", "unchanged", "older"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def history(spark: SparkSession, path: str) -> DataFrame:
    """All manifest rows ever committed."""
    found, fs = _path(spark, f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if fs.exists(found) else spark.createDataFrame([], MANIFEST)


def releases(spark: SparkSession, path: str) -> DataFrame:
    """The manifest row that counts for each snapshot: the last one committed."""
    rows = history(spark, path)
    row = F.struct(*[c for c in rows.columns if c != "snapshot_id"])
    return rows.groupBy("snapshot_id").agg(F.max_by(row, "number").alias("_m")).select("snapshot_id", "_m.*")


def _read(spark: SparkSession, folder: str, schema: StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def _write(rows: DataFrame, folder: str, fmt: str, by: Sequence[str], order: Sequence[str]) -> None:
    if order:
        rows = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    writer = rows.write.mode("errorifexists").format(fmt).option("maxRecordsPerFile", 1_000_000).partitionBy(*by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(folder)


def _commit(rows: DataFrame, path: str) -> None:
    """One file, so the rows become visible together."""
    rows.selectExpr("number", "snapshot_id", "as_of", "created_at", "signature", "rows", "whole", "attempt").coalesce(1).write.mode("append").parquet(
        f"{path}/manifest"
    )


def release(
    rows: DataFrame,
    path: str,
    snapshot_id: str,
    as_of: Column,
    created_at: Column,
    fmt: str = "parquet",
    by: Sequence[str] = (),
    order: Sequence[str] = (),
) -> str:
    """Release a snapshot, in files per value of ``by`` and rows ordered by ``order`` inside them.

    ``unchanged``: the content equals that of the last release, so nothing is committed. ``older``: its date lies before the
    last release's. The signature is taken from the staged files, so it tells what readers find, also if a plan would
    give other rows when run again.
    """
    spark = rows.sparkSession
    last = history(spark, path).filter("whole").orderBy(F.desc("number")).limit(1).collect()
    number = _next_number(spark, path)
    if last and spark.range(1).select(F.lit(last[0]["as_of"]) > as_of).first()[0]:
        return OLDER
    attempt = f"{number}-{uuid.uuid4().hex}"
    folder = f"{path}/rows/attempt={attempt}"
    _write(rows, folder, fmt, by, order)
    stored = content_signature(_read(spark, folder, rows.schema, fmt).select(*rows.columns), []).first()
    if last and last[0]["signature"] == stored["signature"]:
        found, fs = _path(spark, folder)
        fs.delete(found, True)
        return UNCHANGED
    _commit(
        spark.range(1).select(
            F.lit(number).cast("long").alias("number"),
            F.lit(snapshot_id).alias("snapshot_id"),
            as_of.cast("date").alias("as_of"),
            created_at.cast("timestamp").alias("created_at"),
            F.lit(stored["signature"]).alias("signature"),
            F.lit(stored["rows"]).cast("long").alias("rows"),
            F.lit(True).alias("whole"),
            F.lit(attempt).alias("attempt"),
        ),
        path,
    )
    return PUBLISHED


def _next_number(spark: SparkSession, path: str) -> int:
    return (history(spark, path).agg(F.max("number")).first()[0] or 0) + 1


def release_history(rows: DataFrame, snapshots: DataFrame, path: str) -> None:
    """Release all snapshots of ``rows`` (snapshot_id, ...) in one job, in the order of their creation.

    ``snapshots`` has snapshot_id, as_of and created_at, one row each; rows of other snapshots aren't released.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    first = _next_number(spark, path)
    numbered = snapshots.select(
        "snapshot_id",
        F.to_date("as_of").alias("as_of"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        (F.row_number().over(Window.orderBy("created_at", "snapshot_id")) + (first - 1)).cast("long").alias("number"),
    ).withColumn("attempt", F.concat_ws("-", "number", F.lit(run)))
    named = F.broadcast(numbered.select("snapshot_id", "attempt"))
    rows.join(named, "snapshot_id").drop("snapshot_id").write.mode("append").partitionBy("attempt").parquet(f"{path}/rows")
    kept = StructType([f for f in rows.schema if f.name != "snapshot_id"])
    staged = _read(spark, f"{path}/rows", StructType([*kept]).add("attempt", "string"), "parquet")
    signed = content_signature(staged.join(F.broadcast(numbered.select("attempt")), "attempt"), ["attempt"])
    _commit(numbered.join(signed, "attempt").withColumn("whole", F.lit(True)), path)


def released(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Rows of every released snapshot, with its ``snapshot_id``. Columns that retention took are null."""
    named = releases(spark, path).select("snapshot_id", "attempt")
    found = _read(spark, f"{path}/rows", StructType([*schema]).add("attempt", "string"), fmt)
    return found.join(F.broadcast(named), "attempt").select("snapshot_id", *schema.names)


def retain(spark: SparkSession, path: str, schema: StructType, keep: int = 3, fields: Sequence[str] = ("symbol", "kind", "horizon", *PREDICTION_FIELDS)) -> None:
    """All but the newest ``keep`` snapshots of a Parquet path keep only ``fields``: one job writes their rows anew and one
    commit replaces them, and a snapshot without full detail is not written again."""
    newest = Window.orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    number = _next_number(spark, path)
    old = releases(spark, path).withColumn("_r", F.row_number().over(newest)).filter((F.col("_r") > keep) & F.col("whole")).drop("_r")
    # One row per snapshot; taken once, because the manifest changes below.
    old = spark.createDataFrame(old.collect(), old.schema)
    if old.isEmpty():
        return
    renamed = old.withColumn("to", F.concat_ws("-", F.lit(number), F.lit(uuid.uuid4().hex), F.col("number").cast("string")))
    found = _read(spark, f"{path}/rows", StructType([*schema]).add("attempt", "string"), "parquet")
    moved = found.join(F.broadcast(renamed.select("attempt", "to")), "attempt").select(*[c for c in schema.names if c in fields], F.col("to").alias("attempt"))
    moved.write.mode("append").partitionBy("attempt").parquet(f"{path}/rows")
    _commit(renamed.withColumns({"number": F.lit(number).cast("long"), "whole": F.lit(False), "attempt": F.col("to")}), path)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete attempts no snapshot names; run it when no reader holds an earlier manifest and no release is under way."""
    named = {r["attempt"] for r in releases(spark, path).select("attempt").collect()}
    root, fs = _path(spark, f"{path}/rows")
    gone = 0
    for entry in fs.listStatus(root) if fs.exists(root) else []:
        name = entry.getPath().getName()
        if name.startswith("attempt=") and name[8:] not in named:
            gone += fs.delete(entry.getPath(), True)
    return gone
