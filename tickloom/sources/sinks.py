"""Result writers: ranked exports, detail and summary tables, retention and idempotent publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import split_rank
from tickloom.functions.scalars import HORIZONS, canonical_hash

EXPORT_METRICS = ("expected_return", "p_positive", "p_recovery", "score")
DETAIL_COLUMNS = ("bars", "signals", "validation", "features", "samples")
PREDICTION_FIELDS = (
    "expected_return", "p_positive", "p_recovery", "target_date", "entry_date", "eligible", "n", "score", "q10", "q90",
)


def _export_rows(estimates: DataFrame, securities: DataFrame) -> DataFrame:
    return estimates.join(securities.select("symbol", "name", "kind"), "symbol").select(
        F.col("anchor_date").alias("as_of"), "symbol", "name", "kind", "horizon", "target_date", "expected_return", "p_positive",
        "p_recovery", "q10", "q90", "n", "eligible", F.array_join("reasons", "；").alias("reasons"), "score",
    )


def _positions(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Best value first, missing values after all others, ties by symbol."""
    return split_rank(rows, groups, value, ["symbol"]).drop("position_of")


def ranked_export(estimates: DataFrame, securities: DataFrame, horizon: int, metric: str) -> DataFrame:
    """The export table of one horizon ordered by one metric."""
    if horizon not in HORIZONS or metric not in EXPORT_METRICS:
        raise ValueError("unknown horizon or metric")
    rows = _export_rows(estimates.filter(F.col("horizon") == horizon), securities).withColumn("metric", F.lit(metric))
    return _positions(rows, ["horizon"], metric).drop("score")


def all_exports(estimates: DataFrame, securities: DataFrame) -> DataFrame:
    """Every horizon x metric export as one table keyed by (horizon, metric): one pass, then a partitioned write."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in EXPORT_METRICS])
    rows = _export_rows(estimates, securities).select("*", F.inline(pairs))
    return _positions(rows, ["horizon", "metric"], "value")


def write_exports(exports: DataFrame, path: str, snapshot_id: str) -> None:
    """CSV per (snapshot, horizon, metric), rows in position order inside each range-partitioned file."""
    ordered = exports.withColumn("snapshot_id", F.lit(snapshot_id)).repartitionByRange("horizon", "metric", "position")
    (
        ordered.sortWithinPartitions("horizon", "metric", "position")
        .write.mode("overwrite")
        .option("header", True)
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 1_000_000)
        .partitionBy("snapshot_id", "horizon", "metric")
        .csv(path)
    )


def brief_rows(rows: DataFrame) -> DataFrame:
    """Summary rows: everything but the heavy detail columns."""
    return rows.drop(*DETAIL_COLUMNS)


def write_details(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1_000_000).partitionBy("snapshot_id").json(path)


def home_rows(candidates: DataFrame, featured: DataFrame) -> DataFrame:
    """Candidates (as_of, symbol, ...) with gaps filled from the bar of their day; present values are never replaced."""
    source = featured.filter("has_features").select(
        F.col("date").alias("as_of"),
        "symbol",
        F.col("close").alias("_close"),
        F.round("momentum5", 2).alias("_momentum5_pct"),
        F.round("momentum20", 2).alias("_momentum20_pct"),
        F.round("volume_ratio", 2).alias("_relative_volume"),
    )
    joined = candidates.join(source, ["as_of", "symbol"], "left")
    fill = {c: F.coalesce(F.col(c), F.col("_" + c)) for c in ("close", "momentum5_pct", "momentum20_pct", "relative_volume") if c in candidates.columns}
    return joined.withColumns(fill).select(*candidates.columns)


def retention_plan(manifest: DataFrame, keep: int = 3) -> DataFrame:
    """Which snapshots keep full detail. The manifest has one row per snapshot."""
    newest = Window.orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return manifest.select("snapshot_id", (F.row_number().over(newest) <= keep).alias("full_detail"))


def compact_rows(rows: DataFrame) -> DataFrame:
    """Old snapshots keep identity and the prediction fields only."""
    return rows.select("snapshot_id", "symbol", "kind", "horizon", *[c for c in PREDICTION_FIELDS if c in rows.columns])


def compact_history(rows: DataFrame, manifest: DataFrame, path: str, keep: int = 3) -> None:
    """Rewrite the partitions of snapshots that lost full detail; other partitions are untouched."""
    old = retention_plan(manifest, keep).filter("NOT full_detail").select("snapshot_id")
    pruned = compact_rows(rows.join(F.broadcast(old), "snapshot_id", "left_semi"))
    pruned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def content_signature(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Order-free content signature per group: row hashes are summed exactly, so no group is gathered or sorted."""
    columns = [F.col(c) for c in sorted(rows.columns) if c not in groups]
    digest = canonical_hash(*columns)
    limb = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(limb(1 + 15 * i)).alias(f"_s{i}") for i in range(4)]
    return (
        rows.groupBy(*groups)
        .agg(F.count("*").alias("rows"), *sums)
        .select(*groups, "rows", F.sha2(F.concat_ws("|", "rows", *[f"_s{i}" for i in range(4)]), 256).alias("signature"))
    )


def publish(rows: DataFrame, manifest: DataFrame, path: str, snapshot_id: str, as_of: Column, created_at: Column) -> bool:
    """Write a snapshot and its manifest row unless the same content is already the latest; dates may not go back.

    The rows land first and the manifest row last, so a reader never sees a half-written snapshot.
    """
    signature = content_signature(rows, []).first()
    latest = manifest.orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(1).collect()
    day = rows.sparkSession.range(1).select(as_of.alias("d")).first()["d"]
    if latest:
        if latest[0]["signature"] == signature["signature"]:
            return False
        if latest[0]["as_of"] > day:
            raise ValueError("source data is older than the published snapshot")
    rows.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "snapshot_id"
    ).parquet(f"{path}/rows")
    row = rows.sparkSession.range(1).select(
        F.lit(snapshot_id).alias("snapshot_id"), as_of.alias("as_of"), created_at.alias("created_at"), F.lit(signature["signature"]).alias("signature")
    )
    row.write.mode("append").parquet(f"{path}/manifest")
    return True
