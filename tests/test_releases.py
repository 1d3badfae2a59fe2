"""Staged releases: what readers find after releases that succeed, change nothing, come too late or die half-way."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.sources import releases as X

SCHEMA = "symbol string, kind string, horizon int, score double, samples string"
ROWS = [("2330", "stock", 7, 1.5, "a"), ("2317", None, 7, None, ""), ("2330", "stock", 20, 2.5, None), ("2330", "stock", 20, 2.5, None)]


def go(rows, path, name, day, hour, **layout):
    return X.release(rows, path, name, F.lit(day), F.lit(datetime(2026, 10, 1, hour)), **layout)


def held(spark, path, rows, fmt="parquet"):
    return sorted((tuple(r) for r in X.released(spark, path, rows.schema, fmt).collect()), key=str)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_equal_content_is_not_released_and_dates_never_go_back(spark, tmp_path, fmt):
    path, rows = str(tmp_path / "out"), spark.createDataFrame(ROWS, SCHEMA)
    stored = [tuple(None if fmt == "csv" and v == "" else v for v in r) for r in ROWS]
    assert go(rows, path, "s1", "2026-10-01", 8, fmt=fmt, by=["horizon"], order=["symbol"]) == X.PUBLISHED
    assert go(rows.orderBy("symbol").repartition(3), path, "s2", "2026-10-01", 9, fmt=fmt) == X.UNCHANGED
    assert go(rows.limit(1), path, "s3", "2026-09-30", 10, fmt=fmt) == X.OLDER
    assert held(spark, path, rows, fmt) == sorted((("s1", *r) for r in stored), key=str)
    assert go(rows.filter("horizon = 7"), path, "s1", "2026-10-02", 11, fmt=fmt, by=["horizon"]) == X.PUBLISHED
    assert held(spark, path, rows, fmt) == sorted((("s1", *r) for r in stored[:2]), key=str)


def test_rows_without_a_manifest_row_are_never_met(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "out"), spark.createDataFrame(ROWS, SCHEMA)
    go(rows, path, "s1", "2026-10-01", 8)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(X, "_commit", dies)
        with pytest.raises(RuntimeError):
            go(rows.limit(1), path, "s1", "2026-10-02", 9)
    assert len(held(spark, path, rows)) == len(ROWS)
    assert X.sweep(spark, path) == 1 and len(held(spark, path, rows)) == len(ROWS)


def test_retention_of_a_history(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"s{i}", *r) for i in range(5) for r in ROWS], "snapshot_id string, " + SCHEMA)
    snapshots = spark.createDataFrame([(f"s{i}", "2026-10-01", datetime(2026, 10, 1 + i)) for i in range(6)], "snapshot_id string, as_of string, created_at timestamp")
    X.release_history(rows, snapshots, path)
    schema = rows.drop("snapshot_id").schema
    for _ in range(2):
        X.retain(spark, path, schema)
    assert X.history(spark, path).count() == 7
    found = X.released(spark, path, schema)
    kept = {r["snapshot_id"]: (r["n"], r["s"]) for r in found.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.max("samples").alias("s")).collect()}
    assert kept == {f"s{i}": (4, None if i < 2 else "a") for i in range(5)}
    assert X.sweep(spark, path) == 2 and X.released(spark, path, schema).filter("score IS NULL").count() == 5


def test_a_snapshot_without_rows(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.createDataFrame([], SCHEMA)
    assert go(rows, path, "s1", "2026-10-01", 8) == X.PUBLISHED and held(spark, path, rows) == []
    assert go(rows, path, "s2", "2026-10-01", 9) == X.UNCHANGED
