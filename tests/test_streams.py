"""Keyed change state, repeated quotes and late rows, each in several runs from one checkpoint."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tickloom.operators import pit as T
from tickloom.streaming import jobs

ARRIVAL = "source string, symbol string, key string, data_date date, value double, acquired_at timestamp, published_at timestamp, seq long"
START = datetime(2026, 1, 1)


def land(df, source):
    df.repartition(2).write.mode("append").parquet(source)


def test_keyed_state_equals_a_scan(spark, tmp_path):
    """One busy identity, equal times, a null part of the identity (an identity like others), empty and repeated batches."""
    rng = random.Random(4)
    symbol = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    rows = [("s", symbol(), "w", date(2026, 1, 1), float(rng.randint(0, 1)), START + timedelta(minutes=i // 2), None, i) for i in range(160)]
    df = T.content_hashed(spark.createDataFrame(rows, ARRIVAL), "symbol", "key", "value")
    last, want = {}, []
    for _, name, _, _, value, at, _, seq in rows:
        before = last.get(name)
        if before is None or at > before[1]:
            want += [seq] if before is None or value != before[0] else []
            last[name] = (value, at)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for low, high in ((0, 60), (60, 100), (60, 100), (100, 100), (100, 160)):
        land(df.filter((F.col("seq") >= low) & (F.col("seq") < high)), source)
        jobs.capture_keyed_changes(jobs.file_stream(spark, source, df.schema), out, check).awaitTermination()
    found = spark.read.parquet(out)
    assert sorted(r["seq"] for r in found.collect()) == want
    assert found.filter("first_seen_at <> acquired_at OR available_at <> acquired_at").isEmpty()


def test_keyed_state_is_held_in_groups(spark, tmp_path):
    """Far more identities than groups: every change counts, and state has one value per group, not one per identity."""
    names = jobs.STATE_GROUPS * 3
    row = lambda day, i, v: ("s", str(i), "w", date(2026, 1, 1), float(v), START + timedelta(days=day), None, day * names + i)
    days = [[row(d, i, d == 2 and i % 7 == 0) for i in range(names)] for d in range(3)]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for day in days:
        df = T.content_hashed(spark.createDataFrame(day, ARRIVAL), "symbol", "key", "value")
        land(df, source)
        job = jobs.capture_keyed_changes(jobs.file_stream(spark, source, df.schema), out, check)
        job.awaitTermination()
    want = [r[-1] for r in days[0]] + [r[-1] for i, r in enumerate(days[2]) if i % 7 == 0]
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress) <= jobs.STATE_GROUPS


def test_repeated_quotes_count_once(spark, tmp_path):
    quotes = spark.createDataFrame([("a", i, START + timedelta(seconds=i), float(i)) for i in range(50)], "symbol string, seq long, updated_at timestamp, price double")
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for some in (quotes.filter("seq < 30"), quotes.filter("seq >= 10"), quotes):
        land(some, source)
        jobs.distinct_quotes(jobs.file_stream(spark, source, quotes.schema), out, check).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(out).collect()) == list(range(50))


def test_rows_at_least_90_seconds_behind_go_aside(spark, tmp_path):
    """The first batch has no limit; a batch without times leaves it; a batch run again writes the same rows."""
    schema = "seq long, updated_at timestamp"
    at = lambda *pairs: spark.createDataFrame([(n, None if s is None else START + timedelta(seconds=s)) for n, s in pairs], schema)
    batches = (at((1, 0), (2, 500)), at((3, 409), (4, 410), (5, 411), (6, 600)), at((7, None)), at((8, 510), (9, 511)))
    out = str(tmp_path / "late")
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
        jobs.late_side_output(jobs.file_stream(spark, source, b.schema), "updated_at", out, check).awaitTermination()
    found = sorted((r["batch"], r["seq"]) for r in spark.read.parquet(out).collect())
    assert found == [(1, 3), (1, 4), (3, 8)]
