"""Structured Streaming jobs: latest quotes, live rankings, mention partials, change capture and incremental bars.

Each job has a batch twin in ``operators`` and processes whatever has arrived with ``availableNow`` or on a timer.
Sinks are idempotent per micro-batch: a replay overwrites the output of the same batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tickloom.operators import mentions, pit, ranking
from tickloom.operators.calendar import session_table

LATE = "90 seconds"


def file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Start the job: everything available now, or repeatedly on a processing-time trigger such as '15 seconds'."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def latest_quote_stream(quotes: DataFrame, late: str = LATE) -> DataFrame:
    """Newest quote per symbol and day as a native stateful aggregate.

    In update mode state is one row per symbol and open day; a day closes once the watermark passes it and leaves the
    state, and quotes later than the watermark of a closed day are dropped.
    """
    row = F.struct(*[F.col(c) for c in quotes.columns if c not in ("symbol", "updated_at")])
    order = F.struct(F.col("updated_at"), (-F.col("seq")).alias("_s"))
    return (
        quotes.withWatermark("updated_at", late)
        .groupBy(F.window("updated_at", "1 day").alias("_day"), "symbol")
        .agg(F.max_by(row, order).alias("_q"), F.max("updated_at").alias("updated_at"))
        .select("symbol", F.col("_day.start").alias("day_start"), "updated_at", "_q.*")
    )


def distinct_quotes(quotes: DataFrame, path: str, checkpoint: str, late: str = LATE, keys: tuple[str, ...] = ("symbol", "seq"), every: str | None = None) -> StreamingQuery:
    """Every quote once, however often a feed repeats it: the first row of a key that is not later than ``late``.

    State is one key per quote of the last ``late``; a repetition that comes after that is behind the watermark and goes too.
    """
    once = quotes.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(list(keys))
    writer = once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def late_side_output(rows: DataFrame, at: str, path: str, checkpoint: str, late: str = LATE, every: str | None = None) -> StreamingQuery:
    """Rows at least ``late`` behind the newest time of the micro-batches before theirs, with ``newest_at`` and the batch.

    A watermark drops such rows without a trace. The newest time so far is one row, published per batch, so a batch that is
    run again finds the same limit and writes the same rows. Rows without a time are neither late nor newest.
    """
    seen = f"{path}-seen"

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = newest_version(spark, seen, batch_id)
        newest = before.first()["newest_at"] if before is not None else None
        marked = batch.withColumn("newest_at", F.lit(newest).cast("timestamp"))
        behind = marked.filter(F.col(at) <= F.col("newest_at") - F.expr(f"INTERVAL {late}"))
        behind.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        top = batch.agg(F.greatest(F.max(at).cast("timestamp"), F.lit(newest).cast("timestamp")).alias("newest_at"))
        publish_version(top, seen, batch_id)

    return run(rows, split, checkpoint, "append", every)


def published_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions under a path, oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(root)]
    return sorted(int(n[6:]) for n, full in names if n.startswith("batch=") and _exists(spark, f"{full}/_SUCCESS"))


def publish_version(df: DataFrame, path: str, batch_id: int, keep: int = 2) -> None:
    """Write a version beside the ones before it: readers never meet a half-written one. All but the newest go."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    for old in published_versions(spark, path)[:-keep]:
        _removed(spark, f"{path}/batch={old}")


def newest_version(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    known = [v for v in published_versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/batch={known[-1]}") if known else None


def merge_latest(batch: DataFrame, batch_id: int, path: str) -> DataFrame:
    """The newest day's latest quote per symbol: what was published before, replaced by what a micro-batch updated."""
    spark = batch.sparkSession
    stored = newest_version(spark, path, batch_id)
    rows = batch.withColumn("_age", F.lit(1))
    if stored is not None:
        rows = rows.unionByName(stored.withColumn("_age", F.lit(0)))
    row = F.struct(*[c for c in batch.columns if c not in ("symbol", "day_start")])
    latest = rows.groupBy("day_start", "symbol").agg(F.max_by(row, F.struct("updated_at", "_age")).alias("_q"))
    newest = rows.agg(F.max("day_start")).first()[0]
    publish_version(latest.filter(F.col("day_start") == F.lit(newest)).select("day_start", "symbol", "_q.*"), path, batch_id)
    return newest_version(spark, path)


def keep_latest(quotes: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Publish the newest day's latest quotes after every trigger; ``newest_version`` reads them."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        merge_latest(batch.persist(), batch_id, path)
        batch.unpersist()

    return run(latest_quote_stream(quotes), publish, checkpoint, "update", every)


def live_rankings(quotes: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Rank the latest quotes of the newest day after every trigger; ``newest_version`` of ``path/lists`` reads them."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        current = merge_latest(batch.persist(), batch_id, f"{path}/quotes")
        publish_version(ranking.intraday_lists(current), f"{path}/lists", batch_id)
        batch.unpersist()

    return run(latest_quote_stream(quotes), publish, checkpoint, "update", every)


def mention_partial_stream(posts: DataFrame, late: str = "7 days") -> DataFrame:
    """Hourly mention partials per source and symbol; an hour is final once the watermark has passed it."""
    return (
        mentions.post_mentions(posts.withWatermark("published_at", late))
        .groupBy(F.window("published_at", "1 hour").alias("_w"), "source", "symbol")
        .agg(F.count("*").alias("mentions"))
        .select(F.col("_w.start").alias("hour"), "source", "symbol", "mentions")
    )


def mention_partials(
    posts: DataFrame, path: str, checkpoint: str, late: str = "7 days", every: str | None = None, compact_every: int = 20
) -> StreamingQuery:
    """Publish updated hours as batch folders; ``current_partials`` reads the newest count of each hour.

    Every ``compact_every`` batches the folders so far become one version beside them, so readers never merge more than that
    many. A replayed batch overwrites only its own folder, never a compacted version.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            whole = f"{path}-compact"
            if batch_id not in published_versions(spark, whole):
                publish_version(current_partials(spark, path), whole, batch_id)
            for v in published_versions(spark, path):
                if v < batch_id:
                    _removed(spark, f"{path}/batch={v}")

    return run(mention_partial_stream(posts, late), publish, checkpoint, "update", every)


def current_partials(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    compacted = published_versions(spark, f"{path}-compact")
    if compacted:
        whole = spark.read.parquet(f"{path}-compact/batch={compacted[-1]}").withColumn("batch", F.lit(compacted[-1]))
        rows = rows.filter(F.col("batch") > compacted[-1]).unionByName(whole)
    return rows.groupBy("hour", "source", "symbol").agg(F.max_by("mentions", "batch").alias("mentions"))


VERSION_COLUMNS = ("content_hash", "first_seen_at", "available_at")


def merge_arrivals(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Versions a batch of arrivals adds to the store, in arrival order, however many rows an identity has in it.

    The stored current version of each touched identity takes part as its first arrival, so the batch operator decides.
    """
    keys = list(pit.IDENTITY)
    if stored is None:
        return pit.changed_arrivals(batch)
    touched = batch.select(*keys).distinct()
    held = pit.latest_versions(stored.join(touched, keys, "left_semi"))
    seen = held.select(*keys, F.col("first_seen_at").alias("_seen"))
    later = batch.join(seen, keys, "left").filter(F.col("_seen").isNull() | (F.col("acquired_at") > F.col("_seen"))).drop("_seen")
    first = held.select(*[F.col(c) for c in batch.columns]).withColumn("_held", F.lit(True))
    merged = pit.changed_arrivals(first.unionByName(later.withColumn("_held", F.lit(False))))
    return merged.filter("NOT _held").drop("_held")


BUCKETS = 64


def capture_changes(arrivals: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append-if-changed as a stream: new versions per batch under ``path``, current versions under ``path-current``.

    The current table is cut into buckets of identities, and a batch reads and rewrites only the buckets it touches. A
    batch writes its versions before it updates the current table; run again, it finds them and only repeats the update.
    """
    current = f"{path}-current"
    bucket = F.pmod(F.xxhash64(*pit.IDENTITY), F.lit(BUCKETS)).cast("int")

    def held(spark: SparkSession, touched: list[int]) -> DataFrame | None:
        if not _exists(spark, current):
            return None
        return spark.read.parquet(current).filter(F.col("bucket").isin(touched))

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most BUCKETS numbers
        out = f"{path}/batch={batch_id}"
        stored = held(spark, touched)
        if not _exists(spark, f"{out}/_SUCCESS"):
            merge_arrivals(None if stored is None else stored.drop("bucket"), batch).write.mode("overwrite").parquet(out)
        rows = spark.read.parquet(out).withColumn("bucket", bucket)
        if stored is not None:
            rows = rows.unionByName(stored)
        latest = pit.latest_versions(rows)
        latest.write.mode("overwrite").parquet(f"{path}-merged")
        merged = spark.read.parquet(f"{path}-merged").repartition("bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(current)

    return run(arrivals, append, checkpoint, "append", every)


# State of keyed capture lies in this many groups of identities: a call of Python and a read of state serve a group, not one identity.
STATE_GROUPS = 1 << 10


class _LastVersions(StatefulProcessor):
    """Per group of identities: the hash and the time of each identity's last arrival, as a JSON list."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "arrivals string")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["acquired_at", "seq"], kind="stable")
        held = self._last.get()
        last = {tuple(identity): (digest, at) for identity, digest, at in json.loads(held[0])} if held else {}
        at = batch["acquired_at"].astype("datetime64[us]").astype("int64").tolist()
        changed, moved = [], False
        for identity, digest, now in zip(zip(*[batch[c] for c in pit.IDENTITY], strict=True), batch["content_hash"], at, strict=True):
            before = last.get(identity)
            fresh = before is None or now > before[1]
            changed.append(fresh and (before is None or digest != before[0]))
            if fresh:
                last[identity] = (digest, now)
                moved = True
        if moved:
            self._last.update((json.dumps([[i, *v] for i, v in last.items()], ensure_ascii=False, separators=(",", ":")),))
        if any(changed):
            yield batch[changed]

    def close(self) -> None:
        pass


def keyed_changes(arrivals: DataFrame) -> DataFrame:
    """Append-if-changed with keyed state: the versions a micro-batch adds, touching only the groups of the identities it holds.

    An arrival counts when it is later than all arrivals of its identity so far, and is a version when its content differs from
    the one before. Arrivals without a time are left out. State is one hash and time per identity and doesn't expire; identities
    lie in ``STATE_GROUPS`` groups by their hash, and a group's state is one value. A task holds the rows of one group and
    micro-batch; the source's limit of files bounds them.
    """
    timed = arrivals.filter("acquired_at IS NOT NULL")
    grouped = timed.withColumn("_group", F.pmod(F.xxhash64(*pit.IDENTITY), F.lit(STATE_GROUPS)).cast("int")).groupBy("_group")
    return pit.stamped(grouped.transformWithStateInPandas(_LastVersions(), arrivals.schema, "append", "None"))


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
KEYED_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def capture_keyed_changes(arrivals: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """``keyed_changes`` into a Parquet sink, each version once."""
    spark = arrivals.sparkSession
    usual = spark.conf.get(STATE_PROVIDER)
    writer = keyed_changes(arrivals).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    spark.conf.set(STATE_PROVIDER, KEYED_STATE)  # the query takes a copy of the session's settings when it starts
    try:
        return writer.start()
    finally:
        spark.conf.set(STATE_PROVIDER, usual)


def incremental_bars(bars: DataFrame, path: str, checkpoint: str, recheck: int = 5, every: str | None = None) -> StreamingQuery:
    """Bars by session partition; a batch may hold any part of a session.

    A bar that isn't stored yet is always added. A stored one is replaced only in the latest ``recheck`` sessions and
    never changes in older ones. Sessions a batch touches are merged with their stored rows, written aside and then put in
    place, so a batch that is run again leaves the same rows. A bar that a batch brings twice counts once (the greater row).
    """
    keys = ["symbol", "date"]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = F.struct(*[c for c in batch.columns if c not in keys])
        arrived = batch.groupBy(*keys).agg(F.max(rest).alias("_new"))
        if _exists(spark, path):
            stored = spark.read.schema(batch.schema).parquet(path)
            days = arrived.select("date").distinct()
            recent = session_table(stored, days).orderBy(F.desc("ord")).limit(recheck).select("date", F.lit(True).alias("_open"))
            held = stored.join(days, "date", "left_semi").select(*keys, rest.alias("_old"))
            both = held.join(arrived, keys, "full_outer").join(F.broadcast(recent), "date", "left")
            kept = F.when(F.col("_old").isNull() | (F.col("_open") & F.col("_new").isNotNull()), F.col("_new")).otherwise(F.col("_old"))
        else:
            both, kept = arrived, F.col("_new")
        rows = both.select(*keys, kept.alias("_kept")).select(*[c if c in keys else F.col("_kept")[c].alias(c) for c in batch.columns])
        aside = f"{path}-merged/batch={batch_id}"
        rows.write.mode("overwrite").parquet(aside)
        merged = spark.read.schema(batch.schema).parquet(aside)
        spread = merged.repartition("date", F.pmod(F.xxhash64("symbol"), F.lit(8)))
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
        _removed(spark, aside)

    return run(bars, upsert, checkpoint, "append", every)


def _removed(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
