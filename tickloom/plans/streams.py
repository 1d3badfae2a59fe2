"""Streaming jobs over the driver tables, run with ``availableNow`` and read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.operators import pit as T
from tickloom.plans.oracle import oracle, rlist, rnd
from tickloom.plans.registry import Market, query, rounded, text
from tickloom.plans.store import _INTRA
from tickloom.session import checkpoint_dir
from tickloom.streaming import jobs


def folder(m: Market, name: str) -> str:
    return f"{checkpoint_dir(m.spark)}/streams-{m.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


FILES = 4


def landed_events(m: Market, repeat: bool = False, late: int = 3):
    """Events landed in four parts of equal time, each some files and a micro-batch; every fifth event comes ``late`` days late.

    With ``repeat`` the third part lands twice.
    """
    events = m.table("events")
    day = F.datediff("ts", F.lit("1970-01-01").cast("date")) + F.when(F.col("event_id") % 5 == 0, late).otherwise(0)
    first, last = events.agg(F.min(day), F.max(day)).first()
    part = F.floor((day - first) * 4 / (last - first + 1))
    source = folder(m, "events")
    for k in (0, 1, 2, 2, 3) if repeat else (0, 1, 2, 3):
        events.filter(part == k).repartition(FILES).write.mode("append").parquet(source)
    return jobs.file_stream(m.spark, source, events.schema, files_per_trigger=FILES).withColumn("ts", F.col("ts").cast("timestamp"))


def quote_stream(m: Market):
    """Events as quotes; the filters against now are left to the watermark."""
    e = landed_events(m, repeat=True)
    price = F.col("value")
    return e.filter(F.hour("ts") >= 9).select(
        F.col("event_id").alias("seq"), text("user_id").alias("symbol"), F.when(F.col("user_id") % 5 == 0, "etf").otherwise("stock").alias("kind"), price.alias("price"),
        F.round((price - F.col("event_id") % 10) / 10, 4).alias("day_pct"), F.lit(None).cast("double").alias("gap_pct"), F.lit(-9.0909).alias("from_open_pct"), (price * 10).alias("amount"), F.lit(10.0).alias("volume"), F.col("ts").alias("updated_at"),
    )


_DAYQ = "select *, row_number() over (partition by symbol order by ts desc, seq) as rn from (select event_id as seq, cast(user_id as varchar) as symbol, case when user_id % 5 = 0 then 'etf' else 'stock' end as kind, value as price, round((value - event_id % 10) / 10, 4) as day_pct, cast(null as double) as gap_pct, -9.0909e0 as from_open_pct, value * 10 as amount, 10e0 as volume, ts from events where hour(ts) >= 9 and cast(ts as date) = (select max(cast(ts as date)) from events where hour(ts) >= 9)) e"


@query("s2_latest_quote_stream", f"select symbol, seq, price from ({_DAYQ}) q where rn = 1")
def s2(m):
    out = folder(m, "latest")
    jobs.keep_latest(quote_stream(m), out, folder(m, "latest-check")).awaitTermination()
    return jobs.newest_version(m.spark, out).select("symbol", "seq", "price")


@query("s2_distinct_quotes_stream", "select cast(user_id as varchar) as symbol, event_id as seq, value as price from events where hour(ts) >= 9")
def s2_distinct(m):
    """The part that lands twice counts once; five days cover what comes late."""
    out = folder(m, "distinct")
    jobs.distinct_quotes(quote_stream(m), out, folder(m, "distinct-check"), "5 days").awaitTermination()
    return m.spark.read.parquet(out).select("symbol", "seq", "price")


# Batches in the order in which parts land; the third part lands twice.
_LATE = """
with days as (select event_id, ts, datediff('day', date '1970-01-01', cast(ts as date)) + case when event_id % 5 = 0 then 3 else 0 end as d from events),
parts as (select *, (d - min(d) over ()) * 4 // (max(d) over () - min(d) over () + 1) as part from days),
batches as (select * from (values (0, 0), (1, 1), (2, 2), (3, 2), (4, 3)) v(batch, part)),
tops as (select batch, max(ts) as top from batches join parts using (part) group by 1),
limits as (select batch, max(top) over (order by batch rows between unbounded preceding and 1 preceding) as newest from tops)
select l.batch, p.event_id as seq, (epoch_us(l.newest) - epoch_us(p.ts)) // 1000000 as behind_seconds
from parts p join batches b using (part) join limits l on l.batch = b.batch where p.ts <= l.newest - interval 90 second
"""


@query("s4_late_side_output", _LATE)
def s4_late(m):
    out = folder(m, "late")
    rows = landed_events(m, repeat=True).select(F.col("event_id").alias("seq"), F.col("ts").alias("updated_at"))
    jobs.late_side_output(rows, "updated_at", out, folder(m, "late-check")).awaitTermination()
    behind = F.floor((F.unix_micros("newest_at") - F.unix_micros("updated_at")) / 1_000_000)
    return m.spark.read.parquet(out).select("batch", "seq", behind.alias("behind_seconds"))


@query("s6_live_rankings", f"with q4 as (select * from ({_DAYQ}) q where rn = 1) select list, symbol, {rnd('value', 4, 'value')}, position from ({_INTRA}) z")
def s6(m):
    out = folder(m, "lists")
    jobs.live_rankings(quote_stream(m), out, folder(m, "lists-check")).awaitTermination()
    rows = jobs.newest_version(m.spark, f"{out}/lists")
    return rows.select("list", "symbol", F.round("value", 4).alias("value"), "position")


@query("s7_mention_partials_stream", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type as source, cast(user_id as varchar) as symbol, count(*) as mentions from events group by 1, 2, 3")
def s7(m):
    posts = landed_events(m).select(F.col("event_type").alias("source"), F.array(text("user_id")).alias("symbols"), F.col("ts").alias("published_at"))
    out = folder(m, "partials")
    jobs.mention_partials(posts, out, folder(m, "partials-check"), compact_every=2).awaitTermination()
    rows = jobs.current_partials(m.spark, out)
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "source", "symbol", "mentions")


def observation_arrivals(m: Market):
    week = F.date_trunc("week", "ts").cast("date")
    arrivals = landed_events(m, repeat=True, late=0).select(
        F.col("event_type").alias("source"), text("user_id").alias("symbol"), F.date_format(week, "yyyy-MM-dd").alias("key"), week.alias("data_date"), F.floor(F.col("value") / 100).cast("double").alias("value"),
        F.col("ts").alias("acquired_at"), F.lit(None).cast("timestamp").alias("published_at"), F.col("event_id").alias("seq"),
    )
    return T.content_hashed(arrivals, "symbol", "key", "value")


@query("s8_change_capture", oracle("select source, symbol, key, value, seq from ver", "ver"))
def s8(m):
    out = folder(m, "versions")
    jobs.capture_changes(observation_arrivals(m), out, folder(m, "versions-check")).awaitTermination()
    return m.spark.read.parquet(out).select("source", "symbol", "key", "value", "seq")


@query("s8_keyed_change_capture", oracle("select source, symbol, key, value, seq from ver", "ver"))
def s8_keyed(m):
    out = folder(m, "keyed")
    jobs.capture_keyed_changes(observation_arrivals(m), out, folder(m, "keyed-check")).awaitTermination()
    return m.spark.read.parquet(out).select("source", "symbol", "key", "value", "seq")


@query("s9_incremental_bars", oracle("select symbol, cast(date as varchar) as date, " + rlist("open", "close") + " from bars", "bars"))
def s9(m):
    """Every session lands in three parts, each a micro-batch of its own, and the first part lands twice."""
    source = folder(m, "landing")
    for part in (0, 1, 2, 0):
        some = m.bars.filter(F.pmod(F.xxhash64("symbol", "date"), F.lit(3)) == part)
        some.repartition(FILES).write.mode("append").parquet(source)
    out = folder(m, "bars")
    stream = jobs.file_stream(m.spark, source, m.bars.schema, files_per_trigger=FILES)
    jobs.incremental_bars(stream, out, folder(m, "bars-check")).awaitTermination()
    rows = m.spark.read.schema(m.bars.schema).parquet(out)
    return rounded(rows.select("symbol", text("date").alias("date"), "open", "close"), "open", "close")
