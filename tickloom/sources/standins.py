"""Market tables derived from the driver's parquet tables.

The driver has no exchange data. Bars are weekly trades per brand (region on the smallest scale); events play posts,
observations, flows and quotes. Aggregates only: the first and last trade of a bar are min/max of an ordered struct, so
the raw rows of a hot (symbol, session) are combined on the map side and never meet in one window.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalars import valid_bar
from tickloom.operators.calendar import session_table
from tickloom.schemas import conform
from tickloom.session import written

_shared: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derived tables that many queries start from are written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _shared:
        folder = re.sub(r"[^A-Za-z0-9.]+", "_", f"{sf_dir}/{name}").strip("_")
        _shared[key] = written(build(), folder)
    return _shared[key]


def trades(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    columns = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    li = table(spark, sf_dir, "lineitem").select(*columns)
    week = F.date_trunc("week", "l_shipdate").cast("date")
    if grain == "brand":
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        keyed, session = li.join(part, "l_partkey"), week
    elif grain == "region":
        nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        area = supplier.join(nation, "s_nationkey").select("l_suppkey", F.concat(F.lit("Region"), "n_regionkey").alias("symbol"))
        keyed, session = li.join(area, "l_suppkey"), week
    else:
        keyed = li.withColumn("symbol", F.concat("l_returnflag", "l_linestatus"))
        session = F.col("l_shipdate").cast("date")
    return keyed.select(
        "symbol", session.alias("date"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )


def bars(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    """symbol, date, ord, open, high, low, close, volume, turnover, mark, change, valid."""

    def build() -> DataFrame:
        order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        price = F.col("l_extendedprice") / F.col("l_quantity")
        per_bar = (
            trades(spark, sf_dir, grain)
            .groupBy("symbol", "date")
            .agg(
                F.min(order).alias("_first"),
                F.max(order).alias("_last"),
                F.max(price).alias("high"),
                F.min(price).alias("low"),
                F.sum("l_quantity").alias("volume"),
                F.sum("l_extendedprice").alias("turnover"),
            )
        )
        grouped = _once(spark, sf_dir, "trades:" + grain, lambda: per_bar)
        numbered = grouped.join(F.broadcast(session_table(grouped)), "date")
        suffix = F.regexp_extract("symbol", r"(\d+)$", 1).try_cast("int")
        flagged = (F.col("ord") * 7 + F.coalesce(suffix, F.lit(0))) % 97 == 0
        rows = numbered.select(
            "symbol",
            "date",
            "ord",
            (F.col("_first.l_extendedprice") / F.col("_first.l_quantity")).alias("open"),
            "high",
            "low",
            (F.col("_last.l_extendedprice") / F.col("_last.l_quantity")).alias("close"),
            "volume",
            "turnover",
            F.when(flagged, F.lit("**")).otherwise(F.lit("")).alias("mark"),
            F.lit("").alias("change"),
        )
        return conform(rows.withColumn("valid", valid_bar()), "bars")

    return _once(spark, sf_dir, "bars:" + grain, build)


def sessions(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    return _once(spark, sf_dir, "sessions:" + grain, lambda: session_table(bars(spark, sf_dir, grain)))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, close: turnover-weighted price of the whole market."""
    b = bars(spark, sf_dir)
    return _once(spark, sf_dir, "index", lambda: b.groupBy("date").agg((F.sum("turnover") / F.sum("volume")).alias("close")))


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("p_brand", 7, 3).cast("int")
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("symbol"), number.alias("_b"))
        .agg(F.count("*").alias("_n"))
        .select(
            "symbol",
            F.col("symbol").alias("name"),
            F.when(F.col("_b") % 5 == 0, "etf").otherwise("stock").alias("kind"),
            F.when(F.col("_b") % 20 == 0, "USD").otherwise("TWD").alias("currency"),
            F.when(F.col("_b") != 13, F.lpad((F.col("_b") % 7).cast("string"), 2, "0")).alias("industry"),
            F.when(F.col("_b") % 10 == 0, "active").when(F.col("_b") % 5 == 0, "passive").alias("etf_style"),
            F.when(F.col("_b") % 15 == 0, "美國大型股").when(F.col("_b") % 5 == 0, "台灣大型股").alias("index_name"),
        )
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant timestamp (the file stores wall-clock time without a zone)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_type").alias("source"),
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").alias("published_at"),
        F.col("event_type").alias("title"),
        F.array(F.col("user_id").cast("string")).alias("symbols"),
        F.col("event_id").alias("seq"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of official observations: later events of a week correct the week's value."""
    e = events(spark, sf_dir)
    week = F.date_trunc("week", "ts").cast("date")
    return e.select(
        F.col("event_type").alias("source"),
        F.col("user_id").cast("string").alias("symbol"),
        F.date_format(week, "yyyy-MM-dd").alias("key"),
        week.alias("data_date"),
        F.floor(F.col("value") / 100).cast("double").alias("value"),
        F.col("ts").alias("acquired_at"),
        F.lit(None).cast("timestamp").alias("published_at"),
        F.col("event_id").alias("seq"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily buy, sell and net per (symbol, date); a side without events stays NULL."""
    e = events(spark, sf_dir)
    side = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("value")))
    return (
        e.groupBy(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("date").alias("data_date"))
        .agg(side("purchase").alias("buy"), side("view").alias("sell"))
        .withColumn("net", F.col("buy") - F.col("sell"))
    )


def mention_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur in texts: all long tokens of the benchmark passages; those of five letters are ambiguous."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{5,})"), F.lit(1))).alias("name"))
    return words.distinct().select(F.col("name").alias("symbol"), "name", (F.length("name") == 5).alias("ambiguous"))
