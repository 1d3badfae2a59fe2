"""Institution flows: daily measures per group, N-session totals and the twelve rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.layout import complete_sum, split_rank
from tickloom.functions.scalars import adjusted, finite, non_negative
from tickloom.operators.breadth import recent_sessions

GROUPS = ("foreign", "trust", "dealer")
# Header row of the institution feed, in feed order.
INSTITUTION_FIELDS = (
    "證券代號",
    "證券名稱",
    "外陸資買進股數(不含外資自營商)",
    "外陸資賣出股數(不含外資自營商)",
    "外陸資買賣超股數(不含外資自營商)",
    "外資自營商買進股數",
    "外資自營商賣出股數",
    "外資自營商買賣超股數",
    "投信買進股數",
    "投信賣出股數",
    "投信買賣超股數",
    "自營商買賣超股數",
    "自營商買進股數(自行買賣)",
    "自營商賣出股數(自行買賣)",
    "自營商買賣超股數(自行買賣)",
    "自營商買進股數(避險)",
    "自營商賣出股數(避險)",
    "自營商買賣超股數(避險)",
    "三大法人買賣超股數",
)


def daily_measures(observations: DataFrame) -> DataFrame:
    """buy / sell / net per (symbol, day, group).

    Foreign excludes foreign dealers; dealer gross adds own and hedge books while net stays the official figure.
    Negative gross amounts and rows in another unit are missing, not zero.
    """
    field = lambda i: F.try_element_at("official_fields", F.lit(INSTITUTION_FIELDS[i]))
    shares = F.coalesce(F.col("unit") == "shares", F.lit(False))
    legs = {
        "foreign": (field(2), field(3), F.col("foreign_net")),
        "trust": (field(8), field(9), F.col("trust_net")),
        "dealer": (field(12) + field(15), field(13) + field(16), F.col("dealer_net")),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(group).alias("group"),
                F.when(shares, non_negative(buy)).alias("buy"),
                F.when(shares, non_negative(sell)).alias("sell"),
                F.when(shares, finite(net)).alias("net"),
            )
            for group, (buy, sell, net) in legs.items()
        ]
    )
    return observations.select("symbol", "data_date", F.inline(rows))


def period_totals(measures: DataFrame, securities: DataFrame, sessions: DataFrame, as_of: Column, count: int = 5) -> DataFrame:
    """Totals over the last ``count`` sessions per (symbol, group); NULL unless every session is present.

    One session means as_of itself; several need that many calendar sessions ending exactly on as_of.
    """
    if count not in (1, 5):
        raise ValueError("totals cover 1 or 5 sessions")
    dated = measures.withColumnRenamed("data_date", "date")
    if count == 1:
        window = dated.filter(F.col("date") == as_of)
        usable = F.lit(True)
    else:
        window = recent_sessions(dated, sessions, as_of, count)
        usable = F.count_if(F.col("date") == as_of) == 1
    totals = window.groupBy("symbol", "group").agg(
        F.count("*").alias("observed_sessions"),
        *[F.when(usable, complete_sum(F.col(m), count)).alias(m) for m in ("buy", "sell", "net")],
    )
    listed = securities.select("symbol", "kind", F.explode(F.array(*[F.lit(g) for g in GROUPS])).alias("group"))
    return listed.join(totals, ["symbol", "group"], "left").withColumn("observed_sessions", F.coalesce("observed_sessions", F.lit(0)))


def evidence_list(observations: DataFrame, sessions: DataFrame, as_of: Column, count: int = 5) -> DataFrame:
    """Provenance of the observations behind a total: at most ``count`` entries per symbol."""
    window = recent_sessions(observations.withColumnRenamed("data_date", "date"), sessions, as_of, count)
    entry = F.struct(*[c for c in ("date", "first_seen_at", "available_at", "content_hash") if c in window.columns])
    return window.groupBy("symbol").agg(F.sort_array(F.collect_list(entry)).alias("evidence"))


def price_beside(securities: DataFrame, bars: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """Close and day change on as_of; the change needs the session before and an unadjusted current bar."""
    frame = recent_sessions(bars, sessions, as_of, 2).withColumn("_adj", adjusted())
    now, prev = F.col("back") == 0, F.col("back") == 1
    close = F.max(F.when(now & F.col("valid"), finite("close")))
    before = F.max(F.when(prev & F.col("valid"), finite("close")))
    plain = F.count_if(now & F.col("_adj")) == 0
    priced = frame.groupBy("symbol").agg(
        close.alias("close"), F.when(plain & (before > 0), (F.try_divide(close, before) - 1) * 100).alias("change_pct")
    )
    return securities.select("symbol").join(priced, "symbol", "left")


def flow_status(totals: DataFrame, health: str = "success") -> DataFrame:
    """One row: coverage and ready / partial / stale / insufficient_data."""
    whole = F.col("buy").isNotNull() & F.col("sell").isNotNull() & F.col("net").isNotNull()
    some = F.col("buy").isNotNull() | F.col("sell").isNotNull() | F.col("net").isNotNull()
    per_symbol = totals.groupBy("symbol").agg(F.bool_and(whole).alias("_whole"), F.bool_or(some).alias("_some"))
    return per_symbol.agg(
        F.count("*").alias("universe_symbols"),
        F.count_if("_whole").alias("complete_symbols"),
        F.when(~F.bool_or("_some"), "insufficient_data")
        .when(F.lit(health == "error"), "stale")
        .when(F.count_if("_whole") == F.count("*"), "ready")
        .otherwise("partial")
        .alias("status"),
    )


def institution_lists(totals: DataFrame, kind: str = "all") -> DataFrame:
    """Twelve lists: 3 groups x net_buy / net_sell / buy / sell, each in its own direction, ties by symbol."""
    rows = totals if kind == "all" else totals.filter(F.col("kind") == kind)
    net_sell = F.col("net") < 0
    offers = F.array_compact(
        F.array(
            F.when(F.col("net") > 0, F.struct(F.lit("net_buy").alias("metric"), F.col("net").alias("value"), F.col("net").alias("_signed"))),
            F.when(net_sell, F.struct(F.lit("net_sell").alias("metric"), F.col("net").alias("value"), (-F.col("net")).alias("_signed"))),
            F.when(F.col("buy") > 0, F.struct(F.lit("buy").alias("metric"), F.col("buy").alias("value"), F.col("buy").alias("_signed"))),
            F.when(F.col("sell") > 0, F.struct(F.lit("sell").alias("metric"), F.col("sell").alias("value"), F.col("sell").alias("_signed"))),
        )
    )
    offered = rows.select("symbol", "group", F.explode(offers).alias("_o")).select("symbol", "group", "_o.*")
    return split_rank(offered, ["group", "metric"], "_signed", ["symbol"]).drop("_signed")
