"""Quote normalisation, latest quote per security and feed states. Timestamps are local wall-clock time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import finite, percent, positive

OPEN, CLOSE = "09:00:00", "13:30:00"
STALE_SECONDS = 90
FUTURE_SECONDS = 5


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000


def trading_hours(now: Column) -> Column:
    return (clock(now) >= OPEN) & (clock(now) < CLOSE)


def snapshot_state(snapshot_at: Column, now: Column) -> Column:
    """usable, or stale: another date, before the open, from the future, or too old while trading."""
    age = seconds_between(now, snapshot_at)
    stale = (
        (F.to_date(snapshot_at) != F.to_date(now))
        | (clock(snapshot_at) < OPEN)
        | (age < -FUTURE_SECONDS)
        | (trading_hours(now) & (age > STALE_SECONDS))
    )
    return F.when(stale, "stale").otherwise("usable")


def normalized_quotes(raw: DataFrame, universe: DataFrame, now: Column) -> DataFrame:
    """Equity quotes of listed securities with day, gap and from-open percentages.

    ``raw``: type, symbol, name, open_price, close_price, last_price, change, trade_volume, trade_value, updated_at,
    is_trial, snapshot_at. The reference price is derived only when the last price is a regular, non-trial trade.
    """
    listed = universe.filter(F.col("kind").isin("stock", "etf")).select("symbol", "kind")
    volume = finite("trade_volume")
    lead = seconds_between(F.col("updated_at"), now)
    fresh = (
        (F.col("type") == "EQUITY")
        & (volume > 0)
        & (F.unix_micros("updated_at") > 0)
        & (lead <= FUTURE_SECONDS)
        & (F.to_date("updated_at") == F.to_date("snapshot_at"))
        & (clock(F.col("updated_at")) >= OPEN)
    )
    price, opening = positive("close_price"), positive("open_price")
    trial = F.coalesce(F.col("is_trial"), F.lit(False))
    regular = (price == finite("last_price")) & ~trial & F.col("change").isNotNull()
    reference = F.when(regular, F.round(price - F.col("change"), 6))
    rows = raw.filter(fresh).join(listed, "symbol").withColumns(
        {"price": price, "opening": opening, "_ref": F.when(reference > 0, reference)}
    )
    return rows.select(
        "symbol",
        F.substring(F.coalesce("name", "symbol"), 1, 100).alias("name"),
        "kind",
        "price",
        "opening",
        volume.alias("volume"),
        positive("trade_value").alias("amount"),
        percent("price", "_ref").alias("day_pct"),
        percent("opening", "_ref").alias("gap_pct"),
        percent("price", "opening").alias("from_open_pct"),
        "updated_at",
        trial.alias("trial"),
        *[c for c in ("seq",) if c in raw.columns],
    )


def exchange_quotes(raw: DataFrame, universe: DataFrame, now: Column) -> DataFrame:
    """The alternative feed: text fields, exchange and channel checks, trading-hours filter, price and volume required.

    ``raw``: ex, ch, symbol, name, updated_at, z (price), o (open), y (previous close), v (volume), seq.
    """
    listed = universe.filter(F.col("kind").isNotNull()).select("symbol", "kind")
    number = lambda c: positive(F.col(c).try_cast("double"))
    lead = seconds_between(F.col("updated_at"), now)
    base = (
        raw.filter((F.col("ex") == "tse") & (F.col("ch") == F.concat("symbol", F.lit(".tw"))))
        .join(listed, "symbol")
        .filter(F.col("updated_at").isNotNull() & (lead <= FUTURE_SECONDS))
    )
    rows = base.withColumns(
        {
            "same_day": F.to_date("updated_at") == F.to_date(now),
            "price": number("z"),
            "opening": number("o"),
            "_prior": number("y"),
            "volume": number("v"),
        }
    )
    usable = (
        F.col("same_day") & clock(F.col("updated_at")).between(OPEN, CLOSE) & F.col("price").isNotNull() & F.col("volume").isNotNull()
    )
    return rows.select(
        "symbol",
        F.substring(F.coalesce("name", "symbol"), 1, 100).alias("name"),
        "kind",
        "price",
        "opening",
        "volume",
        F.lit(None).cast("double").alias("amount"),
        percent("price", "_prior").alias("day_pct"),
        percent("opening", "_prior").alias("gap_pct"),
        percent("price", "opening").alias("from_open_pct"),
        "updated_at",
        "same_day",
        usable.alias("usable"),
        *[c for c in ("seq",) if c in raw.columns],
    )


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Newest update per symbol, the first arrival winning a tie; combined on the map side."""
    row = F.struct(*[F.col(c) for c in quotes.columns if c != "symbol"])
    return quotes.groupBy("symbol").agg(F.max_by(row, F.struct("updated_at", (-F.col("seq")).alias("_s"))).alias("_q")).select("symbol", "_q.*")


def feed_state(quotes: DataFrame, universe: DataFrame, now: Column) -> DataFrame:
    """One row per feed: live / closed / stale / no_trades / no_catalog with coverage, from usable and old quotes."""
    fed = quotes.select(
        F.when(F.col("usable"), F.col("updated_at")).alias("updated_at"),
        F.when(F.col("usable"), F.col("symbol")).alias("quoted"),
        (~F.col("same_day")).alias("old"),
        F.lit(None).cast("string").alias("listed"),
    )
    empty = {"updated_at": F.lit(None).cast("timestamp"), "quoted": F.lit(None).cast("string"), "old": F.lit(False)}
    members = universe.filter(F.col("kind").isNotNull()).select(F.col("symbol").alias("listed")).withColumns(empty)
    totals = fed.unionByName(members).agg(
        F.max("updated_at").alias("snapshot_at"),
        F.count_distinct("quoted").alias("coverage"),
        F.coalesce(F.bool_or("old"), F.lit(False)).alias("_old"),
        F.count("listed").alias("universe_count"),
    )
    age = seconds_between(now, F.col("snapshot_at"))
    return totals.select(
        F.when(F.col("universe_count") == 0, "no_catalog")
        .when(F.col("snapshot_at").isNull(), F.when(F.col("_old"), "stale").otherwise("no_trades"))
        .when(trading_hours(now) & (age > STALE_SECONDS), "stale")
        .when(trading_hours(now), "live")
        .otherwise("closed")
        .alias("status"),
        "snapshot_at",
        "coverage",
        "universe_count",
    )


def session_state(now: Column) -> Column:
    """outside_session on weekends and before the open; the feed is asked otherwise."""
    return F.when((F.weekday(now) >= 5) | (clock(now) < OPEN), "outside_session").when(clock(now) < CLOSE, "trading").otherwise("after_close")


def batch_union(batches: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows of successful quote batches (batch, ok, symbol, ...) limited to requested symbols; failed batches are skipped."""
    return batches.filter("ok").join(requested.select("symbol"), "symbol", "left_semi")


def batch_status(batches: DataFrame) -> DataFrame:
    per_batch = batches.groupBy("batch").agg(F.bool_and("ok").alias("ok"))
    return per_batch.agg(F.count("*").alias("batch_count"), F.count_if("ok").alias("batches_ok"))
