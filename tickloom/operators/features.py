"""Point-in-time features from 21 consecutive bars, in one shuffle by (symbol, session block)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import blocked, core_rows, series_window
from tickloom.functions.scalars import adjusted, finite

WARMUP = 20
# Wording of the signal labels.
LABEL_LONG_UP = "長紅 K"
LABEL_LONG_DOWN = "長黑 K"
LABEL_SMALL = "小實體／十字線"
LABEL_VOLUME = "成交量放大"
LABEL_BREAK_UP = "突破前20日高點"
LABEL_BREAK_DOWN = "跌破前20日低點"

VECTOR = ("v_body", "v_mom5", "v_mom20", "v_ma_gap", "v_volume", "v_volatility")


def frame_complete(frame, size: int, has_calendar: bool = True) -> Column:
    """All bars of a frame are valid and, with a calendar, sit on consecutive sessions."""
    ok = (F.count(F.lit(1)).over(frame) == size) & F.min("valid").over(frame)
    if has_calendar:
        ok = ok & (F.max("ord").over(frame) - F.min("ord").over(frame) == size - 1) & (F.count("ord").over(frame) == size)
    return ok


def feature_columns(df: DataFrame) -> DataFrame:
    """Add feature columns to blocked bars (needs a halo of 20 sessions behind)."""
    w = series_window()
    w21, before, last20 = w.rowsBetween(-20, 0), w.rowsBetween(-20, -1), w.rowsBetween(-19, 0)
    staged = df.withColumns(
        {
            "_adj": adjusted().cast("int"),
            "_logret": F.ln(F.when(F.col("close") > 0, F.col("close"))) - F.lag(F.ln(F.when(F.col("close") > 0, F.col("close")))).over(w),
            "_money": F.coalesce(F.nullif(F.col("turnover"), F.lit(0.0)), F.col("close") * F.col("volume")),
        }
    )
    c, o = F.col("close"), F.col("open")
    framed = staged.withColumns(
        {
            "_whole": frame_complete(w21, 21) & (F.max("_adj").over(last20) == 0),
            "_avgvol": F.avg("volume").over(before),
            "_high": F.max("high").over(before),
            "_low": F.min("low").over(before),
            "_lag5": F.lag("close", 5).over(w),
            "_lag20": F.lag("close", 20).over(w),
            "_vol": F.stddev_pop("_logret").over(last20),
            "_ma": F.avg("close").over(last20),
            "_turn": F.avg("_money").over(last20),
        }
    )
    ready = F.coalesce(F.col("_whole") & (F.col("_avgvol") > 0), F.lit(False))
    body = F.try_divide(c - o, o)
    ratio = F.try_divide(F.col("volume"), F.col("_avgvol"))
    mom5, mom20 = F.try_divide(c, F.col("_lag5")) - 1, F.try_divide(c, F.col("_lag20")) - 1
    labels = F.array_compact(
        F.array(
            F.when(body >= 0.015 - 1e-12, LABEL_LONG_UP),
            F.when(body <= -0.015 + 1e-12, LABEL_LONG_DOWN),
            F.when(F.abs(body) <= 0.002 + 1e-12, LABEL_SMALL),
            F.when(ratio > 1.5, LABEL_VOLUME),
            F.when(c > F.col("_high"), LABEL_BREAK_UP),
            F.when(c < F.col("_low"), LABEL_BREAK_DOWN),
        )
    )
    values = {
        "labels": labels,
        "body_pct": body * 100,
        "avg_volume_20": F.col("_avgvol"),
        "volume_ratio": ratio,
        "prev_20_high": F.col("_high"),
        "prev_20_low": F.col("_low"),
        "ma20": F.col("_ma"),
        "momentum5": mom5 * 100,
        "momentum20": mom20 * 100,
        "volatility": F.col("_vol") * 100,
        "avg_turnover_20": F.col("_turn"),
        "v_body": body,
        "v_mom5": mom5,
        "v_mom20": mom20,
        "v_ma_gap": F.try_divide(c, F.col("_ma")) - 1,
        "v_volume": F.ln(F.greatest(ratio, F.lit(0.001))),
        "v_volatility": F.col("_vol"),
    }
    out = framed.withColumn("has_features", ready)
    out = out.withColumns({name: F.when(F.col("has_features"), value) for name, value in values.items()})
    return out.drop("_adj", "_logret", "_money", "_whole", "_avgvol", "_high", "_low", "_lag5", "_lag20", "_vol", "_ma", "_turn")


def features(bars: DataFrame) -> DataFrame:
    """Every bar with its features; NULL where the 21-bar frame is short, gapped, invalid or price-adjusted."""
    return core_rows(feature_columns(blocked(bars, back=WARMUP)))


def row_order(bars: DataFrame) -> DataFrame:
    """Without a calendar the gap check is void: number the stored bars of each symbol instead."""
    return bars.withColumn("ord", F.row_number().over(Window.partitionBy("symbol").orderBy("date")).cast("long"))


def completeness(bars: DataFrame, size: int) -> DataFrame:
    """Gap check of the trailing ``size`` bars."""
    frame = series_window().rowsBetween(1 - size, 0)
    return core_rows(blocked(bars, back=size - 1).withColumn("complete", F.coalesce(frame_complete(frame, size), F.lit(False))))


def vector_column() -> Column:
    return F.when(F.col("has_features"), F.array(*VECTOR))


def recent_signals(featured: DataFrame, count: int = 60) -> DataFrame:
    """Labelled bars among the last ``count`` bars of each symbol."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return (
        featured.withColumn("_rn", F.row_number().over(newest))
        .filter((F.col("_rn") <= count) & F.col("has_features"))
        .select("symbol", "date", "labels")
    )


def index_momentum(index_bars: DataFrame, lag: int = 20) -> DataFrame:
    """Index rows with the close ``lag`` index rows earlier; one row per day, so the calendar bound holds."""
    w = Window.orderBy("date")
    return index_bars.filter(F.col("close").isNotNull() & (F.col("close") != 0)).select(
        "date",
        F.col("close").alias("index_close"),
        F.row_number().over(w).alias("index_rows"),
        ((F.try_divide(F.col("close"), F.lag("close", lag).over(w)) - 1) * 100).alias("index_momentum20"),
    )


def market_context(featured: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Index momentum beside each featured bar; needs more than 20 index rows."""
    index = index_momentum(index_bars).filter("index_rows > 20")
    return (
        featured.filter("has_features")
        .join(F.broadcast(index), "date")
        .select(
            "symbol",
            "date",
            F.col("index_momentum20").alias("momentum20"),
            (F.col("momentum20") - F.col("index_momentum20")).alias("relative_momentum20"),
            F.when(F.col("index_momentum20") > 0, F.lit("偏多")).otherwise(F.lit("偏弱")).alias("trend"),
        )
    )


def market_metrics(bars: DataFrame) -> DataFrame:
    """Facts of the last bar of every symbol and session, as a reader of that day would see them."""
    w = series_window()
    pair = w.rowsBetween(-1, 0)
    staged = feature_columns(blocked(bars, back=WARMUP)).withColumns(
        {"_pair": frame_complete(pair, 2), "_prev": finite(F.lag("close").over(w))}
    )
    usable = F.col("valid") & finite("close").isNotNull()
    paired = F.coalesce(F.col("_pair") & ~adjusted() & (F.col("_prev") > 0), F.lit(False))
    metric = lambda value: F.round(F.when(usable, finite(value)), 6)
    return core_rows(staged).select(
        "symbol",
        "date",
        metric("close").alias("close"),
        metric("turnover").alias("turnover"),
        metric("volume").alias("volume"),
        F.round(F.when(usable & paired, (F.col("close") / F.col("_prev") - 1) * 100), 6).alias("change_pct"),
        metric("momentum5").alias("momentum5_pct"),
        metric("momentum20").alias("momentum20_pct"),
        metric("volume_ratio").alias("relative_volume"),
        metric("volatility").alias("volatility_pct"),
        F.when(usable & F.col("has_features"), F.col("close") > F.col("prev_20_high")).alias("new_high20"),
        F.when(usable & F.col("has_features"), F.col("close") < F.col("prev_20_low")).alias("new_low20"),
    )


def explore_catalog(securities: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """Every listed security with the metrics of as_of (NULL when its last bar is older) and its data date.

    ``bars`` may be the whole history: only the sessions a 21-bar frame can reach are read.
    """
    known = bars.filter(F.col("date") <= as_of)
    last = known.groupBy("symbol").agg(F.max("date").alias("data_as_of"))
    today = market_metrics(known).filter(F.col("date") == as_of).drop("date")
    return securities.join(last, "symbol", "left").join(today, "symbol", "left")


def trend_points(bars: DataFrame, as_of: Column, count: int = 20) -> DataFrame:
    """The last finite closes up to as_of as one short array per symbol."""
    from tickloom.operators.clean import last_rows

    recent = last_rows(bars.filter(F.col("date") <= as_of), count).filter(finite("close").isNotNull())
    return recent.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("trend"))
