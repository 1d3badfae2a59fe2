"""Trading calendar: sessions, as-of rolls to sessions and session-offset joins.

A calendar holds at most one row per day of the supported range, so its windows run unpartitioned and it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import calendar_days
from tickloom.functions.scalars import HORIZONS

SEARCH_DAYS = 40


def completeness_cutoff(now: Column, close_hour: int = 19) -> Column:
    """Bars of the current day count only once the evening close has passed."""
    return F.when(F.hour(now) >= close_hour, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))


def months_before(now: Column, count: int) -> Column:
    """First days of the ``count`` months that end with the month of the completeness cutoff, newest first."""
    anchor = F.trunc(completeness_cutoff(now), "month")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.add_months(anchor, -k))


def session_table(*sources: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """Distinct sessions of all sources in order; ``ord`` counts from 1."""
    days = None
    for source in sources:
        one = calendar_days(source)
        days = one if days is None else days.unionByName(one)
    if len(sources) > 1:
        days = days.distinct()
    if cutoff is not None:
        days = days.filter(F.col("date") <= cutoff)
    return days.select("date", F.row_number().over(Window.orderBy("date")).cast("long").alias("ord"))


def calendar_rules(schedule: DataFrame, opening_words: Sequence[str]) -> DataFrame:
    """Holiday schedule rows (date, text): a special opening if the text says so, a holiday otherwise."""
    opens = F.lit(False)
    for word in opening_words:
        opens = opens | F.contains(F.col("text"), F.lit(word))
    return calendar_days_with(schedule, opens)


def calendar_days_with(schedule: DataFrame, opens: Column) -> DataFrame:
    return schedule.groupBy(F.col("date").cast("date").alias("date")).agg(
        F.bool_or(opens).alias("is_open"), F.bool_or(~opens).alias("is_holiday")
    )


def with_ord(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attach the session number; days outside the calendar keep NULL."""
    return bars.join(F.broadcast(sessions.select("date", "ord")), "date", "left")


def rolled_days(
    sessions: DataFrame,
    ahead: int = max(HORIZONS),
    rules: DataFrame | None = None,
    years: Sequence[int] = (),
) -> DataFrame:
    """For every day from the first session on: the session at or after it.

    Inside the known range only real sessions count. Beyond it a day is open when the rules open it, or on a weekday
    that is no holiday; the search covers ``SEARCH_DAYS`` days and stops at a year whose schedule is not loaded.
    """
    span = sessions.agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    days = span.select(
        F.explode(F.sequence("_first", F.date_add("_last", ahead + SEARCH_DAYS + 1))).alias("day"), "_last"
    )
    known = days.join(F.broadcast(sessions.select(F.col("date").alias("day"), "ord")), "day", "left")
    if rules is not None:
        known = known.join(F.broadcast(rules.withColumnRenamed("date", "day")), "day", "left")
    else:
        known = known.withColumns({"is_open": F.lit(False), "is_holiday": F.lit(False)})
    future = F.col("day") > F.col("_last")
    loaded = F.year("day").isin([int(y) for y in years]) if years else F.lit(False)
    trading = F.coalesce(F.col("is_open"), F.lit(False)) | (
        (F.weekday("day") < 5) & ~F.coalesce(F.col("is_holiday"), F.lit(False))
    )
    onward = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    filled = known.select(
        "day",
        future.alias("_future"),
        F.first(F.when(~future & F.col("ord").isNotNull() | future & trading, F.col("day")), True).over(onward).alias("_next"),
        F.first(F.when(future & ~loaded, F.col("day")), True).over(onward).alias("_unloaded"),
        F.first("ord", True).over(onward).alias("_ord"),
    )
    within = F.datediff("_next", "day") < SEARCH_DAYS
    reachable = within & (F.col("_unloaded").isNull() | (F.col("_unloaded") > F.col("_next")))
    return filled.select(
        "day",
        F.when(~F.col("_future") | reachable, F.col("_next")).alias("target_date"),
        F.when(~F.col("_future"), F.col("_ord")).alias("target_ord"),
    )


def target_dates(
    sessions: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    rules: DataFrame | None = None,
    years: Sequence[int] = (),
    signal_days: DataFrame | None = None,
) -> DataFrame:
    """Forward as-of join: (date, horizon) -> the session ``horizon`` calendar days later, rolled forward."""
    days = sessions.select("date") if signal_days is None else calendar_days(signal_days)
    wanted = days.join(F.broadcast(sessions.select("date", "ord")), "date", "left").select(
        "date", "ord", F.explode(F.array(*[F.lit(int(h)) for h in horizons])).alias("horizon")
    )
    rolled = rolled_days(sessions, max(horizons), rules, years)
    return wanted.withColumn("day", F.expr("date_add(date, horizon)")).join(F.broadcast(rolled), "day", "left").drop("day")


def holding_calendar(sessions: DataFrame, horizons: Sequence[int] = HORIZONS, **future) -> DataFrame:
    """One row per session with its holding windows: array of (horizon, entry/exit date, session offsets)."""
    spans = target_dates(sessions, sorted({1, *horizons}), **future)
    entry = spans.filter("horizon = 1").select(
        "date", F.col("target_date").alias("entry_date"), (F.col("target_ord") - F.col("ord")).alias("entry_k")
    )
    joined = spans.filter(F.col("horizon").isin([int(h) for h in horizons])).join(entry, "date")
    window = F.struct(
        "horizon",
        F.col("target_date").alias("exit_date"),
        (F.col("target_ord") - F.col("ord")).cast("int").alias("exit_k"),
        "entry_date",
        F.col("entry_k").cast("int").alias("entry_k"),
    )
    return joined.groupBy("date").agg(F.sort_array(F.collect_list(window)).alias("holding"))


def session_offsets(signals: DataFrame, sessions: DataFrame, bars: DataFrame, count: int = 10) -> DataFrame:
    """The next ``count`` sessions after each signal (entry session = 1), left-joined to bars by session number.

    An equi-join on (symbol, ord): every signal fans out to ``count`` rows spread over all partitions.
    """
    ords = sessions.select(F.col("ord").alias("_ord"), F.col("date").alias("session_date"))
    fanned = (
        signals.join(F.broadcast(sessions.select(F.col("date").alias("signal_date"), F.col("ord").alias("signal_ord"))), "signal_date", "left")
        .withColumn("pos", F.explode(F.sequence(F.lit(1), F.lit(count))))
        .withColumn("_ord", F.col("signal_ord") + F.col("pos"))
        .join(F.broadcast(ords), "_ord", "left")
    )
    priced = bars.withColumnRenamed("ord", "_ord").drop("date", "kind").withColumn("has_bar", F.lit(True))
    return fanned.join(priced, ["symbol", "_ord"], "left").drop("_ord")


def freshness(as_of: Column, next_session: Column, now: Column, release_hour: int = 20) -> Column:
    """fresh / overdue / weekday_unknown from local now; the session after as_of is due at the release hour."""
    today, late = F.to_date(now), F.hour(now) >= release_hour
    due = (today > next_session) | ((today == next_session) & late)
    return (
        F.when(as_of.isNull() | (as_of >= today), F.lit("fresh"))
        .when(next_session.isNotNull(), F.when(due, F.lit("overdue")).otherwise(F.lit("fresh")))
        .when((F.weekday(today) < 5) & late, F.lit("weekday_unknown"))
        .otherwise(F.lit("fresh"))
    )
