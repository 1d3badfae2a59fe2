"""Forward labels: calendar-horizon outcomes, ten-session target outcomes and fixed-policy exits.

Every label needs at most ``max(horizon)`` sessions ahead, so a range frame on the session number inside blocked
series gathers the holding window without exploding bars to one row per held day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import blocked, core_rows, dimension_join, series_window
from tickloom.functions.scalars import HORIZONS, adjusted, net_return, target_price, tick_size
from tickloom.operators.calendar import holding_calendar
from tickloom.operators.features import WARMUP, feature_columns

TEN = 10
TEN_SESSION_VERSION = "two-week-v2"
POLICY_VERSION = "trade-policy-v1"
# Reasons attached to fixed-policy exits.
REASON_NO_SESSION = "缺少實際交易日或訊號日"
REASON_WAITING = "等待下一個實際交易日"
REASON_GAP = "持有窗口缺實際交易日行情"
REASON_EVENT = "價格無效或跨已辨識的公司行動"
REASON_LOCKED = "進場日鎖價，不能假設買入"
REASON_IMMATURE = "尚未滿十個實際交易日"


def _bar() -> Column:
    return F.struct("ord", "date", "open", "high", "low", "close", "valid", adjusted().alias("adj"))


def forward_bars(df: DataFrame, ahead: int, out: str = "_next") -> DataFrame:
    """Bars of the next ``ahead`` sessions as an ordered array (bounded by ``ahead`` elements)."""
    return df.withColumn(out, F.collect_list(_bar()).over(series_window().rangeBetween(1, ahead)))


def _horizon_columns(fee: float, slippage: float) -> dict[str, Column]:
    """Outcome columns from ``_next`` and one holding window struct ``_h``; NULL unless the window is whole."""
    k = F.col("_h.exit_k")
    held = F.slice("_next", 1, F.coalesce(k, F.lit(0)))
    first, last = F.get("_next", F.lit(0)), F.get("_next", k - 1)
    whole = (
        (k >= 1)
        & (F.size("_next") >= k)
        & (first["ord"] == F.col("ord") + F.col("_h.entry_k"))
        & (last["ord"] == F.col("ord") + k)
        & ~F.array_contains(held["valid"], False)
        & ~F.array_contains(F.slice("_next", 2, F.greatest(k - 1, F.lit(0)))["adj"], True)
        & (first["high"] != first["low"])
    )
    net = lambda price: net_return(first["open"], price, "kind", fee, slippage)
    winner = F.get(F.filter(held, lambda b: net(b["close"]) > 0), F.lit(0))
    return {
        "_ok": F.coalesce(whole, F.lit(False)),
        "return_pct": net(last["close"]),
        "recovered": net(F.array_max(held["close"])) > 0,
        "recovery_days": F.datediff(winner["date"], F.col("_h.entry_date")),
        "worst_close_return": net(F.array_min(held["close"])),
    }


def research_table(
    bars: DataFrame,
    sessions: DataFrame,
    securities: DataFrame | None = None,
    horizons: Sequence[int] = HORIZONS,
    fee: float = 0.001425,
    slippage: float = 0.0005,
    with_features: bool = True,
    **future,
) -> DataFrame:
    """Features and all horizon outcomes of every bar: one row per (symbol, date, horizon), one shuffle of the bars.

    ``has_outcome`` is false where the label is not comparable or not yet mature.
    """
    staged = blocked(bars, back=WARMUP if with_features else 0, ahead=max(horizons))
    if with_features:
        staged = feature_columns(staged)
    table = core_rows(forward_bars(staged, max(horizons)))
    if securities is not None:
        table = dimension_join(table.drop("kind"), securities.select("symbol", "kind"))
    windows = holding_calendar(sessions, horizons, **future)
    table = table.join(F.broadcast(windows), "date", "left").withColumn("_h", F.explode_outer("holding"))
    labelled = table.withColumns(_horizon_columns(fee, slippage))
    names = ("return_pct", "recovered", "recovery_days", "worst_close_return")
    labelled = labelled.withColumns({n: F.when(F.col("_ok"), F.col(n)) for n in names})
    return labelled.select(
        *[c for c in table.columns if c not in ("_next", "holding", "_h")],
        F.col("_h.horizon").alias("horizon"),
        F.col("_h.entry_date").alias("entry_date"),
        F.col("_h.exit_date").alias("exit_date"),
        F.col("_ok").alias("has_outcome"),
        *names,
    )


def event_outcomes(bars: DataFrame, sessions: DataFrame, securities: DataFrame | None = None, **options) -> DataFrame:
    """Outcome label table only: comparable, matured (symbol, signal_date, horizon) rows."""
    table = research_table(bars, sessions, securities, with_features=False, **options)
    return table.filter("has_outcome").select(
        "symbol",
        F.col("date").alias("signal_date"),
        "horizon",
        "entry_date",
        "exit_date",
        "return_pct",
        "recovered",
        "recovery_days",
        "worst_close_return",
    )


def _calendar_ahead(sessions: DataFrame) -> DataFrame:
    """Sessions with the next session's date and how many sessions follow (calendar-bounded, unpartitioned window)."""
    w = Window.orderBy("ord")
    return sessions.select(
        "date",
        "ord",
        F.lead("date").over(w).alias("next_date"),
        (F.max("ord").over(Window.partitionBy()) - F.col("ord")).alias("sessions_left"),
    )


def ten_session_columns(df: DataFrame, has_calendar: bool = True) -> DataFrame:
    """Add the ten-session status and measures to blocked bars with ``kind``, ``sessions_left`` and ``next_date``."""
    w = series_window()
    ahead, at_entry, at_exit = w.rangeBetween(1, TEN), w.rangeBetween(1, 1), w.rangeBetween(TEN, TEN)
    staged = df.withColumn("_adj", adjusted()).withColumns(
        {
            "_n": F.count(F.lit(1)).over(ahead),
            "_allvalid": F.min("valid").over(ahead),
            "_anyadj": F.max("_adj").over(ahead),
            "_maxhigh": F.max("high").over(ahead),
            "_entry": F.first(F.struct("date", "open", "high", "low")).over(at_entry),
            "_exit": F.first(F.struct("date", "close")).over(at_exit),
        }
    )
    entry = F.col("_entry")
    missing_entry = entry.isNull() if has_calendar else F.lit(False)
    left = F.col("sessions_left") if has_calendar else F.col("_n")
    status = (
        F.when(F.col("ord").isNull(), "not_comparable")
        .when(left < TEN, "pending")
        .when(missing_entry, "not_filled")
        .when((F.col("_n") < TEN) | ~F.col("_allvalid") | F.col("_anyadj"), "not_comparable")
        .when((entry["high"] == entry["low"]) | (entry["open"] <= 0), "not_filled")
        .otherwise("evaluated")
    )
    target = target_price(entry["open"], "kind")
    staged = staged.withColumn("status", status)
    done = F.col("status") == "evaluated"
    staged = staged.withColumn("target_price", F.when(done, target))
    return staged.withColumns(
        {
            "entry_date": F.when(done, entry["date"]).when(F.col("status") == "not_filled", F.coalesce(entry["date"], F.col("next_date"))),
            "exit_date": F.when(done, F.col("_exit.date")),
            "entry_price": F.when(done, entry["open"]),
            "touched": F.when(done, F.col("_maxhigh") >= F.col("target_price")),
            "potential_fill": F.when(
                done, F.col("_maxhigh") >= F.col("target_price") + tick_size("target_price", "kind").cast("double")
            ),
            "terminal_return_pct": F.when(done, (F.try_divide(F.col("_exit.close"), entry["open"]) - 1) * 100),
        }
    ).drop("_adj", "_n", "_allvalid", "_anyadj", "_maxhigh", "_entry", "_exit")


TEN_COLUMNS = ("status", "entry_date", "exit_date", "entry_price", "target_price", "touched", "potential_fill", "terminal_return_pct")


def ten_session_outcomes(bars: DataFrame, sessions: DataFrame | None, securities: DataFrame | None = None) -> DataFrame:
    """Ten-session target outcome of a signal on every bar: whole-window aggregates, no row fan-out.

    Without sessions the next ten stored bars count (``ord`` must then number the rows of each symbol).
    """
    table = bars
    if securities is not None:
        table = dimension_join(table.drop("kind"), securities.select("symbol", "kind", "etf_style"))
    if sessions is not None:
        table = table.drop("ord").join(F.broadcast(_calendar_ahead(sessions)), "date", "left")
    else:
        table = table.withColumns({"sessions_left": F.lit(None).cast("long"), "next_date": F.lit(None).cast("date")})
    out = core_rows(ten_session_columns(blocked(table, ahead=TEN), sessions is not None))
    extra = [c for c in ("kind", "etf_style") if c in out.columns]
    return out.select("symbol", F.col("date").alias("signal_date"), *extra, *TEN_COLUMNS)


def policy_exits(signals: DataFrame, bars: DataFrame, sessions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Fixed-policy exit of each signal (symbol, signal_date, kind, ...) as known on ``as_of``.

    Signals and bars are unioned into one blocked series, so a signal needs no bar of its own and nothing fans out.
    Each signal then carries an array of at most ten bars.
    """
    if as_of is not None:
        bars, sessions = bars.filter(F.col("date") <= as_of), sessions.filter(F.col("date") <= as_of)
    days = _calendar_ahead(sessions).withColumnRenamed("date", "signal_date")
    keys = [c for c in signals.columns if c != "symbol"]
    marks = signals.join(F.broadcast(days), "signal_date", "left").select(
        "symbol", "ord", F.struct(*keys, "next_date", "sessions_left").alias("_signal"), F.lit(None).alias("_bar")
    )
    marks = marks.withColumn("_bar", F.lit(None).cast(_bar_type()))
    rows = bars.select("symbol", "ord", F.lit(None).cast(marks.schema["_signal"].dataType).alias("_signal"), _bar().alias("_bar"))
    series = blocked(marks.unionByName(rows), ahead=TEN)
    frame = series_window().rangeBetween(1, TEN)
    held = series.withColumn("_held", F.collect_list("_bar").over(frame)).filter("_core AND _signal IS NOT NULL")
    base = held.select("symbol", "ord", "_signal.*", "_held")
    elapsed = F.least(F.col("sessions_left"), F.lit(TEN)).cast("int")
    base = base.withColumn("elapsed_sessions", F.coalesce(elapsed, F.lit(0)))
    first = F.get("_held", F.lit(0))
    broken = F.array_contains(F.col("_held.valid"), False) | F.array_contains(F.col("_held.adj"), True)
    locked = (first["high"] == first["low"]) | (first["open"] <= 0)
    base = base.withColumn(
        "status",
        F.when(F.col("ord").isNull(), "not_comparable")
        .when(F.col("elapsed_sessions") == 0, "pending")
        .when(F.size("_held") < F.col("elapsed_sessions"), "not_comparable")
        .when(broken, "not_comparable")
        .when(locked, "not_filled")
        .when(F.col("elapsed_sessions") < TEN, "pending")
        .otherwise("evaluated"),
    ).withColumn(
        "_why",
        F.when(F.col("ord").isNull(), REASON_NO_SESSION)
        .when(F.col("elapsed_sessions") == 0, REASON_WAITING)
        .when(F.size("_held") < F.col("elapsed_sessions"), REASON_GAP)
        .when(broken, REASON_EVENT)
        .when(locked, REASON_LOCKED)
        .when(F.col("elapsed_sessions") < TEN, REASON_IMMATURE),
    )
    priced = (F.col("status") == "evaluated") | ((F.col("status") == "pending") & (F.col("elapsed_sessions") > 0))
    done = F.col("status") == "evaluated"
    base = base.withColumns(
        {
            "entry_price": F.when(priced, first["open"]),
            "target_price": F.when(priced, target_price(first["open"], "kind")),
        }
    ).withColumn("_limit", F.col("target_price") + tick_size("target_price", "kind").cast("double") - 1e-10)
    hit = F.transform("_held", lambda b, i: ((i > 0) & (b["open"] >= F.col("target_price"))) | (b["high"] >= F.col("_limit")))
    base = base.withColumn("_hit", F.when(done, F.array_position(hit, True).cast("int")))
    at = F.when(F.col("_hit") > 0, F.col("_hit")).otherwise(F.lit(TEN))
    exit_bar = F.get("_held", at - 1)
    gap = (F.col("_hit") > 1) & (exit_bar["open"] >= F.col("target_price"))
    before = F.slice("_held", 1, F.coalesce(at - 1, F.lit(0)))
    base = base.withColumns(
        {
            "reason": F.when(~done, F.col("_why"))
            .when(F.col("_hit") == 0, "expiry_close")
            .when(gap, "gap_open")
            .otherwise("conservative_target"),
            "exit_date": F.when(done, exit_bar["date"]),
            "exit_price": F.when(
                done, F.when(F.col("_hit") == 0, exit_bar["close"]).when(gap, exit_bar["open"]).otherwise(F.col("target_price"))
            ),
            "adverse_before_exit_pct": F.when(
                done, (F.try_divide(F.array_min(before["low"]), F.col("entry_price")) - 1) * 100
            ),
        }
    )
    return base.select(
        "symbol",
        *keys,
        F.lit(POLICY_VERSION).alias("policy_version"),
        "status",
        "reason",
        F.when(done, net_return("entry_price", "exit_price", "kind")).alias("net_return_pct"),
        F.coalesce(done & (F.col("_hit") > 0), F.lit(False)).alias("target_filled"),
        F.coalesce(priced & (F.array_max(F.col("_held.high")) >= F.col("target_price")), F.lit(False)).alias("touched"),
        "elapsed_sessions",
        F.when(F.col("ord").isNotNull(), F.col("next_date")).alias("entry_date"),
        "entry_price",
        "exit_date",
        "exit_price",
        "target_price",
        "adverse_before_exit_pct",
        F.transform("_held", lambda b: F.struct(b["date"].alias("date"), b["open"].alias("open"), b["high"].alias("high"), b["low"].alias("low"), b["close"].alias("close"))).alias("held_bars"),
    )


def _bar_type() -> str:
    return (
        "struct<ord:bigint,date:date,open:double,high:double,low:double,close:double,valid:boolean,adj:boolean>"
    )
