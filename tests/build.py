"""Hand-made bars and calendars."""

from __future__ import annotations

from datetime import date, timedelta

from tickloom.operators.calendar import session_table, with_ord

BAR_SCHEMA = (
    "symbol string, date date, open double, high double, low double, close double, volume double, turnover double, "
    "mark string, change string, valid boolean"
)


def days(start: date, count: int, weekdays: bool = False) -> list[date]:
    out, at = [], start
    while len(out) < count:
        if not weekdays or at.weekday() < 5:
            out.append(at)
        at += timedelta(days=1)
    return out


def bar(day, symbol="2330", open=100.0, high=101.0, low=99.0, close=100.0, volume=10_000.0, turnover=None, mark="", change="", valid=True):
    turnover = close * volume if turnover is None else turnover
    return dict(symbol=symbol, date=day, open=float(open), high=float(high), low=float(low), close=float(close), volume=float(volume), turnover=float(turnover), mark=mark, change=change, valid=valid)


def frame(spark, rows, calendar=None):
    """(bars with ord, sessions); the calendar defaults to the bars' own dates."""
    bars = spark.createDataFrame([tuple(r.values()) for r in rows], BAR_SCHEMA)
    source = bars if calendar is None else spark.createDataFrame([(d,) for d in calendar], "date date")
    sessions = session_table(source)
    return with_ord(bars, sessions), sessions


def securities(spark, rows):
    full = [dict(symbol=s, name=n, kind=k, currency="TWD", industry=i, etf_style=e, index_name=x) for s, n, k, i, e, x in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], "symbol string, name string, kind string, currency string, industry string, etf_style string, index_name string")
