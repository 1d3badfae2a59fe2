"""Scalar functions: dates, numbers, prices and return arithmetic as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Research horizons in calendar days and the standing cost assumptions.
HORIZONS = (1, 3, 5, 7, 14, 30)
FEE_RATE = 0.001425
SLIPPAGE_RATE = 0.0005
STOCK_TAX = 0.003
ETF_TAX = 0.001

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def finite(value) -> Column:
    """NULL instead of NaN or infinity."""
    c = _col(value)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def non_negative(value) -> Column:
    c = finite(value)
    return F.when(c >= 0, c)


def positive(value, limit: float = 1e18) -> Column:
    c = finite(value)
    return F.when((c > 0) & (c < limit), c)


def number(text) -> Column:
    """Lenient number: thousands separators removed, anything unreadable or non-finite is NULL."""
    clean = F.trim(F.regexp_replace(_col(text), ",", ""))
    return F.when(clean.rlike(NUMBER_PATTERN), finite(clean.try_cast("double")))


def strict_number(text, name: str) -> Column:
    """Strict number: an unreadable value fails the job."""
    parsed = number(text)
    return F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit(f"{name}: not a number: "), F.coalesce(_col(text), F.lit("null"))))
    )


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def iso_date(text) -> Column:
    """``y/m/d`` or ``y-m-d``; years before 1911 count from the local era start."""
    parts = F.split(F.trim(_col(text)), "[-/]")
    year = F.get(parts, F.lit(0)).try_cast("int")
    return F.when(
        F.size(parts) == 3,
        _date(F.when(year < 1911, year + 1911).otherwise(year), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))),
    )


def compact_date(text) -> Column:
    """Seven digits are era dates, eight are common-era dates; separators are ignored; else NULL."""
    t = F.regexp_replace(F.trim(_col(text)), r"[/\-]", "")
    digits = F.length(t)
    year = F.substring(t, 1, 4).try_cast("int")
    era_year = F.substring(t, 1, 3).try_cast("int") + 1911
    return (
        F.when(~t.rlike(r"^\d+$"), F.lit(None).cast("date"))
        .when(digits == 8, _date(year, F.substring(t, 5, 2), F.substring(t, 7, 2)))
        .when(digits == 7, _date(era_year, F.substring(t, 4, 2), F.substring(t, 6, 2)))
    )


def era_month(text) -> Column:
    """``yyymm`` (era) or ``yyyymm`` (common era) as the first of that month."""
    t = _col(text)
    year = F.when(F.length(t) == 5, F.substring(t, 1, 3).try_cast("int") + 1911).otherwise(
        F.substring(t, 1, 4).try_cast("int")
    )
    month = F.when(F.length(t) == 5, F.substring(t, 4, 2)).otherwise(F.substring(t, 5, 2))
    return F.when(t.rlike(r"^\d{5,6}$"), _date(year, month, F.lit("01")))


def zoned_timestamp(text) -> Column:
    """Timestamp with an explicit offset; a naive or unreadable value is NULL."""
    t = _col(text)
    zoned = t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, t.try_cast("timestamp"))


def required_timestamp(text) -> Column:
    """As ``zoned_timestamp`` but a naive value fails the job."""
    parsed = zoned_timestamp(text)
    return F.when(parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.concat(F.lit("timestamp needs an offset: "), F.coalesce(_col(text), F.lit("null"))))
    )


def micros_local(micros, zone: str = "Asia/Taipei") -> Column:
    """Microseconds since the epoch as local wall-clock time."""
    return F.from_utc_timestamp(F.timestamp_micros(_col(micros).cast("long")), zone)


def quote_clock(day, clock) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", _col(day), _col(clock)), F.lit("yyyyMMdd HH:mm:ss"))


def month_number(day) -> Column:
    d = _col(day)
    return F.year(d) * 12 + F.month(d)


def percent(value, base, digits: int = 4) -> Column:
    v, b = _col(value), _col(base)
    return F.round(F.try_divide(v - b, b) * 100, digits)


def strip_tags(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), "<[^>]*>", ""))


def canonical_hash(*columns) -> Column:
    """sha256 over compact JSON; NULL fields stay visible so that missing differs from empty."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def url_host(url) -> Column:
    return F.try_parse_url(_col(url), F.lit("HOST"))


def url_dataset(url) -> Column:
    path = F.rtrim(F.try_parse_url(_col(url), F.lit("PATH")), F.lit("/"))
    return F.element_at(F.split(path, "/"), -1)


def url_param(url, key: str) -> Column:
    return F.try_parse_url(_col(url), F.lit("QUERY"), F.lit(key))


# Wording of the verification states.
QUALITY_LABELS = {
    "single_source": "單一官方來源／未完成跨來源複查",
    "missing_evidence": "來源證據不足／待複查",
}
QUALITY_UNRECORDED = "未記錄複查狀態"


def quality_label(status) -> Column:
    s = _col(status)
    out = F.lit(QUALITY_UNRECORDED)
    for key, text in QUALITY_LABELS.items():
        out = F.when(s == key, F.lit(text)).otherwise(out)
    return out


def adjusted(mark="mark", change="change") -> Column:
    """The feed marks a price that is not comparable with the day before."""
    marked = F.contains(F.coalesce(_col(mark), F.lit("")), F.lit("**"))
    return marked | F.contains(F.upper(F.coalesce(_col(change), F.lit(""))), F.lit("X"))


def valid_bar(open_="open", high="high", low="low", close="close", volume="volume") -> Column:
    o, h, l, c, v = (_col(x) for x in (open_, high, low, close, volume))
    sound = all_of(o > 0, c > 0, l > 0, h >= F.greatest(o, c), l <= F.least(o, c), h >= l, v >= 0)
    return F.coalesce(sound, F.lit(False))


def net_return(entry, close, kind, fee: float = FEE_RATE, slippage: float = SLIPPAGE_RATE) -> Column:
    """Percent return after fees, slippage on both sides and the sale tax of the kind."""
    tax = F.when(_col(kind) == "etf", F.lit(ETF_TAX)).otherwise(F.lit(STOCK_TAX))
    paid = _col(entry) * (1 + slippage) * (1 + fee)
    received = _col(close) * (1 - slippage) * (F.lit(1 - fee) - tax)
    return (F.try_divide(received, paid) - 1) * 100


# Price bands (exclusive upper bound) and their tick; the last tick is open-ended.
STOCK_TICKS = (("10", "0.01"), ("50", "0.05"), ("100", "0.1"), ("500", "0.5"), ("1000", "1"), (None, "5"))
ETF_TICKS = (("50", "0.01"), (None, "0.05"))
PRICE_TYPE = "decimal(26,12)"


def _bands(price: Column, table, pick) -> Column:
    out = None
    for bound, tick in reversed(table):
        value = F.lit(pick(tick)).cast("decimal(5,2)")
        out = value if bound is None else F.when(price < F.lit(bound).cast("decimal(5,0)"), value).otherwise(out)
    return out


def _by_kind(price: Column, kind: Column, pick) -> Column:
    return F.when(kind == "etf", _bands(price, ETF_TICKS, pick)).otherwise(_bands(price, STOCK_TICKS, pick))


def _inverse(tick: str) -> str:
    return str(round(1 / float(tick), 2))


def tick_size(price, kind) -> Column:
    return _by_kind(_col(price).cast(PRICE_TYPE), _col(kind), lambda tick: tick)


def target_price(entry, kind) -> Column:
    """Five percent above entry, rounded up to the tick that applies at the target itself."""
    required = _col(entry).cast(PRICE_TYPE) * F.lit("1.05").cast("decimal(3,2)")
    steps = F.ceil(required * _by_kind(required, _col(kind), _inverse))
    return (steps * _by_kind(required, _col(kind), lambda tick: tick)).cast("double")


def r(value, digits: int = 6) -> Column:
    """Report rounding, used at the edge of a query only."""
    return F.round(_col(value), digits)
