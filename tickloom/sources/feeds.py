"""Landing-zone ingest: raw JSON payloads as text rows -> typed tables with fixed schemas.

Every reader takes a DataFrame with one payload per row (for files: ``spark.read.text(path, wholetext=True)``) and
returns typed rows. What breaks the contract of a feed is left out of its rows and named by the feed's ``*_rejects``, row for
row or for a whole payload; ``require_clean`` turns rejects into a failed job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import (
    compact_date,
    era_month,
    iso_date,
    number,
    strip_tags,
    url_host,
    valid_bar,
    zoned_timestamp,
)
from tickloom.operators.flows import INSTITUTION_FIELDS

TABLE_SCHEMA = "stat string, date string, title string, hints string, fields array<string>, data array<array<string>>"
DAY_SCHEMA = (
    "stat string, date string, tables array<struct<title string, fields array<string>, data array<array<string>>, "
    "groups array<struct<title string, span int>>>>"
)
# Header names of the daily and monthly bar feeds.
COL = {
    "date": "日期",
    "volume": "成交股數",
    "turnover": "成交金額",
    "open": "開盤價",
    "high": "最高價",
    "low": "最低價",
    "close": "收盤價",
    "change": "漲跌價差",
    "mark": "註記",
}
MONTH_REQUIRED = ("日期", "成交股數", "開盤價", "最高價", "最低價", "收盤價", "漲跌價差")
DAY_REQUIRED = ("證券代號", "證券名稱", "成交股數", "成交金額", "開盤價", "最高價", "最低價", "收盤價", "漲跌(+/-)", "漲跌價差")
# Header row and group spans of the margin feed.
MARGIN_FIELDS = (
    "代號", "名稱", "買進", "賣出", "現金償還", "前日餘額", "今日餘額", "次一營業日限額",
    "買進", "賣出", "現券償還", "前日餘額", "今日餘額", "次一營業日限額", "資券互抵", "註記",
)
MARGIN_SPANS = (("股票", 2), ("融資", 6), ("融券", 6), ("", 1), ("", 1))
# Shapes of codes, and words of a feed that say there is no data or that a day opens.
CODE_PATTERN = r"^[A-Za-z0-9]{4,12}$"
STOCK_CODE = r"^[1-9]\d{3}$"
FUND_CODE = r"^00(\d{2,4}|\d{3}[AK])$"
ANY_FUND_CODE = r"^[0-9]{4,6}[A-Z]?$"
SIMPLE_CODE = r"^([1-9]\d{3}|00\d{2,3})$"
NO_DATA_WORDS = ("沒有符合", "查無資料")
OPENING_WORDS = ("開始交易", "最後交易")


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per landing file with its provenance."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"),
        F.col("_metadata.file_path").alias("url"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.sha2("value", 256).alias("sha256"),
    )


def require_clean(rejects: DataFrame) -> None:
    """Strict mode: fail on the first reject."""
    first = rejects.limit(1).collect()
    if first:
        raise ValueError(f"feed contract violated: {first[0].asDict()}")


def _first_problem(*cases: tuple[str, Column]) -> Column:
    """Name of the first case that holds; a case that can't be judged (null) holds."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(cases):
        out = F.when(F.coalesce(holds, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def _is_ok(stat: Column) -> Column:
    return F.lower(F.coalesce(stat, F.lit(""))) == "ok"


def _has_all(fields: Column, names: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(n) for n in names]), fields)) == 0


def _as_map(fields: Column, values: Column) -> Column:
    return F.map_from_arrays(fields, values)


def _bar_columns(cell, change: Column, day: Column) -> list[Column]:
    return [
        day.alias("date"),
        *[number(cell(COL[n])).alias(n) for n in ("open", "high", "low", "close", "volume", "turnover")],
        F.coalesce(cell(COL["mark"]), F.lit("")).alias("mark"),
        change.alias("change"),
    ]


def monthly_bars(payloads: DataFrame) -> DataFrame:
    """Monthly per-symbol payloads (symbol, month, load_seq, payload) -> bars with a validity flag."""
    parsed = payloads.withColumn("_p", F.from_json("payload", TABLE_SCHEMA))
    good = parsed.filter(_is_ok(F.col("_p.stat")) & _has_all(F.col("_p.fields"), MONTH_REQUIRED))
    rows = good.select("symbol", "month", "load_seq", F.col("_p.fields").alias("_f"), F.explode("_p.data").alias("_v"))
    rows = rows.withColumn("_m", _as_map(F.col("_f"), F.slice("_v", 1, F.size("_f"))))
    cell = lambda name: F.try_element_at("_m", F.lit(name))
    columns = _bar_columns(cell, F.coalesce(cell(COL["change"]), F.lit("")), iso_date(cell(COL["date"])))
    return rows.select("symbol", "month", "load_seq", *columns).withColumn("valid", valid_bar())


def monthly_rejects(payloads: DataFrame) -> DataFrame:
    """Months without data are issues; other failed states and changed headers are errors."""
    parsed = payloads.withColumn("_p", F.from_json("payload", TABLE_SCHEMA))
    stat = F.coalesce(F.col("_p.stat"), F.lit(""))
    empty = F.contains(stat, F.lit(NO_DATA_WORDS[0])) | F.contains(stat, F.lit(NO_DATA_WORDS[1]))
    problem = (
        F.when(empty, "no_data")
        .when(~_is_ok(F.col("_p.stat")), "bad_status")
        .when(~F.coalesce(_has_all(F.col("_p.fields"), MONTH_REQUIRED), F.lit(False)), "headers_changed")
    )
    return parsed.select("symbol", "month", problem.alias("problem")).filter("problem IS NOT NULL")


def bar_conflicts(bars: DataFrame) -> DataFrame:
    """(symbol, date) delivered more than once with different content."""
    content = F.struct("open", "high", "low", "close", "volume", "turnover", "mark", "change")
    return bars.groupBy("symbol", "date").agg(F.count_distinct(content).alias("versions")).filter("versions > 1")


def bar_issues(bars: DataFrame) -> DataFrame:
    return bars.filter(~F.col("valid")).select("symbol", "date", F.lit("invalid_price_or_volume").alias("issue"))


def last_load_wins(bars: DataFrame) -> DataFrame:
    """Concatenated months of a symbol: a later load overwrites the same date."""
    row = F.struct(*[F.col(c) for c in bars.columns if c not in ("symbol", "date")])
    return bars.groupBy("symbol", "date").agg(F.max_by(row, "load_seq").alias("_b")).select("symbol", "date", "_b.*")


def _market_day(payloads: DataFrame) -> DataFrame:
    """Payloads with their tables that carry all required headers, and the problem of a payload as a whole."""
    parsed = payloads.withColumn("_p", F.from_json("payload", DAY_SCHEMA)).withColumn("_old", F.from_json("payload", "map<string,string>"))
    numbered = F.map_filter("_old", lambda k, v: k.rlike(r"^fields\d*$"))
    old = F.transform(
        F.map_entries(numbered),
        lambda e: F.struct(
            F.from_json(e["value"], "array<string>").alias("fields"),
            F.from_json(
                F.try_element_at(F.col("_old"), F.concat(F.lit("data"), F.substring(e["key"], 7, 9))), "array<array<string>>"
            ).alias("data"),
        ),
    )
    new = F.transform(
        F.coalesce(F.col("_p.tables"), F.array().cast(DAY_SCHEMA.split("tables ")[1])),
        lambda t: F.struct(t["fields"].alias("fields"), t["data"].alias("data")),
    )
    tables = F.filter(F.concat(new, F.coalesce(old, F.array().cast("array<struct<fields:array<string>,data:array<array<string>>>>"))), lambda t: _has_all(t["fields"], DAY_REQUIRED))
    dated = F.col("_p.date") == F.date_format(F.col("session").cast("date"), "yyyyMMdd")
    problem = _first_problem(("bad_status", F.col("_p.stat") != "OK"), ("wrong_date", ~dated), ("tables", F.size("_t") != 1))
    return parsed.withColumn("_t", tables).withColumn("_problem", problem)


def _market_day_rows(payloads: DataFrame) -> DataFrame:
    """Rows of sound payloads: _day, _f, _v, _symbol and the problem of a row (its width, a symbol given twice for a day)."""
    sound = _market_day(payloads).filter("_problem IS NULL")
    rows = sound.select(F.col("session").cast("date").alias("_day"), F.col("_t")[0]["fields"].alias("_f"), F.explode(F.col("_t")[0]["data"]).alias("_v"))
    place = F.array_position("_f", "證券代號").cast("int")
    rows = rows.withColumn("_symbol", F.get("_v", place - 1))
    copies = F.count("*").over(Window.partitionBy("_day", "_symbol"))
    problem = _first_problem(("row_width", F.size("_v") != F.size("_f")), ("duplicate", copies > 1))
    return rows.withColumn("_problem", problem)


def market_day_bars(payloads: DataFrame) -> DataFrame:
    """Whole-market day payloads (session, payload) -> bars. Exactly one table must carry all required headers."""
    rows = _market_day_rows(payloads).filter("_problem IS NULL")
    rows = rows.withColumn("_m", _as_map(F.col("_f"), F.col("_v")))
    cell = lambda name: F.try_element_at("_m", F.lit(name))
    change = F.concat(strip_tags(cell("漲跌(+/-)")), strip_tags(cell(COL["change"])))
    columns = _bar_columns(lambda n: strip_tags(cell(n)), change, F.col("_day"))
    return rows.select(cell("證券代號").alias("symbol"), cell("證券名稱").alias("name"), *columns).withColumn("valid", valid_bar())


def market_day_rejects(payloads: DataFrame) -> DataFrame:
    """session, symbol (null for a whole payload), problem of everything ``market_day_bars`` leaves out."""
    whole = _market_day(payloads).filter("_problem IS NOT NULL").select(F.col("session").cast("date").alias("session"), F.lit(None).cast("string").alias("symbol"), F.col("_problem").alias("problem"))
    rows = _market_day_rows(payloads).filter("_problem IS NOT NULL").select(F.col("_day").alias("session"), F.col("_symbol").alias("symbol"), F.col("_problem").alias("problem"))
    return whole.unionByName(rows)


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def universe_bars(bars: DataFrame, securities: DataFrame) -> DataFrame:
    """Bars of listed symbols only; a symbol absent from a session contributes no filler row."""
    return bars.join(securities.select("symbol"), "symbol", "left_semi")


def security_master(companies: DataFrame, funds: DataFrame) -> DataFrame:
    """Company master and equity fund list as one dimension.

    companies: code, short_name, full_name, listed (yyyymmdd), industry. funds: code, name, listed (y.m.d), index_name.
    """
    code = F.trim("code")
    stocks = companies.filter(~F.upper(F.coalesce("short_name", F.lit(""))).endswith("-DR")).select(
        code.alias("symbol"),
        F.coalesce(F.nullif("short_name", F.lit("")), F.nullif("full_name", F.lit("")), code).alias("name"),
        F.lit("stock").alias("kind"),
        F.when(F.length(F.trim("listed")) == 8, compact_date("listed")).alias("listing_date"),
        F.lit("TWD").alias("currency"),
        F.nullif(F.trim("industry"), F.lit("")).alias("industry"),
        F.lit(None).cast("string").alias("index_name"),
        F.lit(None).cast("string").alias("etf_style"),
    )
    foreign = F.when(F.contains("name", F.lit("人民幣")), "CNY").when(F.contains("name", F.lit("美元")), "USD").otherwise("unknown")
    etfs = funds.select(
        code.alias("symbol"),
        "name",
        F.lit("etf").alias("kind"),
        iso_date(F.regexp_replace("listed", r"\.", "-")).alias("listing_date"),
        F.when(code.endswith("K"), foreign).otherwise("TWD").alias("currency"),
        F.lit(None).cast("string").alias("industry"),
        "index_name",
        F.when(code.endswith("A") | F.col("name").startswith("主動"), "active").otherwise("passive").alias("etf_style"),
    )
    return stocks.unionByName(etfs)


def master_rejects(master: DataFrame) -> DataFrame:
    """Codes of an unexpected shape and codes listed twice."""
    shape = F.when(F.col("kind") == "stock", F.col("symbol").rlike(STOCK_CODE)).otherwise(F.col("symbol").rlike(FUND_CODE))
    odd = master.filter(~shape).select("symbol", F.lit("code_shape").alias("problem"))
    twice = duplicate_keys(master, "symbol").select("symbol", F.lit("duplicate").alias("problem"))
    return odd.unionByName(twice)


def clean_master(master: DataFrame) -> DataFrame:
    """The master without what ``master_rejects`` names: a code of an odd shape, and every row of a code given twice."""
    shape = F.when(F.col("kind") == "stock", F.col("symbol").rlike(STOCK_CODE)).otherwise(F.col("symbol").rlike(FUND_CODE))
    once = master.groupBy("symbol").agg(F.count("*").alias("_n")).filter("_n = 1").select("symbol")
    return master.filter(shape).join(once, "symbol", "left_semi")


def listed_catalog(companies: DataFrame, funds: DataFrame) -> DataFrame:
    """(symbol, kind) of ordinary shares and of every fund type."""
    code = F.trim("code")
    shares = companies.filter(~F.upper(F.coalesce("short_name", F.lit(""))).endswith("-DR"))
    return (
        shares.select(code.alias("symbol"), F.lit("stock").alias("kind"))
        .filter(F.col("symbol").rlike(STOCK_CODE))
        .unionByName(funds.select(code.alias("symbol"), F.lit("etf").alias("kind")).filter(F.col("symbol").rlike(ANY_FUND_CODE)))
    )


def simple_universe(feed: DataFrame) -> DataFrame:
    """Universe of one feed (code, name): known code shapes, kind by prefix."""
    return feed.filter(F.col("code").rlike(SIMPLE_CODE)).select(
        F.col("code").alias("symbol"),
        F.coalesce("name", "code").alias("name"),
        F.when(F.col("code").startswith("00"), "etf").otherwise("stock").alias("kind"),
    )


def _observation(symbol: Column, key: Column, day: Column, unit: str, period: Column | None = None, published: Column | None = None):
    return [
        symbol.alias("symbol"),
        key.alias("key"),
        day.alias("data_date"),
        (F.lit(None).cast("string") if period is None else period).alias("period"),
        (F.lit(None).cast("timestamp") if published is None else published).alias("published_at"),
        F.lit(unit).alias("unit"),
    ]


def _institution(payloads: DataFrame) -> DataFrame:
    p = payloads.withColumn("_p", F.from_json("payload", TABLE_SCHEMA)).withColumn("_d", compact_date("_p.date"))
    header = F.array(*[F.lit(n) for n in INSTITUTION_FIELDS])
    problem = _first_problem(
        ("bad_status", ~_is_ok(F.col("_p.stat"))),
        ("wrong_date", F.col("_d") != F.col("requested_date")),
        ("headers_changed", F.col("_p.fields") != header),
        ("unit_changed", ~F.contains(F.col("_p.hints"), F.lit("單位：股"))),
    )
    return p.withColumn("_problem", problem)


def _figures(width: int, first: int, last: int) -> Column:
    """Problem of a row ``_v``: its width, or a figure that is no number."""
    cells = [number(F.get("_v", F.lit(i))).isNull() for i in range(first, last)]
    broken = cells[0]
    for c in cells[1:]:
        broken = broken | c
    return _first_problem(("row_width", F.size("_v") != width), ("number", broken))


def _institution_rows(payloads: DataFrame) -> DataFrame:
    rows = _institution(payloads).filter("_problem IS NULL").select("_d", F.explode("_p.data").alias("_v"))
    return rows.withColumn("_problem", _figures(len(INSTITUTION_FIELDS), 2, 19))


def _all_rejects(whole: DataFrame, rows: DataFrame) -> DataFrame:
    bad = F.col("_problem").isNotNull()
    one = whole.filter(bad).select(F.col("requested_date").cast("date").alias("day"), F.lit(None).cast("string").alias("symbol"), F.col("_problem").alias("problem"))
    return one.unionByName(rows.filter(bad).select(F.col("_d").alias("day"), F.get("_v", F.lit(0)).alias("symbol"), F.col("_problem").alias("problem")))


def institution_rejects(payloads: DataFrame) -> DataFrame:
    """day, symbol (null for a whole payload), problem of everything ``institution_flows`` leaves out."""
    return _all_rejects(_institution(payloads), _institution_rows(payloads))


def institution_flows(payloads: DataFrame) -> DataFrame:
    """Institution feed (requested_date, payload): exact header, unit hint and date, and rows of numbers only."""
    rows = _institution_rows(payloads).filter("_problem IS NULL")
    cell = lambda i: number(F.get("_v", F.lit(i)))
    fields = F.map_from_arrays(F.array(*[F.lit(INSTITUTION_FIELDS[i]) for i in range(2, 19)]), F.array(*[cell(i) for i in range(2, 19)]))
    text_day = F.date_format("_d", "yyyy-MM-dd")
    return rows.select(
        *_observation(F.get("_v", F.lit(0)), text_day, F.col("_d"), "shares"),
        cell(4).alias("foreign_net"),
        cell(7).alias("foreign_dealer_net"),
        cell(10).alias("trust_net"),
        cell(11).alias("dealer_net"),
        cell(18).alias("total_net"),
        fields.alias("official_fields"),
    )


def _margin(payloads: DataFrame) -> DataFrame:
    p = payloads.withColumn("_p", F.from_json("payload", DAY_SCHEMA)).withColumn("_d", compact_date("_p.date"))
    header = F.array(*[F.lit(n) for n in MARGIN_FIELDS])
    spans = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(s).alias("span")) for t, s in MARGIN_SPANS])
    p = p.withColumn("_t", F.filter("_p.tables", lambda t: t["fields"] == header))
    problem = _first_problem(
        ("bad_status", ~_is_ok(F.col("_p.stat"))),
        ("wrong_date", F.col("_d") != F.col("requested_date")),
        ("tables", F.size("_t") != 1),
        ("groups_changed", F.get("_t", F.lit(0))["groups"] != spans),
    )
    return p.withColumn("_problem", problem)


def _margin_rows(payloads: DataFrame) -> DataFrame:
    rows = _margin(payloads).filter("_problem IS NULL").select("_d", F.explode(F.get("_t", F.lit(0))["data"]).alias("_v"))
    return rows.withColumn("_problem", _figures(len(MARGIN_FIELDS), 2, 15))


def margin_rejects(payloads: DataFrame) -> DataFrame:
    """day, symbol (null for a whole payload), problem of everything ``margin_balances`` leaves out."""
    return _all_rejects(_margin(payloads), _margin_rows(payloads))


def margin_balances(payloads: DataFrame) -> DataFrame:
    """Margin feed (requested_date, payload). Headers repeat, so columns are positional behind a check of the groups."""
    rows = _margin_rows(payloads).filter("_problem IS NULL")
    cell = lambda i: number(F.get("_v", F.lit(i)))
    names = {
        "financing_redemption": 4, "financing_previous": 5, "financing_current": 6, "financing_limit": 7,
        "short_redemption": 10, "short_previous": 11, "short_current": 12, "short_limit": 13, "offset": 14,
    }
    return rows.select(
        *_observation(F.get("_v", F.lit(0)), F.date_format("_d", "yyyy-MM-dd"), F.col("_d"), "trading_unit"),
        *[cell(i).alias(n) for n, i in names.items()],
        F.trim(F.get("_v", F.lit(15))).alias("note"),
        F.lit("next_business_day").alias("note_applies"),
        F.array(*[cell(i) for i in range(2, 15)]).alias("official_columns"),
    )


def trimmed_rows(payloads: DataFrame) -> DataFrame:
    """List payloads as maps with trimmed header names; a row whose headers collide after trimming is flagged."""
    rows = payloads.select(F.explode(F.from_json("payload", "array<map<string,string>>")).alias("_raw"))
    keys = F.transform(F.map_keys("_raw"), lambda k: F.trim(k))
    collides = F.size(F.array_distinct(keys)) < F.size(keys)
    return rows.select(
        collides.alias("collides"), F.when(~collides, F.map_from_arrays(keys, F.map_values("_raw"))).alias("row")
    )


def list_rejects(rows: DataFrame, code: str, day: Column) -> DataFrame:
    """Rows of ``trimmed_rows`` that a list feed leaves out: colliding headers, or no readable date.

    symbol is null where headers collide. ``day`` is the feed's own date, from ``list_day``.
    """
    problem = _first_problem(("headers_collide", F.col("collides")), ("no_date", day.isNull()))
    return rows.select(F.try_element_at("row", F.lit(code)).alias("symbol"), problem.alias("problem")).filter("problem IS NOT NULL")


def list_day(feed: str) -> Column:
    """The date of a row of the revenue, announcement or dividend feed."""
    name, read = {"revenue": ("資料年月", era_month), "announcement": ("發言日期", compact_date), "dividend": ("Date", compact_date)}[feed]
    return read(F.try_element_at("row", F.lit(name)))


def monthly_revenue(rows: DataFrame) -> DataFrame:
    """Revenue rows (``row`` maps): growth is void when last year's base is missing or zero."""
    cell = lambda name: F.try_element_at("row", F.lit(name))
    period = era_month(cell("資料年月"))
    base = number(cell("營業收入-去年當月營收"))
    yoy = number(cell("營業收入-去年同月增減(%)"))
    text = F.date_format(period, "yyyy-MM")
    return rows.filter(period.isNotNull()).select(
        *_observation(cell("公司代號"), text, period, "amount_unverified", text),
        number(cell("營業收入-上月比較增減(%)")).alias("mom_pct"),
        F.when(base.isNotNull() & (base != 0), yoy).alias("yoy_pct"),
        cell("營業收入-當月營收").alias("raw_amount"),
        F.coalesce(cell("備註"), F.lit("")).alias("remark"),
        compact_date(cell("出表日期")).alias("export_date"),
    )


def announcements(rows: DataFrame, utc_offset_hours: int = 8) -> DataFrame:
    """Announcement rows: date and unpadded HHMMSS; an impossible time leaves the publication instant unverified."""
    cell = lambda name: F.try_element_at("row", F.lit(name))
    day = compact_date(cell("發言日期"))
    clock = F.trim(cell("發言時間"))
    padded = F.when(F.length(clock) < 6, F.lpad(clock, 6, "0")).otherwise(clock)
    local = F.when(
        padded.rlike(r"^\d{6}$"),
        F.try_to_timestamp(F.concat(F.date_format(day, "yyyyMMdd"), padded), F.lit("yyyyMMddHHmmss")),
    )
    text_day = F.date_format(day, "yyyy-MM-dd")
    key = F.concat_ws("|", text_day, F.coalesce(cell("發言時間"), F.lit("")), cell("主旨"))
    return rows.filter(day.isNotNull()).select(
        *_observation(cell("公司代號"), key, day, "text", None, local - F.expr(f"interval {utc_offset_hours} hours")),
        cell("主旨").alias("headline"),
        F.coalesce(cell("符合條款"), F.lit("")).alias("clause"),
        F.coalesce(cell("說明"), F.lit("")).alias("description"),
        compact_date(cell("事實發生日")).alias("fact_date"),
        F.when(local.isNotNull(), "verified").otherwise("unverified").alias("time_status"),
    )


def dividend_actions(rows: DataFrame) -> DataFrame:
    cell = lambda name: F.try_element_at("row", F.lit(name))
    day = compact_date(cell("Date"))
    return rows.filter(day.isNotNull()).select(
        *_observation(cell("Code"), F.date_format(day, "yyyy-MM-dd"), day, "official_dividend"),
        F.coalesce(cell("Exdividend"), F.lit("")).alias("type"),
        number(cell("CashDividend")).alias("cash_dividend"),
    )


def contract_violations(rows: DataFrame, required_date: Column | None = None) -> DataFrame:
    """Reject rows of an observation feed: code shape, wrong date, repeated (symbol, key)."""
    code = rows.filter(~F.coalesce(F.col("symbol").rlike(CODE_PATTERN), F.lit(False))).select("symbol", "key", F.lit("code").alias("problem"))
    twice = duplicate_keys(rows, "symbol", "key").select("symbol", "key", F.lit("duplicate").alias("problem"))
    out = code.unionByName(twice)
    if required_date is not None:
        late = rows.filter(F.col("data_date") != required_date).select("symbol", "key", F.lit("date").alias("problem"))
        out = out.unionByName(late)
    return out


def calendar_months(payloads: DataFrame) -> DataFrame:
    """Monthly market payloads -> (date, close) of the index."""
    parsed = payloads.withColumn("_p", F.from_json("payload", TABLE_SCHEMA)).filter(_is_ok(F.col("_p.stat")))
    row = parsed.select(F.explode("_p.data").alias("_v"))
    return row.select(iso_date(F.get("_v", F.lit(0))).alias("date"), number(F.get("_v", F.lit(4))).alias("close"))


FORUM_SCHEMA = "array<struct<id string, title string, excerpt string, createdAt string>>"
SOCIAL_SCHEMA = "struct<data: array<struct<id string, text string, timestamp string, permalink string>>>"
# Hosts of a post's permalink.
SOCIAL_HOSTS = ("www.threads.net", "www.threads.com", "threads.net", "threads.com")


def forum_posts(payloads: DataFrame, since: Column, now: Column, source: str = "dcard", url_prefix: str = "https://www.dcard.tw/f/stock/p/") -> DataFrame:
    """Forum API payloads -> posts of the window with title and excerpt as text."""
    rows = payloads.select(F.inline(F.from_json("payload", FORUM_SCHEMA)))
    published = zoned_timestamp("createdAt")
    return rows.withColumn("published_at", published).filter(F.col("published_at").between(since, now)).select(
        F.lit(source).alias("source"),
        "id",
        F.concat(F.lit(url_prefix), F.col("id")).alias("url"),
        F.substring(F.coalesce("title", F.lit("")), 1, 160).alias("title"),
        "published_at",
        F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit(""))).alias("text"),
    )


def social_posts(payloads: DataFrame, since: Column, now: Column, source: str = "threads", hosts: Sequence[str] = SOCIAL_HOSTS) -> DataFrame:
    """Search payloads -> posts of the window whose permalink is on an allowed host."""
    rows = payloads.select(F.inline(F.from_json("payload", "data array<struct<id string, text string, timestamp string, permalink string>>")["data"]))
    published = zoned_timestamp("timestamp")
    return (
        rows.withColumn("published_at", published)
        .filter(F.col("published_at").between(since, now) & F.coalesce(url_host("permalink").isin(list(hosts)), F.lit(False)))
        .select(
            F.lit(source).alias("source"),
            "id",
            F.col("permalink").alias("url"),
            F.substring(F.coalesce("text", F.lit("")), 1, 120).alias("title"),
            "published_at",
            F.coalesce("text", F.lit("")).alias("text"),
        )
    )


QUOTE_FEED_SCHEMA = (
    "market string, date string, time string, data array<struct<type string, symbol string, name string, openPrice double, "
    "closePrice double, lastPrice double, change double, tradeVolume double, tradeValue double, lastUpdated bigint, isTrial boolean>>"
)


def _snapshot(payloads: DataFrame, market: str) -> DataFrame:
    p = payloads.withColumn("_p", F.from_json("payload", QUOTE_FEED_SCHEMA))
    p = p.withColumn("_at", F.try_to_timestamp(F.concat_ws(" ", "_p.date", "_p.time"), F.lit("yyyy-MM-dd HHmmss")))
    return p.withColumn("_problem", _first_problem(("wrong_market", F.col("_p.market") != market), ("bad_time", F.col("_at").isNull())))


def snapshot_rejects(payloads: DataFrame, market: str = "TSE") -> DataFrame:
    """market, day, time and problem of the payloads that ``snapshot_quotes`` leaves out."""
    p = _snapshot(payloads, market).filter("_problem IS NOT NULL")
    return p.select(F.col("_p.market").alias("market"), F.col("_p.date").alias("day"), F.col("_p.time").alias("time"), F.col("_problem").alias("problem"))


def snapshot_quotes(payloads: DataFrame, market: str = "TSE", zone: str = "Asia/Taipei") -> DataFrame:
    """Nested quote snapshots of one market -> one row per quote with the snapshot time; works on streams as well."""
    p = _snapshot(payloads, market).filter("_problem IS NULL")
    rows = p.select(F.col("_at").alias("snapshot_at"), F.explode("_p.data").alias("_q"), *[c for c in ("seq",) if c in payloads.columns])
    return rows.select(
        "snapshot_at",
        F.col("_q.type").alias("type"),
        F.col("_q.symbol").alias("symbol"),
        F.col("_q.name").alias("name"),
        F.col("_q.openPrice").alias("open_price"),
        F.col("_q.closePrice").alias("close_price"),
        F.col("_q.lastPrice").alias("last_price"),
        F.col("_q.change").alias("change"),
        F.col("_q.tradeVolume").alias("trade_volume"),
        F.col("_q.tradeValue").alias("trade_value"),
        F.from_utc_timestamp(F.timestamp_micros("_q.lastUpdated"), zone).alias("updated_at"),
        F.col("_q.isTrial").alias("is_trial"),
        *[c for c in ("seq",) if c in payloads.columns],
    )
