"""Queries over feed ingest and scalar functions. Payload texts are built by Spark from the driver tables and parsed back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.functions.text import search_normal
from tickloom.operators import clean as C
from tickloom.operators import flows as FL
from tickloom.operators.calendar import calendar_rules
from tickloom.plans.oracle import oracle, rlist, rnd
from tickloom.plans.registry import Market, query, rounded, text
from tickloom.plans.store import TS, stamp
from tickloom.sources import feeds as FD
from tickloom.sources import standins, web

era = lambda c: F.concat((F.year(c) - 1911).cast("string"), F.date_format(c, "/MM/dd"))
ERA_SQL = "(year({0}) - 1911) || strftime({0}, '/%m/%d')"


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# --- bar feeds ----------------------------------------------------------------------------------------------------


def monthly_payloads(m: Market, load_seq: int = 1, factor: float = 1.0):
    """One payload per (symbol, month): at most 31 rows each."""
    cells = F.array(
        era(F.col("date")), F.format_number("volume", 0), text("turnover"), text("open"), text("high"), text("low"), text(F.col("close") * factor), F.lit("X0.00"), F.lit(""), F.col("mark")
    )
    month = m.bars.groupBy("symbol", F.date_format("date", "yyyyMM01").alias("month")).agg(F.sort_array(F.collect_list(cells)).alias("data"))
    fields = lit_array(("日期", "成交股數", "成交金額", "開盤價", "最高價", "最低價", "收盤價", "漲跌價差", "成交筆數", "註記"))
    body = F.to_json(F.struct(F.lit("OK").alias("stat"), fields.alias("fields"), "data"))
    return month.select("symbol", "month", F.lit(load_seq).alias("load_seq"), body.alias("payload"))


_BAR = "select symbol, cast(date as varchar) as date, " + rlist("open", "high", "low", "close", "volume") + ", mark, valid from bars"


def bar_rows(rows):
    rows = rows.select("symbol", text("date").alias("date"), "open", "high", "low", "close", "volume", "mark", "valid")
    return rounded(rows, "open", "high", "low", "close", "volume")


@query("a1_monthly_feed", oracle(_BAR, "bars"))
def a1(m):
    return bar_rows(FD.monthly_bars(monthly_payloads(m)))


@query("a4_last_load_wins", oracle(_BAR, "bars"))
def a4(m):
    """A first load with doubled closes is overwritten by the second."""
    loads = monthly_payloads(m, 1, 2.0).unionByName(monthly_payloads(m, 2))
    return bar_rows(FD.last_load_wins(FD.monthly_bars(loads)))


def day_payloads(m: Market):
    """Market files of a session in pages of symbols; even sessions use the table list, odd ones the numbered layout."""
    sign = F.when(F.col("close") >= F.col("open"), "<p style='color:red'>+</p>").otherwise("<p style='color:green'>-</p>")
    cells = F.array(
        F.col("symbol"), F.col("symbol"), F.format_number("volume", 0), text("turnover"), text("open"), text("high"), text("low"), text("close"), sign,
        F.format_number(F.abs(F.col("close") - F.col("open")), 2), F.col("mark"),
    )
    pages = F.floor(F.regexp_extract("symbol", r"(\d+)$", 1).try_cast("int") / 10)
    day = m.bars.groupBy("date", "ord", pages.alias("_page")).agg(F.sort_array(F.collect_list(cells)).alias("data"))
    fields = lit_array((*FD.DAY_REQUIRED, "註記"))
    stat, when = F.lit("OK").alias("stat"), F.date_format("date", "yyyyMMdd").alias("date")
    table = F.struct(F.lit("t").alias("title"), fields.alias("fields"), F.col("data"))
    other = F.struct(F.lit("index").alias("title"), lit_array(("指數",)).alias("fields"), F.array(lit_array(("1",))).alias("data"))
    new = F.to_json(F.struct(stat, when, F.array(other, table).alias("tables")))
    old = F.to_json(F.struct(stat, when, lit_array(("指數",)).alias("fields1"), F.array(lit_array(("1",))).alias("data1"), fields.alias("fields9"), F.col("data").alias("data9")))
    return day.select(text("date").alias("session"), F.when(F.col("ord") % 2 == 0, new).otherwise(old).alias("payload"))


@query(
    "a2_market_day_feed",
    oracle("select symbol, cast(date as varchar) as date, " + rlist("open", "high", "low", "close", "volume") + ", mark, valid, case when close >= open then '+' else '-' end as sign from bars", "bars"),
)
def a2(m):
    rows = FD.market_day_bars(day_payloads(m))
    signed = rows.withColumn("sign", F.substring("change", 1, 1))
    return bar_rows(rows).join(signed.select("symbol", text("date").alias("date"), "sign"), ["symbol", "date"])


def broken_days(m: Market):
    """Day payloads of which some are broken by the day of the month: 1-3 dated a day late, 4-6 with a header gone, 7-9 with
    the last cell of symbols ending in 5 gone, 10-12 with every row twice."""
    k = F.dayofmonth(F.col("session").cast("date"))
    late = F.replace("payload", F.date_format(F.col("session").cast("date"), "yyyyMMdd"), F.date_format(F.date_add(F.col("session").cast("date"), 1), "yyyyMMdd"))
    gone = F.replace("payload", F.lit("成交金額"), F.lit("?"))
    short = F.regexp_replace("payload", r'(\["[^"]*5",[^\]]*),"[^"]*"\]', "$1]")
    twice = F.regexp_replace("payload", r'"(data9?)":\[(\["Brand.*?\])\]', '"$1":[$2,$2]')
    payload = F.when(k <= 3, late).when(k <= 6, gone).when(k <= 9, short).when(k <= 12, twice).otherwise(F.col("payload"))
    return day_payloads(m).select("session", payload.alias("payload"))


_DAYS = "select symbol, date, cast(regexp_extract(symbol, '([0-9]+)$', 1) as int) // 10 as pg, day(date) as k from bars"


@query(
    "a2_rejects",
    oracle(
        f"select cast(date as varchar) as session, symbol, problem, count(*) as n from (select distinct date, pg, cast(null as varchar) as symbol, case when k <= 3 then 'wrong_date' else 'tables' end as problem from ({_DAYS}) a where k <= 6 "
        f"union all select date, pg, symbol, 'row_width' from ({_DAYS}) b where k between 7 and 9 and symbol like '%5' union all select date, pg, symbol, 'duplicate' from ({_DAYS}) c, (values (1), (2)) t where k between 10 and 12) r group by 1, 2, 3",
        "bars",
    ),
)
def a2_rejects(m):
    rows = FD.market_day_rejects(broken_days(m))
    return rows.groupBy(text("session").alias("session"), "symbol", "problem").agg(F.count("*").alias("n"))


@query("a2_kept", oracle(f"select symbol, cast(date as varchar) as date from ({_DAYS}) d where k > 12 or (k between 7 and 9 and symbol not like '%5')", "bars"))
def a2_kept(m):
    return FD.market_day_bars(broken_days(m)).select("symbol", text("date").alias("date"))


@query("a3_universe_bars", oracle("select b.symbol, count(*) as bars from bars b join sec s on s.symbol = b.symbol and s.kind = 'stock' group by 1", "bars", "sec"))
def a3(m):
    rows = FD.universe_bars(FD.market_day_bars(day_payloads(m)), m.securities.filter("kind = 'stock'"))
    return rows.groupBy("symbol").agg(F.count("*").alias("bars"))


# --- security master ----------------------------------------------------------------------------------------------


def companies(m: Market):
    key = F.col("c_custkey")
    return m.table("customer").select(
        F.concat(F.lit(" "), (key + 1000).cast("string")).alias("code"), F.when(key % 10 == 0, F.concat("c_name", F.lit("-dr"))).when(key % 7 == 0, "").otherwise(F.col("c_name")).alias("short_name"),
        F.concat(F.lit("F"), "c_name").alias("full_name"), F.when(key % 3 == 0, "").otherwise("19990131").alias("listed"), F.when(key % 5 == 0, " ").otherwise(F.lpad((key % 30).cast("string"), 2, "0")).alias("industry"),
    )


def funds(m: Market):
    key = F.col("p_partkey")
    suffix = F.when(key % 7 == 0, "A").when(key % 11 == 0, "K").otherwise("")
    name = F.concat(F.when(key % 13 == 0, "主動").otherwise(""), "p_name", F.when(key % 2 == 0, "人民幣").when(key % 3 == 0, "美元").otherwise(""))
    return m.table("part").select(
        F.concat(F.lit("00"), F.lpad((key % 1000).cast("string"), 3, "0"), suffix).alias("code"), name.alias("name"), F.lit("2001.02.28").alias("listed"), F.col("p_type").alias("index_name")
    )


_FUND = (
    "select '00' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') || case when p_partkey % 7 = 0 then 'A' when p_partkey % 11 = 0 then 'K' else '' end as symbol, "
    "case when p_partkey % 13 = 0 then '主動' else '' end || p_name || case when p_partkey % 2 = 0 then '人民幣' when p_partkey % 3 = 0 then '美元' else '' end as name, p_type, p_partkey as k from part"
)


@query(
    "a5_security_master",
    "select cast(c_custkey + 1000 as varchar) as symbol, case when c_custkey % 7 = 0 then 'F' || c_name else c_name end as name, 'stock' as kind, case when c_custkey % 3 <> 0 then '1999-01-31' end as listing_date, 'TWD' as currency, "
    "case when c_custkey % 5 <> 0 then lpad(cast(c_custkey % 30 as varchar), 2, '0') end as industry, null as etf_style from customer where c_custkey % 10 <> 0 and c_custkey < 9000 union all "
    "select symbol, name, 'etf', '2001-02-28', case when symbol like '%K' then case when contains(name, '人民幣') then 'CNY' when contains(name, '美元') then 'USD' else 'unknown' end else 'TWD' end, null, "
    f"case when symbol like '%A' or name like '主動%' then 'active' else 'passive' end from (select *, count(*) over (partition by symbol) as copies from ({_FUND}) g) f where copies = 1",
)
def a5(m):
    rows = FD.clean_master(FD.security_master(companies(m), funds(m)))
    return rows.select("symbol", "name", "kind", text("listing_date").alias("listing_date"), "currency", "industry", "etf_style")


@query(
    "a5_rejects",
    f"select cast(c_custkey + 1000 as varchar) as symbol, 'code_shape' as problem from customer where c_custkey % 10 <> 0 and c_custkey >= 9000 union all select symbol, 'duplicate' from ({_FUND}) f group by 1 having count(*) > 1",
)
def a5_rejects(m):
    return FD.master_rejects(FD.security_master(companies(m), funds(m))).select("symbol", "problem")


@query("a6_listed_catalog", f"select cast(c_custkey + 1000 as varchar) as symbol, 'stock' as kind from customer where c_custkey % 10 <> 0 and c_custkey < 9000 union all select symbol, 'etf' from ({_FUND}) f")
def a6(m):
    return FD.listed_catalog(companies(m), funds(m))


@query("a7_simple_universe", f"select symbol, name, 'etf' as kind from ({_FUND}) f where regexp_full_match(symbol, '00[0-9]{{2,3}}')")
def a7(m):
    return FD.simple_universe(funds(m).select("code", "name"))


# --- official feeds -----------------------------------------------------------------------------------------------


def institution_payloads(m: Market):
    """Payload pages per day; missing sides are written as 0 shares."""
    f = standins.flows(m.spark, m.sf_dir).na.fill(0.0, ["buy", "sell", "net"])
    money = lambda c: F.format_number(F.col(c), 2)
    cells = [F.col("symbol"), F.col("symbol")] + [money(("buy", "sell", "net")[i % 3]) for i in range(17)]
    day = f.groupBy("data_date", page_of(F.col("symbol").cast("long"))).agg(F.sort_array(F.collect_list(F.array(*cells))).alias("data"))
    body = F.struct(F.lit("OK").alias("stat"), F.date_format("data_date", "yyyyMMdd").alias("date"), F.lit("單位：股").alias("hints"), lit_array(FL.INSTITUTION_FIELDS).alias("fields"), "data")
    return day.select(F.col("data_date").alias("requested_date"), F.to_json(body).alias("payload"))


_FLOW0 = "select cast(user_id as varchar) as symbol, cast(ts as date) as d, coalesce(sum(value) filter (where event_type = 'purchase'), 0) as b, coalesce(sum(value) filter (where event_type = 'view'), 0) as s, count(value) filter (where event_type = 'purchase') > 0 and count(value) filter (where event_type = 'view') > 0 as twosided from events group by 1, 2"


@query("a11_institution_feed", f"select symbol, cast(d as varchar) as data_date, {rnd('b', 2, 'buy')}, {rnd('s', 2, 'sell')}, {rnd('case when twosided then b - s else 0 end', 2, 'foreign_net')}, 'shares' as unit from ({_FLOW0}) f")
def a11(m):
    rows = FD.institution_flows(institution_payloads(m))
    cell = lambda i: F.element_at("official_fields", F.lit(FL.INSTITUTION_FIELDS[i]))
    return rows.select("symbol", text("data_date").alias("data_date"), cell(2).alias("buy"), cell(3).alias("sell"), "foreign_net", "unit")


def broken_institution(m: Market):
    """Institution payloads broken by the day of the month: 1 status, 2 date, 3 header, 4 unit, 5 one figure a row, 6 one cell a row."""
    k = F.dayofmonth("requested_date")
    payload = (
        F.when(k == 1, F.replace("payload", F.lit('"OK"'), F.lit('"x"')))
        .when(k == 2, F.replace("payload", F.date_format("requested_date", "yyyyMMdd"), F.lit("20010101")))
        .when(k == 3, F.replace("payload", F.lit(FL.INSTITUTION_FIELDS[0]), F.lit("?")))
        .when(k == 4, F.replace("payload", F.lit("單位：股"), F.lit("單位：張")))
        .when(k == 5, F.regexp_replace("payload", r',"[\d.,]+"\]', ',"--"]'))
        .when(k == 6, F.regexp_replace("payload", r'\["(\d+)","\d+",', '["$1",'))
        .otherwise(F.col("payload"))
    )
    return institution_payloads(m).select("requested_date", payload.alias("payload"))


_BROKEN = "select distinct cast(ts as date) as d, user_id // 500 as pg, day(ts) as k from events"
_BROKEN_ROWS = "select distinct cast(user_id as varchar) as symbol, cast(ts as date) as d, day(ts) as k from events"
_NAMED = "case k when 1 then 'bad_status' when 2 then 'wrong_date' when 3 then '{0}' when 4 then '{1}' when 5 then 'number' else 'row_width' end"


def rejects_sql(third: str, fourth: str) -> str:
    named = _NAMED.format(third, fourth)
    return (
        f"select cast(d as varchar) as day, symbol, problem, count(*) as n from (select d, pg, cast(null as varchar) as symbol, {named} as problem from ({_BROKEN}) a where k <= 4 "
        f"union all select d, 0, symbol, {named} from ({_BROKEN_ROWS}) b where k in (5, 6)) r group by 1, 2, 3"
    )


def counted(rejects):
    return rejects.groupBy(text("day").alias("day"), "symbol", "problem").agg(F.count("*").alias("n"))


@query("a11_rejects", rejects_sql("headers_changed", "unit_changed"))
def a11_rejects(m):
    return counted(FD.institution_rejects(broken_institution(m)))


def margin_payloads(m: Market):
    f = m.events.groupBy(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.max("event_id").alias("k"))
    cells = [F.col("symbol"), F.col("symbol")] + [text(F.col("n") * (i + 1)) for i in range(13)] + [F.concat(F.lit(" note "), text("k"))]
    day = f.groupBy("d", page_of(F.col("symbol").cast("long"))).agg(F.sort_array(F.collect_list(F.array(*cells))).alias("data"))
    groups = F.array(*[F.struct(F.lit(t).alias("title"), F.lit(s).alias("span")) for t, s in FD.MARGIN_SPANS])
    table = F.struct(lit_array(FD.MARGIN_FIELDS).alias("fields"), F.col("data"), groups.alias("groups"))
    body = F.to_json(F.struct(F.lit("ok").alias("stat"), F.date_format("d", "yyyyMMdd").alias("date"), F.array(table).alias("tables")))
    return day.select(F.col("d").alias("requested_date"), body.alias("payload"))


@query(
    "a12_margin_feed",
    "select cast(user_id as varchar) as symbol, cast(cast(ts as date) as varchar) as data_date, count(*) * 4e0 as financing_previous, count(*) * 5e0 as financing_current, count(*) * 10e0 as short_previous, count(*) * 13e0 as \"offset\", "
    "'note ' || max(event_id) as note from events group by 1, 2",
)
def a12(m):
    rows = FD.margin_balances(margin_payloads(m))
    return rows.select("symbol", text("data_date").alias("data_date"), "financing_previous", "financing_current", "short_previous", "offset", "note")


@query("a12_rejects", rejects_sql("tables", "groups_changed"))
def a12_rejects(m):
    """Margin payloads broken by the day of the month: 1 status, 2 date, 3 header, 4 spans, 5 one figure a row, 6 one cell a row."""
    k = F.dayofmonth("requested_date")
    payload = (
        F.when(k == 1, F.replace("payload", F.lit('"ok"'), F.lit('"x"')))
        .when(k == 2, F.replace("payload", F.date_format("requested_date", "yyyyMMdd"), F.lit("20010101")))
        .when(k == 3, F.replace("payload", F.lit('"資券互抵"'), F.lit('"?"')))
        .when(k == 4, F.replace("payload", F.lit('"span":2'), F.lit('"span":3')))
        .when(k == 5, F.regexp_replace("payload", r',"\d+",(" note)', ',"--",$1'))
        .when(k == 6, F.regexp_replace("payload", r'\["(\d+)","\d+",', '["$1",'))
        .otherwise(F.col("payload"))
    )
    return counted(FD.margin_rejects(margin_payloads(m).select("requested_date", payload.alias("payload"))))


PAGE_ROWS = 500


def page_of(number) -> Column:
    """Payload pages of at most ``PAGE_ROWS`` consecutive ids, so no payload grows with the table."""
    return F.floor((F.col(number) if isinstance(number, str) else number) / PAGE_ROWS)


def list_payloads(rows, entry):
    """Pages of events as JSON lists of objects."""
    return rows.groupBy(page_of("event_id").alias("_g")).agg(F.collect_list(entry).alias("_l")).select(F.to_json("_l").alias("payload"))


def revenue_payloads(m: Market):
    e = m.events
    entry = F.create_map(
        F.lit("資料年月 "), F.concat((F.year("ts") - 1911).cast("string"), F.date_format("ts", "MM")), F.lit("公司代號"), F.lpad(text("event_id"), 6, "0"), F.lit("營業收入-當月營收"), text("value"),
        F.lit("營業收入-去年當月營收"), F.when(F.col("event_id") % 4 == 0, "0").otherwise("1,000"), F.lit("營業收入-去年同月增減(%)"), F.when(F.col("event_id") % 5 == 0, "--").otherwise(text("value")),
        F.lit("出表日期"), era(F.to_date("ts")),
    )
    return list_payloads(e, entry)


@query(
    "a13_revenue_feed",
    "select lpad(cast(event_id as varchar), 6, '0') as symbol, strftime(ts, '%Y-%m') as period, case when event_id % 4 <> 0 and event_id % 5 <> 0 then value end as yoy_pct, cast(cast(ts as date) as varchar) as export_date from events",
)
def a13(m):
    rows = FD.monthly_revenue(FD.trimmed_rows(revenue_payloads(m)).filter("NOT collides"))
    return rows.select("symbol", "period", "yoy_pct", text("export_date").alias("export_date"))


@query(
    "a13_rejects",
    "select case when event_id % 7 <> 0 then lpad(cast(event_id as varchar), 6, '0') end as symbol, case when event_id % 7 = 0 then 'headers_collide' else 'no_date' end as problem from events where event_id % 7 = 0 or event_id % 11 = 0",
)
def a13_rejects(m):
    """Every seventh row has a header twice but for a space, every eleventh no month."""
    month = F.when(F.col("event_id") % 11 == 0, "--").otherwise("11508")
    row = F.create_map(F.lit("資料年月 "), month, F.lit("公司代號"), F.lpad(text("event_id"), 6, "0"))
    entry = F.when(F.col("event_id") % 7 == 0, F.map_concat(row, F.create_map(F.lit("資料年月"), month))).otherwise(row)
    return FD.list_rejects(FD.trimmed_rows(list_payloads(m.events, entry)), "公司代號", FD.list_day("revenue"))


def announcement_rows(m: Market):
    clock = F.when(F.col("event_id") % 6 == 0, "250000").otherwise(F.regexp_replace(F.date_format("ts", "HHmmss"), "^0+(?=.)", ""))
    entry = F.create_map(
        F.lit("公司代號"), F.lpad(text("user_id"), 4, "0"), F.lit("發言日期"), F.concat((F.year("ts") - 1911).cast("string"), F.date_format("ts", "MMdd")), F.lit("發言時間"), clock,
        F.lit("主旨"), F.concat("event_type", text("event_id")), F.lit("事實發生日"), era(F.to_date("ts")),
    )
    return FD.trimmed_rows(list_payloads(m.events, entry)).filter("NOT collides")


@query(
    "a14_announcement_feed",
    f"select lpad(cast(user_id as varchar), 4, '0') as symbol, event_type || event_id as headline, strftime(ts, '%Y-%m-%d') || '|' || t || '|' || event_type || event_id as key, case when event_id % 6 <> 0 then {TS.format('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts) - interval 8 hour')} end as published, "
    "case when event_id % 6 = 0 then 'unverified' else 'verified' end as time_status from (select *, case when event_id % 6 = 0 then '250000' else coalesce(nullif(ltrim(strftime(ts, '%H%M%S'), '0'), ''), '0') end as t from events) e",
)
def a14(m):
    rows = FD.announcements(announcement_rows(m))
    return rows.select("symbol", "headline", "key", stamp("published_at").alias("published"), "time_status")


def action_rows(m: Market):
    entry = F.create_map(
        F.lit("Date"), F.concat((F.year("ts") - 1911).cast("string"), F.date_format("ts", "MMdd")), F.lit("Code"), F.lpad(text("user_id"), 4, "0"), F.lit("Exdividend "), F.col("event_type"), F.lit("CashDividend"), F.when(F.col("value") > 300, "--").otherwise(text("value"))
    )
    return FD.trimmed_rows(list_payloads(m.events, entry)).filter("NOT collides")


@query("a15_dividend_feed", "select lpad(cast(user_id as varchar), 4, '0') as symbol, cast(cast(ts as date) as varchar) as data_date, event_type as type, case when value <= 300 then value end as cash_dividend from events")
def a15(m):
    rows = FD.dividend_actions(action_rows(m))
    return rows.select("symbol", text("data_date").alias("data_date"), "type", "cash_dividend")


@query(
    "a16_contract_checks",
    "select lpad(cast(user_id as varchar), 4, '0') as symbol, strftime(ts, '%Y-%m-%d') as key, 'duplicate' as problem from events group by 1, 2 having count(*) > 1",
)
def a16(m):
    return FD.contract_violations(FD.dividend_actions(action_rows(m)))


# --- posts and pages ----------------------------------------------------------------------------------------------

_LINK = '<a\\b[^>]*\\bhref="(/[A-Za-z]+)"'


@query("a17_index_links", f"select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '{_LINK}', 1))), '|') as links from pages")
def a17(m):
    rows = web.index_links(m.table("pages"), pattern="/[A-Za-z]+", base="")
    return rows.select("page_id", F.array_join(F.sort_array("links"), "|").alias("links"))


@query("a18_article_extraction")
def a18(m):
    """Every page as an article body; compared with hand-made articles in the tests."""
    pages = m.table("pages").withColumn("html", F.concat(F.lit('<div id="main-content">'), "html", F.lit("</div>")))
    parsed = web.articles(web.article_text(pages, "page_id"))
    return parsed.select("page_id", F.length("text").alias("chars"))


def forum_payloads(m: Market):
    when = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 9 == 0, "").otherwise("Z"))
    entry = F.struct(text("event_id").alias("id"), F.col("event_type").alias("title"), text("user_id").alias("excerpt"), when.alias("createdAt"))
    return list_payloads(m.events, entry)


@query(
    "a19_forum_posts",
    "select cast(event_id as varchar) as id, event_type || ' ' || user_id as text from events, (select date_trunc('second', max(ts)) as now from events) n where event_id % 9 <> 0 and date_trunc('second', ts) between now - interval 7 day and now",
)
def a19(m):
    now = F.date_trunc("second", m.now)
    return FD.forum_posts(forum_payloads(m), now - F.expr("interval 7 days"), now).select("id", "text")


@query(
    "a20_social_posts",
    "select cast(event_id as varchar) as id, event_type as text from events, (select date_trunc('second', max(ts)) as now from events) n where event_id % 3 <> 0 and date_trunc('second', ts) between now - interval 7 day and now",
)
def a20(m):
    now = F.date_trunc("second", m.now)
    link = F.concat(F.lit("https://"), F.when(F.col("event_id") % 3 == 0, "example.com").otherwise("www.threads.net"), F.lit("/p/"), text("event_id"))
    entry = F.struct(text("event_id").alias("id"), F.col("event_type").alias("text"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), link.alias("permalink"))
    day = m.events.groupBy(page_of("event_id")).agg(F.collect_list(entry).alias("data")).select(F.to_json(F.struct("data")).alias("payload"))
    return FD.social_posts(day, now - F.expr("interval 7 days"), now).select("id", "text")


@query("a21_snapshot_feed", "select cast(user_id as varchar) as symbol, count(*) as quotes, " + rnd("sum(value)", 4, "price") + f", {TS.format('max(ts)')} as updated from events group by 1")
def a21(m):
    """One nested payload per hour and page."""
    from pyspark.sql.functions import unix_micros

    q = F.struct(
        F.lit("EQUITY").alias("type"), text("user_id").alias("symbol"), F.col("value").alias("closePrice"), (unix_micros("ts") - 8 * 3600 * 1_000_000).alias("lastUpdated"), F.lit(False).alias("isTrial")
    )
    hour = m.events.groupBy(F.date_trunc("hour", "ts").alias("h"), page_of("event_id")).agg(F.collect_list(q).alias("data"))
    body = F.struct(F.lit("TSE").alias("market"), F.date_format("h", "yyyy-MM-dd").alias("date"), F.date_format("h", "HHmmss").alias("time"), "data")
    rows = FD.snapshot_quotes(hour.select(F.to_json(body).alias("payload")))
    return rows.groupBy("symbol").agg(F.count("*").alias("quotes"), F.round(F.sum("close_price"), 4).alias("price"), stamp(F.max("updated_at")).alias("updated"))


@query(
    "a21_rejects",
    "select case when h % 2 = 0 then 'OTC' else 'TSE' end as market, case when h % 2 = 0 then 'wrong_market' else 'bad_time' end as problem, count(*) as n from (select distinct date_trunc('hour', ts) as t, hour(ts) as h from events) e where h % 2 = 0 or h % 3 = 0 group by 1, 2",
)
def a21_rejects(m):
    """Payloads of an hour: even ones of another market, every third without a readable time."""
    hours = m.events.select(F.date_trunc("hour", "ts").alias("h")).distinct()
    body = F.struct(
        F.when(F.hour("h") % 2 == 0, "OTC").otherwise("TSE").alias("market"), F.date_format("h", "yyyy-MM-dd").alias("date"),
        F.when(F.hour("h") % 3 == 0, "noon").otherwise(F.date_format("h", "HHmmss")).alias("time"),
    )
    rows = FD.snapshot_rejects(hours.select(F.to_json(body).alias("payload")))
    return rows.groupBy("market", "problem").agg(F.count("*").alias("n"))


@query(
    "c14_source_manifest",
    "select url, case when host = 'www.thathe.example.net' then 'A' else 'unknown' end as source_family, dataset, requested from (select url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, "
    "regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), '([^/]*)$', 1) as dataset, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as requested from pages) q",
)
def c14(m):
    rows = C.source_manifest(m.table("pages").select("url"), {"www.thathe.example.net": "A"})
    return rows.select("url", "source_family", "dataset", S.url_param("url", "page").alias("requested"))


@query(
    "c14_source_status",
    "select count(*) as items, count(distinct family) as families, case when count(*) > 0 and bool_and(family = 'A') then 'single_source' else 'missing_evidence' end as verification_status, lang from "
    "(select case when regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) like '%.example.net' then 'A' else 'unknown' end as family, case when contains(url, '/en/') then 'en' else 'other' end as lang from pages) q group by lang",
)
def c14_status(m):
    """Pages of one host family are one source; the status is taken for English pages and for all others."""
    family = F.when(S.url_host("url").endswith(".example.net"), "A").otherwise("unknown")
    rows = m.table("pages").select(family.alias("source_family"), F.contains("url", F.lit("/en/")).alias("_en"))
    parts = [C.source_status(rows.filter(F.col("_en") == en), "A").withColumn("lang", F.lit(name)) for en, name in ((True, "en"), (False, "other"))]
    return parts[0].unionByName(parts[1])


@query(
    "c16_allowed_links",
    "select page_id, case when url like 'https://%' and regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) in (select h from (select regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as h from pages group by 1 having count(*) > 1) t) then url else '' end as link from pages",
)
def c16(m):
    """The listed hosts are those of more than one page."""
    pages = m.table("pages").select("page_id", "url")
    hosts = pages.groupBy(S.url_host("url").alias("host")).count().filter("count > 1")
    return C.allowed_links(pages, hosts).select("page_id", "link")


# --- scalar functions ---------------------------------------------------------------------------------------------


@query("f1_iso_date", f"select distinct {ERA_SQL.format('l_shipdate')} as text, cast(cast(l_shipdate as date) as varchar) as day from lineitem")
def f1(m):
    t = m.table("lineitem").select(era(F.col("l_shipdate")).alias("text")).distinct()
    return t.select("text", text(S.iso_date("text")).alias("day"))


@query("f2_official_date", "select distinct strftime(o_orderdate, '%Y-%m-%d') as text, cast(cast(o_orderdate as date) as varchar) as day, cast(cast(o_orderdate as date) + 0 as varchar) as era_day from orders")
def f2(m):
    t = m.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    era_text = F.concat(F.lpad((F.year("d") - 1911).cast("string"), 3, "0"), F.date_format("d", "MMdd"))
    return t.select(text("d").alias("text"), text(S.compact_date(F.date_format("d", "yyyy/MM/dd"))).alias("day"), text(S.compact_date(era_text)).alias("era_day"))


@query("f3_number", "select event_id, case when event_id % 7 = 0 or event_id % 11 = 0 then null else " + rnd("value * 1000", 2) + " end as n from events")
def f3(m):
    t = F.when(F.col("event_id") % 7 == 0, "--").when(F.col("event_id") % 11 == 0, "nan").otherwise(F.format_number(F.col("value") * 1000, 2))
    return m.events.select("event_id", S.number(t).alias("n"))


@query("f4_strict_number", "select event_type, " + rnd("sum(value)", 4, "total") + " from events group by 1")
def f4(m):
    return m.events.groupBy("event_type").agg(F.round(F.sum(S.strict_number(text("value"), "value")), 4).alias("total"))


@query("f5_positive", "select event_id, case when value - 20 > 0 then " + rnd("value - 20", 6) + " end as p from events")
def f5(m):
    return m.events.select("event_id", F.round(S.positive(F.col("value") - 20), 6).alias("p"))


@query("f6_percent", "select event_id, " + rnd("(value - user_id) / nullif(user_id, 0) * 100", 9, "pct") + " from events")
def f6(m):
    return m.events.select("event_id", S.percent("value", F.col("user_id").cast("double"), 9).alias("pct"))


@query("f7_finite", "select event_id, case when event_id % 5 <> 0 then value end as f, case when event_id % 5 <> 0 and value >= 10 then " + rnd("value - 10", 6) + " end as t from events")
def f7(m):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return m.events.select("event_id", S.finite(v).alias("f"), F.round(S.non_negative(v - 10), 6).alias("t"))


@query("f9_header_trim", "select count(*) filter (where event_id % 4 <> 0) as clean, count(*) filter (where event_id % 4 = 0) as collisions from events")
def f9(m):
    name = F.when(F.col("event_id") % 4 == 0, "Date").otherwise("Code ")
    entry = F.create_map(F.lit("Date "), text("ts"), name, text("user_id"))
    rows = FD.trimmed_rows(list_payloads(m.events, entry))
    return rows.agg(F.count_if(~F.col("collides")).alias("clean"), F.count_if("collides").alias("collisions"))


@query("f10_zoned_timestamp", f"select event_id, case when event_id % 2 = 0 then {TS.format('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts) - interval 8 hour')} end as t from events")
def f10(m):
    t = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+08:00").otherwise(""))
    return m.events.select("event_id", stamp(S.zoned_timestamp(t)).alias("t"))


@query("f11_required_instant", f"select event_id, {TS.format('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts)')} as t from events")
def f11(m):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return m.events.select("event_id", stamp(S.required_timestamp(t)).alias("t"))


@query("f12_text_normalise", "select p_partkey, '台' || lower(p_name) as t from part")
def f12(m):
    return m.table("part").select("p_partkey", search_normal(F.concat(F.lit(" 臺"), F.upper("p_name"))).alias("t"))


@query("f13_tag_strip", "select page_id, md5(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) as h from pages")
def f13(m):
    return m.table("pages").select("page_id", F.md5(S.strip_tags("html")).alias("h"))


@query("f14_canonical_hash", "select event_id, sha256('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}') as h from events")
def f14(m):
    return m.events.select("event_id", S.canonical_hash("event_id", "event_type").alias("h"))


@query("f15_url_parts", "select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), '([^/]*)$', 1) as dataset from pages")
def f15(m):
    return m.table("pages").select("page_id", S.url_host("url").alias("host"), S.url_dataset("url").alias("dataset"))


@query("f16_epoch_micros", f"select event_id, {TS.format('ts + interval 8 hour')} as local from events")
def f16(m):
    return m.events.select("event_id", stamp(S.micros_local(F.unix_micros("ts"))).alias("local"))


@query("f17_month_arithmetic", "select distinct cast(cast(o_orderdate as date) as varchar) as day, cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) as months from orders")
def f17(m):
    t = m.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return t.select(text("d").alias("day"), S.month_number("d").cast("long").alias("months"))


@query("f18_quote_clock", f"select event_id, {TS.format('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts)')} as t from events")
def f18(m):
    return m.events.select("event_id", stamp(S.quote_clock(F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HH:mm:ss"))).alias("t"))


@query(
    "f19_quality_label",
    f"select event_type, case when event_type = 'view' then '{S.QUALITY_LABELS['single_source']}' when event_type = 'click' then '{S.QUALITY_LABELS['missing_evidence']}' else '{S.QUALITY_UNRECORDED}' end as label, count(*) as n from events group by 1",
)
def f19(m):
    state = F.when(F.col("event_type") == "view", "single_source").when(F.col("event_type") == "click", "missing_evidence")
    return m.events.groupBy("event_type", S.quality_label(state).alias("label")).agg(F.count("*").alias("n"))


@query(
    "a8_calendar_rules",
    "select cast(cast(o_orderdate as date) as varchar) as date, bool_or(o_orderpriority = '1-URGENT') as is_open, bool_or(o_orderpriority <> '1-URGENT') as is_holiday from orders group by 1",
)
def a8_rules(m):
    word = F.when(F.col("o_orderpriority") == "1-URGENT", FD.OPENING_WORDS[0]).otherwise(F.col("o_orderpriority"))
    rows = calendar_rules(m.table("orders").select(F.col("o_orderdate").cast("date").alias("date"), word.alias("text")), FD.OPENING_WORDS)
    return rows.withColumn("date", text("date"))
