"""Queries over official observations, institution flows, posts and quotes (stand-ins from the events table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import flows as FL
from tickloom.operators import mentions as M
from tickloom.operators import pit as T
from tickloom.operators import quotes as Q
from tickloom.operators import ranking as R
from tickloom.operators.calendar import session_table
from tickloom.plans.oracle import cte, oracle, rlist, rnd
from tickloom.plans.registry import Market, query, rounded, text
from tickloom.sources import standins

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- point-in-time store ------------------------------------------------------------------------------------------

cte(
    "obs",
    "select event_type as source, cast(user_id as varchar) as symbol, strftime(cast(date_trunc('week', ts) as date), '%Y-%m-%d') as key, cast(date_trunc('week', ts) as date) as data_date, "
    "floor(value / 100) as value, ts, event_id as seq from events",
)
cte(
    "ver",
    "select * from (select *, lag(value) over (partition by source, symbol, key order by ts, seq) as pv, row_number() over (partition by source, symbol, key order by ts, seq) as rn from obs) q where rn = 1 or pv <> value",
    "obs",
)
cte("cutoff", "select max(ts) - interval 10 day as c, cast(max(ts) - interval 3 day as date) as d from events")


def versions(m: Market):
    def build():
        rows = T.content_hashed(standins.observations(m.spark, m.sf_dir), "symbol", "key", "value")
        return T.changed_arrivals(rows)

    return m.shared("versions", build)


def cutoff(m: Market):
    return m.now - F.expr("interval 10 days")


def last_day(m: Market):
    return F.to_date(m.now - F.expr("interval 3 days"))


@query("t1_append_if_changed", oracle("select source, symbol, key, value, seq from ver", "ver"))
def t1(m):
    return versions(m).select("source", "symbol", "key", "value", "seq")


_LATEST = "select source, symbol, key, data_date, value, seq, ts from (select *, row_number() over (partition by source, symbol, key order by ts desc, seq desc) as r from ver, cutoff where {0}) q where r = 1"


@query("t2_as_of_query", oracle("select source, symbol, key, value, seq from (" + _LATEST.format("ts <= c and data_date <= d") + ") z", "ver", "cutoff"))
def t2(m):
    return T.latest_versions(versions(m), cutoff(m), last_day(m)).select("source", "symbol", "key", "value", "seq")


# Features: purchases of a day play institution nets, view volume the traded volume, signups the monthly revenue.
cte(
    "pit_inst",
    "select cast(user_id as varchar) as symbol, cast(ts as date) as date, sum(case when event_type = 'purchase' then value when event_type = 'view' then -value else 0 end) as net, count(*) as n from events group by 1, 2",
)
cte("pit_days", "select date, row_number() over (order by date desc) - 1 as back from (select distinct cast(ts as date) as date from events, cutoff where cast(ts as date) <= d) q", "cutoff")


def pit_inputs(m: Market):
    e = m.events
    net = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "view", -F.col("value")).otherwise(0.0))
    daily = e.groupBy(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("data_date")).agg(net.alias("total_net"), F.count("*").cast("double").alias("volume"))
    inst = daily.select(
        "symbol", "data_date", "total_net", F.lit("shares").alias("unit"), text("data_date").alias("key"), F.lit("h").alias("content_hash"), F.to_timestamp("data_date").alias("available_at")
    )
    signups = e.filter("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("symbol"), F.trunc("ts", "month").cast("date").alias("data_date"), F.col("ts").alias("available_at"), F.trunc("ts", "month").alias("period"), F.col("value").alias("yoy_pct")
    )
    return inst, signups, daily.select("symbol", F.col("data_date").alias("date"), "volume"), session_table(e.select(F.to_date("ts").alias("date")))


def pit_rows(m: Market):
    inst, signups, volumes, sessions = pit_inputs(m)
    symbols = m.events.select(F.col("user_id").cast("string").alias("symbol")).distinct()
    return T.pit_features(symbols, inst, signups, volumes, sessions, last_day(m))


PIT = (
    "select u.symbol, x.net, x.ratio, x.streak, y.yoy, x.ratio is not null and y.yoy is not null as eligible from (select distinct cast(user_id as varchar) as symbol from events) u left join "
    "(select symbol, case when count(*) = 5 then sum(net) end as net, case when count(*) = 5 then sum(net) / sum(n) end as ratio, case when count(*) = 5 then coalesce(min(case when net <= 0 then back end), 5) end as streak "
    "from pit_inst join pit_days using (date) where back < 5 group by 1) x on x.symbol = u.symbol left join (select cast(user_id as varchar) as symbol, arg_max(value, ts) as yoy from events where event_type = 'signup' group by 1) y on y.symbol = u.symbol"
)


@query("t3_pit_features", oracle(f"select symbol, {rnd('net', 4, 'institution_net_5')}, {rnd('ratio', 6, 'institution_ratio_5')}, streak as buy_streak, {rnd('yoy', 6, 'revenue_yoy_pct')}, eligible from ({PIT}) z", "pit_inst", "pit_days"))
def t3(m):
    rows = pit_rows(m).drop("provenance").withColumn("buy_streak", F.col("buy_streak").cast("long"))
    return rounded(rounded(rows, "institution_net_5", digits=4), "institution_ratio_5", "revenue_yoy_pct")


@query("w15_buy_streak", oracle(f"select streak as buy_streak, count(*) as symbols from ({PIT}) z group by 1", "pit_inst", "pit_days"))
def w15(m):
    return pit_rows(m).groupBy(F.col("buy_streak").cast("long").alias("buy_streak")).agg(F.count("*").alias("symbols"))


_SOURCES = ("click", "error", "purchase", "signup", "view")


def listed(m: Market):
    return m.events.select(F.col("user_id").cast("string").alias("symbol"), F.when(F.col("user_id") % 5 == 0, "etf").otherwise("stock").alias("kind")).distinct()


@query(
    "t4_symbol_detail",
    oracle(
        "select l.symbol, l.source, v.key, v.value, case when l.source = 'signup' and l.kind <> 'stock' then 'not_applicable' when v.key is null then 'missing' when l.source = 'error' then 'stale' else 'available' end as status from "
        "(select distinct cast(user_id as varchar) as symbol, case when user_id % 5 = 0 then 'etf' else 'stock' end as kind, s.source from events cross join (select unnest(['click','error','purchase','signup','view']) as source) s) l "
        "left join (select *, row_number() over (partition by symbol, source order by data_date desc, key desc) as rn from (" + _LATEST.format("ts <= c and (data_date <= d or source = 'view')") + ") a) v "
        "on v.symbol = l.symbol and v.source = l.source and v.rn <= 10 where not (l.source = 'signup' and l.kind <> 'stock') or coalesce(v.rn, 1) = 1",
        "ver", "cutoff",
    ),
)
def t4(m):
    rows = T.symbol_detail(listed(m), versions(m), _SOURCES, cutoff(m), last_day(m), ["error"], ["signup"], ["view"])
    return rows.select("symbol", "source", "key", "value", "status")


@query(
    "t5_dual_view",
    oracle(
        "select 'current' as view, source, symbol, key, value from (" + _LATEST.format("data_date <= d") + ") a union all select 'at_signal', source, symbol, key, value from (" + _LATEST.format("ts <= c and data_date <= d") + ") b",
        "ver", "cutoff",
    ),
)
def t5(m):
    return T.dual_view(versions(m), cutoff(m), last_day(m)).select("view", "source", "symbol", "key", "value")


@query(
    "t5_views_of_snapshots",
    oracle(
        "select snapshot_id, source, symbol, key, value from (select s.snapshot_id, v.source, v.symbol, v.key, v.value, row_number() over (partition by s.snapshot_id, v.source, v.symbol, v.key order by v.ts desc, v.seq desc) as r "
        "from (select distinct strftime(date_trunc('week', ts), '%Y-%m-%d') as snapshot_id, cast(date_trunc('week', ts) as timestamp) + interval 60 hour as cutoff, cast(date_trunc('week', ts) as date) as as_of from events) s "
        "join ver v on v.ts <= s.cutoff and v.data_date <= s.as_of) q where r = 1",
        "ver",
    ),
)
def t5_snapshots(m):
    """What each weekly snapshot could know at its own cut-off."""
    week = F.date_trunc("week", "ts")
    manifest = m.events.select(F.date_format(week, "yyyy-MM-dd").alias("snapshot_id"), (week + F.expr("interval 60 hours")).alias("cutoff"), F.to_date(week).alias("as_of")).distinct()
    return T.versions_at(versions(m), manifest).select("snapshot_id", "source", "symbol", "key", "value")


@query(
    "g14_source_summary",
    oracle(
        "select h.source, coalesce(n, 0) as covered_symbols, cast(md as varchar) as latest_data_date, coalesce(o, 0) as observations, h.status from (select distinct event_type as source, "
        "case when event_type = 'error' then 'error' else 'success' end as status from events union all select 'never', 'not_collected') h left join (select source, count(distinct symbol) as n, max(data_date) as md, count(*) as o from ("
        + _LATEST.format("true") + ") a group by 1) x on x.source = h.source",
        "ver", "cutoff",
    ),
)
def g14(m):
    health = m.events.select(F.col("event_type").alias("source")).distinct().withColumn("status", F.when(F.col("source") == "error", "error").otherwise("success"))
    never = m.events.agg(F.lit("never").alias("source"), F.lit(None).cast("string").alias("status"))
    rows = T.source_summary(versions(m), health.unionByName(never))
    return rows.withColumn("latest_data_date", text("latest_data_date"))


# --- institution flows --------------------------------------------------------------------------------------------

cte(
    "flow",
    "select cast(user_id as varchar) as symbol, cast(ts as date) as date, sum(value) filter (where event_type = 'purchase') as buy, sum(value) filter (where event_type = 'view') as sell from events group by 1, 2",
)
cte(
    "legs",
    "select symbol, date, 'foreign' as grp, buy, sell, buy - sell as net from flow union all select symbol, date, 'trust', sell, buy, sell - buy from flow union all select symbol, date, 'dealer', buy + sell, buy * 2, buy - sell from flow",
    "flow",
)


def flow_observations(m: Market):
    """Observations in the institution feed's shape: foreign as traded, trust mirrored, dealer from two books."""
    f = standins.flows(m.spark, m.sf_dir)
    names = FL.INSTITUTION_FIELDS
    cells = {2: "buy", 3: "sell", 8: "sell", 9: "buy", 12: "buy", 13: "buy", 15: "sell", 16: "buy"}
    fields = F.map_from_arrays(F.array(*[F.lit(names[i]) for i in cells]), F.array(*[F.col(c) for c in cells.values()]))
    return f.select(
        "symbol", "data_date", F.lit("shares").alias("unit"), fields.alias("official_fields"), F.col("net").alias("foreign_net"), (-F.col("net")).alias("trust_net"), F.col("net").alias("dealer_net"),
        F.to_timestamp("data_date").alias("available_at"),
    )


@query("g6_daily_measures", oracle("select symbol, cast(date as varchar) as data_date, grp, " + rlist("buy", "sell", "net", digits=4) + " from legs", "legs"))
def g6(m):
    rows = rounded(FL.daily_measures(flow_observations(m)), "buy", "sell", "net", digits=4).withColumnRenamed("group", "grp")
    return rows.withColumn("data_date", text("data_date"))


TOTALS = (
    "select u.symbol, u.kind, g.grp, coalesce(x.n, 0) as observed_sessions, x.buy, x.sell, x.net from (select distinct cast(user_id as varchar) as symbol, case when user_id % 5 = 0 then 'etf' else 'stock' end as kind from events) u "
    "cross join (select unnest(['foreign', 'trust', 'dealer']) as grp) g left join (select symbol, grp, count(*) as n, case when count(buy) = {n} then sum(buy) end as buy, case when count(sell) = {n} then sum(sell) end as sell, "
    "case when count(net) = {n} then sum(net) end as net from legs join pit_days using (date) where back < {n} group by 1, 2) x on x.symbol = u.symbol and x.grp = g.grp"
)


def totals(m: Market, count: int):
    sessions = session_table(m.events.select(F.to_date("ts").alias("date")))
    return FL.period_totals(FL.daily_measures(flow_observations(m)), listed(m), sessions, last_day(m), count)


def _totals_query(name, n):
    @query(name, oracle(f"select symbol, kind, grp, observed_sessions, {rlist('buy', 'sell', 'net', digits=4)} from ({TOTALS.format(n=n)}) z", "legs", "pit_days"))
    def run(m):
        return rounded(totals(m, n).withColumnRenamed("group", "grp"), "buy", "sell", "net", digits=4)


_totals_query("g7_five_session_totals", 5)
_totals_query("g7_one_session_totals", 1)


@query(
    "r6_institution_lists",
    oracle(
        "select grp, metric, symbol, value, row_number() over (partition by grp, metric order by case when metric = 'net_sell' then value else -value end, symbol) as position, count(*) over (partition by grp, metric) as position_of from ("
        "select grp, 'net_buy' as metric, symbol, net as value from t where net > 0 union all select grp, 'net_sell', symbol, net from t where net < 0 union all select grp, 'buy', symbol, buy from t where buy > 0 union all "
        "select grp, 'sell', symbol, sell from t where sell > 0) z",
        "legs", "pit_days",
    ).replace("\nselect grp, metric", f",\nt as (select symbol, grp, {rlist('buy', 'sell', 'net', digits=4)} from ({TOTALS.format(n=1)}) z)\nselect grp, metric"),
)
def r6(m):
    """Lists of the published amounts: sums of doubles differ in their last bits by the order of the rows, so equal amounts would part by chance."""
    published = rounded(totals(m, 1), "buy", "sell", "net", digits=4)
    return FL.institution_lists(published).withColumnRenamed("group", "grp")


@query("j11_observation_lookup", oracle("select symbol, back, " + rnd("net", 4, "net") + " from legs join pit_days using (date) where grp = 'foreign' and back < 5", "legs", "pit_days"))
def j11(m):
    from tickloom.operators.breadth import recent_sessions

    sessions = session_table(m.events.select(F.to_date("ts").alias("date")))
    rows = FL.daily_measures(flow_observations(m)).filter(F.col("group") == "foreign").withColumnRenamed("data_date", "date")
    found = recent_sessions(rows, sessions, last_day(m), 5)
    return found.select("symbol", F.col("back").cast("long").alias("back"), F.round("net", 4).alias("net"))


@query("f8_complete_total", oracle("select symbol, count(*) as days, " + rnd("case when count(net) = count(*) then sum(net) end", 4, "net") + " from legs where grp = 'foreign' group by 1", "legs"))
def f8(m):
    from tickloom.functions.layout import complete_sum

    rows = standins.flows(m.spark, m.sf_dir)
    return rows.groupBy("symbol").agg(F.count("*").alias("days"), F.round(complete_sum(F.col("net")), 4).alias("net"))


# --- posts --------------------------------------------------------------------------------------------------------

AVAILABLE = ("click", "purchase", "signup", "view")


def posts(m: Market):
    return standins.posts(m.spark, m.sf_dir)


cte("nowts", "select max(ts) as now from events")
cte("uposts", "select event_type as source, cast(event_id as varchar) as id, cast(user_id as varchar) as symbol, ts from events, nowts where event_type <> 'error' and ts >= now - interval 7 day", "nowts")


def unique(m: Market):
    """The feed is delivered twice, so every post has to be deduplicated."""
    twice = posts(m).unionByName(posts(m).withColumn("seq", F.col("seq") + 1_000_000_000))
    return M.unique_posts(twice, AVAILABLE, m.now)


@query("p2_unique_posts", oracle("select source, id, symbol from uposts", "uposts"))
def p2(m):
    return unique(m).select("source", "id", F.col("symbols")[0].alias("symbol"))


_COUNTS = (
    "select w.wname as win, symbol, " + ", ".join(f"count(*) filter (where source = '{s}') as n_{s}" for s in AVAILABLE) + ", cast(null as bigint) as n_error, count(*) as total from uposts, nowts, "
    "(select '24h' as wname, 1 as days union all select '7d', 7) w where ts >= now - to_days(cast(w.days as int)) group by 1, 2"
)


@query("p3_mention_counts", oracle(_COUNTS, "uposts", "nowts"))
def p3(m):
    return M.mention_counts(unique(m), _SOURCES, AVAILABLE, m.now).withColumnRenamed("window", "win")


@query("p3_mention_evidence", oracle("select symbol, source, id from uposts", "uposts"))
def p3_evidence(m):
    return M.mention_evidence(unique(m), m.now).select("symbol", "source", "id")


@query("r7_mention_ranking", oracle(f"select win, symbol, total, row_number() over (partition by win order by total desc, symbol) as position from ({_COUNTS}) c", "uposts", "nowts"))
def r7(m):
    rows = M.mention_ranking(M.mention_counts(unique(m), _SOURCES, AVAILABLE, m.now))
    return rows.select(F.col("window").alias("win"), "symbol", "total", "position")


@query(
    "p4_retention_merge",
    "select event_type as source, cast(event_id as varchar) as id, event_id % 3 = 0 as refreshed from events, (select max(ts) as now from events) n where ts >= now - interval 7 day and (event_id % 2 = 0 or event_id % 3 = 0)",
)
def p4(m):
    """Stored: even posts of identifier version 2 (odd ones carry version 1); new: every third post."""
    stamped = posts(m).withColumn("refreshed", F.lit(False))
    previous = stamped.withColumn("identifier_version", F.when(F.col("seq") % 2 == 0, 2).otherwise(1))
    recent = F.col("published_at") >= m.now - F.expr("interval 7 days")
    fresh = posts(m).filter(recent & (F.col("seq") % 3 == 0)).withColumns({"refreshed": F.lit(True), "identifier_version": F.lit(2)})
    return M.retained_posts(previous, fresh, 2, m.now).select("source", "id", "refreshed")


_ROLLUP = (
    "select event_type as source, case when bool_and(ok) then 'success' when bool_or(ok) then 'partial' else 'failed' end as status from "
    "(select event_type, cast(ts as date) as d, max(value) > case when event_type = 'view' then 1000 when event_type = 'click' then -1 else 100 end as ok from events group by 1, 2) q group by 1"
)


@query("p4_collection_gate", f"select bool_or(status in ('success', 'partial')) as accepted from ({_ROLLUP}) r")
def p4_gate(m):
    return M.refuse_empty_collection(p5_statuses(m))


@query("p5_overall_status", f"select case when bool_and(status = 'success') then 'success' when bool_or(status in ('success', 'partial')) then 'partial' else 'failed' end as status from ({_ROLLUP}) r")
def p5_overall(m):
    return M.overall_status(p5_statuses(m))


@query(
    "p5_status_rollup",
    "select event_type as source, count(*) as expected_batches, count(*) filter (where ok) as successful_batches, case when bool_and(ok) then 'success' when bool_or(ok) then 'partial' else 'failed' end as status from "
    "(select event_type, cast(ts as date) as d, max(value) > case when event_type = 'view' then 1000 when event_type = 'click' then -1 else 100 end as ok from events group by 1, 2) q group by 1",
)
def p5(m):
    return p5_statuses(m)


def p5_statuses(m: Market):
    limit = F.when(F.col("source") == "view", 1000).when(F.col("source") == "click", -1).otherwise(100)
    batches = m.events.groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.max("value").alias("v")).withColumn("ok", F.col("v") > limit)
    return M.status_rollup(batches)


@query(
    "s7_sliding_mentions",
    oracle(
        "select w.wname as win, symbol, count(*) as total from (select cast(user_id as varchar) as symbol, date_trunc('hour', ts) as h from events) e, nowts, (select '24h' as wname, 24 as n union all select '7d', 168) w "
        "where h > date_trunc('hour', now) - to_hours(cast(w.n as int)) and h <= date_trunc('hour', now) group by 1, 2",
        "nowts",
    ),
)
def s7(m):
    return M.sliding_mentions(M.hourly_partials(posts(m)), m.now).withColumnRenamed("window", "win").withColumn("total", F.col("total").cast("long"))


@query(
    "j12_dictionary_join",
    "select d.doc_id, n.name from documents d join (select distinct name from (select unnest(regexp_extract_all(text, '[a-z]{5,}')) as name from benchmark) t) n on contains(d.text, n.name)",
)
def j12(m):
    return M.dictionary_hits(m.table("documents"), standins.mention_dictionary(m.spark, m.sf_dir), "doc_id", "text")


def document_mentions(m: Market):
    names = standins.mention_dictionary(m.spark, m.sf_dir)
    return M.mentions(m.table("documents").select("doc_id", "text"), names, "doc_id", "text")


# A name counts where it lies in no longer name; five letters (ambiguous) only as a code that stands alone. Any long name is finance context.
_P1 = r"""
with names as (select distinct name from (select unnest(regexp_extract_all(text, '[a-z]{5,}')) as name from benchmark) t),
held as (select doc_id, text, name from documents join names on contains(text, name)),
parts as (select doc_id, name, list_transform(string_split(text, name), lambda p: length(p)) as gaps from held),
places as (select doc_id, name, k, list_sum(gaps[1:k]) + (k - 1) * length(name) as at from (select *, unnest(range(1, len(gaps))) as k from parts) q),
free as (select distinct a.doc_id, a.name from places a where length(a.name) > 5 and not exists (
  select 1 from places b where b.doc_id = a.doc_id and length(b.name) > length(a.name) and b.at <= a.at and b.at + length(b.name) >= a.at + length(a.name))),
codes as (select doc_id, name from held where regexp_matches(text, '(^|[^0-9A-Za-z/.$])' || name || '($|\.($|[^0-9])|\s+($|[^\s%元塊圓張年月日美]|美($|[^元]))|[^0-9A-Za-z/.\s%元塊圓張年月日美])'))
select doc_id, name as symbol from free union select doc_id, name from codes
"""


@query("p1_mention_extraction", _P1)
def p1(m):
    """Long names with span containment; five-letter names need to stand alone as a code."""
    return document_mentions(m).select("doc_id", F.explode("symbols").alias("symbol"))


# --- quotes -------------------------------------------------------------------------------------------------------
# Every event is a quote of its user; the reference price is the value less a tenth of the event id's last digit.

cte(
    "rawq",
    "select event_id as seq, cast(user_id as varchar) as symbol, value as price, value * 1.1e0 as opening, value - (event_id % 10) / 10e0 as prior, ts, event_type from events",
)
cte("qnow", "select max(ts) as now from events where hour(ts) between 9 and 12")
cte(
    "quotes",
    "select r.symbol, case when cast(r.symbol as int) % 5 = 0 then 'etf' else 'stock' end as kind, r.price, r.opening, case when r.prior > 0 and event_type <> 'error' then (r.price - round(r.prior, 6)) / round(r.prior, 6) * 100 end as day_pct, "
    "case when r.prior > 0 and event_type <> 'error' then (r.opening - round(r.prior, 6)) / round(r.prior, 6) * 100 end as gap_pct, (r.price - r.opening) / r.opening * 100 as from_open_pct, r.ts, r.seq from rawq r, qnow "
    "where r.ts <= now + interval 5 second and hour(r.ts) >= 9 and cast(r.ts as date) = cast(now as date)",
    "rawq", "qnow",
)
cte("lastq", "select * from (select *, row_number() over (partition by symbol order by ts desc, seq) as rn from quotes) q where rn = 1", "quotes")


def quote_now(m: Market):
    return F.lit(m.events.filter(F.hour("ts").between(9, 12)).agg(F.max("ts")).first()[0])


def raw_quotes(m: Market):
    now = quote_now(m)
    return m.events.select(
        F.col("event_id").alias("seq"), F.lit("EQUITY").alias("type"), F.col("user_id").cast("string").alias("symbol"), F.lit(None).cast("string").alias("name"),
        (F.col("value") * 1.1).alias("open_price"), F.col("value").alias("close_price"), F.col("value").alias("last_price"), ((F.col("event_id") % 10) / 10.0).alias("change"),
        F.lit(10.0).alias("trade_volume"), (F.col("value") * 10).alias("trade_value"), F.col("ts").alias("updated_at"), (F.col("event_type") == "error").alias("is_trial"), now.alias("snapshot_at"),
    )


def quote_rows(m: Market):
    return Q.normalized_quotes(raw_quotes(m), listed(m), quote_now(m))


@query("s1_quote_normalisation", oracle("select seq, symbol, kind, price, " + rlist("day_pct", "gap_pct", "from_open_pct", digits=4) + " from quotes", "quotes"))
def s1(m):
    return quote_rows(m).select("seq", "symbol", "kind", "price", "day_pct", "gap_pct", "from_open_pct")


@query("s2_latest_quote", oracle("select symbol, seq, case when price > 0 and price < 1e18 then price end as price from lastq", "lastq"))
def s2(m):
    return Q.latest_quotes(quote_rows(m)).select("symbol", "seq", "price")


def exchange_raw(m: Market):
    e = m.events
    return e.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "otc").otherwise("tse").alias("ex"), F.concat(F.col("user_id").cast("string"), F.lit(".tw")).alias("ch"),
        F.col("user_id").cast("string").alias("symbol"), F.lit(None).cast("string").alias("name"), F.col("ts").alias("updated_at"), F.when(F.col("event_type") == "error", "-").otherwise(text("value")).alias("z"),
        text(F.col("value") * 2).alias("o"), text(F.col("value") * 4).alias("y"), F.lit("3").alias("v"),
    )


@query(
    "s3_exchange_quotes",
    oracle(
        "select event_id as seq, cast(user_id as varchar) as symbol, cast(ts as date) = cast(now as date) as same_day, cast(ts as date) = cast(now as date) and strftime(ts, '%H:%M:%S') between '09:00:00' and '13:30:00' and event_type <> 'error' and value > 0 as usable, "
        "case when event_type <> 'error' and value > 0 then -75e0 end as day_pct from events, qnow where event_type <> 'click' and ts <= now + interval 5 second",
        "qnow",
    ),
)
def s3(m):
    return Q.exchange_quotes(exchange_raw(m), listed(m), quote_now(m)).select("seq", "symbol", "same_day", "usable", "day_pct")


@query(
    "s4_snapshot_state",
    oracle(
        "select event_id, case when cast(ts as date) <> cast(now as date) or strftime(ts, '%H:%M:%S') < '09:00:00' or epoch(now) - epoch(ts) < -5 or (strftime(now, '%H:%M:%S') between '09:00:00' and '13:29:59' and epoch(now) - epoch(ts) > 90) then 'stale' "
        "else 'usable' end as state from events, qnow",
        "qnow",
    ),
)
def s4(m):
    return m.events.select("event_id", Q.snapshot_state(F.col("ts"), quote_now(m)).alias("state"))


@query(
    "s5_feed_state",
    oracle(
        "select 'live' as status, max(ts) = (select now from qnow) as newest, count(distinct user_id) as coverage, (select count(distinct user_id) from events) as universe_count from events, qnow where event_type not in ('click', 'error') and value > 0 "
        "and cast(ts as date) = cast(now as date) and strftime(ts, '%H:%M:%S') between '09:00:00' and '13:30:00' and ts <= now + interval 5 second",
        "qnow",
    ),
)
def s5(m):
    state = Q.feed_state(Q.exchange_quotes(exchange_raw(m), listed(m), quote_now(m)), listed(m), quote_now(m))
    newest = F.col("snapshot_at") == quote_now(m)
    # The newest usable quote may be older than now by less than the limit; only equality with SQL's max is compared.
    return state.select("status", newest.alias("newest"), "coverage", "universe_count")


_INTRA = " union all ".join(
    f"select '{key}' as list, symbol, {metric} as value, row_number() over (order by {metric} * {-sign}, symbol) as position from q4 where {metric} * {sign} > 0" + (f" and kind = '{kind}'" if kind else "")
    for key, metric, sign, kind in R.INTRADAY_LISTS
)
_Q4 = "select symbol, kind, round(day_pct, 4) as day_pct, round(gap_pct, 4) as gap_pct, round(from_open_pct, 4) as from_open_pct, price * 10 as amount, 10e0 as volume from lastq"


@query("r8_intraday_lists", oracle("@@", "lastq").replace("@@", "").rstrip() + f",\nq4 as ({_Q4})\nselect list, symbol, {rnd("value", 4, "value")}, position from ({_INTRA}) z")
def r8(m):
    rows = R.intraday_lists(Q.latest_quotes(quote_rows(m)))
    return rows.select("list", "symbol", F.round("value", 4).alias("value"), "position")


@query(
    "r9_opening_analysis",
    oracle("select symbol, " + rnd("gap_pct", 4, "gap_pct") + ", cast(sign(round(gap_pct, 4)) as int) as direction, row_number() over (order by abs(round(gap_pct, 4)) desc, symbol) as position from lastq where gap_pct is not null", "lastq"),
)
def r9(m):
    rows = R.opening_analysis(Q.latest_quotes(quote_rows(m)))
    return rows.select("symbol", F.round("gap_pct", 4).alias("gap_pct"), "direction", "position")


@query("r9_opening_counts", oracle("select count(*) filter (where gap_pct > 0) as up, count(*) filter (where gap_pct < 0) as down, count(*) filter (where gap_pct = 0) as flat from lastq where gap_pct is not null", "lastq"))
def r9_counts(m):
    return R.opening_counts(Q.latest_quotes(quote_rows(m)))


@query(
    "s5_session_state",
    "select event_id, case when isodow(ts) >= 6 or strftime(ts, '%H:%M:%S') < '09:00:00' then 'outside_session' when strftime(ts, '%H:%M:%S') < '13:30:00' then 'trading' else 'after_close' end as state from events",
)
def s5_session(m):
    return m.events.select("event_id", Q.session_state(F.col("ts")).alias("state"))


@query(
    "a22_batch_union",
    "select count(*) as batch_count, count(*) filter (where ok) as batches_ok, cast(sum(case when ok then n else 0 end) as bigint) as rows from (select user_id // 10 as batch, bool_and(event_type <> 'error' or value < 300) as ok, "
    "count(*) filter (where user_id % 2 = 0) as n from events group by 1) q",
)
def a22(m):
    """Batches of ten symbols; a batch with a large error quote failed, and only even symbols were requested."""
    rows = m.events.withColumns({"batch": F.floor(F.col("user_id") / 10), "_ok": ~((F.col("event_type") == "error") & (F.col("value") >= 300))})
    state = rows.groupBy("batch").agg(F.bool_and("_ok").alias("ok"))
    tagged = rows.join(state, "batch").withColumn("symbol", F.col("user_id"))
    wanted = m.events.filter("user_id % 2 = 0").select(F.col("user_id").alias("symbol")).distinct()
    kept = Q.batch_union(tagged, wanted).agg(F.count("*").alias("rows"))
    both = Q.batch_status(tagged).unionByName(kept, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
