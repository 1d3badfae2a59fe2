"""Queries over bars, calendar, features, outcomes, rankings and breadth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.functions.layout import dimension_join
from tickloom.operators import breadth as B
from tickloom.operators import calendar as CA
from tickloom.operators import clean as C
from tickloom.operators import features as FE
from tickloom.operators import outcomes as O
from tickloom.operators import performance as P
from tickloom.operators import ranking as R
from tickloom.operators import validation as V
from tickloom.plans.oracle import net, oracle, rlist, rnd, target, tick
from tickloom.plans.registry import Market, joined, query, rounded, text

DAY = "cast(date as varchar) as date"


@query("fixture_bars", oracle(f"select symbol, {DAY}, ord, {rlist('open', 'high', 'low', 'close', 'volume')}, {rnd('turnover', 2, 'turnover')}, mark, valid from bars", "bars"))
def fixture_bars(m: Market):
    b = rounded(rounded(m.bars, "open", "high", "low", "close", "volume"), "turnover", digits=2)
    return b.select("symbol", text("date").alias("date"), "ord", "open", "high", "low", "close", "volume", "turnover", "mark", "valid")


# --- cleaning -----------------------------------------------------------------------------------------------------


@query("c1_bar_validity", oracle("select symbol, cast(date as varchar) as date, valid from bars", "bars"))
def c1(m):
    return C.with_validity(m.bars.drop("valid")).select("symbol", text("date").alias("date"), "valid")


@query("c2_adjustment_flag", oracle("select adj as adjusted, count(*) as bars from bars group by 1", "bars"))
def c2(m):
    return m.bars.groupBy(S.adjusted().alias("adjusted")).agg(F.count("*").alias("bars"))


@query("c3_as_of_cap", oracle("select symbol, count(*) as bars, cast(max(date) as varchar) as last_date from bars, cutday where date <= d group by 1", "bars", "cutday"))
def c3(m):
    return C.as_of_cap(m.bars, m.as_of).groupBy("symbol").agg(F.count("*").alias("bars"), text(F.max("date")).alias("last_date"))


@query("c4_tradable_region", oracle("select symbol, kind, currency from tradable", "tradable"))
def c4(m):
    return m.securities.filter(C.tradable_region()).select("symbol", "kind", "currency")


@query("c5_security_group", oracle("select symbol, case when kind = 'stock' then 'stock' when etf_style = 'active' then 'active_etf' else 'passive_etf' end as grp from sec", "sec"))
def c5(m):
    return m.securities.select("symbol", C.security_group().alias("grp"))


@query(
    "c6_exclusion_reasons",
    oracle(
        "select s.symbol, case when s.currency <> 'TWD' or x.last_date is null or x.last_date <> a.d or coalesce(x.n, 0) < 21 then concat_ws('|', "
        f"case when s.currency <> 'TWD' then '{C.REASON_CURRENCY}' end, case when x.last_date is null or x.last_date <> a.d then '{C.REASON_NO_BAR}' end, "
        f"case when coalesce(x.n, 0) < 21 then '{C.REASON_SHORT}' end) when not coalesce(f.ok, false) then '{C.REASON_FEATURES}' else '' end as reasons "
        "from sec s cross join cutday a left join (select symbol, max(date) as last_date, count(*) as n from bars, cutday where date <= d group by 1) x "
        "on x.symbol = s.symbol left join feat f on f.symbol = s.symbol and f.date = x.last_date",
        "sec", "cutday", "bars", "feat",
    ),
)
def c6(m):
    known = m.features.filter(F.col("date") <= m.as_of)
    series = known.groupBy("symbol").agg(
        F.max("date").alias("last_date"), F.count("*").alias("n_bars"), F.max_by("has_features", "date").alias("has_features")
    )
    rows = C.market_exclusions(m.securities, series.withColumn("as_of", m.as_of))
    return rows.select("symbol", joined("reasons").alias("reasons"))


def _search_sql(word):
    return (
        f"select symbol, name, lower(symbol) = '{word}' as exact from sec where contains(lower(symbol), '{word}') or contains(lower(name), '{word}')"
    )


@query("c8_security_search", oracle(_search_sql("brand#1"), "sec"))
def c8(m):
    return C.security_search(m.securities, "Ｂｒａｎｄ#1 ", _folding_key).select("symbol", "name", "exact")


def _folding_key(c):
    from tickloom.functions.text import search_normal

    return search_normal(c)


@query(
    "c9_freshness",
    oracle(
        "select cast(date as varchar) as date, case when n is null then 'fresh' when gap > 7 then 'overdue' else 'fresh' end as state from "
        "(select date, lead(date) over (order by date) as n, lead(date, 2) over (order by date) - date as gap from sess) q",
        "sess",
    ),
)
def c9(m):
    """Each session judged when the session after next opens: late if its successor was due before that."""
    from pyspark.sql import Window

    w = Window.orderBy("date")
    days = m.sessions.select("date", F.lead("date").over(w).alias("next"), F.lead("date", 2).over(w).alias("later"))
    now = F.to_timestamp(F.coalesce("later", "date"))
    state = F.when(F.col("next").isNull(), "fresh").otherwise(CA.freshness(F.col("date"), F.col("next"), now))
    return days.select(text("date").alias("date"), state.alias("state"))


@query(
    "c10_watchlist",
    "select user_id, string_agg(event_type, ',' order by event_id) as symbols, false as accepted from (select user_id, upper(event_type) as event_type, "
    "min(event_id) as event_id from events group by 1, 2) q group by 1",
)
def c10(m):
    entries = m.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("e")).groupBy("user_id").agg(
        F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("e", "event_type"))), lambda x: F.concat_ws(" ", x["event_type"], x["event_type"]))).alias("entry")
    )
    return C.watchlist(entries).select("user_id", joined("symbols", ",").alias("symbols"), "accepted")


@query("c11_unknown_symbols", "select distinct p_type as symbol from part where p_type not in (select p_brand from part)")
def c11(m):
    return C.unknown_symbols(m.table("part").select(F.col("p_type").alias("symbol")).distinct(), m.securities)


@query(
    "c12_chart_bars",
    oracle(
        "select b.symbol, count(*) as bars, " + rnd("min(low)", 6, "min_price") + ", " + rnd("max(high)", 6, "max_price") + ", "
        "nullif(count(*) filter (where labels <> ''), 0) as signal_days, cast(max(date) filter (where labels <> '') as varchar) as last_signal from "
        "(select *, row_number() over (partition by symbol order by date desc) as rn from feat) b where rn <= 60 group by 1",
        "feat",
    ),
)
def c12(m):
    rows = C.chart_summary(m.bars, m.features)
    return rounded(rows, "min_price", "max_price").withColumn("last_signal", text("last_signal"))


@query(
    "c13_sparkline",
    oracle(
        "select symbol, count(*) as points, " + rnd("min(close)", 6, "low") + ", " + rnd("max(close)", 6, "high") + ", case when max_by(close, date) >= "
        "min_by(close, date) then 'up' else 'down' end as direction from (select *, row_number() over (partition by symbol order by date desc) as rn from bars) q "
        "where rn <= 20 group by 1 having count(*) >= 2",
        "bars",
    ),
)
def c13(m):
    return rounded(C.sparkline(m.bars), "low", "high")


@query(
    "c15_batch_gate",
    oracle(
        "select count(*) as requested, count(*) filter (where l is null or l <> d) as missing, count(*) filter (where l is null or l <> d) = 0 as accepted "
        "from sec s cross join cutday left join (select symbol, max(date) as l from bars, cutday where date <= d group by 1) x on x.symbol = s.symbol",
        "sec", "cutday", "bars",
    ),
)
def c15(m):
    return C.batch_gate(m.securities.select("symbol"), m.bars, m.as_of)


# --- calendar and joins -------------------------------------------------------------------------------------------


@query("a8_calendar", oracle("select cast(date as varchar) as date, ord from sess", "sess"))
def a8(m):
    return CA.session_table(m.bars).select(text("date").alias("date"), "ord")


@query("a9_sessions_from_bars", oracle("select cast(s.date as varchar) as date from sess s, cutday where s.date <= d", "sess", "cutday"))
def a9(m):
    return CA.session_table(m.bars, cutoff=m.as_of).select(text("date").alias("date"))


@query(
    "a10_completeness_cutoff",
    "select event_id, cast(case when hour(ts) >= 19 then cast(ts as date) else cast(ts as date) - 1 end as varchar) as cutoff, "
    "cast(date_trunc('month', case when hour(ts) >= 19 then cast(ts as date) else cast(ts as date) - 1 end) - interval 2 month as date)::varchar as oldest_month from events",
)
def a10(m):
    months = CA.months_before(F.col("ts"), 3)
    return m.events.select("event_id", text(CA.completeness_cutoff(F.col("ts"))).alias("cutoff"), text(F.element_at(months, -1)).alias("oldest_month"))


@query("j1_forward_as_of", oracle("select cast(date as varchar) as date, horizon, cast(target_date as varchar) as target_date, target_ord from tgt", "tgt"))
def j1(m):
    t = CA.target_dates(m.sessions)
    return t.select(text("date").alias("date"), "horizon", text("target_date").alias("target_date"), "target_ord")


_FUTURE = (
    "select cast(a.d as varchar) as date, h.horizon, cast(min(c.day) as varchar) as target_date from cutday a cross join hz h left join "
    "(select cast(x as date) as day from (select unnest(generate_series(timestamp '1995-01-01', timestamp '2002-12-31', interval 1 day)) as x) y) c "
    "on c.day >= a.d + cast(h.horizon as int) and isodow(c.day) <= 5 and c.day <> a.d + 1 and year(c.day) <= 2002 group by 1, 2"
)


@query("j2_future_sessions", oracle(_FUTURE, "cutday", "hz"))
def j2(m):
    """Beyond the known range: the calendar is cut at as_of, weekdays are open but the day after as_of is a holiday."""
    known = m.sessions.filter(F.col("date") <= m.as_of)
    rules = known.agg(F.date_add(F.max("date"), 1).alias("date")).select("date", F.lit(False).alias("is_open"), F.lit(True).alias("is_holiday"))
    t = CA.target_dates(known, rules=rules, years=(2001, 2002), signal_days=known.filter(F.col("date") == m.as_of))
    return t.select(text("date").alias("date"), F.col("horizon").cast("int").alias("horizon"), text("target_date").alias("target_date"))


@query(
    "j3_holding_window",
    oracle(
        "select b.symbol, cast(b.date as varchar) as date, count(*) as bars, " + rnd("min(w.close)", 6, "low_close") + ", " + rnd("max(w.close)", 6, "high_close") +
        " from bars b join spans p on p.date = b.date and p.horizon = 30 join bars w on w.symbol = b.symbol and w.ord between p.eo and p.xo group by 1, 2",
        "bars", "spans",
    ),
)
def j3(m):
    """Bars inside the 30-day holding window of every bar: a range frame instead of a range join."""
    from tickloom.functions.layout import blocked, core_rows

    series = core_rows(O.forward_bars(blocked(m.bars, ahead=30), 30))
    held = CA.holding_calendar(m.sessions, (30,)).select("date", F.col("holding")[0].alias("h"))
    rows = series.join(F.broadcast(held), "date").filter("h.exit_k IS NOT NULL")
    inside = F.filter("_next", lambda b: b["ord"] <= F.col("ord") + F.col("h.exit_k"))
    rows = rows.withColumn("w", inside).filter(F.size("w") > 0)
    return rows.select(
        "symbol", text("date").alias("date"), F.size("w").cast("long").alias("bars"),
        F.round(F.array_min("w.close"), 6).alias("low_close"), F.round(F.array_max("w.close"), 6).alias("high_close"),
    )


@query(
    "j4_session_offset",
    oracle(
        "select b.symbol, cast(b.date as varchar) as signal_date, k.pos, cast(s.date as varchar) as session_date, w.close is not null as has_bar, "
        + rnd("w.close", 6, "close") + " from bars b cross join (select unnest(range(1, 11)) as pos) k left join sess s on s.ord = b.ord + k.pos "
        "left join bars w on w.symbol = b.symbol and w.ord = b.ord + k.pos",
        "bars", "sess",
    ),
)
def j4(m):
    signals = m.bars.select("symbol", F.col("date").alias("signal_date"))
    rows = CA.session_offsets(signals, m.sessions, m.bars)
    return rows.select(
        "symbol", text("signal_date").alias("signal_date"), F.col("pos").cast("long").alias("pos"), text("session_date").alias("session_date"),
        F.coalesce("has_bar", F.lit(False)).alias("has_bar"), F.round("close", 6).alias("close"),
    )


@query(
    "j5_window_completeness",
    oracle(
        "select symbol, cast(date as varchar) as date, coalesce(n = 5 and v and span = 4, false) as complete from (select symbol, date, count(*) over w as n, "
        "bool_and(valid) over w as v, ord - min(ord) over w as span from bars window w as (partition by symbol order by date rows between 4 preceding and current row)) q",
        "bars",
    ),
)
def j5(m):
    return FE.completeness(m.bars, 5).select("symbol", text("date").alias("date"), "complete")


@query("j7_universe_bars", oracle("select s.symbol, s.kind, count(b.date) as bars from sec s left join bars b on b.symbol = s.symbol group by 1, 2", "sec", "bars"))
def j7(m):
    counts = m.bars.groupBy("symbol").agg(F.count("*").alias("bars"))
    return m.securities.join(counts, "symbol", "left").select("symbol", "kind", F.coalesce("bars", F.lit(0)).alias("bars"))


@query("j8_semi_universe", "select event_type, count(*) as rows from events where user_id in (select c_custkey from customer where c_nationkey < 10) group by 1")
def j8(m):
    universe = m.table("customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("user_id"))
    return m.events.join(universe, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("rows"))


@query(
    "j9_candidates_union_universe",
    oracle("select symbol, max(src) as source from (select symbol, 'listed' as src from sec where kind = 'stock' union all select distinct symbol, 'candidate' from scored) q group by 1", "sec", "scored"),
)
def j9(m):
    listed = m.securities.filter("kind = 'stock'").select("symbol", F.lit("listed").alias("source"))
    old = m.scored.select("symbol", F.lit("candidate").alias("source")).distinct()
    return listed.unionByName(old).groupBy("symbol").agg(F.max("source").alias("source"))


@query("j10_index_change", oracle("select cast(date as varchar) as date, " + rnd("market20", 6, "market20") + " from m20", "m20"))
def j10(m):
    return R.index_change(m.sessions, m.index).select(text("date").alias("date"), F.round("market20", 6).alias("market20"))


# --- features -----------------------------------------------------------------------------------------------------


def _feature(name, columns, digits=6):
    sql = oracle("select symbol, cast(date as varchar) as date, " + rlist(*columns, digits=digits) + " from feat where ok", "feat")

    @query(name, sql)
    def run(m, columns=columns):
        f = m.features.filter("has_features").select("symbol", text("date").alias("date"), *columns)
        return rounded(f, *columns, digits=digits)

    return run


_feature("w2_volume_ratio", ("avg_volume_20", "volume_ratio"))
_feature("w3_prev20_range", ("prev_20_high", "prev_20_low"))
_feature("w4_body_momentum", ("body_pct", "momentum5", "momentum20"))
_feature("w5_volatility", ("volatility",))
_feature("w6_ma20", ("ma20", "v_ma_gap"))
_feature("w7_avg_turnover", ("avg_turnover_20",))


@query("w1_feature_frame", oracle("select symbol, count(*) as bars, count(*) filter (where ok) as complete from feat group by 1", "feat"))
def w1(m):
    return m.features.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if("has_features").alias("complete"))


@query("w8_signal_labels", oracle("select symbol, cast(date as varchar) as date, labels from feat where ok", "feat"))
def w8(m):
    return m.features.filter("has_features").select("symbol", text("date").alias("date"), joined("labels").alias("labels"))


@query("w9_feature_vector", oracle("select symbol, cast(date as varchar) as date, " + rlist(*FE.VECTOR) + " from feat where ok", "feat"))
def w9(m):
    rows = m.features.withColumn("v", FE.vector_column()).filter("v IS NOT NULL")
    return rows.select("symbol", text("date").alias("date"), *[F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate(FE.VECTOR)])


@query(
    "w10_recent_signals",
    oracle("select symbol, cast(date as varchar) as date, labels from (select *, row_number() over (partition by symbol order by date desc) as rn from feat) q where rn <= 60 and ok", "feat"),
)
def w10(m):
    return FE.recent_signals(m.features).select("symbol", text("date").alias("date"), joined("labels").alias("labels"))


@query(
    "w11_market_context",
    oracle(
        "select f.symbol, cast(f.date as varchar) as date, " + rnd("i.mom", 6, "momentum20") + ", " + rnd("f.momentum20 - i.mom", 6, "relative_momentum20") + ", "
        "case when i.mom > 0 then '偏多' else '偏弱' end as trend from feat f join (select date, (close / lag(close, 20) over (order by date) - 1) * 100 as mom, "
        "row_number() over (order by date) as n from idx) i on i.date = f.date and i.n > 20 where f.ok",
        "feat", "idx",
    ),
)
def w11(m):
    rows = FE.market_context(m.features, m.index)
    return rounded(rows, "momentum20", "relative_momentum20").withColumn("date", text("date"))


_METRICS = ("close", "turnover", "volume", "change_pct", "momentum5_pct", "momentum20_pct", "relative_volume", "volatility_pct")


@query(
    "w12_market_metrics",
    oracle("select symbol, cast(date as varchar) as date, " + ", ".join(rnd(c, 2 if c == "turnover" else 6, c) for c in _METRICS) + ", new_high20, new_low20 from met", "met"),
)
def w12(m):
    rows = FE.market_metrics(m.bars).withColumn("date", text("date"))
    return rounded(rows, "turnover", digits=2)


@query("w13_rank_fraction", oracle("select cast(as_of as varchar) as as_of, symbol, grp, " + rnd("rank_fraction", 6, "rank_fraction") + " from scored", "scored"))
def w13(m):
    return m.scored.select(text("as_of").alias("as_of"), "symbol", F.col("group").alias("grp"), F.round("rank_fraction", 6).alias("rank_fraction"))


@query(
    "w14_midpoint_percentile",
    oracle(
        "select cast(as_of as varchar) as as_of, symbol, case when n = 1 then 1e0 else " + rnd("(2 * (rk - 1) + t - 1) / 2e0 / (n - 1)", 6) + " end as pct from "
        "(select as_of, symbol, rank() over (partition by as_of order by relative_volume) as rk, count(*) over (partition by as_of, relative_volume) as t, "
        "count(*) over (partition by as_of) as n from scored) q",
        "scored",
    ),
)
def w14(m):
    from tickloom.operators.reconcile import midpoint_percentile

    rows = midpoint_percentile(m.scored.select("as_of", "symbol", "relative_volume"), ["as_of"], "relative_volume", "pct")
    return rows.select(text("as_of").alias("as_of"), "symbol", F.round("pct", 6).alias("pct"))


# --- outcomes -----------------------------------------------------------------------------------------------------


@query("o1_net_return", oracle(f"select b.symbol, cast(b.date as varchar) as date, {rnd(net('b.open', 'b.close', 's.kind'), 6, 'net_return_pct')} from bars b join sec s on s.symbol = b.symbol", "bars", "sec"))
def o1(m):
    rows = dimension_join(m.bars, m.securities.select("symbol", "kind"), how="inner")
    return rows.select("symbol", text("date").alias("date"), F.round(S.net_return("open", "close", "kind"), 6).alias("net_return_pct"))


_LABEL = "select symbol, cast(date as varchar) as signal_date, horizon, cast(entry_date as varchar) as entry_date, cast(exit_date as varchar) as exit_date, " + rnd("return_pct", 6, "return_pct") + ", recovered, recovery_days, " + rnd("worst_close_return", 6, "worst_close_return") + " from lab"


def _labels(rows):
    rows = rounded(rows, "return_pct", "worst_close_return")
    return rows.withColumns({c: text(c) for c in ("signal_date", "entry_date", "exit_date")}).withColumn("recovery_days", F.col("recovery_days").cast("long"))


@query("o2_horizon_outcome", oracle(_LABEL + " where horizon = 14", "lab"))
def o2(m):
    return _labels(O.event_outcomes(m.bars, m.sessions, m.securities, horizons=(14,)))


@query("o3_all_horizons", oracle(_LABEL, "lab"))
def o3(m):
    return _labels(O.event_outcomes(m.bars, m.sessions, m.securities))


@query("o4_tick_size", oracle(f"select b.symbol, cast(b.date as varchar) as date, cast({tick('cast(b.close as decimal(26,12))', 's.kind')} as double) as tick from bars b join sec s on s.symbol = b.symbol", "bars", "sec"))
def o4(m):
    rows = dimension_join(m.bars, m.securities.select("symbol", "kind"), how="inner")
    return rows.select("symbol", text("date").alias("date"), S.tick_size("close", "kind").cast("double").alias("tick"))


@query("o5_target_price", oracle(f"select b.symbol, cast(b.date as varchar) as date, {rnd(target('b.open', 's.kind'), 6, 'target_price')} from bars b join sec s on s.symbol = b.symbol", "bars", "sec"))
def o5(m):
    rows = dimension_join(m.bars, m.securities.select("symbol", "kind"), how="inner")
    return rows.select("symbol", text("date").alias("date"), F.round(S.target_price("open", "kind"), 6).alias("target_price"))


_TEN = (
    "select symbol, cast(signal_date as varchar) as signal_date, status, cast(entry_date as varchar) as entry_date, cast(exit_date as varchar) as exit_date, "
    + rlist("entry_price", "target_price") + ", touched, potential_fill, " + rnd("terminal_return_pct", 6, "terminal_return_pct") + " from ten"
)


@query("o6_ten_session", oracle(_TEN, "ten"))
def o6(m):
    rows = O.ten_session_outcomes(m.bars, m.sessions, m.securities).drop("kind", "etf_style")
    rows = rounded(rows, "entry_price", "target_price", "terminal_return_pct")
    return rows.withColumns({c: text(c) for c in ("signal_date", "entry_date", "exit_date")})


def tracking(m: Market):
    def build():
        signals = R.universe_rank(m.scored).select("symbol", F.col("as_of").alias("signal_date"), "kind", "etf_style", "rank", "score")
        return O.policy_exits(signals, m.bars, m.sessions)

    return m.shared("tracking", build)


TRACK_SQL = (
    "select symbol, cast(signal_date as varchar) as signal_date, rank, status, " + rnd("net_return_pct", 6, "net_return_pct") + ", target_filled, touched, "
    "elapsed_sessions, cast(exit_date as varchar) as exit_date, " + rlist("exit_price", "adverse_before_exit_pct") + ", exit_reason from track"
)


def track_rows(t):
    t = t.withColumn("exit_reason", F.when(F.col("status") == "evaluated", F.col("reason")))
    t = rounded(t, "net_return_pct", "exit_price", "adverse_before_exit_pct")
    return t.select(
        "symbol", text("signal_date").alias("signal_date"), "rank", "status", "net_return_pct", "target_filled", "touched",
        F.col("elapsed_sessions").cast("long").alias("elapsed_sessions"), text("exit_date").alias("exit_date"), "exit_price", "adverse_before_exit_pct", "exit_reason",
    )


@query("o7_policy_exit", oracle(TRACK_SQL, "track"))
def o7(m):
    return track_rows(tracking(m))


# --- rankings -----------------------------------------------------------------------------------------------------

_CAND = "select cast(as_of as varchar) as as_of, symbol, rank, " + rlist("score", "momentum5_pct", "momentum20_pct", "relative_volume", digits=2) + ", reasons from scored where rank <= 10"


@query("r1_candidates", oracle(_CAND, "scored"))
def r1(m):
    rows = R.research_candidates(m.scored)
    return rows.select(text("as_of").alias("as_of"), "symbol", F.col("rank").cast("long").alias("rank"), "score", "momentum5_pct", "momentum20_pct", "relative_volume", joined("reasons").alias("reasons"))


def history(m: Market):
    outcomes = m.ten.drop("kind", "etf_style")
    return m.scored.withColumnRenamed("as_of", "signal_date").join(outcomes, ["symbol", "signal_date"])


SPLIT = (
    "(select grp, signal_date, nd, case when nd < 80 then 'insufficient' when back <= 20 then 'test' when back <= 30 then 'gap' else 'train' end as part from "
    "(select grp, signal_date, row_number() over (partition by grp order by signal_date desc) as back, count(*) over (partition by grp) as nd from "
    "(select distinct grp, signal_date from hist) d) e)"
)
VALIDATE = (
    "select grp, td as train_dates, sd as test_dates, tn as train_n, sn as test_n, case when enough then p end as probability, case when enough then base end as baseline, "
    "case when enough then hb end as holdout_base, case when enough then ht end as holdout_top, case when enough then bt end as brier, case when enough then bb end as baseline_brier, "
    "case when enough and p >= base + 0.05 and ht >= hb + 0.05 and bt < bb then 'validated' else 'insufficient_validation' end as status from "
    "(select *, tn >= 400 and sn >= 100 and ttn >= 40 and stn >= 20 as enough, p*p*(1-ht)+(1-p)*(1-p)*ht as bt, base*base*(1-ht)+(1-base)*(1-base)*ht as bb from "
    "(select h.grp, count(distinct case when part='train' then h.signal_date end) as td, count(distinct case when part='test' then h.signal_date end) as sd, "
    "count(*) filter (where part='train') as tn, count(*) filter (where part='test') as sn, count(*) filter (where part='train' and rank_fraction>=0.9) as ttn, "
    "count(*) filter (where part='test' and rank_fraction>=0.9) as stn, (count(*) filter (where part='train' and rank_fraction>=0.9 and potential_fill) + 1) / "
    "(count(*) filter (where part='train' and rank_fraction>=0.9) + 2e0) as p, avg(case when part='train' then cast(potential_fill as int) end) as base, "
    "avg(case when part='test' then cast(potential_fill as int) end) as hb, avg(case when part='test' and rank_fraction>=0.9 then cast(potential_fill as int) end) as ht "
    f"from hist h join {SPLIT} s on s.grp = h.grp and s.signal_date = h.signal_date group by 1) a) b"
)


@query("v5_holdout_split", oracle(f"select grp, cast(signal_date as varchar) as signal_date, nd as dates, part from {SPLIT} z", "hist"))
def v5(m):
    rows = V.holdout_split(V.evaluated_history(history(m)))
    return rows.select(F.col("group").alias("grp"), text("signal_date").alias("signal_date"), "dates", "part")


_VAL = ("probability", "baseline", "holdout_base", "holdout_top", "brier", "baseline_brier")


@query("v6_ranker_validation", oracle(f"select grp, status, train_dates, test_dates, train_n, test_n, {rlist(*_VAL)} from ({VALIDATE}) z", "hist"))
def v6(m):
    rows = rounded(V.validate_ranker(history(m)), *_VAL)
    return rows.select(F.col("group").alias("grp"), "status", "train_dates", "test_dates", "train_n", "test_n", *_VAL)


# The stand-in market fills nearly every target, so the unlock rule is exercised with the validated flag forced on.
@query(
    "r2_recommendations",
    oracle(
        f"select * from (select cast(s.as_of as varchar) as as_of, s.symbol, {rnd('v.probability', 6, 'probability')}, s.score + 0.0 as score, "
        f"row_number() over (partition by s.as_of order by v.probability desc, s.score desc, s.symbol) as rank from scored s join ({VALIDATE}) v on v.grp = s.grp "
        "and v.probability is not null where s.rank_fraction >= 0.9) q where rank <= 10",
        "hist",
    ),
)
def r2(m):
    validation = V.validate_ranker(history(m)).filter("probability IS NOT NULL").withColumn("status", F.lit("validated"))
    rows = R.recommendations(m.scored, validation)
    return rows.select(text("as_of").alias("as_of"), "symbol", F.round("probability", 6).alias("probability"), "score", F.col("rank").cast("long").alias("rank"))


@query(
    "r11_list_choice",
    oracle(
        f"with v as ({VALIDATE}), g as (select s.*, v.probability from scored s join v on v.grp = s.grp and v.status = 'validated' where s.rank_fraction >= 0.9), "
        "t as (select as_of, symbol, row_number() over (partition by as_of order by probability desc, score desc, symbol) as rank, 'validated' as status from g), "
        "u as (select as_of, symbol, rank, 'insufficient_validation' as status from scored where as_of not in (select as_of from t)) "
        "select cast(as_of as varchar) as as_of, symbol, rank, status from (select * from t union all select * from u) z where rank <= 10",
        "hist",
    ).replace("\nwith v as", ",\nv as"),
)
def r11(m):
    rows = R.list_choice(m.scored, V.validate_ranker(history(m)))
    return rows.select(text("as_of").alias("as_of"), "symbol", F.col("rank").cast("long").alias("rank"), "status")


_LISTS = " union all ".join(
    f"select '{key}' as list, date, symbol, {metric} as value, row_number() over (partition by date order by {metric} {'asc' if asc else 'desc'}, symbol) as position, "
    f"count(*) over (partition by date) as position_of from m2 where {metric} is not null and {cond}"
    for (key, metric, asc), cond in zip(
        R.MARKET_LISTS,
        ("true", "change_pct > 0", "change_pct < 0", "relative_volume >= 1.5", "new_high20", "new_low20", "true"),
        strict=True,
    )
)
_M2 = (
    "select m.symbol, m.date, round(turnover, 2) as turnover, round(change_pct, 6) as change_pct, round(relative_volume, 6) as relative_volume, "
    "round(momentum20_pct, 6) as momentum20_pct, round(volatility_pct, 6) as volatility_pct, new_high20, new_low20 from met m join sec s on s.symbol = m.symbol and s.currency = 'TWD'"
)


def market_rows(m: Market):
    rows = dimension_join(FE.market_metrics(m.bars), m.securities.select("symbol", "name", "kind", "currency"), how="inner", spread="date")
    return rows.withColumn("turnover", F.round("turnover", 2))


def _lists_oracle(tail: str) -> str:
    return oracle("select * from lists_placeholder", "met", "sec").replace(
        "select * from lists_placeholder", ""
    ).rstrip() + f",\nm2 as ({_M2}),\nlists as ({_LISTS})\n{tail}"


@query("r3_market_lists", _lists_oracle("select list, cast(date as varchar) as date, symbol, " + rnd("value", 6, "value") + ", position, position_of from lists"))
def r3(m):
    rows = R.market_lists(market_rows(m), ["date"])
    return rows.select("list", text("date").alias("date"), "symbol", F.round("value", 6).alias("value"), "position", "position_of")


@query(
    "r5_pagination",
    _lists_oracle(
        "select list, cast(date as varchar) as date, symbol, position, least(2, cast(ceil(position_of / 10.0) as bigint)) as page from lists "
        "where position > (least(2, cast(ceil(position_of / 10.0) as bigint)) - 1) * 10 and position <= least(2, cast(ceil(position_of / 10.0) as bigint)) * 10"
    ),
)
def r5(m):
    rows = R.page(R.market_lists(market_rows(m), ["date"]), 2, 10)
    return rows.select("list", text("date").alias("date"), "symbol", "position", "page")


@query(
    "r10_after_close_report",
    oracle(
        "select s.symbol, s.name, s.kind, " + rnd("m.close", 6, "price") + ", " + rnd("m.change_pct", 6, "day_pct") + ", m.volume, " + rnd("m.turnover", 2, "amount") +
        " from sec s join met m on m.symbol = s.symbol join cutday on m.date = d where m.close is not null",
        "sec", "met", "cutday",
    ),
)
def r10(m):
    catalog = FE.explore_catalog(m.securities, m.bars, m.as_of)
    return rounded(R.after_close_report(catalog, m.as_of), "amount", digits=2)


# --- breadth ------------------------------------------------------------------------------------------------------

BREADTH = (
    "select s.symbol, coalesce(s.industry, '未記錄') as industry, "
    "case when nw and n2 = 2 and v2 = 2 and a1 = 0 and c1 > 0 then (c0 / c1 - 1) * 100 end as daily, "
    "case when nw and n20 = 20 and v20 = 20 and a20 = 0 then c0 > m20 end as ma20, "
    "case when nw and n21 = 21 and v21 = 21 and a20 = 0 then (c0 / c20 - 1) * 100 end as momentum20, case when nw then t0 end as turnover, "
    "case when nw and n21 = 21 and v21 = 21 and a20 = 0 and tn = 20 and tm > 0 and t0 is not null then tm end as previous_turnover, "
    "coalesce(k.rank <= 10, false) as candidate from sec s left join (select symbol, "
    "coalesce(bool_or(back = 0 and valid), false) as nw, count(*) filter (where back < 2) as n2, count(*) filter (where back < 2 and valid) as v2, "
    "count(*) filter (where back < 1 and adj) as a1, count(*) filter (where back < 20) as n20, count(*) filter (where back < 20 and valid) as v20, "
    "count(*) filter (where back < 20 and adj) as a20, count(*) as n21, count(*) filter (where valid) as v21, max(close) filter (where back = 0) as c0, "
    "max(close) filter (where back = 1) as c1, max(close) filter (where back = 20) as c20, avg(close) filter (where back < 20) as m20, "
    "max(turnover) filter (where back = 0 and turnover >= 0) as t0, count(*) filter (where back >= 1 and turnover >= 0) as tn, "
    "avg(turnover) filter (where back >= 1 and turnover >= 0) as tm from (select b.*, o - b.ord as back from bars b, cutday where b.ord between o - 20 and o) w group by 1) x "
    "on x.symbol = s.symbol left join (select symbol, rank from scored, cutday where as_of = d) k on k.symbol = s.symbol where s.kind = 'stock'"
)
BREADTH_NEEDS = ("sec", "bars", "cutday", "scored")


def breadth_metrics(m: Market):
    candidates = R.research_candidates(m.scored.filter(F.col("as_of") == m.as_of))
    return m.shared("breadth", lambda: B.stock_metrics(m.securities, m.bars, m.sessions, m.as_of, candidates))


@query("g1_stock_metrics", oracle(f"select symbol, industry, {rlist('daily', 'momentum20')}, ma20, {rlist('turnover', 'previous_turnover', digits=6)}, candidate from ({BREADTH}) q", *BREADTH_NEEDS))
def g1(m):
    return rounded(breadth_metrics(m), "daily", "momentum20", "turnover", "previous_turnover")


@query(
    "w16_session_frame",
    oracle(
        "select symbol, count(*) as bars, count(*) = 20 as complete from bars, cutday where ord between o - 19 and o group by 1", "bars", "cutday"
    ),
)
def w16(m):
    frame = B.recent_sessions(m.bars, m.sessions, m.as_of, 20)
    return frame.groupBy("symbol").agg(F.count("*").alias("bars"), (F.count("*") == 20).alias("complete"))


@query(
    "g2_metric_coverage",
    oracle(
        " union all ".join(f"select '{n}' as metric, count({c}) as eligible, count(*) - count({c}) as excluded, count(*) as total from ({BREADTH}) q" for n, c in B.COVERAGE),
        *BREADTH_NEEDS,
    ),
)
def g2(m):
    return B.metric_coverage(breadth_metrics(m))


@query(
    "g3_market_breadth",
    oracle(
        "select count(*) filter (where daily > 1e-9) as advancers, count(*) filter (where daily < -1e-9) as decliners, count(*) filter (where abs(daily) <= 1e-9) as unchanged, "
        + rnd("avg(daily)", 6, "equal_weight_return_pct") + ", " + rnd("avg(cast(ma20 as int))", 6, "above_ma20_ratio") + ", " + rnd("sum(turnover)", 2, "turnover") + ", "
        + rnd("sum(turnover) filter (where previous_turnover is not null) / sum(previous_turnover)", 6, "turnover_ratio_20") + f" from ({BREADTH}) q",
        *BREADTH_NEEDS,
    ),
)
def g3(m):
    rows = B.market_breadth(breadth_metrics(m))
    return rounded(rounded(rows, "equal_weight_return_pct", "above_ma20_ratio", "turnover_ratio_20"), "turnover", digits=2)


@query(
    "g4_industry_table",
    oracle(
        "select industry, count(*) as total, count(daily) as valid_count, " + rnd("avg(case when daily is not null then cast(daily > 1e-9 as int) end)", 6, "advancing_ratio") + ", "
        "count(turnover) as turnover_count, count(momentum20) as momentum20_count, count(*) filter (where candidate) as candidate_count, "
        + rnd("sum(turnover) / (select sum(turnover) from b)", 6, "turnover_share") + ", " + rnd("median(daily)", 6, "median_return_pct") + ", " + rnd("median(momentum20)", 6, "median_20_return_pct") + ", "
        "count(daily) < 5 as small_sample, count(momentum20) < 5 as momentum20_small_sample, count(turnover) < 5 as turnover_small_sample from b group by 1",
        *BREADTH_NEEDS,
    ).replace("\nselect industry", f",\nb as ({BREADTH})\nselect industry"),
)
def g4(m):
    return rounded(B.industry_table(breadth_metrics(m)), "advancing_ratio", "turnover_share", "median_return_pct", "median_20_return_pct")


@query("g5_classification_sources", "select distinct p_type as url, p_name as retrieved_at from part where p_size > 25")
def g5(m):
    """Parts over size 25 play stocks; the operator leaves the others out."""
    kind = F.when(F.col("p_size") > 25, "stock").otherwise("etf")
    rows = m.table("part").select(kind.alias("kind"), F.col("p_type").alias("industry_source"), F.col("p_name").alias("industry_retrieved_at"))
    return B.classification_sources(rows)


@query(
    "g13_tracking_summary",
    oracle("select count(*) filter (where status = 'evaluated') as evaluated, count(*) filter (where touched) as touched, count(*) filter (where potential_fill) as potential_fills, count(*) filter (where status = 'not_comparable') as not_comparable from ten", "ten"),
)
def g13(m):
    return B.ten_session_summary(m.ten)


# --- performance --------------------------------------------------------------------------------------------------


@query("g8_status_counts", oracle("select kind, " + ", ".join(f"count(*) filter (where status = '{s}') as {s}" for s in P.STATUSES) + " from track group by 1", "track"))
def g8(m):
    return P.status_counts(tracking(m), ["kind"])


@query(
    "g11_maturity_counts",
    oracle("select kind, count(distinct case when elapsed_sessions >= 10 then signal_date end) as mature_signal_dates, count(distinct case when status = 'evaluated' then signal_date end) as comparable_signal_dates from track group by 1", "track"),
)
def g11(m):
    return P.maturity_counts(tracking(m), ["kind"])


_PERF = ("mean_net_return_pct", "median_net_return_pct", "target_fill_rate", "average_gain_pct", "average_loss_pct", "profit_factor", "top5_gain_share")


def performance_sql(source: str, keys: str) -> str:
    on = " and ".join(f"{{a}}.{k} = {{b}}.{k}" for k in keys.split(", "))
    return (
        f"with e as (select *, count(*) over (partition by {keys}, signal_date) as tr from {source} where status = 'evaluated'), "
        f"dd as (select {keys}, signal_date, avg(net_return_pct) as dm, median(net_return_pct) as dmed, avg(cast(target_filled as int)) as df from e group by {keys}, signal_date), "
        f"ga as (select {keys}, sum(net_return_pct / tr) filter (where net_return_pct > 0) as g, sum(1e0 / tr) filter (where net_return_pct > 0) as gw, "
        f"sum(net_return_pct / tr) filter (where net_return_pct < 0) as l, sum(1e0 / tr) filter (where net_return_pct < 0) as lw from e group by {keys}), "
        f"t5 as (select {keys}, sum(w) as t from (select {keys}, net_return_pct / tr as w, row_number() over (partition by {keys} order by net_return_pct / tr desc) as rn from e "
        f"where net_return_pct > 0) z where rn <= 5 group by {keys}), dg as (select {keys}, count(*) as n, avg(dm) as m, median(dmed) as md, avg(df) as f from dd group by {keys}) "
        f"select {', '.join('dg.' + k for k in keys.split(', '))}, dg.n as comparable_signal_dates, {rnd('dg.m', 6, _PERF[0])}, {rnd('dg.md', 6, _PERF[1])}, {rnd('dg.f', 6, _PERF[2])}, "
        f"{rnd('ga.g / ga.gw', 6, _PERF[3])}, {rnd('ga.l / ga.lw', 6, _PERF[4])}, {rnd('coalesce(ga.g, 0) / -ga.l', 6, _PERF[5])}, {rnd('t5.t / ga.g', 6, _PERF[6])} "
        f"from dg join ga on {on.format(a='ga', b='dg')} left join t5 on {on.format(a='t5', b='dg')}"
    )


def nested(body: str, *needs: str) -> str:
    """A query that starts with its own ``with``, behind shared tables."""
    head, tail = oracle("@@", *needs).rsplit("@@", 1)
    return head.rstrip() + ",\n" + body.removeprefix("with ") + tail


@query("g9_day_weighted", nested(performance_sql("track", "kind"), "track"))
def g9(m):
    return rounded(P.day_weighted_summary(tracking(m), ["kind"]), *_PERF)


_COHORT = (
    "(select *, 'baseline' as cohort from (select *, {g} as grp from track) a union all select *, 'top10' from (select *, {g} as grp from track) b where rank between 1 and 10)"
).format(g="case when kind = 'stock' then 'stock' when etf_style = 'active' then 'active_etf' else 'passive_etf' end")


@query("g10_cohort_report", nested(performance_sql(_COHORT + " c", "grp, cohort"), "track"))
def g10(m):
    rows = P.cohort_report(tracking(m)).withColumnRenamed("group", "grp")
    return rounded(rows.select("grp", "cohort", "comparable_signal_dates", *_PERF).filter("comparable_signal_dates IS NOT NULL"), *_PERF)


@query(
    "u2_date_intersection",
    nested(
        f"with dd as (select grp, cohort, signal_date, avg(net_return_pct) as dm from {_COHORT} c where status = 'evaluated' group by 1, 2, 3) select a.grp, count(*) as paired_dates, "
        f"{rnd('avg(a.dm - b.dm)', 6, 'paired_difference_pct')} from dd a join dd b on a.grp = b.grp and a.signal_date = b.signal_date and a.cohort = 'top10' and b.cohort = 'baseline' group by 1",
        "track",
    ),
)
def u2(m):
    return rounded(P.paired_difference(tracking(m)).withColumnRenamed("group", "grp"), "paired_difference_pct")


@query("u1_session_union", "select count(*) as days, cast(min(d) as varchar) as first_day, cast(max(d) as varchar) as last_day from (select cast(o_orderdate as date) as d from orders union select cast(l_shipdate as date) from lineitem) q")
def u1(m):
    a = m.table("orders").select(F.col("o_orderdate").cast("date").alias("date"))
    b = m.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return CA.session_table(a, b).agg(F.count("*").alias("days"), text(F.min("date")).alias("first_day"), text(F.max("date")).alias("last_day"))


@query("u3_ordered_distinct", "select event_type, min(event_id) as first_seen from events group by 1")
def u3(m):
    return m.events.groupBy("event_type").agg(F.min("event_id").alias("first_seen"))


@query("u4_difference", oracle("select cast(date as varchar) as date from sess where date not in (select as_of from scored)", "sess", "scored"))
def u4(m):
    used = m.scored.select(F.col("as_of").alias("date")).distinct()
    return m.sessions.select("date").join(used, "date", "left_anti").select(text("date").alias("date"))


@query(
    "u5_ordered_union",
    oracle("select 'candidate' as part, symbol, cast(as_of as varchar) as date from scored where rank = 1 union all select 'signal', symbol, cast(date as varchar) from feat where contains(labels, '" + FE.LABEL_BREAK_UP + "')", "scored", "feat"),
)
def u5(m):
    first = R.research_candidates(m.scored, 1).select(F.lit("candidate").alias("part"), "symbol", text("as_of").alias("date"))
    second = m.features.filter(F.array_contains("labels", FE.LABEL_BREAK_UP)).select(F.lit("signal").alias("part"), "symbol", text("date").alias("date"))
    return first.unionByName(second)
