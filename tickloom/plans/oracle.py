"""SQL building blocks for the equivalent queries: named tables and the ones each is built from."""

from __future__ import annotations

from tickloom.operators import clean as C
from tickloom.operators import features as FE

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def oracle(body: str, *needs: str) -> str:
    """``body`` preceded by the tables it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    return "with " + ",\n".join(f"{n} as ({CTES[n][1]})" for n in order) + "\n" + body


def rnd(expr: str, digits: int = 6, alias: str | None = None) -> str:
    # Rounding in decimal: halves go away from zero on both sides.
    out = f"cast(round(cast({expr} as decimal(30,12)), {digits}) as double)"
    return out if alias is None else f"{out} as {alias}"


def rlist(*columns: str, digits: int = 6) -> str:
    return ", ".join(rnd(c, digits, c) for c in columns)


def net(entry: str, close: str, kind: str = "kind") -> str:
    tax = f"case when {kind} = 'etf' then 0.001e0 else 0.003e0 end"
    return f"((({close})*(1-0.0005e0)*((1-0.001425e0)-{tax}))/(({entry})*(1+0.0005e0)*(1+0.001425e0)) - 1)*100"


def _ladder(price: str, table, inverse: bool) -> str:
    text = "case "
    for bound, tick in table:
        value = str(round(1 / float(tick), 2)) if inverse else tick
        text += f"when {price} < {bound} then {value} " if bound else f"else {value} end"
    return text


def tick(price: str, kind: str, inverse: bool = False) -> str:
    from tickloom.functions.scalars import ETF_TICKS, STOCK_TICKS

    cast = lambda ladder: f"cast({ladder} as decimal(5,2))"
    return (
        f"case when {kind} = 'etf' then {cast(_ladder(price, ETF_TICKS, inverse))} "
        f"else {cast(_ladder(price, STOCK_TICKS, inverse))} end"
    )


def target(entry: str, kind: str) -> str:
    required = f"(cast({entry} as decimal(26,12)) * cast(1.05 as decimal(3,2)))"
    return f"cast(ceil({required} * {tick(required, kind, True)}) as double) * cast({tick(required, kind)} as double)"


cte(
    "li",
    "select p_brand as symbol, cast(date_trunc('week', l_shipdate) as date) as date, l_extendedprice / l_quantity as price, l_quantity, "
    "l_extendedprice, row_number() over (partition by p_brand, date_trunc('week', l_shipdate) order by l_shipdate, l_orderkey, l_linenumber, "
    "l_partkey, l_suppkey, l_extendedprice, l_quantity) as rn, count(*) over (partition by p_brand, date_trunc('week', l_shipdate)) as n "
    "from lineitem join part on l_partkey = p_partkey",
)
cte("sess", "select date, row_number() over (order by date) as ord from (select distinct date from li) q", "li")
cte(
    "bars0",
    "select li.symbol, li.date, s.ord, max(case when rn = 1 then price end) as open, max(price) as high, min(price) as low, "
    "max(case when rn = n then price end) as close, sum(l_quantity) as volume, sum(l_extendedprice) as turnover, "
    "case when (s.ord * 7 + cast(substr(li.symbol, 7) as int)) % 97 = 0 then '**' else '' end as mark, '' as change "
    "from li join sess s on li.date = s.date group by li.symbol, li.date, s.ord",
    "li",
    "sess",
)
cte(
    "bars",
    "select *, (open > 0 and close > 0 and low > 0 and high >= greatest(open, close) and low <= least(open, close) and high >= low "
    "and volume >= 0) as valid, mark like '%**%' as adj from bars0",
    "bars0",
)
cte(
    "sec",
    "select symbol, symbol as name, case when b % 5 = 0 then 'etf' else 'stock' end as kind, case when b % 20 = 0 then 'USD' else 'TWD' end "
    "as currency, case when b <> 13 then lpad(cast(b % 7 as varchar), 2, '0') end as industry, case when b % 10 = 0 then 'active' "
    "when b % 5 = 0 then 'passive' end as etf_style, case when b % 15 = 0 then '美國大型股' when b % 5 = 0 then '台灣大型股' end as index_name "
    "from (select distinct p_brand as symbol, cast(substr(p_brand, 7) as int) as b from part) q",
)
cte("idx", "select date, sum(turnover) / sum(volume) as close from bars group by date", "bars")
cte("cutday", "select date as d, ord as o from sess where ord = (select max(ord) - 12 from sess)", "sess")
cte(
    "fx",
    "select *, count(*) over w21 as n21, min(case when valid then 1 else 0 end) over w21 as allv, ord - min(ord) over w21 as span, "
    "max(case when adj then 1 else 0 end) over w20 as anyadj, avg(volume) over p20 as avgvol, max(high) over p20 as ph, min(low) over p20 as pl, "
    "lag(close, 5) over w as l5, lag(close, 20) over w as l20, avg(close) over w20 as ma, "
    "avg(coalesce(nullif(turnover, 0), close * volume)) over w20 as turn, ln(close) - ln(lag(close) over w) as lr from bars "
    "window w as (partition by symbol order by date), w21 as (partition by symbol order by date rows between 20 preceding and current row), "
    "w20 as (partition by symbol order by date rows between 19 preceding and current row), "
    "p20 as (partition by symbol order by date rows between 20 preceding and 1 preceding)",
    "bars",
)
cte(
    "fy",
    "select *, stddev_pop(lr) over (partition by symbol order by date rows between 19 preceding and current row) as sd, "
    "coalesce(n21 = 21 and allv = 1 and span = 20 and anyadj = 0 and avgvol > 0, false) as ok from fx",
    "fx",
)
_LABELS = (
    f"concat_ws('|', case when (close-open)/open >= 0.015e0 - 1e-12 then '{FE.LABEL_LONG_UP}' end, "
    f"case when (close-open)/open <= -0.015e0 + 1e-12 then '{FE.LABEL_LONG_DOWN}' end, "
    f"case when abs((close-open)/open) <= 0.002e0 + 1e-12 then '{FE.LABEL_SMALL}' end, "
    f"case when volume/avgvol > 1.5 then '{FE.LABEL_VOLUME}' end, "
    f"case when close > ph then '{FE.LABEL_BREAK_UP}' end, case when close < pl then '{FE.LABEL_BREAK_DOWN}' end)"
)
cte(
    "feat",
    f"select symbol, date, ord, open, high, low, close, volume, turnover, valid, adj, ok, case when ok then {_LABELS} end as labels, "
    "case when ok then (close-open)/open end as v_body, case when ok then close/l5-1 end as v_mom5, case when ok then close/l20-1 end as v_mom20, "
    "case when ok then close/ma-1 end as v_ma_gap, case when ok then ln(greatest(volume/avgvol, 0.001e0)) end as v_volume, "
    "case when ok then sd end as v_volatility, case when ok then avgvol end as avg_volume_20, case when ok then volume/avgvol end as volume_ratio, "
    "case when ok then ph end as prev_20_high, case when ok then pl end as prev_20_low, case when ok then ma end as ma20, "
    "case when ok then (close/l5-1)*100 end as momentum5, case when ok then (close/l20-1)*100 end as momentum20, "
    "case when ok then sd*100 end as volatility, case when ok then turn end as avg_turnover_20, "
    "case when ok then (close-open)/open*100 end as body_pct from fy",
    "fy",
)
cte("hz", "select unnest([1,3,5,7,14,30]) as horizon")
cte(
    "tgt",
    "select s.date, s.ord, h.horizon, min(t.date) as target_date, min(t.ord) as target_ord from sess s cross join hz h left join sess t "
    "on t.date >= s.date + cast(h.horizon as int) group by 1, 2, 3",
    "sess",
    "hz",
)
cte(
    "spans",
    "select t.date, t.ord, t.horizon, e.target_date as entry_date, e.target_ord as eo, t.target_date as exit_date, t.target_ord as xo from tgt t "
    "join tgt e on e.date = t.date and e.horizon = 1",
    "tgt",
)
cte(
    "hold",
    "select b.symbol, b.date, p.horizon, p.entry_date, p.exit_date, p.eo, p.xo, any_value(s.kind) as kind, count(*) as n, bool_and(w.valid) as av, "
    "bool_or(w.adj and w.ord > p.eo) as aa, max(case when w.ord = p.eo then w.open end) as eopen, max(case when w.ord = p.eo then w.high end) as eh, "
    "max(case when w.ord = p.eo then w.low end) as el, max(case when w.ord = p.xo then w.close end) as xclose, max(w.close) as mx, min(w.close) as mn "
    "from bars b join spans p on p.date = b.date join bars w on w.symbol = b.symbol and w.ord between p.eo and p.xo "
    "left join sec s on s.symbol = b.symbol group by 1,2,3,4,5,6,7",
    "bars",
    "spans",
    "sec",
)
cte("held", "select * from hold where n = xo - eo + 1 and av and not aa and eh <> el", "hold")
cte(
    "rec",
    f"select h.symbol, h.date, h.horizon, min(w.date) as first_day from held h join bars w on w.symbol = h.symbol and w.ord between h.eo and h.xo "
    f"where {net('h.eopen', 'w.close', 'h.kind')} > 0 group by 1, 2, 3",
    "held",
    "bars",
)
cte(
    "lab",
    f"select h.symbol, h.date, h.horizon, h.entry_date, h.exit_date, {net('h.eopen', 'h.xclose', 'h.kind')} as return_pct, "
    f"{net('h.eopen', 'h.mx', 'h.kind')} > 0 as recovered, cast(r.first_day - h.entry_date as bigint) as recovery_days, "
    f"{net('h.eopen', 'h.mn', 'h.kind')} as worst_close_return from held h left join rec r "
    "on r.symbol = h.symbol and r.date = h.date and r.horizon = h.horizon",
    "held",
    "rec",
)
cte(
    "research",
    "select f.*, p.horizon, p.entry_date, p.exit_date, l.return_pct, l.recovered, l.recovery_days, l.worst_close_return, "
    "l.return_pct is not null as has_outcome from feat f join spans p on p.date = f.date left join lab l on l.symbol = f.symbol and l.date = f.date "
    "and l.horizon = p.horizon",
    "feat",
    "spans",
    "lab",
)
VECTOR = ("v_body", "v_mom5", "v_mom20", "v_ma_gap", "v_volume", "v_volatility")
FLOORS = (0.003, 0.01, 0.02, 0.01, 0.2, 0.003)


def estimate_ctes(prefix: str, anchors: str, needs: tuple[str, ...], neighbors: int = 60) -> None:
    """Tables <prefix>_anchor, _pair, _scale, _near, _stat for one set of anchors."""
    cte(f"{prefix}_anchor", anchors, *needs)
    vec = ", ".join(f"a.{v}" for v in VECTOR)
    cvec = ", ".join(f"c.{v} as c_{v}" for v in VECTOR)
    cte(
        f"{prefix}_pair",
        f"select a.symbol, a.horizon, a.date, {vec}, {cvec}, c.ord as c_ord, c.return_pct as c_return, c.recovered as c_rec, "
        f"c.recovery_days as c_days, c.worst_close_return as c_worst from {prefix}_anchor a join research c on c.symbol = a.symbol "
        "and c.horizon = a.horizon and c.exit_date <= a.date and c.ord < a.ord where a.ok and c.ok and c.has_outcome",
        f"{prefix}_anchor",
        "research",
    )
    scales = ", ".join(f"greatest(stddev_pop(c_{v}), {f}e0) as s_{v}" for v, f in zip(VECTOR, FLOORS, strict=True))
    cte(f"{prefix}_scale", f"select symbol, horizon, date, count(*) as candidates, {scales} from {prefix}_pair group by 1, 2, 3", f"{prefix}_pair")
    dist = " + ".join(f"pow((p.c_{v} - p.{v}) / s.s_{v}, 2)" for v in VECTOR)
    cte(
        f"{prefix}_near",
        f"select * from (select p.*, {dist} as distance, row_number() over (partition by p.symbol, p.horizon, p.date order by {dist}, p.c_ord) as rk "
        f"from {prefix}_pair p join {prefix}_scale s on s.symbol = p.symbol and s.horizon = p.horizon and s.date = p.date) q where rk <= {neighbors}",
        f"{prefix}_pair",
        f"{prefix}_scale",
    )
    cte(
        f"{prefix}_stat",
        "select symbol, horizon, date, count(*) as n, avg(c_return) as expected_return, median(c_return) as median_return, "
        "avg(case when c_return > 0 then 1e0 else 0e0 end) as p_positive, avg(case when c_rec then 1e0 else 0e0 end) as p_recovery, "
        "quantile_cont(c_return, 0.1) as q10, quantile_cont(c_return, 0.9) as q90, quantile_cont(c_worst, 0.1) as worst_close_q10, "
        f"median(case when c_rec then c_days end) as median_recovery_days from {prefix}_near group by 1, 2, 3",
        f"{prefix}_near",
    )


estimate_ctes(
    "last",
    "select r.* from research r join (select symbol, max(date) as d from research group by symbol) m on m.symbol = r.symbol and m.d = r.date",
    ("research",),
)
estimate_ctes(
    "day",
    "select r.* from research r join cutday on cutday.d = r.date",
    ("research", "cutday"),
)
cte("rowno", "select symbol, date, row_number() over (partition by symbol order by date) - 1 as idx from bars", "bars")
estimate_ctes(
    "val",
    "select * exclude (rn, mx) from (select *, max(rn) over (partition by symbol, horizon) as mx from (select r.*, row_number() over "
    "(partition by r.symbol, r.horizon order by r.date desc) as rn from research r join rowno i on i.symbol = r.symbol and i.date = r.date "
    "where r.ok and r.has_outcome and i.idx >= 160) q where rn <= 180) z where (mx - rn) % 5 = 0",
    ("research", "rowno"),
)
_MENTION = lambda terms: " or ".join(f"contains(coalesce({c}, ''), '{t}')" for t in terms for c in ("name", "index_name"))
cte(
    "tradable",
    f"select * from sec where currency = 'TWD' and (kind = 'stock' or (kind = 'etf' and not ({_MENTION(C.FOREIGN_TERMS)}) and ({_MENTION(C.DOMESTIC_TERMS)})))",
    "sec",
)
GROUP = "case when kind = 'stock' then 'stock' when etf_style = 'active' then 'active_etf' else 'passive_etf' end"
cte(
    "m20",
    "select n.date, n.ord, coalesce(case when a.close <> 0 and b.close <> 0 then (a.close / b.close - 1) * 100 end, 0e0) as market20 from sess n "
    "left join idx a on a.date = n.date left join sess o on o.ord = n.ord - 20 left join idx b on b.date = o.date",
    "sess",
    "idx",
)
cte(
    "score0",
    f"select f.date as as_of, f.symbol, t.name, t.kind, t.etf_style, {GROUP} as grp, f.close, round(f.momentum5, 2) as momentum5_pct, "
    "round(f.momentum20, 2) as momentum20_pct, round(f.volume_ratio, 2) as relative_volume, round(f.momentum5 + f.momentum20 - m.market20 + "
    f"least(f.volume_ratio, 3e0) * 2 + case when contains(f.labels, '{FE.LABEL_BREAK_UP}') then 2e0 else 0e0 end - f.volatility, 2) as score, "
    "f.labels as reasons from feat f join tradable t on t.symbol = f.symbol join m20 m on m.date = f.date where f.ok and f.avg_turnover_20 >= 100000",
    "feat",
    "tradable",
    "m20",
)
cte(
    "scored",
    "select *, 1 - (row_number() over (partition by as_of, grp order by score desc, symbol) - 1) / cast(count(*) over (partition by as_of, grp) as double) "
    "as rank_fraction, row_number() over (partition by as_of order by score desc, symbol) as rank from score0",
    "score0",
)
cte(
    "tenx",
    "select b.symbol, b.date as signal_date, b.ord, s.kind, s.etf_style, (select max(ord) from sess) - b.ord as sleft, count(w.ord) as n, "
    "bool_and(w.valid) as av, bool_or(w.adj) as aa, max(w.high) as mh, max(case when w.ord = b.ord + 1 then w.open end) as eo, "
    "max(case when w.ord = b.ord + 1 then w.high end) as eh, max(case when w.ord = b.ord + 1 then w.low end) as el, "
    "max(case when w.ord = b.ord + 10 then w.close end) as xc, max(case when w.ord = b.ord + 10 then w.date end) as xd, "
    "max(case when w.ord = b.ord + 1 then 1 else 0 end) as he from bars b left join sec s on s.symbol = b.symbol "
    "left join bars w on w.symbol = b.symbol and w.ord between b.ord + 1 and b.ord + 10 group by 1, 2, 3, 4, 5",
    "bars",
    "sec",
    "sess",
)
cte(
    "teny",
    "select *, case when sleft < 10 then 'pending' when he = 0 then 'not_filled' when n < 10 or not av or aa then 'not_comparable' "
    f"when eh = el or eo <= 0 then 'not_filled' else 'evaluated' end as status, {target('eo', 'kind')} as tp from tenx",
    "tenx",
)
cte(
    "ten",
    "select t.symbol, t.signal_date, t.kind, t.etf_style, t.status, case when status in ('evaluated', 'not_filled') then n.date end as entry_date, "
    "case when status = 'evaluated' then xd end as exit_date, case when status = 'evaluated' then eo end as entry_price, "
    "case when status = 'evaluated' then tp end as target_price, case when status = 'evaluated' then mh >= tp end as touched, "
    f"case when status = 'evaluated' then mh >= tp + cast({tick('cast(tp as decimal(26,12))', 'kind')} as double) end as potential_fill, "
    "case when status = 'evaluated' then (xc / eo - 1) * 100 end as terminal_return_pct from teny t left join sess n on n.ord = t.ord + 1",
    "teny",
    "sess",
)
# Fixed-policy exits of the scored universe of every session.
cte(
    "pol0",
    "select c.symbol, c.as_of as signal_date, c.kind, c.etf_style, c.rank, s.ord, least(10, (select max(ord) from sess) - s.ord) as el "
    "from scored c join sess s on s.date = c.as_of",
    "scored",
    "sess",
)
cte(
    "pol1",
    "select p.symbol, p.signal_date, p.kind, p.etf_style, p.rank, p.ord, p.el, count(w.ord) as n, bool_and(w.valid) as av, bool_or(w.adj) as aa, "
    "max(w.high) as mh, max(case when w.ord = p.ord + 1 then w.open end) as eo, max(case when w.ord = p.ord + 1 then w.high end) as eh, "
    "max(case when w.ord = p.ord + 1 then w.low end) as elo, max(case when w.ord = p.ord + 10 then w.close end) as xc from pol0 p left join bars w "
    "on w.symbol = p.symbol and w.ord between p.ord + 1 and p.ord + 10 group by 1, 2, 3, 4, 5, 6, 7",
    "pol0",
    "bars",
)
cte(
    "pol2",
    "select *, case when el = 0 then 'pending' when n < el then 'not_comparable' when not av or aa then 'not_comparable' "
    f"when eh = elo or eo <= 0 then 'not_filled' when el < 10 then 'pending' else 'evaluated' end as status, {target('eo', 'kind')} as tp from pol1",
    "pol1",
)
cte(
    "pol3",
    f"select *, tp + cast({tick('cast(tp as decimal(26,12))', 'kind')} as double) - 1e-10 as lim from pol2",
    "pol2",
)
cte(
    "pol4",
    "select p.symbol, p.signal_date, min(case when (w.ord > p.ord + 1 and w.open >= p.tp) or w.high >= p.lim then w.ord end) as ho from pol3 p "
    "join bars w on w.symbol = p.symbol and w.ord between p.ord + 1 and p.ord + 10 where p.status = 'evaluated' group by 1, 2",
    "pol3",
    "bars",
)
cte(
    "pol5",
    "select p.symbol, p.signal_date, coalesce(h.ho, p.ord + 10) as xo, h.ho, min(case when w.ord < coalesce(h.ho, p.ord + 10) then w.low end) as lo, "
    "max(case when w.ord = coalesce(h.ho, p.ord + 10) then w.open end) as xopen, max(case when w.ord = coalesce(h.ho, p.ord + 10) then w.date end) as xdate "
    "from pol3 p join pol4 h on h.symbol = p.symbol and h.signal_date = p.signal_date join bars w on w.symbol = p.symbol "
    "and w.ord between p.ord + 1 and p.ord + 10 group by 1, 2, 3, 4",
    "pol3",
    "pol4",
    "bars",
)
cte(
    "pol6",
    "select p.*, x.ho, x.lo, x.xdate, case when x.ho is null then 'expiry_close' when x.ho > p.ord + 1 and x.xopen >= p.tp then 'gap_open' "
    "else 'conservative_target' end as xr, case when x.ho is null then p.xc when x.ho > p.ord + 1 and x.xopen >= p.tp then x.xopen else p.tp end as xp "
    "from pol3 p left join pol5 x on x.symbol = p.symbol and x.signal_date = p.signal_date",
    "pol3",
    "pol5",
)
cte(
    "track",
    "select symbol, signal_date, kind, etf_style, rank, status, case when status = 'evaluated' then xr end as exit_reason, "
    f"case when status = 'evaluated' then {net('eo', 'xp')} end as net_return_pct, coalesce(status = 'evaluated' and ho is not null, false) as target_filled, "
    "coalesce(status in ('evaluated', 'pending') and el > 0 and mh >= tp, false) as touched, el as elapsed_sessions, "
    "case when status = 'evaluated' then xdate end as exit_date, case when status = 'evaluated' then xp end as exit_price, "
    "case when status = 'evaluated' then (lo / eo - 1) * 100 end as adverse_before_exit_pct from pol6",
    "pol6",
)
cte("hist", f"select t.*, s.rank_fraction, {GROUP.replace('kind', 's.kind').replace('etf_style', 's.etf_style')} as grp from scored s join ten t on t.symbol = s.symbol and t.signal_date = s.as_of where t.status = 'evaluated'", "scored", "ten")
cte(
    "met",
    "select f.symbol, f.date, case when f.valid then f.close end as close, case when f.valid then f.turnover end as turnover, "
    "case when f.valid then f.volume end as volume, case when f.valid and p.valid and not f.adj and p.close > 0 then (f.close / p.close - 1) * 100 end as change_pct, "
    "case when f.valid then f.momentum5 end as momentum5_pct, case when f.valid then f.momentum20 end as momentum20_pct, "
    "case when f.valid then f.volume_ratio end as relative_volume, case when f.valid then f.volatility end as volatility_pct, "
    "case when f.valid and f.ok then f.close > f.prev_20_high end as new_high20, case when f.valid and f.ok then f.close < f.prev_20_low end as new_low20 "
    "from feat f left join bars p on p.symbol = f.symbol and p.ord = f.ord - 1",
    "feat",
    "bars",
)
