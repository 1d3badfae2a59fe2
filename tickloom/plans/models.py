"""Queries over analogue estimates, walk-forward validation, snapshots, reconciliation and the experiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import analogue as A
from tickloom.operators import breadth as B
from tickloom.operators import clean as C
from tickloom.operators import pit as T
from tickloom.operators import ranking as R
from tickloom.operators import reconcile as E
from tickloom.operators import validation as V
from tickloom.plans.market import TRACK_SQL, history, nested, track_rows, tracking
from tickloom.plans.oracle import FLOORS, VECTOR, cte, oracle, rlist, rnd
from tickloom.plans.registry import MIN_TURNOVER, Market, joined, query, rounded, text

SETTINGS = A.EstimateSettings(min_turnover=MIN_TURNOVER)
DAY_KEYS = "symbol, horizon, cast(date as varchar) as anchor_date"


def day_anchors(m: Market):
    """All symbols of one session (as_of) for every horizon."""
    return m.research.filter(F.col("date") == m.as_of)


def keyed(df):
    return df.withColumn("anchor_date", text("anchor_date"))


@query(
    "j6_matured_candidates",
    oracle(f"select {DAY_KEYS}, count(*) as candidates, {rnd('avg(c_return)', 6, 'mean_return')} from day_pair group by 1, 2, 3", "day_pair"),
)
def j6(m):
    pairs = A.matured_pairs(A._as_anchors(day_anchors(m)), m.research)
    rows = pairs.groupBy(*A.ANCHOR).agg(F.count("*").alias("candidates"), F.round(F.avg("c_return"), 6).alias("mean_return"))
    return keyed(rows)


@query("k1_anchor_scale", oracle(f"select {DAY_KEYS}, candidates, {rlist(*['s_' + v for v in VECTOR])} from day_scale", "day_scale"))
def k1(m):
    return keyed(rounded(A.anchor_scales(day_anchors(m), m.research), *["s_" + v for v in VECTOR]))


@query("k2_distance", oracle(f"select {DAY_KEYS}, c_ord, {rnd('distance', 6, 'distance')} from day_near", "day_near"))
def k2(m):
    rows = A.nearest(day_anchors(m), m.research)
    return keyed(rows.select(*A.ANCHOR, "c_ord", F.round("distance", 6).alias("distance")))


@query("k3_top_k", oracle(f"select {DAY_KEYS}, c_ord, rk as rank from day_near where rk <= 60", "day_near"))
def k3(m):
    rows = A.nearest(day_anchors(m), m.research, 60)
    return keyed(rows.select(*A.ANCHOR, "c_ord", F.col("rank").cast("long").alias("rank")))


_STATS = ("expected_return", "median_return", "p_positive", "p_recovery", "q10", "q90", "worst_close_q10", "median_recovery_days")


@query("k4_neighbour_statistics", oracle(f"select {DAY_KEYS}, n, {rlist(*_STATS)} from day_stat", "day_stat"))
def k4(m):
    return keyed(rounded(A.neighbour_statistics(A.nearest(day_anchors(m), m.research)), *_STATS))


RAW_SCORE = "greatest(0e0, least(100e0, 50 + expected_return * 3 + (p_positive - 0.5e0) * 40 + least(q10, 0e0) * 2))"


def estimate_cte(name: str, anchor: str, stat: str, stop_date: bool = True) -> None:
    cte(
        name,
        f"select a.symbol, a.horizon, a.date, a.ok, a.ord, a.entry_date, a.exit_date as target_date, a.return_pct as actual, coalesce(s.n, 0) as n, s.expected_return, s.median_return, s.p_positive, "
        f"s.p_recovery, s.q10, s.q90, s.worst_close_q10, s.median_recovery_days, case when not a.ok then '{A.REASON_NO_FEATURES}' when s.n is null then '{A.REASON_NO_CANDIDATES}' "
        f"else concat_ws('|', case when s.n < 30 then '{A.REASON_FEW}' end, case when a.avg_turnover_20 < 100000 then '{A.REASON_TURNOVER}' end, "
        f"case when s.expected_return <= 0 then '{A.REASON_MEAN}' end, case when s.p_positive < 0.55 then '{A.REASON_PROBABILITY}' end, "
        f"case when s.q10 < -8 then '{A.REASON_DOWNSIDE}' end, case when a.exit_date is null then '{A.REASON_TARGET}' end) end as reasons, "
        f"case when s.n is not null then round({RAW_SCORE}, 1) end as score from {anchor} a left join {stat} s on s.symbol = a.symbol and s.horizon = a.horizon and s.date = a.date",
        anchor, stat,
    )


estimate_cte("last_est", "last_anchor", "last_stat")
estimate_cte("day_est", "day_anchor", "day_stat")
estimate_cte("val_est", "val_anchor", "val_stat")


def last_estimates(m: Market):
    return m.shared("last_estimates", lambda: A.latest_estimates(m.research, SETTINGS))


def day_estimates(m: Market):
    return m.shared("day_estimates", lambda: A.estimates(day_anchors(m), m.research, SETTINGS))


@query("k5_eligibility", oracle(f"select {DAY_KEYS}, reasons, reasons = '' as eligible from day_est", "day_est"))
def k5(m):
    return keyed(day_estimates(m).select(*A.ANCHOR, joined("reasons").alias("reasons"), "eligible"))


@query("k6_composite_score", oracle(f"select {DAY_KEYS}, score from day_est", "day_est"))
def k6(m):
    return keyed(day_estimates(m).select(*A.ANCHOR, "score"))


@query(
    "k7_latest_estimate",
    oracle(f"select {DAY_KEYS}, cast(target_date as varchar) as target_date, n, {rlist(*_STATS)}, score, reasons, reasons = '' as eligible from last_est", "last_est"),
)
def k7(m):
    rows = rounded(last_estimates(m), *_STATS)
    return keyed(rows.select(*A.ANCHOR, text("target_date").alias("target_date"), F.col("n").cast("long").alias("n"), *_STATS, "score", joined("reasons").alias("reasons"), "eligible"))


# --- lists over estimates -----------------------------------------------------------------------------------------


@query(
    "c7_list_filter",
    oracle(
        "select e.symbol, e.reasons = '' as eligible, " + rnd("e.expected_return", 6, "expected_return") + " from day_est e join sec s on s.symbol = e.symbol where e.horizon = 7 "
        "and s.kind = 'stock' and contains(lower(concat(s.symbol, ' ', s.name)), 'brand#') and e.symbol in (select symbol from day_est where expected_return > 0 group by 1 having count(distinct horizon) = 6)",
        "day_est", "sec",
    ),
)
def c7(m):
    rows = day_estimates(m).join(m.securities.select("symbol", "name", "kind"), "symbol")
    kept = C.list_filter(rows, 7, "stock", "all", " Brand# ", True)
    return kept.select("symbol", "eligible", F.round("expected_return", 6).alias("expected_return"))


_B2 = ("expected_return", "p_positive", "p_recovery", "score")


@query(
    "r4_horizon_ranking",
    oracle("select symbol, " + rnd("p_positive", 6, "p_positive") + ", row_number() over (order by p_positive desc nulls last, symbol) as position from day_est where horizon = 7", "day_est"),
)
def r4(m):
    ranked = R.horizon_ranking(day_estimates(m), 7, "p_positive")
    return ranked.select("symbol", F.round("p_positive", 6).alias("p_positive"), "position")


@query(
    "b1_ranked_export",
    oracle(
        "select e.symbol, cast(e.date as varchar) as as_of, s.name, s.kind, 7 as horizon, cast(e.target_date as varchar) as target_date, " + rlist("expected_return", "p_positive", "p_recovery", "q10", "q90")
        + ", n, e.reasons = '' as eligible, replace(e.reasons, '|', '；') as reasons, row_number() over (order by p_recovery desc nulls last, e.symbol) as position from day_est e join sec s on s.symbol = e.symbol where e.horizon = 7",
        "day_est", "sec",
    ),
)
def b1(m):
    from tickloom.sources.sinks import ranked_export

    rows = ranked_export(day_estimates(m), m.securities, 7, "p_recovery")
    return rounded(rows.drop("metric"), "expected_return", "p_positive", "p_recovery", "q10", "q90").withColumns({"as_of": text("as_of"), "target_date": text("target_date"), "horizon": F.col("horizon").cast("int"), "n": F.col("n").cast("long")})


@query(
    "b2_all_exports",
    oracle(
        " union all ".join(
            f"select horizon, '{c}' as metric, symbol, {rnd(c, 6, 'value')}, row_number() over (partition by horizon order by {c} desc nulls last, symbol) as position from day_est" for c in _B2
        ),
        "day_est",
    ),
)
def b2(m):
    from tickloom.sources.sinks import all_exports

    rows = all_exports(day_estimates(m), m.securities)
    return rows.select("horizon", "metric", "symbol", F.round("value", 6).alias("value"), "position")


@query("g12_snapshot_coverage", oracle("select horizon, count(*) as securities, count(*) filter (where reasons = '') as eligible from day_est group by 1", "day_est"))
def g12(m):
    return B.eligible_per_horizon(day_estimates(m))


@query(
    "g12_universe_counts",
    oracle(
        "select count(*) as universe_count, count(*) filter (where reasons = '') as analyzed_count, count(*) filter (where reasons <> '') as unavailable_count, count(*) filter (where s.kind = 'stock') as stocks, count(*) filter (where s.kind = 'etf') as etfs from day_est d join sec s on s.symbol = d.symbol where horizon = 7",
        "day_est", "sec",
    ),
)
def g12_universe(m):
    rows = day_estimates(m).filter("horizon = 7").select("symbol", "reasons").join(m.securities.select("symbol", "kind"), "symbol")
    return B.snapshot_coverage(rows)


# --- walk-forward validation --------------------------------------------------------------------------------------


def anchors(m: Market):
    return m.shared("validation_anchors", lambda: V.validation_anchors(m.research, V.row_index(m.bars)))


def preds(m: Market):
    return m.shared("predictions", lambda: V.predictions(anchors(m), m.research, SETTINGS))


cte(
    "vbase",
    "select a.symbol, a.horizon, a.date, avg(case when c.return_pct > 0 then 1e0 else 0e0 end) as baseline from val_anchor a join lab c on c.symbol = a.symbol and c.horizon = a.horizon "
    "and c.exit_date <= a.date and c.date < a.date group by 1, 2, 3",
    "val_anchor", "lab",
)
cte(
    "pred",
    "select e.symbol, e.horizon, e.date, e.target_date, e.expected_return as expected, e.p_positive as probability, e.actual, case when e.actual > 0 then 1e0 else 0e0 end as positive, "
    "coalesce(b.baseline, 0.5e0) as baseline, e.reasons = '' as selected from val_est e left join vbase b on b.symbol = e.symbol and b.horizon = e.horizon and b.date = e.date where e.n >= 30",
    "val_est", "vbase",
)


@query("v1_anchor_sampling", oracle("select symbol, horizon, cast(date as varchar) as date, idx from val_anchor join rowno using (symbol, date)", "val_anchor", "rowno"))
def v1(m):
    rows = anchors(m).select("symbol", "horizon", "date").join(V.row_index(m.bars).select("symbol", "date", "idx"), ["symbol", "date"])
    return rows.withColumn("date", text("date"))


@query(
    "v2_walk_forward",
    oracle("select symbol, horizon, cast(date as varchar) as signal_date, cast(target_date as varchar) as exit_date, " + rlist("expected", "probability", "actual", "positive", "baseline") + ", selected from pred", "pred"),
)
def v2(m):
    rows = rounded(preds(m), "expected", "probability", "actual", "positive", "baseline")
    return rows.withColumns({"signal_date": text("signal_date"), "exit_date": text("exit_date")})


_BIN = "case when probability >= 0.7 then '0.7-1.0' when probability >= 0.6 then '0.6-0.7' when probability >= 0.5 then '0.5-0.6' when probability >= 0.4 then '0.4-0.5' else '0.0-0.4' end"


@query("v3_calibration", oracle(f"select symbol, horizon, {_BIN} as bin, count(*) as n, {rnd('avg(probability)', 6, 'predicted')}, {rnd('avg(positive)', 6, 'actual')} from pred group by 1, 2, 3", "pred"))
def v3(m):
    return rounded(V.calibration(preds(m)), "predicted", "actual")


_V4 = ("mae", "brier", "baseline_brier", "mean_return", "hit_rate")


@query(
    "v4_validation_report",
    oracle(
        f"select symbol, horizon, count(*) as n, {rnd('avg(abs(expected - actual))', 6, 'mae')}, {rnd('avg(pow(probability - positive, 2))', 6, 'brier')}, "
        f"{rnd('avg(pow(baseline - positive, 2))', 6, 'baseline_brier')}, {rnd('avg(actual)', 6, 'mean_return')}, {rnd('avg(positive)', 6, 'hit_rate')} from pred group by 1, 2",
        "pred",
    ),
)
def v4(m):
    return rounded(V.validation_report(preds(m)), *_V4)


_FOLDS = (
    "select k.fold, cast(p.date as varchar) as date, case when p.pos >= 40 + k.fold * 10 then 'test' when p.pos >= 30 + k.fold * 10 then 'purge' else 'warmup' end as role from "
    "(select date, ord - 1 as pos, (select max(ord) from sess) as n from sess) p join (select unnest(range(0, 400)) as fold) k on 40 + k.fold * 10 < p.n and p.pos < 50 + k.fold * 10"
)


@query("v7_purged_folds", oracle(_FOLDS, "sess"))
def v7(m):
    rows = V.rolling_folds(m.sessions)
    return rows.select(F.col("fold").cast("long").alias("fold"), text("date").alias("date"), "role")


@query("v8_block_bootstrap")
def v8(m):
    """Daily mean policy return of the whole scored universe; checked against brute force in the tests."""
    days = tracking(m).filter("status = 'evaluated'").groupBy("signal_date").agg(F.avg("net_return_pct").alias("value"))
    return rounded(V.block_bootstrap(days, "value", "signal_date"), "mean_difference_pct", "ci_low", "ci_high")


# --- snapshots and reconciliation ---------------------------------------------------------------------------------
# A snapshot is taken on every 20th session, and a corrected one an hour later on every 40th.

cte(
    "manifest",
    "select cast(ord as varchar) || suffix as snapshot_id, date as as_of, cast(date as timestamp) + interval 20 hour + h as created_at, 'r1' as ranker_version from sess "
    "cross join (select '-a' as suffix, interval 0 hour as h union all select '-b', interval 1 hour) v where ord % 20 = 0 and (suffix = '-a' or ord % 40 = 0)",
    "sess",
)


def manifest(m: Market):
    kinds = F.when(F.col("ord") % 40 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    base = m.sessions.filter(F.col("ord") % 20 == 0).withColumn("h", F.explode(kinds))
    return base.select(
        F.concat(text("ord"), F.when(F.col("h") == 0, "-a").otherwise("-b")).alias("snapshot_id"),
        F.col("date").alias("as_of"),
        (F.to_timestamp("date") + F.make_dt_interval(F.lit(0), F.col("h") + 20)).alias("created_at"),
        F.lit("r1").alias("ranker_version"),
    )


# Predictions of a snapshot: the mean matured return of the symbol so far (a cheap stand-in for the estimate).
cte(
    "preds",
    "select m.snapshot_id, r.symbol, r.horizon, m.as_of, r.momentum20 as predicted from manifest m join research r on r.date = m.as_of where r.ok",
    "manifest", "research",
)


def snapshot_predictions(m: Market):
    rows = m.research.filter("has_features").select("symbol", "horizon", F.col("date").alias("as_of"), F.col("momentum20").alias("predicted"))
    return rows.join(manifest(m).select("snapshot_id", "as_of"), "as_of")


def labels(m: Market):
    return m.research.filter("has_outcome").select(
        "symbol", F.col("date").alias("signal_date"), "horizon", "entry_date", "exit_date", "return_pct", "recovered", "recovery_days", "worst_close_return"
    )


def audit(m: Market):
    return E.reconciled(snapshot_predictions(m), labels(m))


@query(
    "e1_reconciliation",
    oracle("select p.snapshot_id, p.symbol, p.horizon, " + rnd("p.predicted", 6, "predicted") + ", " + rnd("l.return_pct", 6, "return_pct") + ", l.recovered from preds p join lab l on l.symbol = p.symbol and l.date = p.as_of and l.horizon = p.horizon", "preds", "lab"),
)
def e1(m):
    return rounded(audit(m).select("snapshot_id", "symbol", "horizon", "predicted", "return_pct", "recovered"), "predicted", "return_pct")


@query(
    "e2_revision_chain",
    oracle(
        "select p.snapshot_id, p.symbol, p.horizon, case when l.horizon = 30 and p.symbol like '%5' then 'not_comparable' else 'computed' end as outcome_status, "
        "case when p.symbol like '%3' then 1 else 2 end as version from preds p join lab l on l.symbol = p.symbol and l.date = p.as_of and l.horizon = p.horizon "
        "where p.symbol like '%3' or (l.horizon = 30 and p.symbol like '%5') or (p.symbol like '%7' and l.recovered)",
        "preds", "lab",
    ),
)
def e2(m):
    """Stored audit: all but *3; since then *7 winners were revised and the 30-day outcomes of *5 vanished."""
    rows = audit(m).withColumn("calculation_hash", E.calculation_hash(("symbol", "signal_date", "horizon", "exit_date")))
    stored = rows.filter(~F.col("symbol").endswith("3")).withColumns({"version": F.lit(1), "outcome_status": F.lit("computed")})
    gone = (F.col("horizon") == 30) & F.col("symbol").endswith("5")
    revised = F.col("symbol").endswith("7") & F.col("recovered")
    fresh = rows.filter(~gone).withColumn("calculation_hash", F.when(revised, F.sha2("calculation_hash", 256)).otherwise(F.col("calculation_hash")))
    last = m.bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    out = E.revision_rows(stored, fresh, last, F.lit("2026-01-01").cast("timestamp"))
    return out.select("snapshot_id", "symbol", "horizon", "outcome_status", "version")


@query(
    "e3_pending",
    oracle("select p.snapshot_id, p.symbol, p.horizon, 'not_mature_or_not_comparable' as reason from preds p where not exists (select 1 from lab l where l.symbol = p.symbol and l.date = p.as_of and l.horizon = p.horizon)", "preds", "lab"),
)
def e3(m):
    rows = E.pending(snapshot_predictions(m), audit(m), m.bars)
    return rows.select("snapshot_id", "symbol", "horizon", "reason")


@query(
    "e4_backfill_plan",
    oracle(
        "select distinct symbol, cast(cast(unnest(generate_series(date_trunc('month', as_of), date_trunc('month', least(c, as_of + 70)), interval 1 month)) as date) as varchar) as month from ("
        "select distinct p.snapshot_id, p.symbol, p.as_of, (select max(date) from sess) as c from preds p) q where as_of < c and (select count(distinct l.horizon) from lab l where l.symbol = q.symbol and l.date = q.as_of) < 6 "
        "and not exists (select 1 from (select symbol, min(date) as f, max(date) as t from bars where symbol not like '%2' group by 1) b where b.symbol = q.symbol and b.f <= q.as_of and b.t >= least(c, q.as_of + 70))",
        "preds", "lab", "bars", "sess",
    ),
)
def e4(m):
    """Coverage has lost the symbols ending in 2."""
    kept = m.bars.filter(~F.col("symbol").endswith("2")).groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    last = F.lit(m.sessions.agg(F.max("date")).first()[0])
    rows = E.backfill_plan(snapshot_predictions(m), audit(m), kept, last)
    return rows.select("symbol", text("month").alias("month"))


@query(
    "e5_merge_missing",
    oracle("select symbol, count(*) as bars, " + rnd("sum(case when ord % 3 = 0 then close else 0 end)", 4, "kept_close") + ", sum(case when ord % 3 <> 0 then 1 else 0 end) as filled from bars group by 1", "bars"),
)
def e5(m):
    primary = m.bars.filter("ord % 3 = 0").select("symbol", "date", "close", F.lit(0).alias("filled"))
    supplement = m.bars.select("symbol", "date", F.lit(0.0).alias("close"), F.lit(1).alias("filled"))
    rows = E.merge_missing(primary, supplement)
    return rows.groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("kept_close"), F.sum("filled").alias("filled"))


@query(
    "e6_ten_session_reconcile",
    oracle(
        "select s.symbol, cast(s.as_of as varchar) as signal_date, case when n.ord % 2 = 0 then 'kept' else t.status end as status, " + rnd("s.rank_fraction", 6, "rank_fraction") + " from scored s "
        "join sess n on n.date = s.as_of join ten t on t.symbol = s.symbol and t.signal_date = s.as_of where n.ord % 2 = 0 or t.status <> 'pending'",
        "scored", "sess", "ten",
    ),
)
def e6(m):
    """Even sessions already hold a stored row."""
    cand = m.scored.join(F.broadcast(m.sessions), m.sessions["date"] == F.col("as_of")).select(
        F.concat(text("as_of"), F.lit("-s")).alias("snapshot_id"), "symbol", F.col("as_of").alias("signal_date"), "rank_fraction", "score", "ord"
    )
    stored = cand.filter("ord % 2 = 0").withColumns({"status": F.lit("kept"), "method_version": F.lit("two-week-v2")}).select("snapshot_id", "signal_date", "symbol", "rank_fraction", "score", "status", "method_version")
    rows = E.ten_session_reconcile(cand.drop("ord"), stored, m.ten)
    return rows.select("symbol", text("signal_date").alias("signal_date"), "status", F.round("rank_fraction", 6).alias("rank_fraction"))


@query("e7_tracking_report", oracle(TRACK_SQL, "track"))
def e7(m):
    """Tracking of every session; no earlier result exists, so nothing is retained."""
    t = tracking(m)
    prior = t.filter("status = 'pending'")
    return track_rows(E.retain_prior(t, prior).drop("retained"))


@query("e8_input_fingerprint")
def e8(m):
    rows = E.input_fingerprint(tracking(m))
    return rows.select("symbol", text("signal_date").alias("signal_date"), "input_sha256")


# Experiment rows: scored stocks with stand-in official features.
cte(
    "exp",
    "select s.as_of, s.symbol, s.rank, s.relative_volume as inst, s.momentum5_pct as rev, s.momentum20_pct > -50 as eligible from scored s where s.kind = 'stock'",
    "scored",
)


def experiment_rows(m: Market):
    ranked = m.shared("ranked", lambda: R.universe_rank(m.scored))
    return ranked.filter("kind = 'stock'").select(
        F.col("as_of").alias("signal_date"), "symbol", "rank",
        F.col("relative_volume").alias("institution_ratio_5"), F.col("momentum5_pct").alias("revenue_yoy_pct"), (F.col("momentum20_pct") > -50).alias("eligible"),
    )


_PCT = lambda x, a: f"case when n = 1 then 1e0 else (2 * (rank() over (partition by as_of order by {x}) - 1) + count(*) over (partition by as_of, {x}) - 1) / 2e0 / (n - 1) end as {a}"
cte(
    "expscore",
    "select *, 0.7e0 * pr + 0.2e0 * pi + 0.1e0 * pv as shadow from (select *, " + ", ".join((_PCT("-rank", "pr"), _PCT("inst", "pi"), _PCT("rev", "pv"))) + " from (select *, count(*) over (partition by as_of) as n from exp where eligible) a) b",
    "exp",
)
cte(
    "arms",
    "select * from (select as_of, symbol, rank, shadow, 'baseline' as arm, row_number() over (partition by as_of order by rank, symbol) as ar from expscore union all "
    "select as_of, symbol, rank, shadow, 'shadow', row_number() over (partition by as_of order by round(shadow, 9) desc, rank, symbol) from expscore) q where ar <= 10",
    "expscore",
)


def cohorts(m: Market):
    return m.shared("cohorts", lambda: E.select_cohorts(experiment_rows(m)))


@query("e9_cohort_selection", oracle("select cast(as_of as varchar) as signal_date, arm, symbol, " + rnd("shadow", 6, "shadow_score") + " from arms", "arms"))
def e9(m):
    return cohorts(m).select(text("signal_date").alias("signal_date"), "arm", "symbol", F.round("shadow_score", 6).alias("shadow_score"))


@query(
    "e10_feature_archive",
    oracle("select cast(as_of as varchar) as signal_date, count(*) as candidates from exp join sess n on n.date = as_of where n.ord % 20 <> 0 group by 1", "exp", "sess"),
)
def e10(m):
    """Sessions with a snapshot are archived already."""
    fresh = experiment_rows(m).withColumns({"definition_sha256": F.lit("d1"), "snapshot_id": text("signal_date")})
    done = m.sessions.filter("ord % 20 = 0").select(F.lit("d1").alias("definition_sha256"), text("date").alias("snapshot_id"))
    return E.archive_features(done, fresh).groupBy(text("signal_date").alias("signal_date")).agg(F.count("*").alias("candidates"))


cte("acts", "select symbol, date as data_date from bars where ord % 45 = 0 and adj = false and symbol like '%4'", "bars")


def actions(m: Market):
    return m.bars.filter((F.col("ord") % 45 == 0) & (F.col("mark") == "") & F.col("symbol").endswith("4")).select("symbol", F.col("date").alias("data_date"))


@query(
    "j13_actions_in_window",
    oracle("select distinct cast(a.as_of as varchar) as signal_date, a.symbol, cast(c.data_date as varchar) as data_date from arms a join sess n on n.date = a.as_of join sess f on f.ord = n.ord + 1 join sess t on t.ord = n.ord + 10 join acts c on c.symbol = a.symbol and c.data_date between f.date and t.date", "arms", "sess", "acts"),
)
def j13(m):
    rows = E.actions_in_window(cohorts(m), actions(m), m.sessions)
    return rows.select(text("signal_date").alias("signal_date"), "symbol", text("data_date").alias("data_date"))


cte(
    "expdays",
    "select n.date as signal_date, n.ord, n.ord % 11 = 0 as late, n.ord <= 30 as early, n.ord % 13 <> 0 as uni, coalesce(c.cc, 0) as cc, coalesce(c.ec, 0) as ec, "
    "(select max(ord) from sess) - n.ord as sleft, r.pend, r.broken, r.base, r.shad, coalesce(k.na, 0) as na from sess n left join (select as_of, count(*) as cc, count(*) filter (where eligible) as ec from exp group by 1) c on c.as_of = n.date "
    "left join (select a.as_of, bool_or(coalesce(t.status = 'pending', false)) as pend, bool_or(coalesce(t.status <> 'evaluated', true)) as broken, avg(case when arm = 'baseline' then t.net_return_pct end) as base, "
    "avg(case when arm = 'shadow' then t.net_return_pct end) as shad from arms a left join track t on t.symbol = a.symbol and t.signal_date = a.as_of group by 1) r on r.as_of = n.date "
    "left join (select a.as_of, count(*) as na from (select distinct as_of, symbol from arms) a join sess s on s.date = a.as_of join sess f on f.ord = s.ord + 1 join sess t on t.ord = s.ord + 10 join acts c on c.symbol = a.symbol "
    "and c.data_date between f.date and t.date group by 1) k on k.as_of = n.date",
    "sess", "exp", "arms", "track", "acts",
)
cte(
    "expstat",
    "select *, case when late and sleft > 0 then 'late_entry' when early then 'before_definition' when not uni then 'missing_universe' when ec = 0 then 'insufficient_features' when sleft < 10 or pend then 'pending' "
    "when broken then 'not_comparable' when na > 0 then 'corporate_action' else 'comparable' end as status from expdays",
    "expdays",
)


def experiment(m: Market):
    def build():
        snaps = m.sessions.select(
            F.col("date").alias("signal_date"),
            text("date").alias("snapshot_id"),
            (F.to_timestamp("date") + F.when(F.col("ord") % 11 == 0, F.expr("interval 400 days")).otherwise(F.expr("interval 20 hours"))).alias("created_at"),
            (F.col("ord") % 13 != 0).alias("has_universe"),
        )
        frozen = m.sessions.filter("ord = 31").first()["date"]
        return E.experiment_days(snaps, experiment_rows(m), cohorts(m), tracking(m), actions(m), m.sessions, F.lit(frozen).cast("timestamp"))

    return m.shared("experiment", build)


@query(
    "e11_experiment_days",
    oracle(
        "select cast(signal_date as varchar) as signal_date, status, cc as candidate_count, ec as eligible_count, " + rnd("case when status = 'comparable' then shad - base end", 6, "difference_pct") + " from expstat",
        "expstat",
    ),
)
def e11(m):
    rows = experiment(m)
    return rows.select(text("signal_date").alias("signal_date"), "status", "candidate_count", "eligible_count", F.round("difference_pct", 6).alias("difference_pct"))


@query("g15_exclusion_histogram", oracle("select status, count(*) as days from expstat group by 1", "expstat"))
def g15(m):
    return E.exclusion_histogram(experiment(m))


# --- snapshot store -----------------------------------------------------------------------------------------------


@query("b7_history_listing", oracle("select snapshot_id, cast(as_of as varchar) as as_of from manifest order by created_at desc, snapshot_id desc limit 5", "manifest"))
def b7(m):
    return T.history_listing(manifest(m), 5).select("snapshot_id", text("as_of").alias("as_of"))


@query(
    "b8_visible_outcomes",
    oracle("select p.snapshot_id, p.symbol, p.horizon from preds p where snapshot_id in (select snapshot_id from manifest order by created_at desc, snapshot_id desc limit 3)", "preds", "manifest"),
)
def b8(m):
    visible = T.history_listing(manifest(m), 3).select("snapshot_id")
    return snapshot_predictions(m).join(F.broadcast(visible), "snapshot_id", "left_semi").select("snapshot_id", "symbol", "horizon")


@query("t6_latest_snapshot", oracle("select p.symbol, p.horizon, " + rnd("p.predicted", 6, "predicted") + " from preds p where snapshot_id = (select snapshot_id from manifest order by created_at desc, snapshot_id desc limit 1)", "preds", "manifest"))
def t6(m):
    return T.snapshot_rows(snapshot_predictions(m), manifest(m)).select("symbol", "horizon", F.round("predicted", 6).alias("predicted"))


@query("t7_first_original", oracle("select cast(as_of as varchar) as as_of, snapshot_id from (select *, row_number() over (partition by as_of, ranker_version order by created_at, snapshot_id) as rn from manifest) q where rn = 1", "manifest"))
def t7(m):
    return T.first_originals(manifest(m)).select(text("as_of").alias("as_of"), "snapshot_id")


# Every snapshot carries its symbol's last 60 sessions of bars; odd multiples of 20 restate the close by a cent.
cte(
    "snapbars",
    "select b.symbol, b.date, m.snapshot_id, m.created_at, b.close + case when n.ord % 40 = 20 then 0.01e0 else 0e0 end as close from manifest m join sess n on n.date = m.as_of join bars b on b.ord between n.ord - 59 and n.ord",
    "manifest", "sess", "bars",
)


def snapshot_bars(m: Market):
    stamps = manifest(m).join(m.sessions.withColumnRenamed("date", "as_of"), "as_of").select(
        "snapshot_id", F.when(F.col("ord") % 40 == 20, 0.01).otherwise(0.0).alias("shift"), F.explode(F.sequence(F.col("ord") - 59, F.col("ord"))).alias("ord")
    )
    return m.bars.join(F.broadcast(stamps), "ord").select("symbol", "date", "snapshot_id", (F.col("close") + F.col("shift")).alias("close"))


@query(
    "t8_bars_across_snapshots",
    oracle("select symbol, cast(date as varchar) as date, arg_max(snapshot_id, (created_at, snapshot_id)) as snapshot_id, " + rnd("arg_max(close, (created_at, snapshot_id))", 8, "close") + " from snapbars group by 1, 2", "snapbars"),
)
def t8(m):
    rows = T.bars_across_snapshots(snapshot_bars(m), manifest(m))
    return rows.select("symbol", text("date").alias("date"), "snapshot_id", F.round("close", 8).alias("close"))


@query(
    "b5_retention",
    oracle(
        "select p.snapshot_id, count(*) as rows, r <= 3 as full_detail from preds p join (select snapshot_id, row_number() over (order by created_at desc, snapshot_id desc) as r from manifest) k on k.snapshot_id = p.snapshot_id group by 1, 3",
        "preds", "manifest",
    ),
)
def b5(m):
    from tickloom.sources.sinks import retention_plan

    plan = retention_plan(manifest(m))
    return snapshot_predictions(m).join(F.broadcast(plan), "snapshot_id").groupBy("snapshot_id", "full_detail").agg(F.count("*").alias("rows"))


@query("b6_publish_signature")
def b6(m):
    """Content signature per snapshot; equal content gives an equal signature (tested)."""
    from tickloom.sources.sinks import content_signature

    return content_signature(snapshot_predictions(m), ["snapshot_id"])


@query(
    "b4_home_enrichment",
    oracle(
        "select cast(s.as_of as varchar) as as_of, s.symbol, " + rnd("coalesce(case when s.rank % 2 = 0 then s.close end, f.close)", 6, "close") + ", s.momentum5_pct from scored s join feat f on f.symbol = s.symbol and f.date = s.as_of where s.rank <= 10",
        "scored", "feat",
    ),
)
def b4(m):
    """Even ranks already carry their close."""
    from tickloom.sources.sinks import home_rows

    listed = R.research_candidates(m.scored).select("as_of", "symbol", F.when(F.col("rank") % 2 == 0, F.col("close")).alias("close"), F.lit(None).cast("double").alias("momentum5_pct"))
    return home_rows(listed, m.features).select(text("as_of").alias("as_of"), "symbol", F.round("close", 6).alias("close"), "momentum5_pct")


@query("b3_summary_split", oracle("select symbol, horizon, cast(date as varchar) as as_of, reasons = '' as eligible, score, 0 as detail_columns from day_est", "day_est"))
def b3(m):
    """Estimates that carry every detail column lose them all."""
    from tickloom.sources.sinks import DETAIL_COLUMNS, brief_rows

    detailed = day_estimates(m).withColumns({c: F.lit("detail") for c in DETAIL_COLUMNS})
    brief = brief_rows(detailed)
    left = sum(c in brief.columns for c in DETAIL_COLUMNS)
    return brief.select("symbol", "horizon", text("anchor_date").alias("as_of"), "eligible", "score", F.lit(left).alias("detail_columns"))
