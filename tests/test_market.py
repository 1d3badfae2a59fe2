"""Calendar, features, outcomes and rankings on hand-made bars with exact expectations."""

from datetime import date, timedelta

import pytest
from build import bar, days, frame, securities
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.functions.layout import group_median, split_rank
from tickloom.operators import analogue as A
from tickloom.operators import breadth as B
from tickloom.operators import calendar as CA
from tickloom.operators import features as FE
from tickloom.operators import outcomes as O
from tickloom.operators import performance as P
from tickloom.operators import ranking as R
from tickloom.operators import reconcile as E
from tickloom.operators import validation as V

START = date(2026, 1, 1)


def test_future_session_skips_a_holiday_and_stops_at_an_unloaded_year(spark):
    sessions = CA.session_table(spark.createDataFrame([(date(2026, 9, 24),), (date(2026, 9, 25),)], "date date"))
    rules = spark.createDataFrame([(date(2026, 9, 28), False, True)], "date date, is_open boolean, is_holiday boolean")
    t = CA.target_dates(sessions, (1, 100), rules, (2026,))
    got = {(r["date"], r["horizon"]): r["target_date"] for r in t.collect()}
    assert got[date(2026, 9, 25), 1] == date(2026, 9, 29)
    assert got[date(2026, 9, 25), 100] is None
    assert got[date(2026, 9, 24), 1] == date(2026, 9, 25)


def test_special_opening_beats_a_weekend(spark):
    sessions = CA.session_table(spark.createDataFrame([(date(2026, 9, 25),)], "date date"))
    rules = spark.createDataFrame([(date(2026, 9, 26), True, False)], "date date, is_open boolean, is_holiday boolean")
    assert CA.target_dates(sessions, (1,), rules, (2026,)).first()["target_date"] == date(2026, 9, 26)


@pytest.mark.parametrize("volume, labelled", [(15_000, False), (15_001, True)])
def test_volume_label_is_strict(spark, volume, labelled):
    rows = [bar(d) for d in days(START, 20)] + [bar(START + timedelta(20), volume=volume)]
    last = FE.features(frame(spark, rows)[0]).orderBy(F.desc("date")).first()
    assert last["has_features"] and (FE.LABEL_VOLUME in last["labels"]) == labelled
    assert FE.LABEL_SMALL in last["labels"]


def test_a_missing_session_gives_null_not_a_shifted_window(spark):
    calendar = days(START, 22)
    rows = [bar(d) for d in calendar if d != calendar[5]]
    assert FE.features(frame(spark, rows, calendar)[0]).filter("has_features").count() == 0
    plain = FE.row_order(frame(spark, rows)[0])
    assert FE.features(plain).filter("has_features").count() == 1


def test_the_oldest_bar_of_the_frame_may_be_adjusted(spark):
    rows = [bar(d, mark="**" if i == 0 else "") for i, d in enumerate(days(START, 21))]
    assert FE.features(frame(spark, rows)[0]).filter("has_features").count() == 1
    rows[1]["change"] = "x1.0"
    assert FE.features(frame(spark, rows)[0]).filter("has_features").count() == 0


def test_block_size_does_not_change_features_or_labels(spark, monkeypatch):
    rows = [bar(d, open=100 + i % 7, high=110 + i % 5, low=90, close=100 + (i * 13) % 9, volume=1000 + i * 17 % 400) for i, d in enumerate(days(START, 130)) if i % 53 != 7]
    bars, sessions = frame(spark, rows, days(START, 130))
    sec = securities(spark, [("2330", "A", "stock", None, None, None)])
    import tickloom.functions.layout as layout

    def result():
        cols = ["date", "horizon", "has_features", "momentum20", "volatility", "return_pct", "recovery_days", "worst_close_return"]
        return [tuple(r) for r in O.research_table(bars, sessions, sec).select(*cols).orderBy("date", "horizon").collect()]

    whole = result()
    original = layout.blocked
    small = lambda df, back=0, ahead=0, size=31, ord_col="ord": original(df, back, ahead, size, ord_col)
    monkeypatch.setattr(O, "blocked", small)
    assert result() == whole and any(r[2] for r in whole) and any(r[5] is not None for r in whole)


def _outcome(spark, rows, horizon, **costs):
    bars, sessions = frame(spark, rows)
    sec = securities(spark, [("2330", "A", "stock", None, None, None)])
    return O.event_outcomes(bars, sessions, sec, horizons=(horizon,), **costs).orderBy("signal_date").first()


def test_net_return_enters_at_the_next_open(spark):
    d = days(START, 3)
    rows = [bar(d[0], close=999, high=999), bar(d[1], open=100, close=101, high=102), bar(d[2])]
    got = _outcome(spark, rows, 1, fee=0.001, slippage=0.0)
    assert got["return_pct"] == pytest.approx(0.4955044955045) and got["entry_date"] == d[1] == got["exit_date"]


def test_recovered_then_lost(spark):
    d = days(START, 4)
    rows = [bar(d[0]), bar(d[1], open=100, close=103, high=103), bar(d[2], close=98, low=97, open=98), bar(d[3], close=98, low=97, open=98)]
    got = _outcome(spark, rows, 3, fee=0.001, slippage=0.0)
    assert got["return_pct"] < 0 and got["recovered"] and got["recovery_days"] == 0


def test_locked_or_adjusted_window_has_no_outcome(spark):
    d = days(START, 4)
    locked = [bar(d[0]), bar(d[1], high=100, low=100), bar(d[2]), bar(d[3])]
    first = lambda rows: _outcome(spark, rows, 3)
    assert first(locked) is None or first(locked)["signal_date"] != d[0]
    adjusted = [bar(d[0]), bar(d[1]), bar(d[2], change="X"), bar(d[3])]
    assert first(adjusted) is None or first(adjusted)["signal_date"] != d[0]
    entry_only = [bar(d[0]), bar(d[1], change="X"), bar(d[2]), bar(d[3])]
    assert first(entry_only)["signal_date"] == d[0]


def test_target_prices_and_ticks(spark):
    rows = spark.createDataFrame(
        [(48.01, "stock", 50.5), (48.01, "etf", 50.45), (100.0, "stock", 105.0), (5.91, "stock", 6.21), (150.0, "stock", 157.5)], "p double, k string, want double"
    ).select("want", S.target_price("p", "k").alias("got"))
    assert all(r["got"] == r["want"] for r in rows.collect())


def _ten(spark, rows, calendar=None):
    bars, sessions = frame(spark, rows, calendar)
    sec = securities(spark, [("2330", "A", "stock", None, None, None)])
    return O.ten_session_outcomes(bars, sessions, sec).orderBy("signal_date").first()


def test_ten_session_statuses(spark):
    d = days(START, 12)
    rows = lambda **at: [bar(x, **at.get(f"d{i}", {})) for i, x in enumerate(d[:11])]
    touched = _ten(spark, rows(d1=dict(high=105, close=104)))
    assert (touched["status"], touched["touched"], touched["potential_fill"]) == ("evaluated", True, False)
    assert touched["entry_date"] == d[1] and touched["exit_date"] == d[10]
    assert _ten(spark, rows(d1=dict(high=105.5)))["potential_fill"]
    assert _ten(spark, rows()[:5])["status"] == "pending"
    assert _ten(spark, rows(d5=dict(valid=False)))["status"] == "not_comparable"
    assert _ten(spark, rows(d1=dict(change="X")))["status"] == "not_comparable"
    assert _ten(spark, rows(d1=dict(open=110, high=110, low=110, close=110)))["status"] == "not_filled"
    assert _ten(spark, [r for r in rows() if r["date"] != d[1]], d)["status"] == "not_filled"
    assert _ten(spark, [r for r in rows() if r["date"] != d[4]], d)["status"] == "not_comparable"


def _trade(spark, change=None, drop=None, kind="stock", as_of=None):
    d = days(START, 11)
    rows = [bar(x, open=100, high=104, low=97, close=98) for x in d]
    for i, values in (change or {}).items():
        rows[i].update(values)
    rows = [r for i, r in enumerate(rows) if i != drop]
    bars, sessions = frame(spark, rows, d)
    signal = spark.createDataFrame([("2330", d[0], kind)], "symbol string, signal_date date, kind string")
    return O.policy_exits(signal, bars, sessions, None if as_of is None else F.lit(d[as_of])).first()


def test_policy_exits(spark):
    expiry = _trade(spark, {1: dict(high=105.0)})
    assert (expiry["touched"], expiry["target_filled"], expiry["exit_price"], expiry["reason"]) == (True, False, 98.0, "expiry_close")
    fill = _trade(spark, {2: dict(high=105.5, low=80.0)})
    assert fill["exit_price"] == 105.0 and fill["adverse_before_exit_pct"] == pytest.approx(-3)
    assert _trade(spark, {1: dict(high=105.5)})["adverse_before_exit_pct"] is None
    gap = _trade(spark, {2: dict(open=107.0, high=108.0, close=107.0)}, kind="etf")
    assert gap["exit_price"] == 107.0 and gap["reason"] == "gap_open"
    early = _trade(spark, {1: dict(high=106.0)}, as_of=4)
    assert (early["status"], early["elapsed_sessions"], early["net_return_pct"]) == ("pending", 4, None)
    assert _trade(spark, drop=4)["status"] == "not_comparable"
    assert _trade(spark, drop=1)["status"] == "not_comparable"
    assert _trade(spark, {1: dict(high=100.0, low=100.0, close=100.0)})["status"] == "not_filled"
    assert _trade(spark, {3: dict(change="X")})["status"] == "not_comparable"


def test_later_prices_do_not_change_an_earlier_estimate(spark):
    d = days(START, 80)
    base = [bar(x, open=100 + i % 5, high=112, low=90, close=100 + (i * 7) % 11, volume=1000 + (i * 31) % 300) for i, x in enumerate(d)]
    sec = securities(spark, [("2330", "A", "stock", None, None, None)])
    settings = A.EstimateSettings(neighbors=10, min_samples=3, min_turnover=0)

    def estimate(rows):
        bars, sessions = frame(spark, rows)
        research = O.research_table(bars, sessions, sec, horizons=(3,))
        anchors = research.filter(F.col("date") == F.lit(d[60]))
        r = A.estimates(anchors, research, settings).first()
        return [r[c] for c in ("n", "expected_return", "q10", "q90", "p_positive", "score")]

    changed = [dict(r) for r in base]
    for r in changed[61:]:
        r.update(open=50.0, high=51.0, low=1.0, close=2.0)
    before = estimate(base)
    assert before[0] == 10 and estimate(changed) == before


def test_nearest_matches_brute_force(spark):
    import numpy as np

    d = days(START, 70)
    rows = [bar(x, open=100 + i % 5, high=112, low=90, close=100 + (i * 7) % 11, volume=1000 + (i * 31) % 300) for i, x in enumerate(d)]
    bars, sessions = frame(spark, rows)
    research = O.research_table(bars, sessions, securities(spark, [("2330", "A", "stock", None, None, None)]), horizons=(5,))
    local = research.orderBy("date").collect()
    anchor = local[60]
    pool = [r for r in local if r["has_features"] and r["has_outcome"] and r["exit_date"] <= anchor["date"] and r["ord"] < anchor["ord"]]
    vec = np.array([[r[v] for v in FE.VECTOR] for r in pool])
    scale = np.maximum(vec.std(axis=0), A.SCALE_FLOORS)
    dist = (((vec - np.array([anchor[v] for v in FE.VECTOR])) / scale) ** 2).sum(axis=1)
    want = [pool[i]["ord"] for i in np.argsort(dist.round(9), kind="stable")[:8]]
    got = A.nearest(research.filter(F.col("date") == F.lit(anchor["date"])), research, 8).orderBy("rank").collect()
    assert sorted(r["c_ord"] for r in got) == sorted(want)
    stats = A.neighbour_statistics(A.nearest(research.filter(F.col("date") == F.lit(anchor["date"])), research, 8)).first()
    returns = np.array([r["return_pct"] for r in pool if r["ord"] in want])
    assert stats["q10"] == pytest.approx(np.quantile(returns, 0.1)) and stats["expected_return"] == pytest.approx(returns.mean())


def test_folds_of_75_days(spark):
    sessions = spark.createDataFrame([(x,) for x in days(START, 75)], "date date")
    rows = V.rolling_folds(sessions).groupBy("fold").pivot("role", ["warmup", "purge", "test"]).count().orderBy("fold").collect()
    assert [(r["warmup"], r["purge"], r["test"]) for r in rows] == [(30, 10, 10), (40, 10, 10), (50, 10, 10), (60, 10, 5)]


def test_bootstrap(spark):
    constant = lambda n: spark.createDataFrame([(x, 2.0) for x in days(START, n)], "d date, v double")
    short = V.block_bootstrap(constant(29), "v", "d", replicates=100).first()
    assert short["ci_low"] is None and short["mean_difference_pct"] is None and short["valid_test_days"] == 29
    full = V.block_bootstrap(constant(30), "v", "d").first()
    assert (round(full["ci_low"], 9), round(full["ci_high"], 9), full["conclusion"]) == (2.0, 2.0, "above_zero")
    varied = spark.createDataFrame([(x, float(i % 7)) for i, x in enumerate(days(START, 47))], "d date, v double")
    got = V.block_bootstrap(varied, "v", "d").first()
    import numpy as np

    rng, v = np.random.default_rng(1), np.array([i % 7 for i in range(47)], float)
    means = np.sort([np.concatenate([v[s : s + 10] for s in rng.integers(0, 38, 5)])[:47].mean() for _ in range(4000)])
    assert abs(got["ci_low"] - means[100]) < 0.15 and abs(got["ci_high"] - means[3900]) < 0.15


def test_day_weighting_and_profit_factor(spark):
    rows = [(date(2026, 1, d), "stock", None, 1, "evaluated", v, v > 0, "trade-policy-v1", 10) for d, v in ((1, 10.0), (1, 10.0), (2, -10.0))]
    schema = "signal_date date, kind string, etf_style string, rank int, status string, net_return_pct double, target_filled boolean, policy_version string, elapsed_sessions int"
    full = spark.createDataFrame(rows, schema)
    got = P.cohort_report(full).filter("cohort = 'top10'").first()
    assert got["mean_net_return_pct"] == 0 and got["comparable_signal_dates"] == 2 and got["profit_factor"] == pytest.approx(1)
    assert P.paired_difference(full).first()["paired_difference_pct"] == 0
    assert P.cohort_report(spark.createDataFrame(rows[:2], schema)).first()["profit_factor"] is None
    more = spark.createDataFrame([*rows, (date(2026, 1, 3), "stock", None, 1, "pending", None, None, None, 3)], schema)
    assert P.cohort_report(more).filter("cohort = 'top10'").first()["pending"] == 1


def test_breadth(spark):
    d = days(START, 21)
    closes = {"A": 110, "B": 90, "C": 100, "E": 1000}
    rows = [bar(x, symbol=s, open=100, high=2000, low=1, close=c if x == d[-1] else 100, volume=10, turnover=200 if x == d[-1] else 100) for s, c in closes.items() for x in d]
    bars, sessions = frame(spark, rows)
    sec = securities(spark, [("A", "A", "stock", "01", None, None), ("B", "B", "stock", "01", None, None), ("C", "C", "stock", None, None, None), ("E", "E", "etf", None, None, None), ("Z", "Z", "stock", "01", None, None)])
    summary = B.market_summary(sec, bars, sessions, F.lit(d[-1]))
    market = summary["market"].first()
    assert (market["advancers"], market["decliners"], market["unchanged"]) == (1, 1, 1)
    assert market["equal_weight_return_pct"] == pytest.approx(0) and market["turnover_ratio_20"] == 2
    coverage = {r["metric"]: (r["eligible"], r["excluded"], r["total"]) for r in summary["coverage"].collect()}
    assert coverage["daily_return"] == (3, 1, 4)
    industries = {r["industry"]: r for r in summary["industries"].collect()}
    assert industries[B.NO_INDUSTRY]["total"] == 1 and industries["01"]["median_return_pct"] == pytest.approx(0) and industries["01"]["small_sample"]


def test_split_rank_and_median_with_a_hot_group(spark):
    import random

    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 11}", f"s{i:04d}", rng.choice([0.0, -1.5, 2.0, rng.uniform(-1e6, 1e6), rng.uniform(-1, 1)])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, s string, v double")
    for descending in (True, False):
        got = {r["s"]: (r["position"], r["position_of"]) for r in split_rank(df, ["g"], "v", ["s"], descending).collect()}
        for g in {r[0] for r in rows}:
            group = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2] if descending else r[2], r[1]))
            assert [got[r[1]] for r in group] == [(i + 1, len(group)) for i in range(len(group))]
    import statistics

    medians = {r["g"]: r["m"] for r in group_median(df, ["g"], "v", ["s"], "m").collect()}
    for g, m in medians.items():
        assert m == pytest.approx(statistics.median(r[2] for r in rows if r[0] == g))


def test_split_rank_of_one_constant_value_fills_no_task(spark):
    from tickloom.functions import layout

    rows = spark.range(4000).select(F.lit("g").alias("g"), F.format_string("s%05d", "id").alias("s"), F.lit(1.0).alias("v"))
    kept = {}
    real = layout.written
    layout.written = lambda df, name: kept.setdefault("rows", real(df, name))
    try:
        got = split_rank(rows, ["g"], "v", ["s"]).orderBy("s").collect()
    finally:
        layout.written = real
    assert [r["position"] for r in got] == list(range(1, 4001))
    sizes = [r["count"] for r in kept["rows"].groupBy("_slice").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000
    nulls = spark.createDataFrame([("g", "a", None), ("g", "b", 2.0), (None, "c", 1.0)], "g string, s string, v double")
    assert {r["s"]: r["position"] for r in split_rank(nulls, ["g"], "v", ["s"]).collect()} == {"a": 2, "b": 1, "c": 1}


def test_calendar_keeps_far_days_and_refuses_what_it_cannot_hold(spark):
    from tickloom.operators.calendar import session_table

    days = spark.createDataFrame([("1899-12-29",), ("2201-01-02",), (None,)], "date string")
    assert [str(r["date"]) for r in session_table(days).orderBy("ord").collect()] == ["1899-12-29", "2201-01-02"]
    with pytest.raises(Exception, match="no supported session"):
        session_table(spark.sql("select date_add(date'9999-12-31', 1) as date")).collect()


def test_midpoint_percentile_ties_and_single_row(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", 5.0), (1, "c", 7.0), (2, "d", 3.0)], "d int, s string, v double")
    got = {r["s"]: r["p"] for r in E.midpoint_percentile(df, ["d"], "v", "p").collect()}
    assert got == {"a": 0.25, "b": 0.25, "c": 1.0, "d": 1.0}


def test_fixed_weight_cohort_keeps_ineligible_out(spark):
    rows = [(START, f"S{i:02d}", i, float(15 - i), float(i), True) for i in range(1, 16)] + [(START, "BAD", 0, 99.0, 99.0, False)]
    df = spark.createDataFrame(rows, "signal_date date, symbol string, rank int, institution_ratio_5 double, revenue_yoy_pct double, eligible boolean")
    got = E.select_cohorts(df).collect()
    base = [r["symbol"] for r in sorted((r for r in got if r["arm"] == "baseline"), key=lambda r: r["arm_rank"])]
    assert base == [f"S{i:02d}" for i in range(1, 11)] and len(got) == 20 and "BAD" not in {r["symbol"] for r in got}


def test_page_past_the_end_is_the_last_page(spark):
    df = spark.createDataFrame([(f"s{i:02d}", float(i)) for i in range(23)], "symbol string, v double").withColumn("g", F.lit(1))
    ranked = split_rank(df, ["g"], "v", ["symbol"])
    rows = R.page(ranked, 9, 10).collect()
    assert sorted(r["position"] for r in rows) == [21, 22, 23] and {r["page"] for r in rows} == {3}
