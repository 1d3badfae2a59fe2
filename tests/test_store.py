"""Feeds, point-in-time store, flows, posts, quotes, sinks and streams."""

import json
from datetime import date, datetime, timedelta

import pytest
from build import bar, days, frame, securities
from pyspark.sql import functions as F

from tickloom.functions.text import AMBIGUOUS_NAMES, MentionMatcher, article_parts
from tickloom.operators import flows as FL
from tickloom.operators import mentions as M
from tickloom.operators import pit as T
from tickloom.operators import quotes as Q
from tickloom.sources import feeds as FD
from tickloom.sources import sinks, web
from tickloom.streaming import jobs

ARRIVAL = "source string, symbol string, key string, data_date date, value double, acquired_at timestamp, published_at timestamp, seq long"


def arrivals(spark, rows):
    df = spark.createDataFrame([("institution", "2330", "2026-10-07", date(2026, 10, 7), v, at, None, i) for i, (at, v) in enumerate(rows)], ARRIVAL)
    return T.content_hashed(df, "symbol", "key", "value")


def test_versions_corrections_and_cutoffs(spark):
    at = lambda d, h=8: datetime(2026, 10, d, h)
    rows = arrivals(spark, [(at(8), 10.0), (at(9), 10.0), (at(9, 9), 20.0), (at(10), 10.0)])
    versions = T.changed_arrivals(rows)
    assert [r["value"] for r in versions.orderBy("seq").collect()] == [10.0, 20.0, 10.0]
    seen = lambda cut: [r["value"] for r in T.latest_versions(versions, F.lit(cut)).collect()]
    assert seen(at(7, 19)) == [] and seen(at(8, 19)) == [10.0] and seen(at(9, 9)) == [20.0] and seen(at(11)) == [10.0]
    assert T.latest_versions(versions, None, F.lit(date(2026, 10, 6))).count() == 0


def test_publication_after_acquisition_delays_availability(spark):
    row = arrivals(spark, [(datetime(2026, 10, 8, 8), 1.0)]).withColumn("published_at", F.lit(datetime(2026, 10, 10, 9)))
    assert T.latest_versions(T.changed_arrivals(row), F.lit(datetime(2026, 10, 9, 19))).count() == 0


def test_a_batch_not_later_than_the_store_is_dropped(spark):
    store = T.changed_arrivals(arrivals(spark, [(datetime(2026, 10, 8), 1.0)]))
    late = arrivals(spark, [(datetime(2026, 10, 8), 2.0)])
    assert T.new_versions(store, late).count() == 0
    assert T.new_versions(store, arrivals(spark, [(datetime(2026, 10, 9), 2.0)])).count() == 1


def test_versions_of_a_hot_identity_match_a_sequential_scan(spark):
    import random

    rng, start = random.Random(3), datetime(2026, 1, 1)
    rows = [(start + timedelta(minutes=97 * i), float(rng.randint(0, 2))) for i in range(400)]
    want, held = [], None
    for i, (_, v) in enumerate(rows):
        if v != held:
            want.append(i)
            held = v
    for grain in ("hour", "day", "month"):
        got = [r["seq"] for r in T.changed_arrivals(arrivals(spark, rows), grain).orderBy("seq").collect()]
        assert got == want


def pit(spark, volumes):
    d = [date(2026, 10, x) for x in (1, 2, 5, 6, 7)]
    inst = spark.createDataFrame([("2330", x, 10.0, "shares", str(x), "h", datetime(2026, 10, 7)) for x in d], "symbol string, data_date date, total_net double, unit string, key string, content_hash string, available_at timestamp")
    rev = spark.createDataFrame([("2330", date(2026, 8, 1), datetime(2026, 10, 7), date(2026, 8, 1), 5.0)], "symbol string, data_date date, available_at timestamp, period date, yoy_pct double")
    vol = spark.createDataFrame([("2330", x, 100.0) for x in d[:volumes]], "symbol string, date date, volume double")
    _, sessions = frame(spark, [bar(x) for x in d])
    return T.pit_features(spark.createDataFrame([("2330",)], "symbol string"), inst, rev, vol, sessions, F.lit(d[-1])).first()


def test_point_in_time_features(spark):
    full = pit(spark, 5)
    assert (full["institution_ratio_5"], full["buy_streak"], full["revenue_yoy_pct"], full["eligible"]) == (0.1, 5, 5.0, True)
    gap = pit(spark, 4)
    assert gap["institution_ratio_5"] is None and gap["buy_streak"] is None and not gap["eligible"]


def institution_payload(day, symbols, hints="單位：股", fields=FL.INSTITUTION_FIELDS, numbers=(100, 40, 60, 10000, 0, 10000, 20, 30, -10, 12, 5, 4, 1, 15, 4, 11, 62)):
    data = [[s, s] + [f"{n * k:,}" for n in numbers] for s, k in symbols]
    return (day, json.dumps(dict(stat="OK", date=day.strftime("%Y%m%d"), hints=hints, fields=list(fields), data=data), ensure_ascii=False))


def payloads(spark, rows):
    return spark.createDataFrame(rows, "requested_date date, payload string")


def test_institution_measures_and_totals(spark):
    d = [date(2026, 10, x) for x in (12, 13, 14, 15, 16)]
    feed = payloads(spark, [institution_payload(x, [("2330", 1), ("0050", 0)] + ([("2317", 1)] if x == d[-1] else [])) for x in d])
    obs = FD.institution_flows(feed)
    day = {(r["symbol"], r["group"]): (r["buy"], r["sell"], r["net"]) for r in FL.daily_measures(obs).filter(F.col("data_date") == d[-1]).collect()}
    assert day["2330", "foreign"] == (100, 40, 60) and day["2330", "trust"] == (20, 30, -10) and day["2330", "dealer"] == (20, 8, 12)
    sec = securities(spark, [("2330", "a", "stock", None, None, None), ("2317", "b", "stock", None, None, None), ("0050", "c", "etf", None, None, None)])
    _, sessions = frame(spark, [bar(x) for x in d])
    totals = FL.period_totals(FL.daily_measures(obs), sec, sessions, F.lit(d[-1]))
    got = {(r["symbol"], r["group"]): r for r in totals.collect()}
    assert got["2330", "foreign"]["buy"] == 500 and got["2317", "foreign"]["net"] is None and got["0050", "trust"]["net"] == 0
    status = FL.flow_status(totals).first()
    assert (status["complete_symbols"], status["status"]) == (2, "partial")
    lists = {(r["group"], r["metric"]): r["symbol"] for r in FL.institution_lists(totals).filter("position = 1").collect()}
    assert lists["foreign", "net_buy"] == "2330" and lists["trust", "net_sell"] == "2330"


def test_institution_feed_refuses_any_corruption(spark):
    d = date(2026, 10, 16)
    good = institution_payload(d, [("2330", 1)])
    swapped = list(FL.INSTITUTION_FIELDS)
    swapped[2], swapped[3] = swapped[3], swapped[2]
    bad = [institution_payload(d, [("2330", 1)], hints=""), institution_payload(d, [("2330", 1)], fields=swapped), (date(2026, 10, 15), good[1])]
    assert FD.institution_flows(payloads(spark, [good])).count() == 1
    assert FD.institution_flows(payloads(spark, bad)).count() == 0


def test_monthly_feed(spark):
    fields = ["日期", "成交股數", "成交金額", "開盤價", "最高價", "最低價", "收盤價", "漲跌價差", "成交筆數", "註記"]
    row = ["115/09/01", "1,000", "100,000", "100.00", "101.00", "99.00", "100.50", "X0.00", "5", "**"]
    body = lambda **k: json.dumps(dict(dict(stat="OK", fields=fields, data=[row, ["115/09/02", "--", "--", "--", "--", "--", "--", "", "", ""]]), **k), ensure_ascii=False)
    df = lambda *p: spark.createDataFrame([("2330", "20260901", i, x) for i, x in enumerate(p)], "symbol string, month string, load_seq int, payload string")
    rows = FD.monthly_bars(df(body())).orderBy("date").collect()
    assert rows[0]["date"] == date(2026, 9, 1) and rows[0]["volume"] == 1000 and rows[0]["valid"] and not rows[1]["valid"] and rows[1]["close"] is None
    assert FD.bar_issues(FD.monthly_bars(df(body()))).count() == 1
    other = body(data=[row[:6] + ["100.75"] + row[7:]])
    assert FD.bar_conflicts(FD.monthly_bars(df(body(), other))).count() == 1
    problems = [r["problem"] for r in FD.monthly_rejects(df(body(stat="很抱歉，沒有符合條件的資料!"), body(stat="error"), body(fields=fields[1:]), body())).collect()]
    assert problems == ["no_data", "bad_status", "headers_changed"]
    with pytest.raises(ValueError):
        FD.require_clean(FD.monthly_rejects(df(body(stat="error"))))


def test_list_feeds(spark):
    def rows(*objects):
        return FD.trimmed_rows(spark.createDataFrame([(json.dumps(list(objects), ensure_ascii=False),)], "payload string"))

    revenue = {"資料年月": "11508", "公司代號": "2330", "營業收入-去年當月營收": "0", "營業收入-去年同月增減(%)": "12", "營業收入-上月比較增減(%)": "--", "出表日期 ": "1150910"}
    got = FD.monthly_revenue(rows(revenue).filter("NOT collides")).first()
    assert (got["period"], got["yoy_pct"], got["mom_pct"], got["export_date"]) == ("2026-08", None, None, date(2026, 9, 10))
    news = {"公司代號": "2330", "發言日期": "1150910", "發言時間": "70105", "主旨": "x", "事實發生日": "1150910"}
    good, bad = FD.announcements(rows(news, {**news, "發言時間": "250000"})).collect()
    assert good["published_at"] == datetime(2026, 9, 9, 23, 1, 5) and good["time_status"] == "verified"
    assert bad["published_at"] is None and bad["time_status"] == "unverified"
    assert rows({"A": "1", "A ": "2"}).first()["collides"]
    twice = FD.dividend_actions(rows(*[{"Code": "2330", "Date": "1150910", "CashDividend": "1.5"}] * 2))
    assert [r["problem"] for r in FD.contract_violations(twice).collect()] == ["duplicate"]


CHIPS = [("7710", "晶河電"), ("7720", "遠山塑"), ("7730", "青石")]
CLOSE = CHIPS + [("7740", "光明"), ("7750", "光明海運"), ("7760", "東方")]
CASES = [
    ("晶河電和遠山塑今天都上漲", CHIPS, ["7710", "7720"]),  # long names need no context
    ("臺灣的青石很美", CHIPS, []),  # a two-character name without context
    ("法人連日買超青石", CHIPS, ["7730"]),
    ("排隊77105人，共7710元", CHIPS, []),  # digits around a code, or a unit after it
    ("持股：7710、7720", CHIPS, ["7710", "7720"]),
    ("ETF 配息 7710.5，7720張", CHIPS, []),
    ("見 /7710 與 $7720，股票", CHIPS, []),
    ("光明股價創高", CLOSE, ["7740"]),  # an everyday word with a word of finance after it
    ("[標的] 東方", CLOSE, ["7760"]),
    ("標的  ： 光明", CLOSE, ["7740"]),
    ("我看到一線光明，法人也往東方去", CLOSE, []),
    ("光明海運營收大增", CLOSE, ["7750"]),  # the longer name hides the one inside it
    ("法人說光明在前，7740 可買", CLOSE, ["7740"]),
    ("ＥＴＦ與７７３０", CHIPS, ["7730"]),  # full-width forms
    ("", CHIPS, []),
]


def entries(stocks):
    return [(s, n, n in AMBIGUOUS_NAMES) for s, n in stocks]


@pytest.mark.parametrize("text, stocks, want", CASES)
def test_mentions(text, stocks, want):
    assert MentionMatcher(entries(stocks)).identify(text) == want
    filler = [(f"9{i:04d}Z", f"公司{i:04d}") for i in range(300)]
    assert MentionMatcher(entries(stocks + filler)).identify(text) == want


def test_mentions_of_a_table_equal_one_matcher(spark):
    texts = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None)], "id int, text string")
    filler = [(f"9{i:04d}Z", f"公司{i:04d}") for i in range(2000)]
    names = spark.createDataFrame(CLOSE + filler, "symbol string, name string")
    one = MentionMatcher(entries(CLOSE))
    got = {r["id"]: list(r["symbols"]) for r in M.mentions(texts, names, "id", "text").collect()}
    assert got == {**{i: one.identify(c[0]) for i, c in enumerate(CASES)}, 99: []}
    hits = sorted((r["id"], r["name"]) for r in M.dictionary_hits(texts, names, "id", "text").collect())
    assert hits == sorted((i, n) for i, c in enumerate(CASES) for _, n in CLOSE if n in c[0])


def test_board_page_regions():
    page = "<p>a<div ID='main-content'>b &amp; <div>c<br></div><span class=\"push x\">no<span>no</span></span>d<!-- <b> --><style>e</style></div>f"
    assert article_parts(page) == ([], "b & cd")
    assert article_parts("<div id=main-content><script>if (a<b) '</div>'</script>x<span class=article-meta-value> t </span>") == (["t"], "x")
    assert article_parts(None) == ([], "") and article_parts("<div id=main-content>cut <spa") == ([], "cut <spa")


def test_trailing_windows_and_unavailable_sources(spark):
    now = datetime(2026, 9, 29, 12)
    post = lambda source, id, at, seq: (source, id, at, "t", ["2330"], seq)
    rows = [post("a", "1", now - timedelta(hours=1), 1), post("a", "1", now - timedelta(hours=1), 2), post("a", "2", now - timedelta(days=2), 3), post("a", "3", now + timedelta(hours=1), 4), post("b", "4", now, 5)]
    posts = spark.createDataFrame(rows, "source string, id string, published_at timestamp, title string, symbols array<string>, seq long")
    counts = {r["window"]: r for r in M.mention_counts(M.unique_posts(posts, ["a", "c"], F.lit(now)), ["a", "b", "c"], ["a", "c"], F.lit(now)).collect()}
    assert counts["24h"]["total"] == 1 and counts["7d"]["total"] == 2
    assert counts["7d"]["n_b"] is None and counts["7d"]["n_c"] == 0


def test_board_article(spark):
    html = (
        '<div id="main-content"><div class="article-metaline"><span class="article-meta-value">me</span></div><div class="article-metaline-right"><span class="article-meta-value">Stock</span></div>'
        '<div class="article-metaline"><span class="article-meta-value">[標的] 2330</span></div><div class="article-metaline"><span class="article-meta-value">Tue Sep 29 08:00:00 2026</span></div>\n'
        "own words\n> quoted\n: quoted too\n※ 引述 someone\n<script>x()</script>last\n※ 發信站: here\n<div class=\"push\">reply</div></div>"
    )
    got = web.articles(web.article_text(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id")).first()
    assert got["title"] == "[標的] 2330" and got["published_at"] == datetime(2026, 9, 29, 0, 0)
    assert [x for x in got["text"].split("\n") if x] == ["own words", "last"]
    index = '<a href="/bbs/Stock/M.1.A.html">x</a><a class="c" href="/bbs/Stock/M.2.B.html">y</a><a href="/bbs/Stock/M.1.A.html">x</a><a href="/bbs/Stock/index12.html">‹ 上頁</a>'
    links = web.index_links(spark.createDataFrame([(1, index)], "page_id int, html string")).first()
    assert [x[-8:] for x in links["links"]] == ["1.A.html", "2.B.html"] and links["previous"].endswith("index12.html")


def quote(symbol="2330", last=102.0, trial=False):
    at = datetime(2026, 11, 9, 9, 10, 5)
    return ("EQUITY", symbol, "n", 98.0, 102.0, last, 2.0, 100.0, 1e7, at, trial, datetime(2026, 11, 9, 9, 10, 10), 1)


def test_quotes(spark):
    schema = "type string, symbol string, name string, open_price double, close_price double, last_price double, change double, trade_volume double, trade_value double, updated_at timestamp, is_trial boolean, snapshot_at timestamp, seq long"
    sec = securities(spark, [("2330", "a", "stock", None, None, None), ("0050", "b", "etf", None, None, None)])
    now = F.lit(datetime(2026, 11, 9, 9, 10, 10))
    rows = {r["symbol"]: r for r in Q.normalized_quotes(spark.createDataFrame([quote(), quote("0050", 101.0, True), quote("9999")], schema), sec, now).collect()}
    assert set(rows) == {"2330", "0050"}
    assert (rows["2330"]["day_pct"], rows["2330"]["gap_pct"]) == (2.0, -2.0) and rows["0050"]["day_pct"] is None and rows["0050"]["price"] == 102


def test_exchange_quotes_and_states(spark):
    schema = "ex string, ch string, symbol string, name string, updated_at timestamp, z string, o string, y string, v string, seq long"
    sec = securities(spark, [("2330", "a", "stock", None, None, None), ("0050", "b", "etf", None, None, None)])
    now = F.lit(datetime(2026, 11, 10, 9, 10, 10))
    row = lambda s, z="102.00", at=datetime(2026, 11, 10, 9, 10, 5): ("tse", s + ".tw", s, "n", at, z, "98.00", "100.00", "999", 1)
    state = lambda *rows: Q.feed_state(Q.exchange_quotes(spark.createDataFrame(list(rows), schema), sec, now), sec, now).first()
    live = state(row("2330"), row("0050", "-"), row("9999"))
    assert (live["status"], live["coverage"], live["universe_count"]) == ("live", 1, 2)
    assert state(row("2330", at=datetime(2026, 11, 9, 13, 30)))["status"] == "stale"
    assert state(row("2330", at=datetime(2026, 11, 10, 9, 5)))["status"] == "stale"
    assert state(row("2330", z="-"))["status"] == "no_trades"


def test_publish_is_idempotent_and_never_goes_back(spark, tmp_path):
    rows = spark.createDataFrame([("2330", "stock", 7, 1.5), ("2317", "stock", 7, None)], "symbol string, kind string, horizon int, score double")
    manifest = spark.createDataFrame([], "snapshot_id string, as_of date, created_at timestamp, signature string")
    path = str(tmp_path / "out")
    go = lambda data, m, id, day: sinks.publish(data, m, path, id, F.lit(day), F.lit(datetime(2026, 10, 1, 20)))
    assert go(rows, manifest, "s1", date(2026, 10, 1))
    stored = spark.read.parquet(path + "/manifest")
    assert not go(rows.orderBy("symbol"), stored, "s2", date(2026, 10, 1))
    with pytest.raises(ValueError):
        go(rows.withColumn("score", F.lit(2.0)), stored, "s3", date(2026, 9, 30))
    assert go(rows.withColumn("score", F.lit(2.0)), stored, "s4", date(2026, 10, 2))
    assert {r["snapshot_id"] for r in spark.read.parquet(path + "/rows").select("snapshot_id").distinct().collect()} == {"s1", "s4"}


def test_exports_details_and_compaction(spark, tmp_path):
    schema = (
        "symbol string, horizon int, anchor_date date, target_date date, expected_return double, p_positive double, p_recovery double, "
        "q10 double, q90 double, n int, eligible boolean, reasons array<string>, score double"
    )
    day = date(2026, 10, 1)
    row = lambda s, v: (s, 7, day, day, v, v, v, v, v, 60, True, ["a", "b"], v)
    sec = securities(spark, [("A", "a", "stock", None, None, None), ("B", "b", "etf", None, None, None), ("C", "c", "stock", None, None, None), ("D", "d", "stock", None, None, None)])
    estimates = spark.createDataFrame([row("C", None), row("B", None), row("A", 1.0), row("D", 2.0)], schema)
    ranked = sinks.ranked_export(estimates, sec, 7, "p_positive").orderBy("position").collect()
    assert [(r["symbol"], r["position"]) for r in ranked] == [("D", 1), ("A", 2), ("B", 3), ("C", 4)] and ranked[0]["reasons"] == "a；b"
    with pytest.raises(ValueError):
        sinks.ranked_export(estimates, sec, 8, "score")
    out = str(tmp_path / "csv")
    sinks.write_exports(sinks.all_exports(estimates, sec), out, "s1")
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 16 and back.select("snapshot_id", "horizon", "metric").distinct().count() == 4
    snaps = [f"s{i}" for i in range(5)]
    manifest = spark.createDataFrame([(s, day, datetime(2026, 10, 1 + i), "x") for i, s in enumerate(snaps)], "snapshot_id string, as_of date, created_at timestamp, signature string")
    rows = spark.createDataFrame([(s, "A", "stock", 7, 1.5, "long") for s in snaps], "snapshot_id string, symbol string, kind string, horizon int, score double, samples string")
    path = str(tmp_path / "rows")
    rows.write.partitionBy("snapshot_id").parquet(path)
    sinks.compact_history(rows, manifest, path)
    kept = {r["snapshot_id"]: r["samples"] for r in spark.read.option("mergeSchema", True).parquet(path).collect()}
    assert kept == {"s0": None, "s1": None, "s2": "long", "s3": "long", "s4": "long"}


def test_stored_tables_conform_to_their_schema(spark):
    from tickloom.schemas import SCHEMAS, conform, schema

    for name in SCHEMAS:
        assert conform(spark.range(1), name).schema.simpleString() == schema(name).simpleString()


def test_capture_in_batches_equals_one_pass(spark, tmp_path):
    import random

    rng, start = random.Random(9), datetime(2026, 1, 1)
    rows = [("s", f"k{rng.randint(0, 3)}", "w", date(2026, 1, 1), float(rng.randint(0, 2)), start + timedelta(minutes=i), None, i) for i in range(120)]
    df = T.content_hashed(spark.createDataFrame(rows, ARRIVAL), "symbol", "key", "value")
    want = sorted(r["seq"] for r in T.changed_arrivals(df).collect())
    source = str(tmp_path / "in")
    for b in range(3):
        df.filter((F.col("seq") >= 40 * b) & (F.col("seq") < 40 * b + 40)).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, df.schema)
        jobs.capture_changes(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_sessions_that_land_in_parts_keep_all_rows(spark, tmp_path):
    schema = "symbol string, date date, close double"
    d = days(date(2026, 1, 1), 12)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, spark.createDataFrame([], schema).schema, files_per_trigger=1)
        jobs.incremental_bars(stream, out, check).awaitTermination()

    land([("A", x, 1.0) for x in d])
    land([("B", x, 2.0) for x in d] + [("A", d[0], 9.0), ("A", d[11], 9.0)])
    land([("C", d[0], 3.0), ("C", d[0], 3.5)])
    got = {(r["symbol"], r["date"]): r["close"] for r in spark.read.schema(schema).parquet(out).collect()}
    want = {("A", x): 1.0 for x in d} | {("B", x): 2.0 for x in d} | {("A", d[11]): 9.0, ("C", d[0]): 3.5}
    assert got == want


def test_only_recent_sessions_are_rewritten(spark, tmp_path):
    d = days(date(2026, 1, 1), 12)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def land(rows):
        bars, _ = frame(spark, rows)
        bars.drop("ord").coalesce(1).write.mode("append").parquet(source)
        jobs.incremental_bars(jobs.file_stream(spark, source, bars.drop("ord").schema), out, check).awaitTermination()

    land([bar(x) for x in d[:10]])
    land([bar(x, close=100.5) for x in d])
    closes = {r["date"]: r["close"] for r in spark.read.parquet(out).collect()}
    assert [closes[x] for x in d] == [100.0] * 7 + [100.5] * 5


def test_words_held_by_long_texts(spark):
    """Texts of 500,000 characters, names with a common head, short and folded names, repeated and null keys; time grows with the length."""
    import random
    import time

    rng = random.Random(3)
    names = [f"Brand#{k}" for k in range(300)] + ["a", "xy", "日本", "日本語の", "🎉x", ""]
    long = "".join(rng.choice(["Brand#", "q", "7", " ", "xy", "日本", "🎉"]) for _ in range(200_000))
    texts = [(1, "no name"), (2, "Brand#12 and xy"), (2, "日本語の🎉x"), (None, "Brand#299"), (3, None), (4, ""), (5, long[:500_000])]
    words = spark.createDataFrame([(n,) for n in names] * 2, "name string")
    got = {tuple(r) for r in M.held_words(spark.createDataFrame(texts, "k long, t string"), words, "k", "t", "name").collect()}
    assert got == {(k, n) for k, t in texts for n in names if n and t and n in t}
    seconds = []
    for size in (50_000, 500_000):
        start = time.perf_counter()
        for _ in range(3):
            M.gram_codes(long[:size], [1, 2, 3, 4])
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 60 * seconds[0]


def test_subject_mark_before_a_name():
    marked = [MentionMatcher.is_marked(t, len(t)) for t in ("[標的]", "x標的 : \n", "標的：", "[標的] ", "標的", "標的]", ":", "", "標 的:", "[標的")]
    assert marked == [True, True, True, True, False, False, False, False, False, False]


def test_versions_at_many_cutoffs_equal_one_by_one(spark):
    """Late publication, equal times, cut-offs before, between and after all versions, several on one day, and one twice."""
    import random
    rng, start = random.Random(8), datetime(2024, 1, 30)
    rows = []
    for seq in range(400):
        seen = start + timedelta(hours=rng.randrange(24 * 60))
        identity = rng.randrange(12)
        late = seen + timedelta(hours=rng.choice([0, 0, 0, 30, 500]))
        rows.append((f"s{identity % 3}", "x", f"k{identity}", (start + timedelta(days=identity * 4)).date(), seen, late, seq, seq * 10))
    table = spark.createDataFrame(rows, "source string, symbol string, key string, data_date date, first_seen_at timestamp, available_at timestamp, seq long, value long")
    cuts = [start - timedelta(days=9), *[start + timedelta(hours=rng.randrange(24 * 80)) for _ in range(12)], rows[5][5], start + timedelta(hours=5), start + timedelta(hours=7), start + timedelta(days=900)]
    manifest = [(f"n{k}", c, (c - timedelta(days=k % 5)).date()) for k, c in enumerate([*cuts, cuts[3]])] + [("none", None, None)]
    stored = spark.createDataFrame(manifest, "snapshot_id string, cutoff timestamp, as_of date")
    got = {(r.snapshot_id, r.source, r.key, r.value) for r in T.versions_at(table, stored).collect()}
    want = set()
    for name, cutoff, as_of in manifest[:-1]:
        best = {}
        for r in rows:
            if r[5] <= cutoff and r[3] <= as_of and (r[4], r[6]) >= best.get((r[0], r[2]), ((datetime.min, 0), 0))[0]:
                best[r[0], r[2]] = ((r[4], r[6]), r[7])
        want |= {(name, *identity, value) for identity, (_, value) in best.items()}
    assert got == want and len(want) > 60
    assert T.versions_at(table, stored.filter("snapshot_id = 'none'")).count() == 0 == T.versions_at(table.limit(0), stored).count()


def few_and_many(spark, monkeypatch, run):
    """Results of the lookup where the text is and of the join for larger dictionaries; the first has no join in its plan."""
    few = run()
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(M, "FEW", 0)
    many = run()
    assert "Join" in many._jdf.queryExecution().optimizedPlan().toString()
    return [sorted(tuple(map(str, r)) for r in rows.collect()) for rows in (few, many)]


FEW_TEXTS = [(1, "banana bananas 𝒳bananas anana ab abab"), (2, None), (3, ""), (4, "營收 1101 台泥 臺泥股價 aaaaaaa"), (5, "x" * 5000 + "banana"), (6, "12345 banana 1101")]


def test_few_mentions_need_no_join(spark, monkeypatch):
    texts = spark.createDataFrame(FEW_TEXTS, "id long, text string")
    names = spark.createDataFrame([("1101", "臺泥"), ("9", "banana"), ("8", "bananas"), ("7", "aaa"), ("6", "aaa"), ("5", None)], "symbol string, name string")
    few, many = few_and_many(spark, monkeypatch, lambda: M.mentions(texts, names, "id", "text").select("id", "symbols"))
    assert few == many and ("4", "['1101', '6', '7']") in few


def test_few_dictionary_hits_need_no_join(spark, monkeypatch):
    texts = spark.createDataFrame([*FEW_TEXTS, (1, "anana banana"), (None, "abab")], "id long, text string")
    names = spark.createDataFrame([(n,) for n in ("banana", "anana", "abab", "a", "台", "")], "name string")
    few, many = few_and_many(spark, monkeypatch, lambda: M.dictionary_hits(texts, names, "id", "text"))
    assert few == many and ("None", "abab") in few and few.count(("1", "anana")) == 1
