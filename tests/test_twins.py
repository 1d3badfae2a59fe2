"""Queries against their SQL on small tables that the driver's smallest scales don't have: long ids, equal sums, prices of zero."""

from datetime import datetime, timedelta

import duckdb
import pytest
from compare import compare

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
START = datetime(2024, 1, 1, 9, 30)


def same(spark, tmp_path, name, rows):
    """Compare on a folder with these events (user, type, value, day, minute) only."""
    listed = [(i, START + timedelta(days=day, minutes=minute), user, kind, float(value), "{}") for i, (user, kind, value, day, minute) in enumerate(rows)]
    df = spark.createDataFrame(listed, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    assert compare(found, con, ORACLES[name]) is None
    return found


LONG_IDS = [(user, kind, 10 + user % 7, day, user % 50) for user in (3, 1000, 1001, 10000, 10500, 90007) for kind in ("purchase", "view") for day in range(8)]


@pytest.mark.parametrize("name", ("a11_institution_feed", "a11_rejects", "a12_rejects"))
def test_ids_of_five_digits(spark, tmp_path, name):
    same(spark, tmp_path, name, LONG_IDS)


def test_equal_sums_part_by_symbol(spark, tmp_path):
    """The same cents in several orders: sums differ in their last bits, and one net of opposite amounts is zero or nearly so."""
    cents = (0.1, 0.2, 0.3, 55.35, 1e3, 0.7)
    rows = [(user, kind, v, 4, k) for user in range(40) for kind, turn in (("purchase", user), ("view", 3 * user + 1)) for k, v in enumerate(cents[turn % 6 :] + cents[: turn % 6])]
    found = same(spark, tmp_path, "r6_institution_lists", [*rows, (1, "click", 1, 7, 0)])
    buys = sorted((r["position"], r["symbol"], r["value"]) for r in found.filter("grp = 'foreign' AND metric = 'buy'").collect())
    assert len({v for *_, v in buys}) == 1 and [s for _, s, _ in buys] == sorted(str(u) for u in range(40))


# The newest quote of every third user, and the only one of user 5, has the price zero, which is no price.
ZEROS = [(user, "view", 0 if user == 5 or (minute == 9 and user % 3 == 0) else 10 + user, day, minute) for user in range(12) for day in (0, 1) for minute in ((9,) if user == 5 else (3, 9))]


@pytest.mark.parametrize("name", ("s2_latest_quote", "s3_exchange_quotes", "s5_feed_state"))
def test_a_price_of_zero_is_none(spark, tmp_path, name):
    same(spark, tmp_path, name, [*ZEROS, (11, "purchase", 21, 1, 10)])
