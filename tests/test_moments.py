"""Running sums over matured outcomes against the pairs they stand for."""

from __future__ import annotations

import random
from datetime import date, timedelta
from statistics import pstdev

import pytest
from pyspark.sql import functions as F

from tickloom.operators import analogue as A
from tickloom.operators import validation as V

COLUMNS = ("symbol", "horizon", "date", "ord", "exit_date", "has_features", "has_outcome", "return_pct", *A.VECTOR)
SCHEMA = "symbol string, horizon int, date date, ord long, exit_date date, has_features boolean, has_outcome boolean, return_pct double, " + ", ".join(f"{v} double" for v in A.VECTOR)


def made(seed: int, bars: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for symbol, horizon, step in (("A", 5, 7), ("A", 20, 7), ("B", 5, 1)):
        for k in range(bars):
            day = date(2015, 1, 5) + timedelta(days=k * step)
            featured, ended = rng.random() < 0.8, k + horizon < bars
            vector = [rng.gauss(mean, spread) for mean, spread in ((0.0, 0.02), (0.1, 0.05), (3.0, 0.1), (0.0, 0.0), (40.0, 2.0), (-0.01, 0.001))]
            rows.append((symbol, horizon, day, k, day + timedelta(days=horizon * step) if ended else None, featured, ended, rng.gauss(0, 3) if ended else None, *(vector if featured else [None] * 6)))
    return rows


def pairs(rows, anchor, featured):
    return [r for r in rows if r[:2] == anchor[:2] and r[6] and (r[5] or not featured) and r[4] <= anchor[2] and r[3] < anchor[3]]


@pytest.mark.parametrize("days", [10, 512])
def test_scales_and_baselines_equal_those_of_pairs(spark, monkeypatch, days):
    monkeypatch.setattr(A.matured_sums, "__defaults__", (days,))
    rows = made(days, 90)
    research = spark.createDataFrame(rows, SCHEMA)
    anchors = research.filter(F.col("ord") % 4 == 1)
    scales = {(r.symbol, r.horizon, r.anchor_date): r for r in A.anchor_scales(anchors, research).collect()}
    rates = {(r.symbol, r.horizon, r.anchor_date): r.baseline for r in V.matured_baseline(anchors, research).collect()}
    wanted = [r for r in rows if r[3] % 4 == 1]
    for anchor in wanted:
        known = pairs(rows, anchor, True)
        got = scales.pop(anchor[:3], None)
        assert (got is not None) == bool(known and anchor[5])
        if got is not None:
            assert got.candidates == len(known)
            for k, (v, floor) in enumerate(zip(A.VECTOR, A.SCALE_FLOORS)):
                assert got["s_" + v] == pytest.approx(max(pstdev([r[8 + k] for r in known]), floor), rel=1e-9)
        known = pairs(rows, anchor, False)
        assert rates.pop(anchor[:3], None) == (sum(r[7] > 0 for r in known) / len(known) if known else None)
    assert not scales and not rates


def test_no_outcomes_and_plan_without_pairs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(made(1, 12), SCHEMA)
    assert A.anchor_scales(some, empty).count() == V.matured_baseline(some, empty).count() == A.anchor_scales(empty, some).count() == 0
    # An anchor that is asked for twice is one row.
    assert V.matured_baseline(some.union(some), some).count() == V.matured_baseline(some, some).count()
    plan = V.matured_baseline(some, some)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1
