"""Exports, retention and publication as runs: each query releases to a folder of its own and returns what a reader finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans.models import _B2, day_estimates, manifest, snapshot_predictions
from tickloom.plans.oracle import oracle, rlist, rnd
from tickloom.plans.registry import ORACLES, Market, query, rounded, text
from tickloom.plans.streams import folder
from tickloom.sources import releases as X
from tickloom.sources.sinks import all_exports, ranked_export

_RATES = ("expected_return", "p_positive", "p_recovery", "q10", "q90")


def day(later: int = 0):
    return F.date_add(F.to_date(F.lit("2026-01-02")), later)


def at(hour: int):
    return F.to_timestamp(F.lit(f"2026-01-02 {hour:02d}:00:00"))


@query("b1_released_export", "select *, 2 as releases from (" + ORACLES["b1_ranked_export"] + ") b1")
def b1_released(m: Market):
    """The CSV of one horizon and metric: a draft, the final export that replaces it, and the final one again."""
    path = folder(m, "export")
    final = ranked_export(day_estimates(m), m.securities, 7, "p_recovery").drop("metric")
    draft = ranked_export(day_estimates(m).withColumn("p_recovery", 1 - F.col("p_recovery")), m.securities, 7, "p_recovery").drop("metric")
    for hour, rows in ((8, draft), (9, final), (10, final)):
        X.release(rows, path, "day", day(), at(hour), "csv", order=["position"])
    found = X.released(m.spark, path, final.schema, "csv").drop("snapshot_id")
    typed = rounded(found, *_RATES).withColumns({"as_of": text("as_of"), "target_date": text("target_date"), "horizon": F.col("horizon").cast("int"), "n": F.col("n").cast("long"), "reasons": F.coalesce("reasons", F.lit(""))})
    return typed.withColumn("releases", F.lit(X.history(m.spark, path).count()).cast("long"))


_EXPORTED = " union all ".join(
    f"select '{s}' as snapshot_id, horizon, '{c}' as metric, symbol, {rnd(c, 6, 'value')}, row_number() over (partition by horizon order by {c} desc nulls last, symbol) as position from day_est where {which}"
    for s, which in (("first", "horizon <= 20"), ("second", "true"))
    for c in _B2
)


@query("b2_released_exports", oracle(_EXPORTED, "day_est"))
def b2_released(m: Market):
    """All CSV exports of two snapshots; the first is released again with fewer horizons, whose old files nobody meets."""
    path = folder(m, "exports")
    rows = all_exports(day_estimates(m), m.securities).select("horizon", "metric", "symbol", "value", "position")
    for hour, name, some in ((8, "first", rows), (9, "second", rows), (10, "first", rows.filter("horizon <= 20"))):
        X.release(some.withColumn("snapshot", F.lit(name)), path, name, day(), at(hour), "csv", ["horizon", "metric"], ["position"])
    found = X.released(m.spark, path, rows.schema, "csv")
    return found.select("snapshot_id", "horizon", "metric", "symbol", F.round("value", 6).alias("value"), "position")


@query(
    "b5_history_after_retention",
    oracle(
        "select p.snapshot_id, p.symbol, p.horizon, " + rnd("p.predicted", 6, "expected_return") + ", case when r <= 3 then cast(p.as_of as varchar) end as evidence, r > 3 and m.snapshot_id is not null as compacted from preds p "
        "join (select snapshot_id, row_number() over (order by created_at desc, snapshot_id desc) as r from manifest) m on m.snapshot_id = p.snapshot_id",
        "preds", "manifest",
    ),
)
def b5_retained(m: Market):
    """The whole history is released, then retained twice: old snapshots keep their forecasts and lose their evidence."""
    path = folder(m, "history")
    rows = snapshot_predictions(m).select("snapshot_id", "symbol", "horizon", F.col("predicted").alias("expected_return"), text("as_of").alias("evidence"))
    X.release_history(rows, manifest(m), path)
    schema = rows.drop("snapshot_id").schema
    for _ in range(2):
        X.retain(m.spark, path, schema)
    X.sweep(m.spark, path)
    whole = X.releases(m.spark, path).select("snapshot_id", (~F.col("whole")).alias("compacted"))
    found = X.released(m.spark, path, schema).join(F.broadcast(whole), "snapshot_id")
    return found.withColumn("expected_return", F.round("expected_return", 6))


_STEP = "select {0} as step, '{1}' as decision, '{2}' as snapshot_id, count(*) as rows, {3} from preds"


@query(
    "b6_release_decisions",
    oracle(
        " union all ".join(
            _STEP.format(step, decision, held, rnd(f"sum(predicted + {shift})", 3, "total"))
            for step, decision, held, shift in ((1, "published", "one", "0"), (2, "unchanged", "one", "0"), (3, "older", "one", "0"), (4, "published", "three", "case when horizon = 7 then 1 else 0 end"))
        ),
        "preds",
    ),
)
def b6_decisions(m: Market):
    """Publications of all predictions: new, equal in another order, of an earlier date, and corrected. Each step with what a
    reader finds as the newest snapshot after it."""
    path = folder(m, "publish")
    rows = snapshot_predictions(m).withColumnRenamed("snapshot_id", "source")
    shifted = rows.withColumn("predicted", F.col("predicted") + F.when(F.col("horizon") == 7, 1.0).otherwise(0.0))
    steps = (
        ("one", rows, day(), 8),
        ("again", rows.repartition("symbol").sortWithinPartitions(F.desc("as_of")), day(), 9),
        ("two", shifted, day(-1), 10),
        ("three", shifted, day(1), 11),
    )
    out = None
    for step, (name, some, when, hour) in enumerate(steps, 1):
        decision = X.release(some, path, name, when, at(hour))
        newest = X.releases(m.spark, path).agg(F.max_by("snapshot_id", "number")).first()[0]
        held = X.released(m.spark, path, rows.schema).filter(F.col("snapshot_id") == newest)
        total = F.round(F.sum("predicted").cast("decimal(30,12)"), 3).cast("double")
        found = held.groupBy("snapshot_id").agg(F.count("*").alias("rows"), total.alias("total")).select(
            F.lit(step).alias("step"), F.lit(decision).alias("decision"), "snapshot_id", "rows", "total"
        )
        out = found if out is None else out.unionByName(found)
    return out
