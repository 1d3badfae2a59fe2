"""Prediction audit, backfill plans, ten-session reconciliation and the fixed-weight experiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import magnitude_bucket
from tickloom.functions.scalars import HORIZONS, canonical_hash
from tickloom.operators.outcomes import TEN, TEN_SESSION_VERSION
from tickloom.operators.ranking import top_k

PREDICTION = ("snapshot_id", "symbol", "horizon")
# Percentile weights of the experiment, in the order baseline rank, institution ratio, revenue growth.
WEIGHTS = (0.7, 0.2, 0.1)


def reconciled(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Matured predictions beside their outcome: equi-join on (symbol, signal date, horizon)."""
    return predictions.withColumnRenamed("as_of", "signal_date").join(outcomes, ["symbol", "signal_date", "horizon"])


def pending(predictions: DataFrame, done: DataFrame, bars: DataFrame) -> DataFrame:
    """Predictions without an outcome: the signal bar itself is missing, or the window is not mature / comparable."""
    known = bars.select("symbol", F.col("date").alias("as_of"), F.lit(True).alias("_bar"))
    return (
        predictions.join(done.select(*PREDICTION), list(PREDICTION), "left_anti")
        .join(known, ["symbol", "as_of"], "left")
        .select(*PREDICTION, "as_of", F.when(F.col("_bar").isNull(), "missing_history").otherwise("not_mature_or_not_comparable").alias("reason"))
    )


def calculation_hash(columns: Sequence[str]) -> Column:
    return canonical_hash(*(F.col(c) for c in columns))


def revision_rows(stored: DataFrame, fresh: DataFrame, last_bars: DataFrame, calculated_at: Column) -> DataFrame:
    """New versions to append to the audit.

    ``stored`` holds the current version per prediction (calculation_hash, exit_date, ...), ``fresh`` the outcomes
    computed now with their input hash, ``last_bars`` the last bar date per symbol. Same hash: nothing. Changed hash:
    a new version. Outcome gone although bars reach the stored exit: a ``not_comparable`` version.
    """
    held = stored.select(*PREDICTION, F.col("calculation_hash").alias("_hash"), F.col("version").alias("_version"))
    changed = (
        fresh.join(held, list(PREDICTION), "left")
        .filter(F.col("_hash").isNull() | (F.col("_hash") != F.col("calculation_hash")))
        .withColumns({"outcome_status": F.lit("computed"), "version": F.coalesce(F.col("_version"), F.lit(0)) + 1})
        .drop("_hash", "_version")
    )
    gone = (
        stored.filter("outcome_status = 'computed'")
        .join(fresh.select(*PREDICTION), list(PREDICTION), "left_anti")
        .join(last_bars, "symbol")
        .filter(F.col("last_date") >= F.col("exit_date"))
        .drop("last_date")
        .withColumns(
            {
                "outcome_status": F.lit("not_comparable"),
                "version": F.col("version") + 1,
                "return_pct": F.lit(None).cast("double"),
                "calculation_hash": F.sha2(F.concat_ws("|", "calculation_hash", F.lit("not_comparable")), 256),
            }
        )
    )
    return changed.unionByName(gone.select(*changed.columns), allowMissingColumns=True).withColumn("calculated_at", calculated_at)


def current_versions(versions: DataFrame) -> DataFrame:
    row = F.struct(*[F.col(c) for c in versions.columns if c not in PREDICTION])
    return versions.groupBy(*PREDICTION).agg(F.max_by(row, "version").alias("_v")).select(*PREDICTION, "_v.*")


def backfill_plan(predictions: DataFrame, done: DataFrame, coverage: DataFrame, cutoff: Column, days: int = 70) -> DataFrame:
    """(symbol, month) still needed to judge past predictions; ``coverage`` has first and last bar date per symbol."""
    horizons = done.groupBy("snapshot_id", "symbol").agg(F.count_distinct("horizon").alias("_h"))
    past = predictions.select("snapshot_id", "symbol", "as_of").distinct().filter(F.col("as_of") < cutoff)
    end = F.least(cutoff, F.date_add("as_of", days))
    open_ = (
        past.join(horizons, ["snapshot_id", "symbol"], "left")
        .filter(F.coalesce(F.col("_h"), F.lit(0)) < len(HORIZONS))
        .join(coverage, "symbol", "left")
        .withColumn("_end", end)
    )
    covered = (F.col("first_date") <= F.col("as_of")) & (F.col("last_date") >= F.col("_end"))
    months = F.sequence(F.trunc("as_of", "month"), F.trunc("_end", "month"), F.expr("interval 1 month"))
    return open_.filter(~F.coalesce(covered, F.lit(False))).select("symbol", F.explode(months).alias("month")).distinct()


def merge_missing(primary: DataFrame, supplement: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Supplement rows only fill keys the primary table lacks."""
    extra = supplement.join(primary.select(*keys), list(keys), "left_anti")
    return primary.unionByName(extra.select(*primary.columns))


def ten_session_reconcile(candidates: DataFrame, existing: DataFrame, outcomes: DataFrame, version: str = TEN_SESSION_VERSION) -> DataFrame:
    """Rows of the current method stay as stored; other candidates get today's outcome unless it is still pending."""
    kept = existing.filter(F.col("method_version") == version)
    fresh = (
        candidates.join(kept.select("snapshot_id", "symbol"), ["snapshot_id", "symbol"], "left_anti")
        .join(outcomes.drop("kind", "etf_style"), ["symbol", "signal_date"])
        .filter("status <> 'pending'")
        .withColumn("method_version", F.lit(version))
    )
    return kept.unionByName(fresh.select(*kept.columns))


def retain_prior(tracking: DataFrame, prior: DataFrame, gap_word: str = "缺") -> DataFrame:
    """A completed result survives when its bars have since vanished; its elapsed sessions are still updated."""
    columns = ("status", "reason", "net_return_pct", "target_filled", "touched", "exit_date", "exit_price")
    held = prior.filter("status <> 'pending'").select("signal_date", "symbol", *[F.col(c).alias("_p_" + c) for c in columns])
    joined = tracking.join(held, ["signal_date", "symbol"], "left")
    keep = F.coalesce(
        (F.col("status") == "not_comparable") & F.contains("reason", F.lit(gap_word)) & F.col("_p_status").isNotNull(), F.lit(False)
    )
    values = {c: F.when(keep, F.col("_p_" + c)).otherwise(F.col(c)) for c in columns}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in tracking.columns], keep.alias("retained"))


def input_fingerprint(tracking: DataFrame) -> DataFrame:
    """sha256 over the inputs of each simulated trade."""
    return tracking.withColumn("input_sha256", canonical_hash("policy_version", "kind", "signal_date", "held_bars"))


def value_percentiles(rows: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    """Percentile of each distinct value of a group, ties sharing their mean position; a lone row is 1.

    Works on distinct values: counts per value are combined first, and the running count inside a value range is added
    to a histogram of ranges, so a hot group is never sorted in one task.
    """
    counted = rows.groupBy(*groups, F.col(value).alias("_x")).agg(F.count("*").alias("_t"))
    keyed = counted.withColumn("_b", magnitude_bucket(F.col("_x").cast("double")))
    ranges = keyed.groupBy(*groups, "_b").agg(F.sum("_t").alias("_n"))
    group = Window.partitionBy(*groups)
    offsets = ranges.select(
        *groups,
        "_b",
        F.coalesce(F.sum("_n").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(group).alias("_all"),
    )
    inside = Window.partitionBy(*groups, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_off") + F.coalesce(F.sum("_t").over(inside), F.lit(0))
    share = F.when(F.col("_all") == 1, 1.0).otherwise(F.try_divide(2 * below + F.col("_t") - 1, 2 * (F.col("_all") - 1)))
    return keyed.join(offsets, [*groups, "_b"]).select(*groups, F.col("_x").alias(value), share.alias(out))


def midpoint_percentile(rows: DataFrame, groups: Sequence[str], value: str, out: str) -> DataFrame:
    return rows.join(value_percentiles(rows, groups, value, out), [*groups, value])


def experiment_scores(rows: DataFrame, day: str = "signal_date") -> DataFrame:
    """Fixed-weight score of the eligible candidates of each signal day."""
    eligible = rows.filter("eligible").withColumn("_neg_rank", -F.col("rank"))
    rated = eligible
    for value, out in (("_neg_rank", "_p_rank"), ("institution_ratio_5", "_p_inst"), ("revenue_yoy_pct", "_p_rev")):
        rated = rated.join(value_percentiles(eligible, [day], value, out), [day, value])
    score = WEIGHTS[0] * F.col("_p_rank") + WEIGHTS[1] * F.col("_p_inst") + WEIGHTS[2] * F.col("_p_rev")
    return rated.withColumn("shadow_score", F.round(score, 9)).drop("_neg_rank", "_p_rank", "_p_inst", "_p_rev")


def select_cohorts(rows: DataFrame, top: int = 10, day: str = "signal_date") -> DataFrame:
    """Baseline (by rank) and shadow (by score) top lists of the same eligible candidates; one row per (day, arm, symbol).

    Both arms offer every row once and share one per-partition top-k: the sort key of an arm is its own.
    """
    by_rank = F.struct(F.lit("baseline").alias("arm"), F.lit(0.0).alias("_key"))
    by_score = F.struct(F.lit("shadow").alias("arm"), (-F.col("shadow_score")).alias("_key"))
    offered = experiment_scores(rows, day).select("*", F.inline(F.array(by_rank, by_score)))
    return top_k(offered, [day, "arm"], [F.col("_key"), F.col("rank"), F.col("symbol")], top, "arm_rank").drop("_key")


def archive_features(existing: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("definition_sha256", "snapshot_id")) -> DataFrame:
    """Write-once archive: snapshots already archived under the same definition are left alone."""
    return fresh.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def actions_in_window(cohorts: DataFrame, actions: DataFrame, sessions: DataFrame, count: int = TEN) -> DataFrame:
    """Corporate actions that fall between the first and the ``count``-th session after the signal.

    The window's bounds come from the calendar; the join is an equi-join on symbol with a residual date range.
    """
    ords = sessions.select("ord", "date")
    first = ords.select((F.col("ord") - 1).alias("ord"), F.col("date").alias("_from"))
    last = ords.select((F.col("ord") - count).alias("ord"), F.col("date").alias("_to"))
    bounds = ords.join(first, "ord").join(last, "ord").select(F.col("date").alias("signal_date"), "_from", "_to")
    wanted = cohorts.select("signal_date", "symbol").distinct().join(F.broadcast(bounds), "signal_date")
    dated = actions.select("symbol", "data_date")
    return wanted.join(dated, "symbol").filter("data_date BETWEEN _from AND _to").select("signal_date", "symbol", "data_date")


def experiment_days(
    snapshots: DataFrame, rows: DataFrame, cohorts: DataFrame, tracking: DataFrame, actions: DataFrame, sessions: DataFrame, frozen_at: Column
) -> DataFrame:
    """Classify every signal day; the first state that applies wins, and only comparable days carry a difference.

    ``snapshots``: signal_date, snapshot_id, created_at, has_universe. ``rows``: signal candidates with eligible.
    """
    w = Window.orderBy("ord")
    calendar = sessions.select(
        F.col("date").alias("signal_date"),
        F.lead("date").over(w).alias("_next"),
        (F.max("ord").over(Window.partitionBy()) - F.col("ord")).alias("_left"),
    )
    counts = rows.groupBy("signal_date").agg(F.count("*").alias("candidate_count"), F.count_if("eligible").alias("eligible_count"))
    trades = cohorts.select("signal_date", "symbol", "arm").join(
        tracking.select("signal_date", "symbol", "status", "net_return_pct"), ["signal_date", "symbol"], "left"
    )
    arm = lambda name: F.avg(F.when(F.col("arm") == name, F.col("net_return_pct")))
    results = trades.groupBy("signal_date").agg(
        F.bool_or(F.coalesce(F.col("status") == "pending", F.lit(False))).alias("_pending"),
        F.bool_or(F.coalesce(F.col("status") != "evaluated", F.lit(True))).alias("_broken"),
        arm("baseline").alias("baseline_return_pct"),
        arm("shadow").alias("shadow_return_pct"),
    )
    acted = actions_in_window(cohorts, actions, sessions).groupBy("signal_date").agg(F.count("*").alias("_actions"))
    days = (
        snapshots.join(F.broadcast(calendar), "signal_date", "left")
        .join(counts, "signal_date", "left")
        .join(results, "signal_date", "left")
        .join(acted, "signal_date", "left")
    )
    opening = F.to_timestamp(F.col("_next")) + F.expr("interval 9 hours")
    status = (
        F.when(F.col("created_at") >= opening, "late_entry")
        .when(frozen_at.isNull() | (F.col("created_at") < frozen_at), "before_definition")
        .when(~F.col("has_universe"), "missing_universe")
        .when(F.coalesce(F.col("eligible_count"), F.lit(0)) == 0, "insufficient_features")
        .when((F.coalesce(F.col("_left"), F.lit(0)) < TEN) | F.col("_pending"), "pending")
        .when(F.col("_broken"), "not_comparable")
        .when(F.coalesce(F.col("_actions"), F.lit(0)) > 0, "corporate_action")
        .otherwise("comparable")
    )
    done = F.col("status") == "comparable"
    return days.withColumn("status", status).select(
        "signal_date",
        "snapshot_id",
        "status",
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.coalesce("eligible_count", F.lit(0)).alias("eligible_count"),
        F.when(done, F.col("baseline_return_pct")).alias("baseline_return_pct"),
        F.when(done, F.col("shadow_return_pct")).alias("shadow_return_pct"),
        F.when(done, F.col("shadow_return_pct") - F.col("baseline_return_pct")).alias("difference_pct"),
    )


def exclusion_histogram(days: DataFrame) -> DataFrame:
    return days.groupBy("status").agg(F.count("*").alias("days"))
