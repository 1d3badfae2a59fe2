"""Performance of simulated trades: equal weight inside a signal day, then equal weight across days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.clean import security_group
from tickloom.operators.outcomes import POLICY_VERSION
from tickloom.operators.ranking import top_k

STATUSES = ("evaluated", "pending", "not_filled", "not_comparable")


def status_counts(records: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Counts of the four states; an absent state counts 0."""
    return records.groupBy(*groups).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def maturity_counts(records: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    mature = F.coalesce(F.col("elapsed_sessions"), F.lit(10)) >= 10
    return records.groupBy(*groups).agg(
        F.count_distinct(F.when(mature, F.col("signal_date"))).alias("mature_signal_dates"),
        F.count_distinct(F.when(comparable(), F.col("signal_date"))).alias("comparable_signal_dates"),
    )


def comparable() -> Column:
    return (F.col("status") == "evaluated") & F.col("net_return_pct").isNotNull()


def daily_performance(records: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """One row per (group, day). A day's trades are bounded by the listed securities."""
    filled = F.coalesce(F.col("target_filled"), F.lit(False)).cast("double")
    value = F.col("net_return_pct")
    return records.filter(comparable()).groupBy(*groups, "signal_date").agg(
        F.count("*").alias("trades"),
        F.avg(value).alias("daily_mean"),
        F.median(value).alias("daily_median"),
        F.avg(filled).alias("daily_fill"),
        F.sum(F.when(value > 0, value)).alias("_gain"),
        F.sum(F.when(value < 0, value)).alias("_loss"),
        F.count_if(value > 0).alias("_wins"),
        F.count_if(value < 0).alias("_losses"),
    )


def day_weighted_summary(records: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Day-equal-weight summary per group; undefined ratios stay NULL.

    A trade weighs 1/(trades of its day). The five largest weighted gains per group come from a per-partition top-k.
    """
    days = daily_performance(records, groups)
    weight = 1 / F.col("trades")
    gains, losses = F.sum(F.col("_gain") * weight), -F.sum(F.col("_loss") * weight)
    summary = days.groupBy(*groups).agg(
        F.count("*").alias("comparable_signal_dates"),
        F.avg("daily_mean").alias("mean_net_return_pct"),
        F.median("daily_median").alias("median_net_return_pct"),
        F.avg("daily_fill").alias("target_fill_rate"),
        F.try_divide(gains, F.sum(F.col("_wins") * weight)).alias("average_gain_pct"),
        F.try_divide(-losses, F.sum(F.col("_losses") * weight)).alias("average_loss_pct"),
        F.try_divide(F.coalesce(gains, F.lit(0.0)), losses).alias("profit_factor"),
        gains.alias("_gains"),
    )
    weighted = (
        records.filter(comparable() & (F.col("net_return_pct") > 0))
        .join(days.select(*groups, "signal_date", "trades"), [*groups, "signal_date"])
        .withColumn("_w", F.col("net_return_pct") / F.col("trades"))
    )
    top = top_k(weighted, groups, [F.desc("_w")], 5, "_rk").groupBy(*groups).agg(F.sum("_w").alias("_top5"))
    if groups:
        joined = summary.join(top, list(groups), "left")
    else:
        both = summary.unionByName(top, allowMissingColumns=True)
        joined = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return joined.withColumn("top5_gain_share", F.try_divide(F.col("_top5"), F.col("_gains"))).drop("_gains", "_top5")


def cohort_records(records: DataFrame, policy: str = POLICY_VERSION) -> DataFrame:
    """Each record of the current policy in its group, once for the baseline and once more if it ranked 1-10."""
    cohorts = F.array_compact(F.array(F.lit("baseline"), F.when(F.col("rank").between(1, 10), F.lit("top10"))))
    return records.filter(F.coalesce(F.col("policy_version"), F.lit(policy)) == policy).select(
        "*", security_group().alias("group"), F.explode(cohorts).alias("cohort")
    )


def cohort_report(records: DataFrame) -> DataFrame:
    """Summary, states and maturity per (group, cohort)."""
    keyed = cohort_records(records)
    keys = ["group", "cohort"]
    return (
        status_counts(keyed, keys)
        .join(maturity_counts(keyed, keys).drop("comparable_signal_dates"), keys)
        .join(day_weighted_summary(keyed, keys), keys, "left")
    )


def paired_difference(records: DataFrame) -> DataFrame:
    """Mean difference of top-10 and baseline daily means over the days both have."""
    days = daily_performance(cohort_records(records), ["group", "cohort"])
    side = lambda name, out: days.filter(F.col("cohort") == name).select("group", "signal_date", F.col("daily_mean").alias(out))
    return (
        side("top10", "_top")
        .join(side("baseline", "_base"), ["group", "signal_date"])
        .groupBy("group")
        .agg(F.count("*").alias("paired_dates"), F.avg(F.col("_top") - F.col("_base")).alias("paired_difference_pct"))
    )
