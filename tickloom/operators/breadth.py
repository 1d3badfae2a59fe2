"""Market breadth at one session: nullable per-stock metrics, coverage, market totals and the industry table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import dimension_join, group_median
from tickloom.functions.scalars import adjusted, non_negative

# The industry of stocks without one, and the coverage names of the metrics.
NO_INDUSTRY = "未記錄"
COVERAGE = (
    ("daily_return", "daily"),
    ("ma20", "ma20"),
    ("turnover", "turnover"),
    ("momentum20", "momentum20"),
    ("turnover_ratio_20", "previous_turnover"),
)
FLAT = 1e-9


def recent_sessions(bars: DataFrame, sessions: DataFrame, as_of: Column, count: int) -> DataFrame:
    """Bars of the last ``count`` sessions up to as_of with their distance ``back`` (0 = as_of).

    The sessions are a handful of rows; their dates prune the bars' scan through the broadcast join.
    """
    known = sessions.filter(F.col("date") <= as_of).select("date")
    days = known.select("date", (F.row_number().over(Window.orderBy(F.desc("date"))) - 1).alias("back")).filter(F.col("back") < count)
    return bars.join(F.broadcast(days), "date")


def stock_metrics(
    securities: DataFrame, bars: DataFrame, sessions: DataFrame, as_of: Column, candidates: DataFrame | None = None
) -> DataFrame:
    """One row per stock; every metric is NULL on its own terms. One combinable aggregate over 21 sessions of bars."""
    frame = recent_sessions(bars, sessions, as_of, 21).withColumns({"_adj": adjusted(), "_turn": non_negative("turnover")})
    at = lambda k, c: F.max(F.when(F.col("back") == k, F.col(c)))

    def whole(n: int) -> Column:
        inside = F.col("back") < n
        return (F.count_if(inside) == n) & (F.count_if(inside & F.col("valid")) == n) & (F.count_if((F.col("back") < n - 1) & F.col("_adj")) == 0)

    prior = (F.col("back") >= 1) & (F.col("back") <= 20)
    per_symbol = frame.groupBy("symbol").agg(
        F.bool_or((F.col("back") == 0) & F.col("valid")).alias("_now"),
        whole(2).alias("_pair"),
        (whole(20) & (F.count_if((F.col("back") == 19) & F.col("_adj")) == 0)).alias("_twenty"),
        whole(21).alias("_history"),
        at(0, "close").alias("_c0"),
        at(1, "close").alias("_c1"),
        at(20, "close").alias("_c20"),
        F.avg(F.when(F.col("back") < 20, F.col("close"))).alias("_mean20"),
        at(0, "_turn").alias("_t0"),
        F.count_if(prior & F.col("_turn").isNotNull()).alias("_tn"),
        F.avg(F.when(prior, F.col("_turn"))).alias("_tmean"),
    )
    now = F.coalesce(F.col("_now"), F.lit(False))
    metrics = per_symbol.select(
        "symbol",
        F.when(now & F.col("_pair") & (F.col("_c1") > 0), (F.col("_c0") / F.col("_c1") - 1) * 100).alias("daily"),
        F.when(now & F.col("_twenty"), F.col("_c0") > F.col("_mean20")).alias("ma20"),
        F.when(now & F.col("_history"), (F.try_divide(F.col("_c0"), F.col("_c20")) - 1) * 100).alias("momentum20"),
        F.when(now, F.col("_t0")).alias("turnover"),
        F.when(
            now & F.col("_history") & (F.col("_tn") == 20) & (F.col("_tmean") > 0) & F.col("_t0").isNotNull(), F.col("_tmean")
        ).alias("previous_turnover"),
    )
    stocks = securities.filter("kind = 'stock'").select("symbol", F.coalesce("industry", F.lit(NO_INDUSTRY)).alias("industry"))
    out = stocks.join(metrics, "symbol", "left")
    if candidates is None:
        return out.withColumn("candidate", F.lit(False))
    chosen = candidates.select("symbol").distinct().withColumn("_c", F.lit(True))
    return out.join(chosen, "symbol", "left").withColumn("candidate", F.coalesce("_c", F.lit(False))).drop("_c")


def metric_coverage(metrics: DataFrame) -> DataFrame:
    """eligible / excluded / total per metric, each with its own denominator."""
    counts = metrics.agg(F.count("*").alias("total"), *[F.count(c).alias("n_" + name) for name, c in COVERAGE])
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col("n_" + name).alias("eligible")) for name, _ in COVERAGE])
    return counts.select("total", F.inline(pairs)).select("metric", "eligible", (F.col("total") - F.col("eligible")).alias("excluded"), "total")


def market_breadth(metrics: DataFrame) -> DataFrame:
    cohort = F.col("previous_turnover").isNotNull()
    return metrics.agg(
        F.count_if(F.col("daily") > FLAT).alias("advancers"),
        F.count_if(F.col("daily") < -FLAT).alias("decliners"),
        F.count_if(F.abs("daily") <= FLAT).alias("unchanged"),
        F.avg("daily").alias("equal_weight_return_pct"),
        F.avg(F.col("ma20").cast("double")).alias("above_ma20_ratio"),
        F.sum("turnover").alias("turnover"),
        F.try_divide(F.sum(F.when(cohort, F.col("turnover"))), F.sum("previous_turnover")).alias("turnover_ratio_20"),
    )


def industry_table(metrics: DataFrame) -> DataFrame:
    """Counts, medians and turnover share per industry; medians are selected by position, not collected."""
    up = F.when(F.col("daily").isNotNull(), (F.col("daily") > FLAT).cast("double"))
    base = metrics.groupBy("industry").agg(
        F.count("*").alias("total"),
        F.count("daily").alias("valid_count"),
        F.avg(up).alias("advancing_ratio"),
        F.sum("turnover").alias("_turnover"),
        F.count("turnover").alias("turnover_count"),
        F.count("momentum20").alias("momentum20_count"),
        F.count_if("candidate").alias("candidate_count"),
    )
    market = F.sum("_turnover").over(Window.partitionBy())
    shared = base.withColumn("turnover_share", F.when(market > 0, F.col("_turnover") / market))
    daily = group_median(metrics, ["industry"], "daily", ["symbol"], "median_return_pct")
    momentum = group_median(metrics, ["industry"], "momentum20", ["symbol"], "median_20_return_pct")
    return (
        shared.drop("_turnover")
        .join(daily, "industry", "left")
        .join(momentum, "industry", "left")
        .withColumns(
            {
                "small_sample": F.col("valid_count") < 5,
                "momentum20_small_sample": F.col("momentum20_count") < 5,
                "turnover_small_sample": F.col("turnover_count") < 5,
            }
        )
    )


def classification_sources(securities: DataFrame) -> DataFrame:
    """Distinct (url, retrieved_at) of the stocks' industry classification, in order."""
    return (
        securities.filter("kind = 'stock' AND industry_source IS NOT NULL AND industry_retrieved_at IS NOT NULL")
        .select(F.col("industry_source").alias("url"), F.col("industry_retrieved_at").alias("retrieved_at"))
        .distinct()
        .orderBy("url", "retrieved_at")
    )


def classification_missing(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count_if(F.col("industry") == NO_INDUSTRY).alias("classification_missing"))


def snapshot_coverage(rows: DataFrame) -> DataFrame:
    """Universe counts of one result set of (symbol, kind, reasons)."""
    broken = F.size("reasons") > 0
    return rows.agg(
        F.count("*").alias("universe_count"),
        F.count_if(~broken).alias("analyzed_count"),
        F.count_if(broken).alias("unavailable_count"),
        F.count_if(F.col("kind") == "stock").alias("stocks"),
        F.count_if(F.col("kind") == "etf").alias("etfs"),
    )


def eligible_per_horizon(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("horizon").agg(F.count("*").alias("securities"), F.count_if("eligible").alias("eligible"))


def ten_session_summary(outcomes: DataFrame) -> DataFrame:
    done = F.col("status") == "evaluated"
    return outcomes.agg(
        F.count_if(done).alias("evaluated"),
        F.count_if(done & F.col("touched")).alias("touched"),
        F.count_if(done & F.col("potential_fill")).alias("potential_fills"),
        F.count_if(F.col("status") == "not_comparable").alias("not_comparable"),
    )


def market_summary(securities: DataFrame, bars: DataFrame, sessions: DataFrame, as_of: Column, candidates=None) -> dict[str, DataFrame]:
    """The whole summary of a session from one metrics table."""
    metrics = stock_metrics(securities, bars, sessions, as_of, candidates)
    return {
        "metrics": metrics,
        "coverage": metric_coverage(metrics),
        "market": market_breadth(metrics),
        "industries": industry_table(metrics),
        "missing": classification_missing(metrics),
    }
