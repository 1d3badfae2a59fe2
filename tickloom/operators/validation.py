"""Walk-forward validation, ranker hold-out tests, purged folds and the block bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.analogue import ANCHOR, EstimateSettings, estimates, matured_sums
from tickloom.operators.clean import security_group
from tickloom.functions.layout import BLOCK_SESSIONS, blocked

# Lower edges of the probability bins; the last bin is closed above.
BIN_EDGES = (0.0, 0.4, 0.5, 0.6, 0.7)
BIN_LABELS = ("0.0-0.4", "0.4-0.5", "0.5-0.6", "0.6-0.7", "0.7-1.0")


def row_index(bars: DataFrame, size: int = BLOCK_SESSIONS) -> DataFrame:
    """0-based position of each stored bar in its symbol: block counts are accumulated, rows numbered inside blocks."""
    block = F.floor(F.col("ord") / size)
    keyed = bars.withColumn("_b", block)
    counts = keyed.groupBy("symbol", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("symbol").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("symbol", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("symbol", "_b").orderBy("ord")
    return (
        keyed.join(offsets, ["symbol", "_b"])
        .withColumn("idx", F.col("_off") + F.row_number().over(inside) - 1)
        .drop("_b", "_off")
    )


def validation_anchors(research: DataFrame, indexed: DataFrame, first: int = 160, span: int = 180, step: int = 5, keep: int = 36) -> DataFrame:
    """Every ``step``-th of the last ``span`` comparable bars per (symbol, horizon), at most ``keep``, from bar ``first`` on."""
    usable = research.filter("has_features AND has_outcome").join(
        indexed.filter(F.col("idx") >= first).select("symbol", "date"), ["symbol", "date"], "left_semi"
    )
    series = Window.partitionBy("symbol", "horizon")
    recent = usable.withColumn("_rn", F.row_number().over(series.orderBy(F.desc("date")))).filter(F.col("_rn") <= span)
    sampled = recent.withColumn("_pos", F.max("_rn").over(series) - F.col("_rn")).filter(F.col("_pos") % step == 0)
    kept = sampled.withColumn("_rn", F.row_number().over(series.orderBy(F.desc("date"))))
    return kept.filter(F.col("_rn") <= keep).drop("_rn", "_pos")


def matured_baseline(anchors: DataFrame, research: DataFrame) -> DataFrame:
    """Win rate of all outcomes known on the anchor's date, whether or not their bar had features."""
    keyed = anchors.select("symbol", "horizon", F.col("date").alias("anchor_date"))
    won = F.when(F.col("return_pct") > 0, 1.0).otherwise(0.0)
    sums = matured_sums(keyed, research.filter("has_outcome"), {"won": won}).filter("n > 0")
    return sums.select(*ANCHOR, (F.col("won") / F.col("n")).alias("baseline"))


def predictions(anchors: DataFrame, research: DataFrame, settings: EstimateSettings = EstimateSettings()) -> DataFrame:
    """Walk-forward predictions beside what happened; anchors with too few neighbours are skipped."""
    rated = estimates(anchors, research, settings).filter(F.col("n") >= settings.min_samples)
    truth = anchors.select("symbol", "horizon", F.col("date").alias("anchor_date"), F.col("return_pct").alias("actual"))
    return (
        rated.join(truth, list(ANCHOR))
        .join(matured_baseline(anchors, research), list(ANCHOR), "left")
        .select(
            "symbol",
            "horizon",
            F.col("anchor_date").alias("signal_date"),
            F.col("target_date").alias("exit_date"),
            F.col("expected_return").alias("expected"),
            F.col("p_positive").alias("probability"),
            "actual",
            F.when(F.col("actual") > 0, 1.0).otherwise(0.0).alias("positive"),
            F.coalesce("baseline", F.lit(0.5)).alias("baseline"),
            F.col("eligible").alias("selected"),
        )
    )


def probability_bin(p: Column) -> Column:
    out = F.lit(BIN_LABELS[0])
    for edge, label in zip(BIN_EDGES[1:], BIN_LABELS[1:], strict=True):
        out = F.when(p >= edge, F.lit(label)).otherwise(out)
    return out


def calibration(preds: DataFrame, keys: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    return (
        preds.groupBy(*keys, probability_bin(F.col("probability")).alias("bin"))
        .agg(F.count("*").alias("n"), F.avg("probability").alias("predicted"), F.avg("positive").alias("actual"))
    )


def validation_report(preds: DataFrame, keys: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    return preds.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(F.col("expected") - F.col("actual"))).alias("mae"),
        F.avg(F.pow(F.col("probability") - F.col("positive"), F.lit(2))).alias("brier"),
        F.avg(F.pow(F.col("baseline") - F.col("positive"), F.lit(2))).alias("baseline_brier"),
        F.avg("actual").alias("mean_return"),
        F.avg("positive").alias("hit_rate"),
    )


def holdout_split(history: DataFrame, purge_from_end: int = 30, test: int = 20, minimum: int = 80) -> DataFrame:
    """Tag every (group, signal_date) of evaluated history as train / gap / test; too few dates give no split.

    Dates per group are calendar-bounded, so the ranking runs over distinct dates only.
    """
    dates = history.select("group", "signal_date").distinct()
    newest = Window.partitionBy("group").orderBy(F.desc("signal_date"))
    total = Window.partitionBy("group")
    ranked = dates.select(
        "group", "signal_date", F.row_number().over(newest).alias("_back"), F.count("*").over(total).alias("dates")
    )
    part = F.when(F.col("_back") <= test, "test").when(F.col("_back") <= purge_from_end, "gap").otherwise("train")
    return ranked.select(
        "group", "signal_date", "dates", F.when(F.col("dates") >= minimum, part).otherwise("insufficient").alias("part")
    )


def evaluated_history(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter((F.col("status") == "evaluated") & F.col("rank_fraction").isNotNull()).withColumn(
        "group", security_group()
    )


def validate_ranker(outcomes: DataFrame, min_train: int = 400, min_test: int = 100, min_top: int = 40, min_top_test: int = 20) -> DataFrame:
    """Top-decile rule fitted on train dates and tested on held-out dates; one row per security group present."""
    pool = evaluated_history(outcomes)
    tagged = pool.join(holdout_split(pool), ["group", "signal_date"])
    top = F.col("rank_fraction") >= 0.9
    filled = F.col("potential_fill").cast("double")
    train, test = F.col("part") == "train", F.col("part") == "test"
    counts = tagged.groupBy("group").agg(
        F.count_distinct(F.when(train, F.col("signal_date"))).alias("train_dates"),
        F.count_distinct(F.when(test, F.col("signal_date"))).alias("test_dates"),
        F.count_if(train).alias("train_n"),
        F.count_if(test).alias("test_n"),
        F.count_if(train & top).alias("_top_n"),
        F.count_if(test & top).alias("holdout_top_n"),
        F.sum(F.when(train & top, filled)).alias("_top_fills"),
        F.avg(F.when(train, filled)).alias("baseline"),
        F.avg(F.when(test, filled)).alias("holdout_base"),
        F.avg(F.when(test & top, filled)).alias("holdout_top"),
    )
    enough = (
        (F.col("train_n") >= min_train)
        & (F.col("test_n") >= min_test)
        & (F.col("_top_n") >= min_top)
        & (F.col("holdout_top_n") >= min_top_test)
    )
    p, base, hit = F.col("probability"), F.col("baseline"), F.col("holdout_top")
    # A mean squared error against 0/1 fills only needs their rate: p^2 (1 - rate) + (1 - p)^2 rate.
    brier = lambda guess: guess * guess * (1 - hit) + (1 - guess) * (1 - guess) * hit
    out = counts.withColumn("_enough", enough).withColumn("probability", (F.col("_top_fills") + 1) / (F.col("_top_n") + 2))
    out = out.withColumns({"brier": brier(p), "baseline_brier": brier(base)})
    good = F.col("_enough") & (p >= base + 0.05) & (hit >= F.col("holdout_base") + 0.05) & (F.col("brier") < F.col("baseline_brier"))
    fields = ("probability", "baseline", "holdout_base", "holdout_top", "brier", "baseline_brier")
    return out.select(
        "group",
        F.when(F.coalesce(good, F.lit(False)), "validated").otherwise("insufficient_validation").alias("status"),
        "train_dates",
        "test_dates",
        "train_n",
        "test_n",
        *[F.when(F.col("_enough"), F.col(c)).alias(c) for c in fields],
        F.when(F.col("_enough"), F.col("holdout_top_n")).alias("holdout_top_n"),
    )


def rolling_folds(days: DataFrame, warmup: int = 30, purge: int = 10, test: int = 10, column: str = "date") -> DataFrame:
    """Purged walk-forward folds over distinct days: one row per (fold, day) with its role; the last fold may be short."""
    distinct = days.select(F.col(column).alias("date")).distinct()
    w = Window.orderBy("date")
    numbered = distinct.select("date", (F.row_number().over(w) - 1).alias("pos"), F.count("*").over(Window.partitionBy()).alias("_n"))
    start = warmup + purge
    last_fold = F.floor((F.col("_n") - 1 - start) / test)
    own = F.floor((F.col("pos") - start) / test)
    folds = numbered.filter(F.col("_n") > start).select(
        "date", "pos", F.explode(F.sequence(F.greatest(own, F.lit(0)), last_fold)).alias("fold")
    )
    begin = start + F.col("fold") * test
    role = F.when(F.col("pos") >= begin, "test").when(F.col("pos") >= begin - purge, "purge").otherwise("warmup")
    return folds.select("fold", "date", role.alias("role"))


def block_bootstrap(
    days: DataFrame, value: str, order: str, replicates: int = 2000, block: int = 10, minimum: int = 30, seed: int = 20261008
) -> DataFrame:
    """Moving-block bootstrap interval of the mean of a daily series; NULL bounds below ``minimum`` days.

    Block starts come from a seeded hash of (replicate, block number), so a recomputed task draws the same blocks.
    ``days`` has one row per day (calendar-bounded); prefix sums turn each block into two lookups by position.
    """
    w = Window.orderBy(order)
    total = Window.partitionBy()
    prefix = days.select(
        F.row_number().over(w).alias("pos"),
        F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.count("*").over(total).alias("n"),
        F.avg(value).over(total).alias("_mean"),
        F.col(value).alias("_value"),
    )
    summary = days.agg(F.count("*").alias("valid_test_days"), F.avg(value).alias("mean_difference_pct"))
    size = prefix.filter(F.col("n") >= minimum).select("n").distinct()
    blocks = F.ceil(F.col("n") / block)
    draws = (
        size.select("n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
        .repartition("rep")
        .select("n", "rep", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("b"))
        .withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "rep", "b"), F.col("n") - block + 1))
        .withColumn("length", F.least(F.lit(block), F.col("n") - F.col("b") * block))
    )
    low = prefix.select(F.col("pos").alias("start"), F.col("_upto").alias("_from"))
    high = prefix.select(F.col("pos").alias("_end"), F.col("_upto").alias("_to"))
    means = (
        draws.withColumn("_end", F.col("start") + F.col("length"))
        .join(F.broadcast(low), "start", "left")
        .join(F.broadcast(high), "_end")
        .groupBy("rep", "n")
        .agg((F.sum(F.col("_to") - F.coalesce("_from", F.lit(0.0))) / F.first("n")).alias("mean"))
    )
    ordered = means.withColumn("_rn", F.row_number().over(Window.orderBy("mean", "rep")) - 1)
    ci = ordered.agg(
        F.max(F.when(F.col("_rn") == int(0.025 * replicates), F.col("mean"))).alias("ci_low"),
        F.max(F.when(F.col("_rn") == int(0.975 * replicates), F.col("mean"))).alias("ci_high"),
    )
    columns = ("valid_test_days", "mean_difference_pct", "ci_low", "ci_high")
    both = summary.unionByName(ci, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in columns])
    enough = F.col("valid_test_days") >= minimum
    return both.select(
        "valid_test_days",
        F.when(enough, F.col("mean_difference_pct")).alias("mean_difference_pct"),
        "ci_low",
        "ci_high",
        F.when(~enough, "insufficient")
        .when(F.col("ci_low") > 0, "above_zero")
        .when(F.col("ci_high") < 0, "below_zero")
        .otherwise("includes_zero")
        .alias("conclusion"),
    )
