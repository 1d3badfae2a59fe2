"""Nearest-analogue estimation: matured candidates, per-anchor scale, stable top-k and neighbour statistics.

Candidates are cut into session blocks and anchors repeated for the blocks before them, so the theta self-join stays an
equi-join on (symbol, horizon, block) with a residual date filter. It runs once, for distances, where the top-k limit is
applied per partition before rows move; pairs are never materialised. What an anchor needs of all its candidates (scales,
win rates) are running sums in order of the exit date, so they take no pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import BLOCK_SESSIONS
from tickloom.operators.clean import reasons_of
from tickloom.operators.features import VECTOR

# Smallest scale per feature dimension, in the order of VECTOR.
SCALE_FLOORS = (0.003, 0.01, 0.02, 0.01, 0.2, 0.003)
# Reasons attached to estimates.
REASON_NO_FEATURES = "最近20日資料不足、缺漏或跨價格調整，暫不估計"
REASON_NO_CANDIDATES = "沒有已成熟且價格可比較的歷史樣本"
REASON_FEW = "有效相近樣本不足"
REASON_TURNOVER = "20日平均成交金額低於門檻"
REASON_MEAN = "成本後期望值不為正"
REASON_PROBABILITY = "歷史到期獲利比例低於門檻"
REASON_DOWNSIDE = "歷史下檔分位超過風險門檻"
REASON_TARGET = "目標年度官方開休市資料尚未取得"

# Calendar days of a block of running sums; it steers cost only.
SUM_DAYS = 512
ANCHOR = ("symbol", "horizon", "anchor_date")


@dataclass(frozen=True)
class EstimateSettings:
    neighbors: int = 60
    min_samples: int = 30
    min_turnover: float = 20_000_000
    min_probability: float = 0.55
    max_downside: float = 8


def latest_anchors(research: DataFrame) -> DataFrame:
    """The last bar of every symbol for every horizon."""
    last = research.groupBy("symbol").agg(F.max("date").alias("date"))
    return research.join(last, ["symbol", "date"], "left_semi")


def _candidates(research: DataFrame, size: int) -> DataFrame:
    return research.filter("has_features AND has_outcome").select(
        "symbol",
        "horizon",
        F.floor(F.col("ord") / size).alias("block"),
        F.col("ord").alias("c_ord"),
        F.col("exit_date").alias("c_exit"),
        *[F.col(v).alias("c_" + v) for v in VECTOR],
        F.col("return_pct").alias("c_return"),
        F.col("recovered").alias("c_recovered"),
        F.col("recovery_days").alias("c_days"),
        F.col("worst_close_return").alias("c_worst"),
    )


def _fan(anchors: DataFrame, size: int) -> DataFrame:
    """Repeat an anchor for every block that can hold earlier candidates (calendar length / block size)."""
    return anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("ord") / size))))


def matured_pairs(anchors: DataFrame, research: DataFrame, size: int = BLOCK_SESSIONS) -> DataFrame:
    """Anchor x candidate pairs of one symbol and horizon whose exit is known on the anchor's date."""
    candidates = _candidates(research, size)
    return _fan(anchors, size).join(candidates, ["symbol", "horizon", "block"]).filter("c_exit <= anchor_date AND c_ord < ord")


def matured_sums(anchors: DataFrame, outcomes: DataFrame, sums: dict[str, Column], days: int = SUM_DAYS) -> DataFrame:
    """`n` and the sums over all outcomes of an anchor's symbol and horizon that have exited by its date.

    An exit lies behind its signal, so an outcome that is known is also an earlier one. Outcomes are added up per exit day and
    run on inside blocks of calendar days; the blocks before add one row each. Anchors without any outcome have zeros.
    """
    keys, names = ["symbol", "horizon"], ["n", *sums]
    known = outcomes.groupBy(*keys, F.col("exit_date").alias("_day")).agg(
        F.count("*").alias("n"), *[F.sum(value).alias(name) for name, value in sums.items()]
    )
    asked = anchors.select(*keys, F.col("anchor_date").alias("_day")).distinct().withColumn("_asked", F.lit(True))
    both = known.withColumn("_asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    both = both.withColumn("_block", F.floor(F.unix_date("_day") / days))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        both.groupBy(*keys, "_block")
        .agg(*[F.sum(c).alias(c) for c in names])
        .select(*keys, "_block", *[F.sum(c).over(earlier).alias("_" + c) for c in names])
    )
    upto = Window.partitionBy(*keys, "_block").orderBy("_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.select(*keys, "_block", "_day", "_asked", *[F.sum(c).over(upto).alias(c) for c in names]).filter("_asked")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col("_" + c), F.lit(0))
    return inside.join(ahead, [*keys, "_block"]).select(
        *keys, F.col("_day").alias("anchor_date"), *[whole(c).alias(c) for c in names]
    )


def _as_anchors(rows: DataFrame) -> DataFrame:
    return rows.filter("has_features").select(
        "symbol", "horizon", F.col("date").alias("anchor_date"), "ord", *VECTOR
    )


def anchor_scales(anchors: DataFrame, research: DataFrame) -> DataFrame:
    """Population standard deviation of each dimension over the anchor's own candidates, floored.

    Variances are differences of running moments. What that loses in digits is far below the floors, which also stand for
    dimensions that are constant.
    """
    candidates = research.filter("has_features AND has_outcome")
    moments = {f"m{k}_{v}": F.pow(F.col(v), F.lit(k)) for v in VECTOR for k in (1, 2)}
    sums = matured_sums(_as_anchors(anchors), candidates, moments)
    mean = lambda k, v: F.col(f"m{k}_{v}") / F.col("n")
    scale = lambda v: F.sqrt(F.greatest(mean(2, v) - mean(1, v) * mean(1, v), F.lit(0.0)))
    return sums.filter("n > 0").select(
        *ANCHOR,
        F.col("n").alias("candidates"),
        *[F.greatest(scale(v), F.lit(floor)).alias("s_" + v) for v, floor in zip(VECTOR, SCALE_FLOORS, strict=True)],
    )


def distance() -> Column:
    terms = [F.pow((F.col("c_" + v) - F.col(v)) / F.col("s_" + v), F.lit(2)) for v in VECTOR]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def nearest(anchors: DataFrame, research: DataFrame, k: int = 60) -> DataFrame:
    """The k nearest matured candidates of every anchor; equal distances keep the older bar."""
    keyed = _as_anchors(anchors)
    scaled = keyed.join(anchor_scales(anchors, research), list(ANCHOR))
    pairs = matured_pairs(scaled, research).select(
        *ANCHOR,
        F.xxhash64(*ANCHOR).alias("_id"),
        "c_ord",
        "c_return",
        "c_recovered",
        "c_days",
        "c_worst",
        distance().alias("distance"),
    )
    # The hash leads the sort so that most comparisons end at its eight bytes; the key columns keep groups exact.
    order = Window.partitionBy("_id", *ANCHOR).orderBy("distance", "c_ord")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_id")


def neighbour_statistics(neighbours: DataFrame) -> DataFrame:
    """Statistics of at most k neighbours per anchor; quantiles interpolate linearly."""
    won = F.when(F.col("c_return") > 0, 1.0).otherwise(0.0)
    q = lambda c, p: F.percentile(c, F.lit(p))
    return neighbours.groupBy(*ANCHOR).agg(
        F.count("*").alias("n"),
        F.avg("c_return").alias("expected_return"),
        F.median("c_return").alias("median_return"),
        F.avg(won).alias("p_positive"),
        F.avg(F.col("c_recovered").cast("double")).alias("p_recovery"),
        q("c_return", 0.1).alias("q10"),
        q("c_return", 0.9).alias("q90"),
        q("c_worst", 0.1).alias("worst_close_q10"),
        F.median(F.when(F.col("c_recovered"), F.col("c_days"))).alias("median_recovery_days"),
    )


def composite_score() -> Column:
    raw = 50 + F.col("expected_return") * 3 + (F.col("p_positive") - 0.5) * 40 + F.least(F.col("q10"), F.lit(0.0)) * 2
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def estimate_reasons(settings: EstimateSettings) -> Column:
    rated = reasons_of(
        (F.col("n") < settings.min_samples, REASON_FEW),
        (F.col("avg_turnover_20") < settings.min_turnover, REASON_TURNOVER),
        (F.col("expected_return") <= 0, REASON_MEAN),
        (F.col("p_positive") < settings.min_probability, REASON_PROBABILITY),
        (F.col("q10") < -settings.max_downside, REASON_DOWNSIDE),
        (F.col("target_date").isNull(), REASON_TARGET),
    )
    return (
        F.when(~F.col("has_features"), F.array(F.lit(REASON_NO_FEATURES)))
        .when(F.col("n").isNull(), F.array(F.lit(REASON_NO_CANDIDATES)))
        .otherwise(rated)
    )


def estimates(anchors: DataFrame, research: DataFrame, settings: EstimateSettings = EstimateSettings()) -> DataFrame:
    """One row per anchor (symbol, horizon, anchor_date): statistics, score, reasons and eligibility."""
    stats = neighbour_statistics(nearest(anchors, research, settings.neighbors))
    base = anchors.select(
        "symbol",
        "horizon",
        F.col("date").alias("anchor_date"),
        "has_features",
        "avg_turnover_20",
        "entry_date",
        F.col("exit_date").alias("target_date"),
    )
    joined = base.join(stats, list(ANCHOR), "left")
    reasons = estimate_reasons(settings)
    return joined.select(
        *base.columns,
        *[c for c in stats.columns if c not in (*ANCHOR, "n")],
        F.round(F.when(F.col("n").isNotNull(), composite_score()), 1).alias("score"),
        reasons.alias("reasons"),
        (F.size(reasons) == 0).alias("eligible"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
    )


def latest_estimates(research: DataFrame, settings: EstimateSettings = EstimateSettings()) -> DataFrame:
    return estimates(latest_anchors(research), research, settings)
