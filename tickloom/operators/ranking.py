"""Rankings: candidate scores per session, market lists, pages and list choices.

Whole-market positions come from ``split_rank``; top-k lists use a per-group limit that Spark applies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.layout import dimension_join, split_rank
from tickloom.functions.scalars import finite
from tickloom.operators.clean import security_group, tradable_region
from tickloom.operators.features import LABEL_BREAK_UP

TOP = 10
METRICS = ("expected_return", "p_positive", "p_recovery", "score")
# The seven market lists as (key, metric, ascending).
MARKET_LISTS = (
    ("amount", "turnover", False),
    ("gainers", "change_pct", False),
    ("losers", "change_pct", True),
    ("volume", "relative_volume", False),
    ("high20", "momentum20_pct", False),
    ("low20", "momentum20_pct", True),
    ("quiet", "volatility_pct", True),
)
# The ten intraday lists as (key, metric, sign, kind).
INTRADAY_LISTS = (
    ("gainers", "day_pct", 1, "stock"),
    ("losers", "day_pct", -1, "stock"),
    ("etf-gainers", "day_pct", 1, "etf"),
    ("etf-losers", "day_pct", -1, "etf"),
    ("amount", "amount", 1, None),
    ("volume", "volume", 1, None),
    ("gap-up", "gap_pct", 1, None),
    ("gap-down", "gap_pct", -1, None),
    ("from-open-up", "from_open_pct", 1, None),
    ("from-open-down", "from_open_pct", -1, None),
)


def index_change(sessions: DataFrame, index_bars: DataFrame, lag: int = 20) -> DataFrame:
    """Index change over the ``lag`` sessions that end on each session; 0 where either close is missing."""
    closes = sessions.join(index_bars, "date", "left").select("date", "ord", F.col("close").alias("_new"))
    earlier = closes.select((F.col("ord") + lag).alias("ord"), F.col("_new").alias("_old"))
    usable = (F.col("_new") != 0) & (F.col("_old") != 0)
    change = F.when(usable, (F.try_divide(F.col("_new"), F.col("_old")) - 1) * 100)
    return closes.join(earlier, "ord", "left").select("date", F.coalesce(change, F.lit(0.0)).alias("market20"))


def scored_universe(
    featured: DataFrame, securities: DataFrame, sessions: DataFrame, index_bars: DataFrame, min_turnover: float = 20_000_000
) -> DataFrame:
    """Every tradable, liquid security of every session with its score, group and rank fraction inside the group."""
    bars = featured.filter(F.col("has_features") & (F.col("avg_turnover_20") >= min_turnover))
    listed = dimension_join(bars.drop("kind"), securities.filter(tradable_region()), how="inner")
    market = index_change(sessions, index_bars)
    raw = (
        F.col("momentum5")
        + F.col("momentum20")
        - F.coalesce("market20", F.lit(0.0))
        + F.least(F.col("volume_ratio"), F.lit(3.0)) * 2
        + F.when(F.array_contains("labels", LABEL_BREAK_UP), 2.0).otherwise(0.0)
        - F.col("volatility")
    )
    rows = listed.join(F.broadcast(market), "date", "left").select(
        F.col("date").alias("as_of"),
        "symbol",
        "name",
        "kind",
        "etf_style",
        security_group().alias("group"),
        "close",
        F.round("momentum5", 2).alias("momentum5_pct"),
        F.round("momentum20", 2).alias("momentum20_pct"),
        F.round("volume_ratio", 2).alias("relative_volume"),
        F.round(raw, 2).alias("score"),
        F.col("labels").alias("reasons"),
    )
    return rank_fraction(rows)


def rank_fraction(rows: DataFrame) -> DataFrame:
    """1 - position/size inside (as_of, group), best score first, ties by symbol."""
    ranked = split_rank(rows, ["as_of", "group"], "score", ["symbol"], out="group_pos")
    return ranked.withColumn("rank_fraction", 1 - (F.col("group_pos") - 1) / F.col("group_pos_of")).drop("group_pos", "group_pos_of")


def universe_rank(scored: DataFrame) -> DataFrame:
    """Position in the whole scored universe of a session."""
    return split_rank(scored, ["as_of"], "score", ["symbol"], out="rank").drop("rank_of")


def top_k(rows: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int = TOP, out: str = "rank") -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def research_candidates(scored: DataFrame, k: int = TOP) -> DataFrame:
    return top_k(scored, ["as_of"], [F.desc("score"), F.col("symbol")], k)


def recommendations(scored: DataFrame, validation: DataFrame, k: int = TOP) -> DataFrame:
    """Top decile of validated groups only; the validation table has one row per group (three at most)."""
    unlocked = validation.filter("status = 'validated'").select("group", "probability")
    best = scored.filter("rank_fraction >= 0.9").join(F.broadcast(unlocked), "group")
    return top_k(best, ["as_of"], [F.desc("probability"), F.desc("score"), F.col("symbol")], k)


def list_choice(scored: DataFrame, validation: DataFrame, k: int = TOP) -> DataFrame:
    """Per session the recommendations where there are any, else the research candidates."""
    chosen = recommendations(scored, validation, k).withColumn("status", F.lit("validated"))
    plain = research_candidates(scored, k).join(chosen.select("as_of").distinct(), "as_of", "left_anti")
    return chosen.unionByName(
        plain.withColumns({"probability": F.lit(None).cast("double"), "status": F.lit("insufficient_validation")})
    )


def _signed(metric: str, ascending: bool) -> Column:
    return -F.col(metric) if ascending else F.col(metric)


def market_lists(metrics: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """All seven lists in one pass: each row is offered to the lists it qualifies for, then positions are counted."""
    rules = {
        "gainers": F.col("change_pct") > 0,
        "losers": F.col("change_pct") < 0,
        "volume": F.col("relative_volume") >= 1.5,
        "high20": F.col("new_high20"),
        "low20": F.col("new_low20"),
    }
    offers = [
        F.when(
            finite(metric).isNotNull() & F.coalesce(rules.get(key, F.lit(True)), F.lit(False)),
            F.struct(F.lit(key).alias("list"), F.col(metric).alias("value"), _signed(metric, ascending).alias("_signed")),
        )
        for key, metric, ascending in MARKET_LISTS
    ]
    home = metrics.filter(F.coalesce(F.col("currency"), F.lit("TWD")) == "TWD")
    rows = home.select(*groups, "symbol", F.explode(F.array_compact(F.array(*offers))).alias("_o")).select(*groups, "symbol", "_o.*")
    return split_rank(rows, [*groups, "list"], "_signed", ["symbol"]).drop("_signed")


def intraday_lists(quotes: DataFrame) -> DataFrame:
    """The ten intraday lists: sign and kind filters, best value first, ties by symbol."""
    offers = [
        F.when(
            F.coalesce((finite(metric) * sign > 0) & (F.lit(True) if kind is None else F.col("kind") == kind), F.lit(False)),
            F.struct(
                F.lit(key).alias("list"),
                F.col(metric).cast("double").alias("value"),
                (F.col(metric) * sign).cast("double").alias("_signed"),
            ),
        )
        for key, metric, sign, kind in INTRADAY_LISTS
    ]
    rows = quotes.select("symbol", F.explode(F.array_compact(F.array(*offers))).alias("_o")).select("symbol", "_o.*")
    return split_rank(rows, ["list"], "_signed", ["symbol"]).drop("_signed")


def opening_analysis(quotes: DataFrame) -> DataFrame:
    """Quotes by size of the opening gap, with the direction of each gap."""
    gaps = quotes.filter(finite("gap_pct").isNotNull()).withColumns(
        {"_size": F.abs("gap_pct"), "direction": F.signum("gap_pct").cast("int"), "_all": F.lit(1)}
    )
    return split_rank(gaps, ["_all"], "_size", ["symbol"]).drop("_size", "_all")


def opening_counts(quotes: DataFrame) -> DataFrame:
    return quotes.filter(finite("gap_pct").isNotNull()).agg(
        F.count_if(F.col("gap_pct") > 0).alias("up"),
        F.count_if(F.col("gap_pct") < 0).alias("down"),
        F.count_if(F.col("gap_pct") == 0).alias("flat"),
    )


def horizon_ranking(estimates: DataFrame, horizon: int, metric: str) -> DataFrame:
    """Estimates of one horizon with their position, best metric first, missing values last, ties by symbol."""
    return split_rank(estimates.filter(F.col("horizon") == horizon), ["horizon"], metric, ["symbol"]).orderBy("position")


def page(ranked: DataFrame, number: int, size: int, groups: Sequence[str] = (), position: str = "position") -> DataFrame:
    """One page of a positioned list; a page past the end shows the last one."""
    total = F.col(position + "_of")
    pages = F.greatest(F.lit(1), F.ceil(total / size))
    shown = F.greatest(F.lit(1), F.least(F.lit(number), pages))
    start = (shown - 1) * size
    return ranked.withColumns({"page": shown.cast("long"), "pages": pages.cast("long")}).filter(
        (F.col(position) > start) & (F.col(position) <= start + size)
    )


def after_close_report(catalog: DataFrame, as_of: Column) -> DataFrame:
    """Rows published after the close: priced on the catalog date, of a known kind."""
    return catalog.filter(
        (F.col("data_as_of") == as_of) & F.col("kind").isin("stock", "etf") & finite("close").isNotNull()
    ).select(
        "symbol",
        "name",
        "kind",
        F.col("close").alias("price"),
        F.col("change_pct").alias("day_pct"),
        "volume",
        F.col("turnover").alias("amount"),
    )
