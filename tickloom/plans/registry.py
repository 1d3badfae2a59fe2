"""Named queries over the driver tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features as feature_ops
from tickloom.operators import outcomes as outcome_ops
from tickloom.operators import ranking as ranking_ops
from tickloom.sources import standins
from tickloom.sources.standins import _once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Liquidity threshold for the stand-in market, whose weekly turnover per symbol is far below a real one.
MIN_TURNOVER = 100_000.0
AS_OF_BACK = 12


@dataclass
class Market:
    """Tables of one data folder; those that most queries share are derived once per session."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return standins.table(self.spark, self.sf_dir, name)

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return _once(self.spark, self.sf_dir, name, build)

    @cached_property
    def bars(self) -> DataFrame:
        return standins.bars(self.spark, self.sf_dir)

    @cached_property
    def sessions(self) -> DataFrame:
        return standins.sessions(self.spark, self.sf_dir)

    @cached_property
    def index(self) -> DataFrame:
        return standins.index_bars(self.spark, self.sf_dir)

    @cached_property
    def securities(self) -> DataFrame:
        return standins.securities(self.spark, self.sf_dir)

    @cached_property
    def features(self) -> DataFrame:
        return self.shared("features", lambda: feature_ops.features(self.bars))

    @cached_property
    def research(self) -> DataFrame:
        return self.shared("research", lambda: outcome_ops.research_table(self.bars, self.sessions, self.securities))

    @cached_property
    def ten(self) -> DataFrame:
        return self.shared("ten", lambda: outcome_ops.ten_session_outcomes(self.bars, self.sessions, self.securities))

    @cached_property
    def scored(self) -> DataFrame:
        return self.shared(
            "scored",
            lambda: ranking_ops.scored_universe(self.features, self.securities, self.sessions, self.index, MIN_TURNOVER),
        )

    @cached_property
    def as_of(self) -> Column:
        """A session shortly before the end of the data (a scalar read from the calendar)."""
        last = self.sessions.agg(F.max("ord")).first()[0]
        day = self.sessions.filter(F.col("ord") == last - AS_OF_BACK).first()["date"]
        return F.lit(day)

    @cached_property
    def events(self) -> DataFrame:
        return standins.events(self.spark, self.sf_dir)

    @cached_property
    def now(self) -> Column:
        return F.lit(self.events.agg(F.max("ts")).first()[0])


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Wall-clock columns are read and written in one zone, whatever the session started with.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Market(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def text(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def joined(column, separator: str = "|") -> Column:
    return F.array_join(column, separator)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
