"""Physical layout helpers: bounded windows, skew-safe joins, ranks and medians.

Bars are unique on (symbol, date), so a window over one symbol is bounded by the calendar; it is still cut into blocks
of sessions so that a market with few long series spreads over all executors. Rankings over a whole market have no such
bound and are cut into sorted slices of rows instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import written

BLOCK_SESSIONS = 256
# A calendar holds a row per day of these years at most (3,652,059 rows of 12 bytes), so it can always be broadcast.
CALENDAR_FROM, CALENDAR_TO = "0001-01-01", "9999-12-31"


def calendar_days(df: DataFrame, day: str = "date") -> DataFrame:
    """Distinct days; null is no day, and a day outside the supported years fails the job instead of vanishing."""
    own = F.col(day).cast("date")
    inside = own.between(F.lit(CALENDAR_FROM).cast("date"), F.lit(CALENDAR_TO).cast("date"))
    checked = F.when(inside, own).otherwise(F.raise_error(F.concat(F.lit("no supported session: "), own.cast("string"))).cast("date"))
    return df.filter(own.isNotNull()).select(checked.alias("date")).distinct()


def blocked(df: DataFrame, back: int = 0, ahead: int = 0, size: int = BLOCK_SESSIONS, ord_col: str = "ord") -> DataFrame:
    """Assign rows to session blocks and repeat the halo that frames of neighbouring blocks reach into.

    Adds ``_block`` and ``_core``; a frame of at most ``back`` sessions behind and ``ahead`` sessions before a core row
    lies inside that row's block, so windows over (symbol, _block) are exact for core rows.
    """
    if max(back, ahead) > size:
        raise ValueError("halo exceeds the block size")
    block = F.floor(F.col(ord_col) / size)
    place = F.col(ord_col) - block * size
    homes = [F.struct(block.alias("_block"), F.lit(True).alias("_core"))]
    if back:
        homes.append(F.when(place >= size - back, F.struct((block + 1).alias("_block"), F.lit(False).alias("_core"))))
    if ahead:
        homes.append(F.when(place < ahead, F.struct((block - 1).alias("_block"), F.lit(False).alias("_core"))))
    return df.select("*", F.explode(F.array_compact(F.array(*homes))).alias("_home")).select(
        *df.columns, "_home._block", "_home._core"
    )


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_core", "_block")


def series_window(*keys: str, order: str = "ord"):
    return Window.partitionBy(*(keys or ("symbol",)), "_block").orderBy(order)


def dimension_join(
    big: DataFrame, dimension: DataFrame, on: str = "symbol", how: str = "left", spread: str = "ord", salts: int = 16
) -> DataFrame:
    """Attach a dimension that is unique on ``on``; a hot key of the big side is spread over ``salts`` tasks.

    No broadcast hint: the optimizer broadcasts by measured size, and the salted equi-join carries the rest.
    """
    salted = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
        .join(salted, [on, "_salt"], how)
        .drop("_salt")
    )


def magnitude_bucket(value: Column, per_octave: int = 16) -> Column:
    """A monotone integer bucket of a number of any scale, narrow enough to split distinct values into many tasks."""
    size = F.floor(F.log2(F.abs(value)) * per_octave) + 1100 * per_octave
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))


def split_rank(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    ties: Sequence[str],
    descending: bool = True,
    out: str = "position",
) -> DataFrame:
    """1-based position of each row in its group by value (NULL last), then ties.

    Rows are sorted over all tasks by group, value and ties together, so equal values of one group part by their ties.
    The sorted slices are written once; a slice numbers its own rows, and the rows of a group ahead of a slice are summed
    from one count for each (group, slice). No task holds a whole group unless it fits one slice.
    """
    by_value = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    order = [*groups, by_value, *ties]
    slices = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    sliced = df.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    rows = written(sliced, f"ranked-{uuid.uuid4().hex}")
    counts = rows.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"_group{k}") for k, g in enumerate(groups)],
        F.col("_slice").alias("_of"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_total"),
    )
    inside = Window.partitionBy(*groups, "_slice").orderBy(by_value, *ties)
    placed = rows.withColumn("_place", F.row_number().over(inside))
    same = [F.col(g).eqNullSafe(F.col(f"_group{k}")) for k, g in enumerate(groups)] + [F.col("_slice") == F.col("_of")]
    return placed.join(offsets, same).select(
        *[c for c in df.columns if c not in (out, out + "_of")],
        (F.col("_ahead") + F.col("_place")).cast("long").alias(out),
        F.col("_total").alias(out + "_of"),
    )


def group_median(df: DataFrame, groups: Sequence[str], value: str, ties: Sequence[str], out: str) -> DataFrame:
    """Exact median per group from the one or two middle positions; an even count averages them."""
    ranked = split_rank(df.filter(F.col(value).isNotNull()), groups, value, ties, descending=False, out="_pos")
    middle = (F.col("_pos") == F.floor((F.col("_pos_of") + 1) / 2)) | (F.col("_pos") == F.floor(F.col("_pos_of") / 2) + 1)
    return ranked.filter(middle).groupBy(*groups).agg(F.avg(value).alias(out))


def complete_sum(value: Column, expected: int | None = None) -> Column:
    """Sum that is NULL as soon as one element is missing."""
    full = F.count(value) == (F.count(F.lit(1)) if expected is None else F.lit(expected))
    return F.when(full, F.sum(value))
