"""Point-in-time store of official observations and of research snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import canonical_hash, finite, month_number
from tickloom.operators.breadth import recent_sessions

IDENTITY = ("source", "symbol", "key")


def content_hashed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumn("content_hash", canonical_hash(*(F.col(c) for c in columns)))


def changed_arrivals(arrivals: DataFrame, grain: str = "day", keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Append-if-changed over a history of arrivals: a row is a new version when its content differs from the version
    before it; returning to an old value is a new version again.

    Rows carry acquired_at, seq, content_hash and published_at. Feeds hold one row per identity and acquisition, so a
    second row with the same acquisition time is not later and is dropped. A hot identity is cut by ``grain``: inside a
    slice the previous hash is a lag, the first row of a slice looks at the last hash of the slice before it.
    """
    sliced = arrivals.withColumn("_slice", F.date_trunc(grain, "acquired_at"))
    last = sliced.groupBy(*keys, "_slice").agg(
        F.max_by("content_hash", F.struct(F.col("acquired_at"), (-F.col("seq")).alias("_s"))).alias("_last")
    )
    carried = last.select(*keys, "_slice", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("acquired_at", "seq")
    ordered = sliced.withColumn("_fresh", ~F.col("acquired_at").eqNullSafe(F.lag("acquired_at").over(inside)))
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    compared = ordered.withColumn("_before", F.last(F.when(F.col("_fresh"), F.col("content_hash")), True).over(earlier))
    joined = compared.filter("_fresh").join(carried, [*keys, "_slice"])
    changed = joined.filter(~F.col("content_hash").eqNullSafe(F.coalesce("_before", "_carry")))
    return stamped(changed.drop("_slice", "_fresh", "_before", "_carry"))


def stamped(rows: DataFrame) -> DataFrame:
    """Versions with the time they were first seen and the time they were available."""
    return rows.withColumns(
        {
            "first_seen_at": F.col("acquired_at"),
            "available_at": F.greatest(F.col("acquired_at"), F.coalesce("published_at", "acquired_at")),
        }
    )


def new_versions(current: DataFrame, batch: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Rows of one acquisition that change the stored current version (unique on ``keys``) or start a new identity."""
    held = current.select(*keys, F.col("content_hash").alias("_held"), F.col("first_seen_at").alias("_seen"))
    joined = batch.join(held, list(keys), "left")
    accept = F.col("_held").isNull() | ((F.col("_held") != F.col("content_hash")) & (F.col("acquired_at") > F.col("_seen")))
    return stamped(joined.filter(accept).drop("_held", "_seen"))


def latest_versions(
    observations: DataFrame, cutoff: Column | None = None, as_of: Column | None = None, keys: Sequence[str] = IDENTITY
) -> DataFrame:
    """The version of each identity that was available at ``cutoff`` (inclusive), for data up to ``as_of``.

    A combinable max_by: the versions of a hot identity are reduced on the map side.
    """
    known = observations
    if cutoff is not None:
        known = known.filter(F.col("available_at") <= cutoff)
    if as_of is not None:
        known = known.filter(F.col("data_date") <= as_of)
    row = F.struct(*[F.col(c) for c in observations.columns if c not in keys])
    order = F.struct("first_seen_at", "seq") if "seq" in observations.columns else F.col("first_seen_at")
    return known.groupBy(*keys).agg(F.max_by(row, order).alias("_v")).select(*keys, "_v.*")


def superseded(observations: DataFrame, grain: str = "month", keys: Sequence[str] = IDENTITY) -> DataFrame:
    """The versions with ``superseded_at``: when the first version acquired after them became available (null: never yet).

    A version that is published late can be overtaken before it is available; it then has no time of its own and is left
    out. A hot identity is cut by ``grain``: inside a slice the least time of the following rows is a window, the slices behind
    it come from one summary row each.
    """
    sliced = observations.withColumn("_slice", F.date_trunc(grain, "first_seen_at"))
    least = sliced.groupBy(*keys, "_slice").agg(F.min("available_at").alias("_least"))
    behind = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    later = least.select(*keys, "_slice", F.min("_least").over(behind).alias("_later"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("first_seen_at", "seq").rowsBetween(1, Window.unboundedFollowing)
    timed = sliced.withColumn("_next", F.min("available_at").over(inside)).join(later, [*keys, "_slice"])
    held = timed.withColumn("superseded_at", F.least("_next", "_later")).drop("_slice", "_next", "_later")
    return held.filter(F.col("superseded_at").isNull() | (F.col("available_at") < F.col("superseded_at")))


def _ordinals(rows: DataFrame, days: DataFrame, first_day, moment: str, out: str, last: int) -> DataFrame:
    """Add how many cut-offs lie before a moment (null: all of them); ``days`` is a whole calendar from the first to the last cut-off."""
    own = days.select(F.col("day").alias("_day"), F.col("before").alias("_before"), F.col("moments").alias("_moments"))
    joined = rows.join(F.broadcast(own), F.to_date(moment) == F.col("_day"), "left")
    inside = F.col("_before") + F.size(F.filter("_moments", lambda c: c < F.col(moment)))
    count = F.when(F.col(moment).isNull(), F.lit(last)).when(F.to_date(moment) < F.lit(first_day), F.lit(0)).otherwise(F.coalesce(inside, F.lit(last)))
    return joined.withColumn(out, count.cast("int")).drop("_day", "_before", "_moments")


def versions_at(observations: DataFrame, manifest: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """For every snapshot of ``manifest`` (snapshot_id, cutoff, as_of) the version of each identity that was available at its
    cut-off, for data up to its as_of: one pass over the versions for all cut-offs.

    Each version knows from when to when it was the latest, so it meets a contiguous run of the cut-offs, counted by a
    calendar of days. The data date belongs to the identity: all versions of one have the same. A manifest has one row per
    snapshot; rows without a cut-off are no snapshots.
    """
    moments = manifest.filter("cutoff IS NOT NULL").select("cutoff").distinct()
    numbered = moments.withColumn("_at", F.row_number().over(Window.orderBy("cutoff")) - 1)
    found = moments.agg(F.count("*"), F.min(F.to_date("cutoff")), F.max(F.to_date("cutoff"))).first()
    if not found[0]:
        return manifest.select("snapshot_id").join(observations, F.lit(False))
    listed = numbered.groupBy(F.to_date("cutoff").alias("day")).agg(F.sort_array(F.collect_list("cutoff")).alias("moments"), F.min("_at").alias("_first"))
    span = observations.sparkSession.range(1).select(F.explode(F.sequence(F.lit(found[1]), F.lit(found[2]))).alias("day"))
    ahead = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = span.join(listed, "day", "left").withColumn("moments", F.coalesce("moments", F.array().cast("array<timestamp>")))
    days = days.withColumn("before", F.coalesce(F.sum(F.size("moments")).over(ahead), F.lit(0)))
    timed = _ordinals(superseded(observations, keys=keys), days, found[1], "available_at", "_lo", found[0])
    timed = _ordinals(timed, days, found[1], "superseded_at", "_hi", found[0])
    each = timed.filter("_lo < _hi").withColumn("_at", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    snapshots = manifest.join(numbered, "cutoff").select("snapshot_id", F.col("as_of").alias("_as_of"), "_at")
    met = each.join(F.broadcast(snapshots), "_at").filter(F.col("data_date") <= F.col("_as_of"))
    return met.select("snapshot_id", *observations.columns)


def pit_features(
    symbols: DataFrame,
    institution: DataFrame,
    revenue: DataFrame,
    volumes: DataFrame,
    sessions: DataFrame,
    as_of: Column,
    count: int = 5,
    max_months: int = 3,
) -> DataFrame:
    """Institution and revenue features from point-in-time views (already cut by ``latest_versions``).

    Institution rows: symbol, data_date, unit, total_net. Revenue rows: symbol, data_date, available_at, period, yoy_pct.
    """
    volume = volumes.select("symbol", F.col("date").alias("data_date"), finite("volume").alias("_volume"))
    dated = institution.join(volume, ["symbol", "data_date"], "left").withColumnRenamed("data_date", "date")
    window = recent_sessions(dated, sessions, as_of, count)
    sound = (F.col("unit") == "shares") & (F.col("_volume") >= 0)
    net = F.col("total_net")
    whole = F.count_if(sound) == count
    stop = F.min(F.when(net <= 0, F.col("back")))
    ref = F.struct("date", F.col("key").alias("data_key"), "content_hash", "available_at")
    flows = window.groupBy("symbol").agg(
        F.when(whole, F.sum(net)).alias("institution_net_5"),
        F.when(whole, F.try_divide(F.sum(net), F.sum("_volume"))).alias("institution_ratio_5"),
        F.when(whole, F.coalesce(stop, F.lit(count))).cast("int").alias("buy_streak"),
        F.sort_array(F.collect_list(ref)).alias("provenance"),
    )
    newest = revenue.groupBy("symbol").agg(
        F.max_by(F.struct("period", "yoy_pct"), F.struct("data_date", "available_at")).alias("_r")
    )
    age = month_number(as_of) - month_number("_r.period")
    rated = newest.select("symbol", F.when(age.between(0, max_months), F.col("_r.yoy_pct")).alias("revenue_yoy_pct"))
    joined = symbols.select("symbol").join(flows, "symbol", "left").join(rated, "symbol", "left")
    return joined.withColumn("eligible", F.col("institution_ratio_5").isNotNull() & F.col("revenue_yoy_pct").isNotNull())


def symbol_detail(
    securities: DataFrame,
    observations: DataFrame,
    sources: Sequence[str],
    cutoff: Column | None = None,
    as_of: Column | None = None,
    failed: Sequence[str] = (),
    stock_only: Sequence[str] = ("revenue",),
    undated: Sequence[str] = ("action",),
    count: int = 10,
) -> DataFrame:
    """The newest ``count`` rows of every (symbol, source) with the source's state; sources without rows keep one line.

    Announced future actions are shown, so ``undated`` sources ignore as_of.
    """
    known = observations if as_of is None else observations.filter(F.col("source").isin(list(undated)) | (F.col("data_date") <= as_of))
    latest = latest_versions(known, cutoff)
    newest = Window.partitionBy("symbol", "source").orderBy(F.desc("data_date"), F.desc("available_at"), F.desc("key"))
    top = latest.withColumn("row", F.row_number().over(newest)).filter(F.col("row") <= count)
    listed = securities.select("symbol", "kind", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"))
    skip = F.col("source").isin(list(stock_only)) & (F.col("kind") != "stock")
    status = (
        F.when(skip, "not_applicable")
        .when(F.col("row").isNull(), "missing")
        .when(F.col("source").isin(list(failed)), "stale")
        .otherwise("available")
    )
    joined = listed.join(top, ["symbol", "source"], "left").withColumn("status", status)
    return joined.filter((F.col("status") != "not_applicable") | F.coalesce(F.col("row") == 1, F.lit(True)))


def dual_view(observations: DataFrame, signal_cutoff: Column, as_of: Column) -> DataFrame:
    """Current and at-signal versions side by side, tagged by view."""
    now = latest_versions(observations, None, as_of).withColumn("view", F.lit("current"))
    then = latest_versions(observations, signal_cutoff, as_of).withColumn("view", F.lit("at_signal"))
    return now.unionByName(then)


def source_summary(observations: DataFrame, health: DataFrame) -> DataFrame:
    """Coverage of the latest versions per source beside its health row; a source never collected says so."""
    seen = latest_versions(observations).groupBy("source").agg(
        F.count_distinct("symbol").alias("covered_symbols"),
        F.max("data_date").alias("latest_data_date"),
        F.count("*").alias("observations"),
    )
    return health.join(seen, "source", "left").select(
        "source",
        F.coalesce("covered_symbols", F.lit(0)).alias("covered_symbols"),
        "latest_data_date",
        F.coalesce("observations", F.lit(0)).alias("observations"),
        F.coalesce("status", F.lit("not_collected")).alias("status"),
    )


def snapshot_rows(snapshots: DataFrame, manifest: DataFrame, snapshot_id: str | None = None) -> DataFrame:
    """Rows of one snapshot, the latest by default; the id filter prunes the snapshot_id partitions."""
    if snapshot_id is not None:
        return snapshots.filter(F.col("snapshot_id") == snapshot_id)
    latest = manifest.orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(1).select("snapshot_id")
    return snapshots.join(F.broadcast(latest), "snapshot_id", "left_semi")


def first_originals(manifest: DataFrame) -> DataFrame:
    """One signal per (as_of, ranker version): the earliest snapshot wins."""
    return (
        manifest.groupBy("as_of", "ranker_version")
        .agg(F.min(F.struct("created_at", "snapshot_id")).alias("_f"))
        .select("as_of", "ranker_version", "_f.created_at", "_f.snapshot_id")
    )


def bars_across_snapshots(snapshot_bars: DataFrame, manifest: DataFrame, selected_created_at: Column | None = None) -> DataFrame:
    """Each bar from the newest snapshot that holds it, with that snapshot's id.

    The manifest has one row per snapshot; bars are reduced per (symbol, date) on the map side.
    """
    stamps = manifest.select("snapshot_id", "created_at")
    if selected_created_at is not None:
        stamps = stamps.filter(F.col("created_at") <= selected_created_at)
    stamped = snapshot_bars.join(stamps, "snapshot_id")
    values = F.struct(*[F.col(c) for c in snapshot_bars.columns if c not in ("symbol", "date")])
    return (
        stamped.groupBy("symbol", "date")
        .agg(F.max_by(values, F.struct("created_at", "snapshot_id")).alias("_b"))
        .select("symbol", "date", "_b.*")
    )


def history_listing(manifest: DataFrame, limit: int | None = None) -> DataFrame:
    listed = manifest.orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return listed if limit is None else listed.limit(limit)
