"""Row predicates, reasons, list filters and checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import HORIZONS, adjusted, finite, valid_bar

# Words in a fund or index name that place its assets abroad or at home.
FOREIGN_TERMS = ("美國", "日本", "中國", "大陸", "香港", "印度", "韓國", "全球", "世界", "越南", "歐洲", "NASDAQ", "標普", "S&P")
DOMESTIC_TERMS = ("台灣", "臺灣", "台股", "臺股", "中華民國")
# Exclusion reasons as shown to the reader.
REASON_CURRENCY = "外幣交易版本：尚未加入匯率與外幣流動性門檻，暫不排行"
REASON_NO_BAR = "當日無行情／停牌或尚未上市，暫不估計"
REASON_SHORT = "歷史資料不足20個交易日暖機"
REASON_FEATURES = "最近20日有價格調整、缺漏或無效價格，暫不估計"


def with_validity(bars: DataFrame) -> DataFrame:
    """Invalid bars are kept and flagged, so that a window across them is rejected rather than closed up."""
    return bars.withColumn("valid", valid_bar())


def as_of_cap(df: DataFrame, as_of: Column, day: str = "date") -> DataFrame:
    return df.filter(F.col(day) <= as_of)


def _mentions(terms: Sequence[str]) -> Column:
    texts = (F.coalesce(F.col("name"), F.lit("")), F.coalesce(F.col("index_name"), F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(term)) for term in terms for t in texts])


def tradable_region() -> Column:
    """Local-currency stocks, and funds whose name or index names the home market and no foreign one."""
    home = F.coalesce(F.col("currency"), F.lit("TWD")) == "TWD"
    fund = (F.col("kind") == "etf") & ~_mentions(FOREIGN_TERMS) & _mentions(DOMESTIC_TERMS)
    return home & ((F.col("kind") == "stock") | fund)


def security_group(kind: str = "kind", style: str = "etf_style") -> Column:
    return (
        F.when(F.col(kind) == "stock", F.lit("stock"))
        .when(F.col(style) == "active", F.lit("active_etf"))
        .otherwise(F.lit("passive_etf"))
    )


def reasons_of(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in pairs]))


def market_exclusions(securities: DataFrame, series: DataFrame) -> DataFrame:
    """Why a security is not estimated. ``series`` holds per symbol: last_date, n_bars, has_features; with as_of."""
    joined = securities.join(series, "symbol", "left")
    pre = reasons_of(
        (F.coalesce(F.col("currency"), F.lit("TWD")) != "TWD", REASON_CURRENCY),
        (F.col("last_date").isNull() | (F.col("last_date") != F.col("as_of")), REASON_NO_BAR),
        (F.coalesce(F.col("n_bars"), F.lit(0)) < 21, REASON_SHORT),
    )
    late = F.when(~F.coalesce(F.col("has_features"), F.lit(False)), F.array(F.lit(REASON_FEATURES))).otherwise(
        F.array().cast("array<string>")
    )
    return joined.withColumn("_pre", pre).withColumn("reasons", F.when(F.size("_pre") > 0, F.col("_pre")).otherwise(late)).drop("_pre")


def list_filter(
    rows: DataFrame, horizon: int = 7, kind: str = "all", eligibility: str = "all", query: str = "", positive_all: bool = False
) -> DataFrame:
    """Filter a (symbol x horizon) estimate table to the securities a reader asked for; keeps the chosen horizon.

    The all-horizons test is one grouped pass; a symbol missing any horizon is not positive in all of them.
    """
    selected = rows.filter(F.col("horizon") == horizon)
    text = query.strip().lower()
    if text:
        selected = selected.filter(F.contains(F.lower(F.concat_ws(" ", "symbol", F.coalesce("name", F.lit("")))), F.lit(text)))
    if kind != "all":
        selected = selected.filter(F.col("kind") == kind)
    chosen = F.coalesce(F.col("eligible"), F.lit(False))
    if eligibility == "eligible":
        selected = selected.filter(chosen)
    elif eligibility == "excluded":
        selected = selected.filter(~chosen)
    if positive_all:
        good = (
            rows.filter(F.col("horizon").isin(list(HORIZONS)) & (finite("expected_return") > 0))
            .groupBy("symbol")
            .agg(F.count_distinct("horizon").alias("_h"))
            .filter(F.col("_h") == len(HORIZONS))
        )
        selected = selected.join(good.select("symbol"), "symbol", "left_semi")
    return selected


def search_key(text) -> Column:
    """Search form of a code or a short name; full-width forms are folded by the caller's NFKC column if needed."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.lower(F.translate(F.coalesce(c, F.lit("")), "臺", "台")))


def security_search(securities: DataFrame, query: str, normalise=search_key) -> DataFrame:
    """Substring match on code or name; an exact code comes first, then code order."""
    wanted = normalise(F.lit(query))
    code, name = normalise("symbol"), normalise("name")
    return (
        securities.filter(F.contains(code, wanted) | F.contains(name, wanted))
        .withColumn("exact", code == wanted)
        .orderBy(F.desc("exact"), "symbol")
    )


def watchlist(lists: DataFrame, column: str = "entry", pattern: str = r"^[0-9]{4,6}[A-Z]?$") -> DataFrame:
    """Upper-case codes split on commas and blanks, first occurrence kept, with a verdict on the whole list."""
    parts = F.array_distinct(F.filter(F.split(F.upper(F.col(column)), r"[,\s]+"), lambda p: p != ""))
    return lists.withColumn("symbols", parts).withColumn(
        "accepted", (F.size("symbols") > 0) & F.forall("symbols", lambda s: s.rlike(pattern))
    )


def unknown_symbols(requested: DataFrame, securities: DataFrame) -> DataFrame:
    return requested.join(securities.select("symbol"), "symbol", "left_anti")


def last_rows(bars: DataFrame, count: int, order: str = "date") -> DataFrame:
    """The last ``count`` rows per symbol; the limit is applied before the shuffle as well."""
    newest = Window.partitionBy("symbol").orderBy(F.desc(order))
    return bars.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= count)


def chart_rows(bars: DataFrame, count: int = 60) -> DataFrame:
    """The last bars of each symbol that can be drawn: all four prices finite."""
    drawable = reduce(lambda a, b: a & b, [finite(c).isNotNull() for c in ("open", "high", "low", "close")])
    return last_rows(bars, count).filter(drawable).drop("_rn")


def chart_summary(bars: DataFrame, features: DataFrame, count: int = 60) -> DataFrame:
    """Price range of the drawable bars and how many of the last bars carry a signal."""
    drawn = chart_rows(bars, count).groupBy("symbol").agg(
        F.count("*").alias("bars"), F.min("low").alias("min_price"), F.max("high").alias("max_price")
    )
    marked = (
        last_rows(features, count)
        .filter(F.size("labels") > 0)
        .groupBy("symbol")
        .agg(F.count("*").alias("signal_days"), F.max("date").alias("last_signal"))
    )
    return drawn.join(marked, "symbol", "left")


def sparkline(bars: DataFrame, count: int = 20) -> DataFrame:
    """Range and direction of the last closes; fewer than two finite closes give no line."""
    recent = last_rows(bars, count).filter(finite("close").isNotNull())
    return (
        recent.groupBy("symbol")
        .agg(
            F.count("*").alias("points"),
            F.min("close").alias("low"),
            F.max("close").alias("high"),
            F.min_by("close", "date").alias("_first"),
            F.max_by("close", "date").alias("_last"),
        )
        .filter("points >= 2")
        .withColumn("direction", F.when(F.col("_last") >= F.col("_first"), "up").otherwise("down"))
        .drop("_first", "_last")
    )


def batch_gate(requested: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """One row: may a watch-list batch be published? Every requested symbol needs a bar exactly on as_of."""
    last = bars.filter(F.col("date") <= as_of).groupBy("symbol").agg(F.max("date").alias("last_date"))
    missing = F.count_if(F.col("last_date").isNull() | (F.col("last_date") != as_of))
    return requested.join(last, "symbol", "left").agg(
        F.count("*").alias("requested"), missing.alias("missing"), (missing == 0).alias("accepted")
    )


def allowed_links(rows: DataFrame, hosts: DataFrame, url: str = "url", out: str = "link") -> DataFrame:
    """Add the link itself when it is https on a host of ``hosts`` (column ``host``), else an empty string."""
    listed = hosts.select(F.col("host").alias("_host")).filter("_host IS NOT NULL").distinct()
    own = F.when(F.try_parse_url(F.col(url), F.lit("PROTOCOL")) == "https", F.try_parse_url(F.col(url), F.lit("HOST")))
    both = rows.withColumn("_own", own).join(listed, F.col("_own") == F.col("_host"), "left")
    return both.withColumn(out, F.when(F.col("_host").isNotNull(), F.col(url)).otherwise(F.lit(""))).drop("_own", "_host")


def source_manifest(evidence: DataFrame, families: dict[str, str]) -> DataFrame:
    """Provenance per fetched url: provider family by host, dataset, requested symbol and period."""
    from tickloom.functions.scalars import url_dataset, url_host, url_param

    family = F.lit("unknown")
    for host, name in families.items():
        family = F.when(url_host("url") == host, F.lit(name)).otherwise(family)
    return evidence.select(
        "url",
        family.alias("source_family"),
        url_dataset("url").alias("dataset"),
        url_param("url", "stockNo").alias("symbol"),
        url_param("url", "date").alias("requested_period"),
        *[c for c in ("fetched_at", "sha256", "raw_file") if c in evidence.columns],
    )


def source_status(manifest: DataFrame, family: str) -> DataFrame:
    """single_source only when there is evidence and all of it comes from the one family."""
    return manifest.agg(
        F.count("*").alias("items"),
        F.count_distinct("source_family").alias("families"),
        F.when((F.count("*") > 0) & F.bool_and(F.col("source_family") == family), "single_source")
        .otherwise("missing_evidence")
        .alias("verification_status"),
    )
