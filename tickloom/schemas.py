"""Fixed schemas of the stored tables; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS: dict[str, str] = {
    "bars": (
        "symbol string, date date, ord bigint, open double, high double, low double, close double, volume double, "
        "turnover double, mark string, change string, valid boolean"
    ),
    "securities": (
        "symbol string, name string, kind string, listing_date date, currency string, industry string, index_name string, "
        "etf_style string, industry_source string, industry_retrieved_at timestamp"
    ),
    "sessions": "date date, ord bigint",
    "calendar_rules": "date date, is_open boolean, is_holiday boolean",
    "index_bars": "date date, close double",
    "outcomes": (
        "symbol string, signal_date date, horizon int, entry_date date, exit_date date, return_pct double, "
        "recovered boolean, recovery_days int, worst_close_return double"
    ),
    "estimates": (
        "symbol string, horizon int, anchor_date date, target_date date, n bigint, expected_return double, "
        "median_return double, p_positive double, p_recovery double, q10 double, q90 double, worst_close_q10 double, "
        "median_recovery_days double, score double, reasons array<string>, eligible boolean"
    ),
    "predictions": (
        "symbol string, horizon int, signal_date date, exit_date date, expected double, probability double, "
        "actual double, positive double, baseline double, selected boolean"
    ),
    "candidates": (
        "as_of date, symbol string, name string, kind string, etf_style string, group string, close double, "
        "momentum5_pct double, momentum20_pct double, relative_volume double, score double, rank_fraction double, "
        "reasons array<string>"
    ),
    "ten_session_outcomes": (
        "symbol string, signal_date date, status string, entry_date date, exit_date date, entry_price double, "
        "target_price double, touched boolean, potential_fill boolean, terminal_return_pct double"
    ),
    "tracking": (
        "symbol string, signal_date date, kind string, rank bigint, policy_version string, status string, reason string, "
        "net_return_pct double, target_filled boolean, touched boolean, elapsed_sessions int, entry_date date, "
        "entry_price double, exit_date date, exit_price double, target_price double, adverse_before_exit_pct double"
    ),
    "manifest": "snapshot_id string, as_of date, created_at timestamp, signature string",
    "observations": (
        "source string, symbol string, key string, data_date date, period string, published_at timestamp, unit string, "
        "content_hash string, acquired_at timestamp, first_seen_at timestamp, available_at timestamp, seq bigint"
    ),
    "posts": "source string, id string, url string, title string, published_at timestamp, symbols array<string>, seq bigint",
    "quotes": (
        "symbol string, name string, kind string, price double, opening double, volume double, amount double, "
        "day_pct double, gap_pct double, from_open_pct double, updated_at timestamp, trial boolean, seq bigint"
    ),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the table in order and type; an absent column is NULL, an extra one is dropped."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema(table).fields
        ]
    )
