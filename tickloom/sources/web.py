"""Bulletin-board pages: index links with native regular expressions, article text in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import article_parts

# Fixed patterns: article and index links of the board, signature and quote marks in article text.
ARTICLE_LINK = r"/bbs/Stock/M\.[A-Za-z0-9.]+\.html"
INDEX_LINK = r"/bbs/Stock/index\d+\.html"
PREVIOUS_WORD = "上頁"
SIGNATURE = "※ 發信站:"


def index_links(pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str = ARTICLE_LINK, base: str = "https://www.ptt.cc") -> DataFrame:
    """Distinct article links of each page in page order, plus the link to the previous index page."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(rf'<a\b[^>]*\bhref="({pattern})"'), F.lit(1))
    previous = F.regexp_extract(F.col(html), rf'<a\b[^>]*\bhref="({INDEX_LINK})"[^>]*>[^<]*{PREVIOUS_WORD}', 1)
    return pages.select(
        key,
        F.transform(F.array_distinct(hrefs), lambda h: F.concat(F.lit(base), h)).alias("links"),
        F.when(previous != "", F.concat(F.lit(base), previous)).alias("previous"),
    )


def article_text(pages: DataFrame, key: str, html: str = "html", main_id: str = "main-content") -> DataFrame:
    """(key, meta, raw_text) per page; parsing is a small helper inside a streaming map over partitions."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [article_parts(h, main_id) for h in batch[html]]
            yield pd.DataFrame({key: batch[key], "meta": [m for m, _ in parts], "raw_text": [t for _, t in parts]})

    return pages.select(key, html).mapInPandas(parse, f"{key} {kind}, meta array<string>, raw_text string")


def articles(parsed: DataFrame, utc_offset_hours: int = 8) -> DataFrame:
    """Title, publication time and own words of each article: no signature tail, no quoted lines."""
    body = F.element_at(F.split("raw_text", SIGNATURE, 2), 1)
    own = F.filter(
        F.split(body, "\n"),
        lambda line: ~(
            F.ltrim(line).startswith(">") | F.ltrim(line).startswith("※ 引述") | F.ltrim(line).startswith(": ")
        ),
    )
    stamp = F.regexp_replace(F.trim(F.get("meta", F.lit(3))), r"\s+", " ")
    local = F.try_to_timestamp(F.regexp_replace(stamp, r"^\w{3} ", ""), F.lit("MMM d HH:mm:ss yyyy"))
    return parsed.select(
        *[c for c in parsed.columns if c not in ("meta", "raw_text")],
        F.substring(F.get("meta", F.lit(2)), 1, 160).alias("title"),
        (local - F.expr(f"interval {utc_offset_hours} hours")).alias("published_at"),
        F.array_join(own, "\n").alias("text"),
    )
