"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

`judged` adds host, path, the longest fitting rule and a verdict. A URL that no rule fits is blocked if its canonical form
is listed. The list may be of any length: its blocked Bloom filter (blocks of 512 bits, one bit in each of eight words)
lets few other URLs through, and an exact hash join on the canonical form removes those. Everything is DataFrame
expressions. The filter is a table of at most MAX_BLOCKS rows of 72 bytes, so its broadcast is bounded whatever the
list's length; a longer list only raises the share of false hits that the join must remove.

Null URLs and URLs without ``://`` have empty host and path, fit no rule and are never listed; repeated rows are judged
each; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Verdict, host and path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MAX_BLOCKS = 1 << 17
URLS_PER_BLOCK = 32
# Query parameters that only track where a visitor came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.` and default port, path without a closing slash, query sorted and without tracking; null if no URL."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(?<=.)/+$", "")
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(TRACKING))), "&")
    whole = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host != "", whole)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (by its whole text) that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, on, under in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(under)
        name = F.when(fits, F.lit(on + under)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def _word_bit(key: Column, word: int) -> Column:
    """A key's bit in one of a block's eight words, chosen by six bits of a second hash."""
    number = F.shiftrightunsigned(F.xxhash64(F.lit("bits"), key), word * 6).bitwiseAND(F.lit(63).cast("long"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter's blocks that hold bits: block, w0..w7, from an aggregate that combines before its shuffle."""
    k = F.col(key)
    held = listed.select(_block(k, blocks).alias("block"), *[_word_bit(k, w).alias(f"b{w}") for w in range(8)])
    return held.groupBy("block").agg(*[F.bit_or(f"b{w}").alias(f"w{w}") for w in range(8)])


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """`pages` with a struct `filter`: host, path, rule, verdict, canonical, listed. `listed` has a column `canonical`."""
    exact = listed.select(F.col("canonical").alias("_listed")).filter(F.col("_listed").isNotNull()).distinct()
    blocks = min(MAX_BLOCKS, max(1, -(-exact.count() // URLS_PER_BLOCK)))
    filled = bloom(exact, "_listed", blocks)
    u = F.col(url).cast("string")
    parts = F.struct(host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("canonical"))
    rows = pages.select(F.struct(*pages.columns).alias("_row"), parts.alias("_url"))  # no name of the input can clash
    rows = rows.withColumn("_block", _block(F.col("_url.canonical"), blocks))
    words = F.broadcast(filled.select(F.col("block").alias("_b"), F.struct(*[f"w{w}" for w in range(8)]).alias("_w")))
    rows = rows.join(words, F.col("_block") == F.col("_b"), "left")
    every = F.lit(True)
    for w in range(8):
        every &= F.col("_w")[f"w{w}"].bitwiseAND(_word_bit(F.col("_url.canonical"), w)) != 0
    # No canonical form begins with a slash: rows that can't be listed get one of many keys that match nothing.
    apart = F.concat(F.lit("/"), F.pmod(F.monotonically_increasing_id(), F.lit(4093)).cast("string"))
    rows = rows.withColumn("_probe", F.when(F.coalesce(every, F.lit(False)), F.col("_url.canonical")).otherwise(apart))
    probed = rows.join(exact, F.col("_probe") == F.col("_listed"), "left")
    name, verdict = rule_of(F.col("_url.host"), F.col("_url.path"), rules)
    is_listed = F.col("_listed").isNotNull()
    result = F.struct(
        F.col("_url.host").alias("host"),
        F.col("_url.path").alias("path"),
        name.alias("rule"),
        F.coalesce(verdict, F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("_url.canonical").alias("canonical"),
        is_listed.alias("listed"),
    )
    return probed.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c != "filter"], result.alias("filter"))
