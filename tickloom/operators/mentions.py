"""Post mentions: extraction, deduplication, trailing windows, retention and status roll-ups."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.layout import split_rank
from tickloom.functions.text import AMBIGUOUS_NAMES, MentionMatcher, fold, folded
from tickloom.session import written

USABLE = ("success", "partial")
# A name is looked up by one run of GRAM characters (a shorter name by all it has). Runs of the whole dictionary mark bits of a bitmap of
# fixed size, which goes to every task; tasks that share one much-used run are SALTS.
GRAM, BITS, SALTS = 4, 1 << 24, 16
# A dictionary of at most FEW rows and FEW_CHARS characters goes to every task, as a broadcast table would; a larger one is joined.
FEW, FEW_CHARS = 100_000, 4_000_000


def gram_codes(text: str, sizes: Sequence[int]) -> np.ndarray:
    """Codes of the runs of each size, place by place: one pass of array operations over the text."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = []
    for size in sizes:
        if len(chars) < size:
            continue
        h = np.full(len(chars) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            h = (h ^ chars[k : len(chars) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def keyed_words(words: DataFrame) -> DataFrame:
    """`_w` and `_g`, the code of its run that the fewest words have (ties by code)."""

    def codes(batch: pa.Array) -> pa.Array:
        return _lists([np.unique(gram_codes(w, [min(GRAM, len(w))])) for w in batch.to_pylist()])

    runs = words.select("_w", F.explode(F.arrow_udf(codes, "array<bigint>")("_w")).alias("_g"))
    shared = runs.groupBy("_g").agg(F.count("*").alias("_n"))
    return runs.join(shared, "_g").groupBy("_w").agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))


def _bit(code: Column) -> Column:
    return code.bitwiseAND(F.lit(BITS - 1))


def bitmap(keys: DataFrame) -> np.ndarray:
    """A flag for each possible low part of a code; at most BITS / 64 rows come to the driver, however large the dictionary."""
    place = _bit(F.col("_g"))
    parts = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_g & 63 as int))")).alias("bits")).toPandas()
    held = np.zeros(BITS // 64, dtype=np.int64)
    held[parts["at"].to_numpy(dtype=np.int64)] = parts["bits"].to_numpy(dtype=np.int64)
    return held.view(np.uint8)


def is_few(rows: DataFrame, *columns: str) -> bool:
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(F.concat_ws("", *columns))), F.lit(0))).first()
    return size[0] <= FEW and size[1] <= FEW_CHARS


class WordTable:
    """Few words by the codes of their keys, with the flags of the codes: finds all places of the words that a text holds."""

    def __init__(self, keys: DataFrame):
        rows = keys.collect()  # at most FEW
        self.sizes = sorted({min(GRAM, len(r["_w"])) for r in rows})
        flags, self.words = np.zeros(BITS, dtype=bool), {}
        for r in rows:
            word, code = r["_w"], r["_g"]
            run = gram_codes(word, [min(GRAM, len(word))]).tolist().index(code)
            self.words.setdefault(code, []).append((word, run))
            flags[code & (BITS - 1)] = True
        self.bits = np.packbits(flags, bitorder="little")

    def places(self, text: str) -> dict[str, list[int]]:
        """Starts of each held word, ascending: a word is looked at only where its key stands."""
        codes = gram_codes(text, self.sizes)
        hits = np.flatnonzero(flagged(codes, self.bits))
        starts = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(max(0, len(text) - n + 1)) for n in self.sizes]])
        out: dict[str, list[int]] = {}
        for code, at in zip(codes[hits].tolist(), starts[hits].tolist(), strict=True):
            for word, run in self.words.get(code, ()):
                if at >= run and text.startswith(word, at - run):
                    out.setdefault(word, []).append(at - run)
        return out


def flagged(codes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = codes & (BITS - 1)
    return (bits[low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool)


def known_codes(text: str, sizes: Sequence[int], bits: np.ndarray) -> np.ndarray:
    """Distinct codes of a text's runs whose bit is set."""
    codes = gram_codes(text, sizes)
    return np.unique(codes[flagged(codes, bits)])


def keys_of(words: DataFrame, word: str) -> DataFrame:
    listed = words.select(F.col(word).alias("_w")).filter("_w <> ''").distinct()
    return written(keyed_words(listed), f"word-keys-{uuid.uuid4().hex}")


def held_words(texts: DataFrame, words: DataFrame, key: str, text: str, word: str) -> DataFrame:
    """Distinct (key, word) where the text holds the word; words of any number, texts of any length.

    Every word has one key, the rarest of its runs of characters, so a head that all words share costs nothing. A text is
    walked once: its runs whose bit is set are the candidates' keys, an equi-join gives the words, and each text looks for its
    candidates once. A text that repeats a key, or a null one, is found under each of its rows' keys once. Few words are looked
    up by their keys where the text is, without the join.
    """
    keys = keys_of(words, word)
    rows = texts.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    if is_few(keys, "_w"):
        table = texts.sparkSession.sparkContext.broadcast(WordTable(keys))

        def held(batch: pa.Array) -> pa.Array:
            return pa.array([list(table.value.places(t or "")) for t in batch.to_pylist()], pa.list_(pa.string()))

        found = rows.select("_k", F.explode(F.arrow_udf(held, "array<string>")("_t")).alias("_w"))
        return found.select(F.col("_k").alias(key), F.col("_w").alias(word)).distinct()
    sizes = sorted({r[0] for r in keys.select(F.least(F.length("_w"), F.lit(GRAM))).distinct().collect()})
    flags = texts.sparkSession.sparkContext.broadcast(bitmap(keys).tobytes())

    def known(batch: pa.Array) -> pa.Array:
        bits, out = np.frombuffer(flags.value, dtype=np.uint8), []
        for t in batch.to_pylist():
            out.append(known_codes(t or "", sizes, bits))
        return _lists(out)

    hits = rows.select("_k", F.explode(F.arrow_udf(known, "array<bigint>")("_t")).alias("_g"))
    hits = hits.withColumn("_s", F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int"))
    spread = keys.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    near = hits.join(spread, ["_g", "_s"]).groupBy(F.col("_k").alias("_of")).agg(F.collect_set("_w").alias("_near"))
    both = rows.join(near, F.col("_k").eqNullSafe(F.col("_of")))

    def looked_for(bodies: pa.Array, near: pa.Array) -> pa.Array:
        return pa.array([[w for w in ws if w in t] for t, ws in zip(bodies.to_pylist(), near.to_pylist())], pa.list_(pa.string()))

    found = both.select("_k", F.explode(F.arrow_udf(looked_for, "array<string>")("_t", "_near")).alias("_w"))
    return found.select(F.col("_k").alias(key), F.col("_w").alias(word)).distinct()


def mentions(texts: DataFrame, dictionary: DataFrame, key: str, text: str, ambiguous: Sequence[str] = AMBIGUOUS_NAMES) -> DataFrame:
    """Add ``symbols``: the securities each text names; ``key`` identifies a text.

    Each text meets only the entries whose name or code it holds, so the dictionary may be of any size. A column
    ``ambiguous`` of the dictionary marks further names that need a finance word beside them.
    """
    body = texts.select(key, folded(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    marked = F.col("ambiguous") if "ambiguous" in dictionary.columns else F.lit(False)
    name = F.coalesce("name", F.lit(""))
    entries = dictionary.select("symbol", name.alias("name"), (F.coalesce(marked, F.lit(False)) | name.isin(list(ambiguous))).alias("ambiguous"), folded(name).alias("_n"))
    words = entries.select(F.explode(F.array("_n", "symbol")).alias("_word"))
    whole = F.struct("symbol", "name", "ambiguous")
    by_word = entries.select(F.explode(F.array_distinct(F.array("_n", "symbol"))).alias("_word"), whole.alias("_e"))
    if is_few(by_word, "_word", "_e.symbol", "_e.name"):
        return texts.withColumn("symbols", _few_mentions(by_word).asNondeterministic()(F.col(text)))
    held = held_words(body, words, key, "_t", "_word")
    found = held.join(by_word, "_word").groupBy(key).agg(F.collect_set("_e").alias("_entries"))

    @F.pandas_udf("array<string>")
    def identify(bodies: pd.Series, entries: pd.Series) -> pd.Series:
        def one(body, found):
            if found is None or len(found) == 0:
                return []
            return MentionMatcher([(e["symbol"], e["name"], e["ambiguous"]) for e in found]).identify(body)

        return pd.Series([one(b, e) for b, e in zip(bodies, entries, strict=True)])

    # Marked non-deterministic so that a filter on the result is not pushed below it as a second evaluation.
    return texts.join(found, key, "left").withColumn("symbols", identify.asNondeterministic()(F.col(text), F.col("_entries"))).drop("_entries")


def _few_mentions(by_word: DataFrame):
    """The securities a text names, as a function of the text alone: it carries the entries (_word, _e), which are few."""
    listed: dict[str, list] = {}
    for r in by_word.collect():  # at most FEW
        listed.setdefault(r["_word"], []).append(tuple(r["_e"]))
    context = by_word.sparkSession.sparkContext
    table = context.broadcast((WordTable(keys_of(by_word, "_word")), listed))

    @F.pandas_udf("array<string>")
    def identify(bodies: pd.Series) -> pd.Series:
        words, entries = table.value

        def one(body):
            places = words.places(fold(body))
            met = {e for w in places for e in entries[w]}
            return MentionMatcher(met, places).identify(body) if met else []

        return pd.Series([one(b) for b in bodies])

    return identify


def dictionary_hits(texts: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """(text, name) pairs where the name occurs, as a substring, anywhere in the whole text."""
    return held_words(texts, dictionary, key, text, "name")


def unique_posts(posts: DataFrame, available: Sequence[str], now: Column, days: int = 7) -> DataFrame:
    """Posts of usable sources inside the trailing window, one per (source, id); the last arrival wins."""
    inside = posts.filter(
        F.col("source").isin(list(available)) & F.col("published_at").between(now - F.expr(f"interval {days} days"), now)
    )
    row = F.struct(*[F.col(c) for c in posts.columns if c not in ("source", "id")])
    return inside.groupBy("source", "id").agg(F.max_by(row, "seq").alias("_p")).select("source", "id", "_p.*")


def post_mentions(posts: DataFrame) -> DataFrame:
    """One row per (post, symbol), a symbol counting once per post."""
    return posts.withColumn("symbol", F.explode(F.array_distinct("symbols")))


def mention_counts(
    unique: DataFrame, sources: Sequence[str], available: Sequence[str], now: Column, windows: dict[str, int] | None = None
) -> DataFrame:
    """Counts per (window, symbol): per source NULL when the source is unavailable, 0 when it is available and silent."""
    windows = windows or {"24h": 1, "7d": 7}
    spans = [
        F.when(F.col("published_at") >= now - F.expr(f"interval {days} days"), F.lit(name)) for name, days in windows.items()
    ]
    rows = post_mentions(unique).select("source", "symbol", F.explode(F.array_compact(F.array(*spans))).alias("window"))
    per_source = [
        (F.count_if(F.col("source") == s) if s in available else F.lit(None).cast("long")).alias("n_" + s) for s in sources
    ]
    return rows.groupBy("window", "symbol").agg(*per_source, F.count("*").alias("total"))


def mention_evidence(unique: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The posts behind the counts as rows keyed by symbol: a much-named symbol is never gathered into one list."""
    recent = unique.filter(F.col("published_at") >= now - F.expr(f"interval {days} days"))
    return post_mentions(recent).select("symbol", "source", "id", "title", "published_at")


def mention_ranking(counts: DataFrame, source: str = "all") -> DataFrame:
    """Positions per window by total or by one source's count; only positive counts, ties by symbol."""
    column = "total" if source == "all" else "n_" + source
    positive = counts.filter(F.col(column) > 0)
    return split_rank(positive, ["window"], column, ["symbol"])


def retained_posts(previous: DataFrame, fresh: DataFrame, version: int, now: Column, days: int = 7) -> DataFrame:
    """Previous posts of the same identifier version inside the window, merged with new ones; the new arrival wins."""
    kept = previous.filter(
        (F.col("identifier_version") == version) & F.col("published_at").between(now - F.expr(f"interval {days} days"), now)
    ).withColumn("_age", F.lit(0))
    merged = kept.unionByName(fresh.withColumn("_age", F.lit(1)))
    row = F.struct(*[F.col(c) for c in previous.columns if c not in ("source", "id")])
    return merged.groupBy("source", "id").agg(F.max_by(row, F.struct("_age", "seq")).alias("_p")).select("source", "id", "_p.*")


def refuse_empty_collection(statuses: DataFrame) -> DataFrame:
    """One row saying whether a collection run may replace the stored posts: some source must have been usable."""
    return statuses.agg(F.coalesce(F.bool_or(F.col("status").isin(list(USABLE))), F.lit(False)).alias("accepted"))


def status_rollup(batches: DataFrame) -> DataFrame:
    """Source state from its batches (batch ok yes/no): success, partial or failed."""
    return batches.groupBy("source").agg(
        F.count("*").alias("expected_batches"),
        F.count_if("ok").alias("successful_batches"),
        F.when(F.bool_and("ok"), "success").when(F.bool_or("ok"), "partial").otherwise("failed").alias("status"),
    )


def overall_status(statuses: DataFrame) -> DataFrame:
    return statuses.agg(
        F.when(F.bool_and(F.col("status") == "success"), "success")
        .when(F.bool_or(F.col("status").isin(list(USABLE))), "partial")
        .otherwise("failed")
        .alias("status")
    )


def hourly_partials(posts: DataFrame) -> DataFrame:
    """Mentions per (hour, source, symbol): the partial sums a sliding window is assembled from."""
    return post_mentions(posts).groupBy(
        F.date_trunc("hour", "published_at").alias("hour"), "source", "symbol"
    ).agg(F.count("*").alias("mentions"))


def sliding_mentions(partials: DataFrame, now: Column, hours: dict[str, int] | None = None) -> DataFrame:
    """Windows of whole hours ending with the hour of ``now``, summed from hourly partials."""
    hours = hours or {"24h": 24, "7d": 168}
    end = F.date_trunc("hour", now)
    spans = [
        F.when(F.col("hour") > end - F.expr(f"interval {n} hours"), F.lit(name)) for name, n in hours.items()
    ]
    current = partials.filter(F.col("hour") <= end)
    return (
        current.select("symbol", "mentions", F.explode(F.array_compact(F.array(*spans))).alias("window"))
        .groupBy("window", "symbol")
        .agg(F.sum("mentions").alias("total"))
    )
