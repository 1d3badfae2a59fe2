"""Benchmark decontamination: which documents hold a test item, by size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles over letters and digits (A-Z lower-cased). Items are partitioned by size:
class B holds items of B/2 < n <= B shingles. Items of up to 32 shingles are too small for minima; they are keyed by as many of
their shingles as a document that holds enough of them can't all lack (n - 0.8 n + 1), and are found exactly. For each other class a document is read as overlapping windows of two neighbouring
blocks of B shingles, so a short item inside a document of any length meets a window of about its own size, and a MinHash
signature finds it: with containment 0.8 a window and the item agree in one of 48 minima with probability over 0.9999.
The minima of larger blocks come from those of smaller ones, so each shingle is hashed once.

A document's minima are first tested on a bitmap of the items' minima (of bounded size; a full one only lets more pass),
those that pass join the items' minima exactly, and every candidate is verified by exact shingle containment in the whole
document. Documents without a candidate never leave their task.

Null and empty texts hold nothing and are held by nothing. A text of fewer than five words is one shingle: such an item is
found only where it is a whole document. Repeated documents and items give a row for each distinct pair of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import parked, plain_words, shingles

WORDS = 5
LEAST = 0.8
MINIMA = 48
SMALLEST = 32
# The bitmap has 256 bits for each key of an item and at most this many (32 MiB).
MAX_BITS = 1 << 28
_ODD = np.random.default_rng(20).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(text: str | None) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s) for s in shingles(plain_words(text), WORDS)], dtype=np.uint64)


def block_minima(h: np.ndarray, block: int = SMALLEST) -> np.ndarray:
    """Minima of each block under each permutation, one row a block."""
    out = []
    for at in range(0, len(h), block * 128):
        part = h[at : at + block * 128, None] * _ODD[None, :]
        out.append(np.minimum.reduceat(part, np.arange(0, len(part), block), axis=0))
    return np.concatenate(out) if out else np.zeros((0, MINIMA), dtype=np.uint64)


def merged(minima: np.ndarray) -> np.ndarray:
    """Minima of blocks twice as large."""
    return np.minimum.reduceat(minima, np.arange(0, len(minima), 2), axis=0)


def size_class(n: int) -> int:
    """0 for up to SMALLEST shingles, 1 for up to twice as many, and so on."""
    return max(0, (n - 1).bit_length() - (SMALLEST - 1).bit_length())


def keys(minima: np.ndarray, cls: int) -> np.ndarray:
    """Minima made distinct by class and permutation."""
    salt = np.arange(minima.shape[1], dtype=np.uint64) + np.uint64(cls * MINIMA + 1)
    mixed = (minima ^ salt[None, :] * _MIX) * _MIX
    return mixed ^ mixed >> np.uint64(29)


def shingle_keys(h: np.ndarray) -> np.ndarray:
    """Keys of single shingles, distinct from those of minima."""
    return keys(h[:, None], 0)[:, 0]


def item_keys(h: np.ndarray, least: float) -> np.ndarray:
    """The keys of an item with the distinct hashes `h`."""
    cls = size_class(len(h))
    if cls:
        return np.unique(keys((h[:, None] * _ODD[None, :]).min(axis=0)[None, :], cls))
    return np.unique(shingle_keys(h))[: max(1, len(h) - ceil(least * len(h) - 1e-9) + 1)]


def _item_rows(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, rows = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.unique(hashes(text))
                if len(h):
                    own = item_keys(h, least).view(np.int64).tolist()
                    rows += own
                    ids += [k] * len(own)
                    classes += [size_class(len(h))] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, batch.schema.field(0).type), pa.array(classes, pa.int32())], ["key", "item", "cls"])

    return run


def _bits(key: np.ndarray, size: int, k: int) -> np.ndarray:
    return (key * np.uint64(2 * k + 3) ^ key >> np.uint64(7 * k + 3)) * _MIX >> np.uint64(64 - (size - 1).bit_length())


def bitmap(found: DataFrame) -> np.ndarray:
    """Bits of the items' keys, four for each; filled by an aggregate over words of 32 bits, at most MAX_BITS in all."""
    size = 1 << 12
    wanted = 256 * found.count()
    while size < min(wanted, MAX_BITS):
        size <<= 1

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key = pdf["key"].to_numpy().view(np.uint64)
            at = np.concatenate([_bits(key, size, k) for k in range(4)])
            yield pd.DataFrame({"word": (at >> np.uint64(5)).astype(np.int64), "bits": np.left_shift(1, (at & np.uint64(31)).astype(np.int64))})

    rows = found.select("key").mapInPandas(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(size >> 5, dtype=np.uint32)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def _searcher(classes: list[int], filled):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = filled.value
        size = len(table) << 5
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                h = hashes(text)
                if not len(h) or not classes:
                    continue
                minima = block_minima(h) if classes[-1] else None
                passed, cls = [], 0
                for wanted in classes:
                    while cls < wanted:
                        minima, cls = merged(minima), cls + 1
                    if cls:
                        key = np.unique(keys(np.minimum(minima[:-1], minima[1:]) if len(minima) > 1 else minima, cls))
                    else:
                        key = np.unique(shingle_keys(h))
                    for k in range(4):
                        at = _bits(key, size, k)
                        key = key[table[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1) == 1]
                    passed.append(key)
                found = np.concatenate(passed)
                if len(found):
                    rows.append(row)
                    hits.append(found.view(np.int64))
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(hits, pa.list_(pa.int64()))], ["doc", "text", "keys"])

    return run


def _shared(doc: pd.Series, item: pd.Series) -> pd.DataFrame:
    rows = []
    for d, i in zip(doc, item):
        own = set(shingles(plain_words(i), WORDS))
        rows.append((len(own), len(own & set(shingles(plain_words(d), WORDS)))))
    return pd.DataFrame(rows, columns=["n_shingles", "n_shared"], dtype="int64")


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", least: float = LEAST, text: str = "text") -> DataFrame:
    """Pairs `doc_id`, `item_id` with n_shingles (of the item), n_shared and containment of `least` or more."""
    items = items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("words"))
    found = parked(items.mapInArrow(_item_rows(least), f"key long, item {items.schema['item'].dataType.simpleString()}, cls int"), "item-keys")
    classes = sorted(r[0] for r in found.select("cls").distinct().collect())  # one for each doubling of size
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, text string, keys array<bigint>"
    filled = docs.sparkSession.sparkContext.broadcast(bitmap(found))
    hits = parked(rows.mapInArrow(_searcher(classes, filled), schema).withColumn("row", F.monotonically_increasing_id()), "hits")
    pairs = hits.select("row", F.explode("keys").alias("key")).join(found.select("key", "item"), "key").select("row", "item").distinct()
    both = pairs.join(hits.select("row", "doc", "text"), "row").join(items, "item")
    got = both.withColumn("got", F.pandas_udf(_shared, "n_shingles long, n_shared long")("text", "words")).filter(
        F.col("got.n_shared") >= least * F.col("got.n_shingles")
    )
    best = got.groupBy("doc", "item").agg(F.max("got.n_shingles").alias("n_shingles"), F.max("got.n_shared").alias("n_shared"))
    share = (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_shingles", "n_shared", share)
