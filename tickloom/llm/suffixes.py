"""Exact substring dedup: suffix arrays of shards find every string of LENGTH bytes that starts at two or more places.

All places of a corpus can't share one suffix array, but equal strings can be brought to the same shard. Each window of
LENGTH bytes has a key that depends on its content alone: the smallest hash of its 32-byte grams. A document is cut into
spans, runs of window starts whose (leftmost) smallest gram is the same one; every window belongs to one span, and no
two windows of a span are equal. Spans whose key occurs once in the corpus hold no repeat. All others go to the shard of their key with their bytes; equal spans travel once with their count.
A shard's array is built by induced sorting (`induced`), and the permuted common prefixes mark the windows that share
LENGTH bytes or more with a neighbour. The marks join back to the places of the spans, and each document drops the bytes
they cover. A key that gathers more bytes than an array should hold is cut again by the keys of other hashes.

Texts are UTF-8 bytes; null and empty texts have none; a removed byte may be part of a character, so what is kept is
bytes. Very long texts are read piece by piece; ties don't arise, as marks don't depend on an order; repeated rows are
places of their own; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import parked, raw
from tickloom.llm.induced import common_prefixes, suffix_array

LENGTH = 200
GRAM = 32
# Bytes in one suffix array and in one pass over texts; a place in a pass needs PLACE_BITS bits.
ARRAY_BYTES, PIECE_BYTES, PLACE_BITS = 1 << 20, 1 << 20, 22
SEPARATOR = 0xFF  # in no UTF-8 text


def _grams(b: np.ndarray, level: int) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by joining hashes of half the length; another function at each level."""
    rng = np.random.default_rng(7 + level)
    h = rng.integers(0, 2**64, 256, dtype=np.uint64)[b]
    size = 1
    while size < GRAM:
        h = h[:-size] * np.uint64(int(rng.integers(1, 2**62)) * 2 + 1) + h[size:]
        size *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of `width` values."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def spans(b: np.ndarray, ends: np.ndarray, length: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of window starts and keys of the spans of texts laid end to end (`ends` of each text)."""
    none = np.zeros(0, dtype=np.int64)
    if len(b) < length:
        return none, none, np.zeros(0, dtype=np.uint64)
    if len(b) >> PLACE_BITS:
        raise ValueError("more bytes than a pass can number")
    grams = _grams(b, level)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = _least(grams & ~place | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1) & place
    n = len(least)
    edge = np.zeros(n + 1, dtype=np.int32)  # windows over the end of a text don't count
    np.add.at(edge, np.clip(ends - length + 1, 0, n), 1)
    np.add.at(edge, np.clip(ends, 0, n), -1)
    begin = np.r_[0, ends[:-1]]
    short = ends - begin < length
    np.add.at(edge, np.clip(np.where(short, begin, 0), 0, n), short.astype(np.int32))
    np.add.at(edge, np.clip(np.where(short, np.maximum(begin, ends - length + 1), 0), 0, n), -short.astype(np.int32))
    whole = np.cumsum(edge[:-1]) == 0
    cut = np.ones(n, dtype=bool)
    cut[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    inside = begin[begin < n]
    cut[inside] = True
    starts = np.flatnonzero(cut)
    counts = np.diff(np.r_[starts, n])
    kept = whole[starts]
    starts, counts = starts[kept], counts[kept]
    return starts, counts, grams[least[starts].astype(np.int64)]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end, about PIECE_BYTES at a time: bytes, ends, and each part's text number and offset in it.

    A long text comes in parts that overlap by length - 1, so that each of its windows is in one part.
    """
    held, ends, number, offset, size = [], [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE_BYTES):
            part = text[at : at + PIECE_BYTES + length - 1]
            held.append(part)
            size += len(part)
            ends.append(size)
            number.append(k)
            offset.append(at)
            if size >= PIECE_BYTES:
                yield np.frombuffer(b"".join(held), dtype=np.uint8), np.array(ends), np.array(number), np.array(offset)
                held, ends, number, offset, size = [], [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), dtype=np.uint8), np.array(ends), np.array(number), np.array(offset)


def _key_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for b, ends, number, _ in _pieces([raw(t) for t in batch.column(1).to_pylist()], length):
                starts, _, key = spans(b, ends, length)
                own = doc[number[np.searchsorted(ends, starts, side="right")]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key.view(np.int64))], ["doc", "key"])

    return run


def _span_rows(length: int, kept: int = 100_000):
    """Rows of two kinds: a place (doc, start) of each span with a repeated key, and the bytes of each distinct span with the
    number of its places, combined before they leave the task as far as `kept` entries go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("n", pa.int32()), ("doc", pa.int64()), ("start", pa.int64()), ("places", pa.int64()), ("data", pa.binary())])
        held: dict[tuple[int, int], list] = {}

        def flushed() -> pa.RecordBatch:
            rows = [(k, c, n, None, None, places, data) for (k, c), (n, places, data) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = [np.array(w, dtype=np.int64) for w in batch.column(2).to_pylist()]
            for b, ends, number, offset in _pieces([raw(t) for t in batch.column(1).to_pylist()], length):
                starts, counts, key = spans(b, ends, length)
                part = np.searchsorted(ends, starts, side="right")
                key, owner = key.view(np.int64), number[part]
                keep = np.zeros(len(key), dtype=bool)
                edges = np.searchsorted(owner, np.arange(owner[0], owner[-1] + 2)) if len(owner) else []
                for k in range(len(edges) - 1):
                    lo, hi = edges[k], edges[k + 1]
                    if lo < hi:
                        keep[lo:hi] = np.isin(key[lo:hi], wanted[owner[lo]])
                begin = np.r_[0, ends[:-1]]
                data = b.tobytes()
                starts, counts, key, part = starts[keep], counts[keep], key[keep], part[keep]
                contents = []
                for s, n, k in zip(starts.tolist(), counts.tolist(), key.tolist()):
                    own = data[s : s + n + length - 1]
                    content = xxhash.xxh3_64_intdigest(own) - (1 << 63)
                    contents.append(content)
                    entry = held.get((k, content))
                    if entry is None:
                        held[k, content] = [n, 1, own]
                    else:
                        entry[1] += 1
                if contents:
                    doc = docs[number[part]]
                    at = starts - begin[part] + offset[part]
                    columns = [key, np.array(contents, dtype=np.int64), counts.astype(np.int32), doc, at.astype(np.int64)]
                    columns = [pa.array(x) for x in columns] + [pa.nulls(len(contents), pa.int64()), pa.nulls(len(contents), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                if len(held) > kept:
                    yield flushed()
        if held:
            yield flushed()

    return run


def marked(texts: list[bytes], counts: list[int], length: int = LENGTH, level: int = 1) -> list[np.ndarray]:
    """For each text, whether each of its first `counts` window starts begins a string that starts at two places of the texts."""
    if sum(map(len, texts)) > ARRAY_BYTES and len(texts) > 1:
        done = _cut_again(texts, counts, length, level)
        if done is not None:
            return done
    t = np.frombuffer(bytes([SEPARATOR]).join(texts), dtype=np.uint8)
    prior, shared = common_prefixes(t, suffix_array(t))
    again = np.zeros(len(t), dtype=bool)
    long = np.flatnonzero(shared >= length)
    again[long] = True
    again[prior[long]] = True
    out, at = [], 0
    for text, n in zip(texts, counts):
        out.append(again[at : at + n])
        at += len(text) + 1
    return out


def _cut_again(texts: list[bytes], counts: list[int], length: int, level: int) -> list[np.ndarray] | None:
    """The same marks from smaller arrays: windows dealt by their key under another hash; None where that doesn't part them."""
    if level > 6:
        return None
    found, base = [], 0
    for b, ends, number, _ in _pieces(texts, length):
        own = spans(b, ends, length, level)
        found.append((own[0] + base, own[1], own[2], number[np.searchsorted(ends, own[0], side="right")]))
        base += len(b)
    starts, sizes, key, owner = map(np.concatenate, zip(*found))
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begin = np.cumsum([0, *map(len, texts)])[:-1]
    out = [np.zeros(n, dtype=bool) for n in counts]
    order = np.argsort(key, kind="stable")
    edges = np.r_[0, np.flatnonzero(np.diff(key[order])) + 1, len(order)]
    weight = sizes[order] + length - 1
    groups = [order[a:z] for a, z in zip(edges[:-1], edges[1:])]
    if len(groups) == 1 and level > 3:
        return None
    batch: list[np.ndarray] = []
    size = 0

    def solve(part: np.ndarray) -> None:
        seen: dict[bytes, list[int]] = {}
        for k in part.tolist():
            seen.setdefault(b[starts[k] : starts[k] + sizes[k] + length - 1].tobytes(), []).append(k)
        marks = marked(list(seen), [len(x) - length + 1 for x in seen], length, level + 1)
        for (_, places), mark in zip(seen.items(), marks):
            for k in places:
                at = int(starts[k] - begin[owner[k]])
                out[owner[k]][at : at + sizes[k]] = True if len(places) > 1 else mark

    for group, a, z in zip(groups, edges[:-1], edges[1:]):
        own = int(weight[a:z].sum())
        if batch and size + own > ARRAY_BYTES:
            solve(np.concatenate(batch))
            batch, size = [], 0
        batch.append(group)
        size += own
    if batch:
        solve(np.concatenate(batch))
    return out


def _shard(length: int):
    """Marks of sorted rows (key, content, places, data): runs of marked window starts within each span."""

    def solved(rows: dict[tuple[int, int], list]) -> pa.RecordBatch:
        names = list(rows)
        texts = [rows[k][1] for k in names]
        marks = marked(texts, [len(x) - length + 1 for x in texts], length)
        got = []
        for name, mark in zip(names, marks):
            if rows[name][0] > 1:
                lo, hi = np.array([0]), np.array([len(mark)])
            else:
                edge = np.diff(np.r_[0, mark.astype(np.int8), 0])
                lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if len(lo):
                got.append((*name, lo.tolist(), hi.tolist()))
        cols = list(zip(*got)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, kinds)], ["key", "content", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size, last = 0, None
        for batch in batches:
            for key, content, places, data in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and size > ARRAY_BYTES // 2:
                    yield solved(held)
                    held, size = {}, 0
                last = key
                entry = held.get((key, content))
                if entry is None:
                    held[key, content] = [places, data]
                    size += len(data)
                else:
                    entry[0] += places
        if held:
            yield solved(held)

    return run


def _cleaned(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Marks of all documents laid flat: for each run of window starts its first and end in the document.
            marks = batch.column(2)
            per_doc = np.r_[0, np.cumsum(marks.value_lengths().to_numpy(zero_copy_only=False))]
            spans_ = marks.flatten()
            lo, hi = spans_.field("lo"), spans_.field("hi")
            runs = lo.value_lengths().to_numpy(zero_copy_only=False)
            base = np.repeat(spans_.field("start").to_numpy(zero_copy_only=False), runs)
            first = lo.flatten().to_numpy(zero_copy_only=False) + base
            end = hi.flatten().to_numpy(zero_copy_only=False) + base + length - 1
            per_span = np.r_[0, np.cumsum(runs)]
            rows = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                b = raw(text)
                own = slice(per_span[per_doc[k]], per_span[per_doc[k + 1]])
                edge = np.bincount(first[own], minlength=len(b) + 1) - np.bincount(end[own], minlength=len(b) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
                rows.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), kept))
            cols = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(cols, kinds)]], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def row_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text).cast("string"))


def repeats_removed(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """`key`, n_bytes, n_removed, n_spans and the bytes `kept` of every document that repeats something.

    A document that isn't in the result keeps all it has; `removed_digest` adds those.
    """
    ids = df.select(F.col(key), row_key(key, text).alias("doc")).distinct()
    return _removed(df, key, text, length).join(ids, "doc").select(key, "n_bytes", "n_removed", "n_spans", "kept")


def _removed(df: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans and kept; `doc` is the row's key."""
    if length < 2 * GRAM:
        raise ValueError(f"repeats are found from {2 * GRAM} bytes on")
    rows = df.select(row_key(key, text).alias("doc"), F.col(text).cast("string").alias("text"))
    keys = parked(rows.mapInArrow(_key_rows(length), "doc long, key long"), "span-keys")
    # Written, so that the join below reads plain shuffles and a key with many places can be split over tasks.
    again = parked(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "repeated-keys")
    wanted = keys.join(again, "key").groupBy("doc").agg(F.collect_set("key").alias("wanted"))
    spans_schema = "key long, content long, n int, doc long, start long, places long, data binary"
    found = parked(rows.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_span_rows(length), spans_schema), "span-rows")
    bytes_ = found.filter("places IS NOT NULL").select("key", "content", "places", "data")
    marks = bytes_.repartition("key").sortWithinPartitions("key").mapInArrow(_shard(length), "key long, content long, lo array<bigint>, hi array<bigint>")
    places = found.filter("doc IS NOT NULL").select("key", "content", "doc", "start").join(marks, ["key", "content"])
    by_doc = places.groupBy("doc").agg(F.collect_set(F.struct("start", "lo", "hi")).alias("marks"))
    # Texts are shuffled anew from the input: holding those with repeats in between would take more room than that.
    cleaned = rows.join(by_doc, "doc").select("doc", "text", "marks")
    return cleaned.mapInArrow(_cleaned(length), "doc long, n_bytes long, n_removed long, n_spans long, kept binary")


def removed_digest(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """`key`, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes, for every document."""
    gone = _removed(df, key, text, length).select("doc", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc"])
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = df.select(F.col(key), row_key(key, text).alias("doc"), F.octet_length(own).cast("long").alias("n_bytes"), F.sha2(own, 256).alias("_whole"))
    return whole.join(gone, "doc", "left").select(
        key, "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256")
    )
