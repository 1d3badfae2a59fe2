"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends and that is at least
`least` words and `exponent` (3 or more) periods long. The basic factors are the stretches of a power of two of words; the factors of
each length are named by pairs of names of half the length, so equal names mean equal factors. A factor's next occurrence
within twice its length gives a distance, and occurrences at one distance after another an arithmetic progression with
that distance as proposed period. The first pair of each progression is extended word by word to both sides; stretches
found from several progressions or lengths are one run. No run is missed: for period q the first length of at least q
words (at least the smallest one used) fits twice, q words apart, into every run, and a run's factor of q or more words recurs after
q words and not before. Once all factors of one length differ, longer ones can't recur and the search ends.

Null and empty texts and texts of fewer than `least` words have no run; very long texts are searched whole, in memory in
proportion to their words; ties in strength go to the smallest start, then period; repeated rows are searched each; other
columns pass through, one named as the output is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import raw

LEAST, EXPONENT = 24, 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def named(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))


def joined(names: np.ndarray, size: int) -> np.ndarray:
    """Names of the factors of twice `size` words from those of `size` words."""
    n = len(names) - size
    return np.unique(names[:n] * (int(names.max()) + 1) + names[size:], return_inverse=True)[1]


def proposals(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that the factors of one length propose, one for each progression."""
    order = np.argsort(names, kind="stable")
    gap = np.diff(order)
    near = (np.diff(names[order]) == 0) & (gap <= 2 * size)
    first = near.copy()
    first[1:] &= ~near[:-1] | (gap[1:] != gap[:-1])
    at = np.flatnonzero(first)
    return order[at], gap[at]


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements of two arrays agree; looks at ever larger parts."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        end = min(n, at + step)
        apart = np.flatnonzero(a[at:end] != b[at:end])
        if len(apart):
            return at + int(apart[0])
        at, step = end, step * 2
    return n


def runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    if exponent < 3 or least < 2:
        raise ValueError("the search is complete for three periods or more and runs of two words or more")
    n = len(words)
    if n < least:
        return []
    base = names = named(words)
    size, smallest = 1, 1
    while 3 * 2 * smallest <= 2 * least:  # a factor of so many words and half as many more fit into every run
        smallest *= 2
    found: dict[int, list[tuple[int, int]]] = {}
    while True:
        if int(names.max()) + 1 == len(names):
            break
        if size >= smallest:
            places, periods = proposals(names, size)
            for k in np.lexsort((places, periods)).tolist():
                at, q = int(places[k]), int(periods[k])
                own = found.setdefault(q, [])
                if own and own[-1][0] <= at and at + size <= own[-1][1]:
                    continue  # inside the run that the proposal before has given
                end = at + size + q
                end += _agreeing(base[end:], base[end - q :])
                start = at - _agreeing(base[:at][::-1], base[: at + q][::-1])
                own.append((start, end))
        if size >= smallest and exponent * size >= n:  # longer factors would be for periods over n / exponent
            break
        names = joined(names, size)
        size *= 2
    return sorted({(s, e - s, q) for q, own in found.items() for s, e in own if e - s >= max(least, exponent * q)})


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods, compared exactly; ties by start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words outside of every run's repetitions, that is all but its first period."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def _struct_array(rows: list[tuple[int, int, int] | None]) -> pa.Array:
    table = np.array([r or (0, 0, 0) for r in rows], dtype=np.int64).reshape(-1, 3)
    mask = pa.array([r is None for r in rows], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], fields=list(_RUN), mask=mask)


def periodic(df: DataFrame, text: str = "text", out: str = "periodic", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The rows of `df` with a struct: n_words, the runs, the strongest run (null without one), the text without repetitions."""
    kind = f"struct<n_words:bigint,runs:array<{RUN}>,strongest:{RUN},collapsed:string>"

    def run(texts: pa.Array) -> pa.Array:
        counts, found, best, kept = [], [], [], []
        for t in texts.to_pylist():
            words = raw(t).split()
            own = runs(words, least, exponent)
            counts.append(len(words))
            found.append(own)
            best.append(strongest(own))
            kept.append(collapsed(words, own).decode("utf-8", "surrogatepass"))
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), _struct_array([r for own in found for r in own]))
        columns = [pa.array(counts, pa.int64()), lists, _struct_array(best), pa.array(kept, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_words", "runs", "strongest", "collapsed"])

    return df.withColumn(out, F.arrow_udf(run, kind)(F.col(text).cast("string")))


def with_cycles(key: Column, text: Column) -> Column:
    """The query's texts: a tenth, chosen by the key's checksum, go on from one of their words in a cycle; a null key is not chosen."""
    h = F.crc32(key.cast("string").cast("binary"))

    def run(codes: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for code, t in zip(codes.to_pylist(), texts.to_pylist()):
            words = raw(t).split() if code is not None and code % 10 == 0 else []
            if words:
                n, g = len(words), code // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                turns = -(-(n - a) // p)
                words = words[:a] + (words[a : a + p] * turns)[: n - a]
                t = b" ".join(words).decode("utf-8", "surrogatepass")
            out.append(t)
        return pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(h, text.cast("string"))
