"""SimHash near-dedup by a generalised pigeonhole search.

A fingerprint has 64 bits: bit k is 1 if it is set in over half of the XXH64 values (seed 42) of a text's word shingles.
Two fingerprints link at `within` or fewer differing bits. The search cuts the 64 bits into parts and gives part p its own
threshold t[p] (-1 skips it). If the sum of (t[p] + 1) exceeds `within`, then any linked pair differs in at most t[p] bits
of some part p. `plan` puts correlated bits into one part and finds the thresholds by dynamic programming on estimated
candidate counts; both come from a bounded sample of fingerprints and steer cost only: every plan finds every link.

Each fingerprint is filed under its own value of every part and probes all values within t[p] bits. Files are read in
runs sorted by part and value; a run's links are verified on all 64 bits, and only a forest of them is passed on, so a
group of n near copies passes on n - 1 links and not n * n. Runs of over `run_rows` fingerprints are first cut again: the
bits outside the part are dealt into within + 1 slices, one of which linked fingerprints share whole, and what is still
too long is compared block against block. No cap drops a row.

Null and empty texts have the fingerprint zero and link like any other; fewer words than a shingle give one shingle of
the whole text; exact copies share a fingerprint and are compared once; repeated rows count as copies; a null doc_id gets
the component of its text and names none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import forget, lower_words, parked, shingles
from tickloom.llm.graph import components

SEED = 42
# Samples that only steer cost: fingerprints of a plan, texts whose shingles are counted, and how many common shingles are kept.
SAMPLE, SAMPLE_TEXTS, MAX_COMMON = 4096, 16384, 500_000
# Rows of shingles that are paired at a time, and how many of the shingles before its own a row names.
PAIR_ROWS = 65536
EARLIER = 3
# Bits of a set's sketch at most, and shingles of either side of a cell in which pairs are compared.
SKETCH_BITS = 8192
CELL_SHINGLES = 100_000


def hashes_of(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    return np.array([xxhash.xxh64_intdigest(r, SEED) for r in shingles(lower_words(text), words)], dtype="<u8")


def prints_of(text: str | None, words: int = 4, count: int = 1) -> list[int]:
    """Fingerprints of a text: the first from the shingles' hashes, others from the same hashes mixed anew."""
    return _prints(hashes_of(text, words), count)


def _prints(hashes: np.ndarray, count: int) -> list[int]:
    if not len(hashes):
        return [0] * count
    total = np.zeros((count, 64), dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # a long text is counted piece by piece
        h = hashes[at : at + 65536]
        for k in range(count):
            own = h if k == 0 else _mixed(h, k)
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[k] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(text: str | None, words: int = 4) -> int:
    return prints_of(text, words)[0]


def fingerprints(df: DataFrame, text: str = "text", words: int = 4, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """The rows of `df` with a fingerprint, a signed long, for each of `names`."""

    def each(texts: pd.Series) -> pd.DataFrame:
        rows = np.array([prints_of(t, words, len(names)) for t in texts], dtype=np.uint64).reshape(-1, len(names))
        return pd.DataFrame(rows.view(np.int64), columns=list(names))

    schema = ", ".join(f"{n} long" for n in names)
    got = df.withColumn("_prints", F.pandas_udf(each, schema)(F.col(text).cast("string")))
    return got.withColumns({n: F.col("_prints")[n] for n in names}).drop("_prints")


@dataclass(frozen=True)
class Plan:
    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def ball(bits: int, within: int) -> int:
    return sum(comb(bits, k) for k in range(within + 1))


def correlated_parts(sample: np.ndarray, parts: int) -> tuple[tuple[int, ...], ...]:
    """Bits dealt into parts of equal size: a part grows by the bit most correlated with those it has."""
    bits = (sample[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0) if len(bits) else 0
    spread = (bits.std(axis=0) if len(bits) else np.zeros(64)) + 1e-9
    like = np.abs(bits.T @ bits / max(1, len(bits)) / np.outer(spread, spread))
    free, out = list(range(64)), []
    for p in range(parts):
        size = (64 - sum(map(len, out))) // (parts - p)
        own = [free.pop(0)]
        while len(own) < size:
            best = max(free, key=lambda b: (like[b, own].sum(), -b))
            free.remove(best)
            own.append(best)
        out.append(tuple(sorted(own)))
    return tuple(out)


def values(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The value of a part: its bits drawn together."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def plan(sample: np.ndarray, rows: int, within: int, counts: tuple[int, ...] = (3, 4)) -> Plan:
    """The cheapest parts and thresholds for `rows` fingerprints.

    The cost of a part at threshold t is what it probes (rows shuffled) and the candidates it is expected to verify, the
    latter from how many sampled pairs differ in at most t bits of the part.
    """
    best = None
    for m in counts:
        parts = correlated_parts(sample, m)
        need = within - m + 1  # the sum of thresholds, with -1 for a part that is skipped
        costs = []
        for bits in parts:
            v = values(sample[:1024], bits)
            n = len(v)
            near = np.bitwise_count(v[:, None] ^ v[None, :])[np.triu_indices(n, 1)] if n > 1 else np.zeros(0)
            size = len(bits)
            line = [0.0]
            for t in range(within + 1):
                seen = float((near <= t).mean()) if len(near) else 0.0
                line.append(rows * (1 + ball(size, t)) * 50 + rows * rows / 2 * max(seen, ball(size, t) / 2**size))
            costs.append(line)
        table = {0: (0.0, ())}  # sum of thresholds so far, each taken plus one -> cost, thresholds
        for line in costs:
            nxt: dict[int, tuple[float, tuple]] = {}
            for got, (cost, chosen) in table.items():
                for t, own in enumerate(line):
                    to = min(got + t, need + m)
                    if to not in nxt or cost + own < nxt[to][0]:
                        nxt[to] = (cost + own, (*chosen, t - 1))
            table = nxt
        cost, chosen = table[need + m]
        if best is None or cost < best[0]:
            best = (cost, Plan(parts, chosen))
    return best[1]


def _probes(within: int, how: Plan):
    """For batches of fingerprints: rows (part, value, fp, own) of their own files and of all values they probe."""
    flips = [
        np.array([sum(1 << k for k in c) for t in range(threshold + 1) for c in combinations(range(len(bits)), t)], dtype=np.uint64)
        for bits, threshold in zip(how.parts, how.thresholds)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                own = fp[at : at + 4096]
                for p, (bits, flip) in enumerate(zip(how.parts, flips)):
                    if not len(flip):
                        continue
                    v = values(own, bits)
                    probe = (v[:, None] ^ flip[None, :]).ravel()
                    n = len(probe)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(probe.view(np.int64) << 3 | p),
                            pa.array(np.repeat(own, len(flip)).view(np.int64)),
                            pa.array(np.arange(n) % len(flip) == 0),
                        ],
                        ["file", "fp", "own"],
                    )

    return run


class Forest:
    """Union-find over the fingerprints of one run."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def run_links(filed: np.ndarray, probing: np.ndarray, within: int) -> list[tuple[int, int]]:
    """A forest of the links between filed fingerprints and all of a run (filed ones first), nearest links first."""
    every = np.concatenate([filed, probing])
    forest, out = Forest(len(every)), []
    step = max(1, 1_000_000 // max(1, len(every)))
    found = []
    for at in range(0, len(filed), step):
        apart = np.bitwise_count(filed[at : at + step, None] ^ every[None, :])
        i, j = np.nonzero(apart <= within)
        keep = i + at < j
        found.append((i[keep] + at, j[keep], apart[i[keep], j[keep]]))
        if sum(len(x[0]) for x in found) > 4_000_000:  # what is joined already needs no more links
            out += _joined(forest, every, found, within)
            found = []
    return out + _joined(forest, every, found, within)


def _joined(forest: Forest, every: np.ndarray, found: list[tuple], within: int) -> list[tuple[int, int]]:
    i, j, apart = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=int),) * 3
    out = []
    for d in range(within + 1):
        level = np.flatnonzero(apart == d)
        if len(level) > 64:
            root = np.array([forest.root(x) for x in range(len(every))])
            level = level[root[i[level]] != root[j[level]]]
        for x, y in zip(i[level].tolist(), j[level].tolist()):
            if forest.join(x, y):
                out.append((int(every[x]), int(every[y])))
    return out


def _verify(within: int):
    """Links of sorted rows (file, fp, own); a run goes over batch borders."""

    def pairs(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(key)]
        filed = np.add.reduceat(own.astype(np.int64), starts)
        out: list[tuple[int, int]] = []
        for s, e in zip(starts[(ends - starts > 1) & (filed > 0)], ends[(ends - starts > 1) & (filed > 0)]):
            f, o = fp[s:e], own[s:e]
            out += run_links(f[o], f[~o], within)
        two = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(now[0]):
                continue
            now = (now[0], now[1].view(np.uint64), now[2])
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last run may go on in the next batch
            if held and held[-1][0][-1] != now[0][0]:
                yield pairs(*map(np.concatenate, zip(*held)))
                held = []
            if cut:
                yield pairs(*map(np.concatenate, zip(*held, tuple(x[:cut] for x in now))))
                held = []
            held.append(tuple(x[cut:] for x in now))
        if held:
            yield pairs(*map(np.concatenate, zip(*held)))

    return run


def links(distinct: DataFrame, within: int = 4, run_rows: int = 20_000) -> DataFrame:
    """Links `a`, `b` between the distinct fingerprints `fp` that connect all that the full set of links connects."""
    rows = distinct.count()
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    how = plan(sample, rows, within)
    filed = distinct.select("fp").mapInArrow(_probes(within, how), "file long, fp long, own boolean")
    sizes = filed.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") > run_rows)
    big = parked(sizes, "large-runs")
    if not big.isEmpty():
        marked = filed.join(big, "file", "left")
        short = marked.filter("n IS NULL").select(F.xxhash64("file").alias("file"), "fp", "own")
        slices = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(_slices(within))])
        cut = marked.filter("n IS NOT NULL").select("file", "fp", "own", F.explode(slices).alias("s"))
        cut = cut.select(F.xxhash64("file", "s.k", "s.v").alias("file"), "fp", "own")
        again = cut.groupBy("file").agg(F.ceil(F.count("*") / run_rows).cast("int").alias("blocks")).filter("blocks > 1")
        cut = cut.join(again, "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        block = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
        pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        cut = cut.select("file", "fp", "own", block.alias("block"), pair)
        filed = short.unionByName(cut.select(F.xxhash64("file", F.least("block", "other"), F.greatest("block", "other")).alias("file"), "fp", "own"))
    return filed.repartition("file").sortWithinPartitions("file").mapInArrow(_verify(within), "a long, b long")


def _slices(within: int) -> list[int]:
    """within + 1 bit masks over all 64 bits, as signed longs: linked fingerprints agree on one of them whole."""
    masks = [sum(1 << b for b in range(k, 64, within + 1)) for k in range(within + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, within: int = 4) -> DataFrame:
    """`key`, `fp` and `component`, the smallest key reachable over links, for every row of `df`."""
    prints = parked(fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", words).select("key", "fp"), "prints")
    firsts = prints.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(links(firsts.select("fp"), within))
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("fp", "component")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def _common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that several texts of a sample have."""
    step = max(1, rows.count() // SAMPLE_TEXTS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(hashes_of(t, words)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], ["h"])

    some = rows.filter(F.pmod("own", F.lit(step)) == 0).select("text").mapInArrow(each, "h long")
    held = parked(some.groupBy("h").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(MAX_COMMON), "common-sample")
    counted = held.toPandas()
    forget(held)
    h, n = counted["h"].to_numpy(dtype=np.int64).view(np.uint64), counted["n"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, int]:
    """The rarest of a set's sorted hashes, by sampled count and hash, and how many of them aren't common.

    There are so many that two sets alike by `least` share one of them, whatever the counts.
    """
    size = min(len(own), len(own) - ceil(least * len(own) - 1e-9) + 1)
    rank = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        rank = np.where(common[at] == own, counts[at], 0)
    first = np.argsort(rank, kind="stable")[:size]
    return own[first], int((rank[first] == 0).sum())


def _node(own: np.ndarray) -> int:
    """A hash of a set of shingles, as a signed long: texts with the same set are copies."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def sketch(own: np.ndarray) -> bytes:
    """For each of at least twice as many bits as a set has shingles (a power of two, `SKETCH_BITS` at most) if an odd number of them falls on it."""
    bits = min(SKETCH_BITS, max(64, 1 << (2 * len(own)).bit_length()))
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of rows; of two of unequal length the longer is folded to the bits of the shorter, which is its set's sketch of that length."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.width = raw, np.array([len(r) for r in raw], dtype=np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def table(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The sketches of this length or of twice that, folded, and where each row's stands."""
        if width not in self.tables:
            own, twice = np.flatnonzero(self.width == width), np.flatnonzero(self.width == 2 * width)
            whole = np.frombuffer(b"".join(self.raw[k] for k in own), dtype=np.uint64).reshape(-1, width // 8)
            halves = np.frombuffer(b"".join(self.raw[k] for k in twice), dtype=np.uint64).reshape(-1, 2, width // 8)
            place = np.zeros(len(self.raw), dtype=np.int64)
            place[own], place[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            self.tables[width] = np.concatenate([whole, halves[:, 0] ^ halves[:, 1]]), place
        return self.tables[width]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For rows `a` and `b`, whose lengths are equal or one twice the other, a number of shingles that at least one set has alone: never too many."""
        out = np.zeros(len(a), dtype=np.int64)
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width).tolist():
            table, place = self.table(w)
            some = np.flatnonzero(width == w)
            for at in range(0, len(some), step := max(1, 4_000_000 // w)):
                k = some[at : at + step]
                out[k] = np.bitwise_count(table[place[a[k]]] ^ table[place[b[k]]]).sum(axis=1, dtype=np.int64)
        return out


def _described(words: int, count: int):
    """For texts: `count` fingerprints, a hash of the whole shingle set and the set's size."""
    names = [*(f"fp{k}" for k in range(count)), "node", "size"]

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = hashes_of(t, words)
            own = np.unique(h)
            rows.append((*np.array(_prints(h, count), dtype=np.uint64).view(np.int64).tolist(), _node(own), len(own)))
        return pd.DataFrame(rows, columns=names)

    return run


def _prefixes(words: int, least: float, common):
    """For texts: the hash of the shingle set, its rarest shingles and its sketch."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            own = np.unique(hashes_of(t, words))
            first, rare = prefix(own, *common.value, least)
            rows.append((_node(own), rare, first.view(np.int64), sketch(own)))
        return pd.DataFrame(rows, columns=["node", "rare", "prefix", "sketch"])

    return run


def rarest_shingles(rows: DataFrame, words: int, least: float, common) -> DataFrame:
    """`node`, `rare`, `prefix` and `sketch`, once for all texts with the same set."""
    # Not deterministic for the planner, which would else work texts out a second time for a filter that joins put below.
    described = F.pandas_udf(_prefixes(words, least, common), "node long, rare long, prefix array<bigint>, sketch binary").asNondeterministic()
    found = rows.select(described("text").alias("_p")).select("_p.*")
    return found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("rare", "prefix", "sketch")])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column those that share its value with a neighbour; a run goes over batch borders."""
    held, before = None, None  # the last row, not yet judged, and the value before it
    for batch in batches:
        if not batch.num_rows:
            continue
        every = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        v = every.column(0).to_numpy(zero_copy_only=False)
        same = v[1:] == v[:-1]
        keep = np.r_[before is not None and before == v[0], same]
        keep[:-1] |= same
        yield every.slice(0, len(v) - 1).filter(pa.array(keep[:-1]))
        held, before = every.slice(len(v) - 1), v[-2] if len(v) > 1 else before
    if held is not None and before is not None and before == held.column(0)[0].as_py():
        yield held


def _meetings(least: float, file: np.ndarray, shingle: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, block: np.ndarray, *earlier: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of rows, sorted by file, whose nodes are of different groups and share a shingle: those that sizes and places in the sets' order allow.

    A pair comes from the first shingle that both share, and not again from one whose last `EARLIER` before it hold another that both share. Two
    nodes of one block are paired where the block meets itself (`block` is -1 there and in undealt runs).
    """
    i, far = np.arange(len(file)), 0
    while True:
        far += 1
        i = i[i + far < len(file)]
        i = i[file[i] == file[i + far]]
        if not len(i):
            return
        j = i + far
        keep = (shingle[i] == shingle[j]) & (group[i] != group[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9)
        both = np.minimum(size[i] - place[i], size[j] - place[j])  # at most so many in common, if this is their first
        keep &= (1 + least) * both >= least * (size[i] + size[j]) - 1e-6
        keep &= (block[i] < 0) | (block[i] != block[j])
        a, b = i[keep], j[keep]
        met = np.zeros(len(a), dtype=bool)
        for u in earlier:
            for v in earlier:
                met |= (u[a] == v[b]) & (u[a] != shingle[a])  # the own shingle stands for none
        a, b = a[~met], b[~met]
        if len(a):
            yield a, b


def _by_file(each):
    """`each` over the columns of many rows sorted by file at a time, and never over a part of a file's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        for batch in batches:
            now = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append(now)
            rows += len(now[0])
            if rows < PAIR_ROWS:
                continue
            every = tuple(map(np.concatenate, zip(*held)))
            cut = int(np.searchsorted(every[0], every[0][-1]))  # the last run may go on in the next batch
            if cut:
                yield from each(*(x[:cut] for x in every))
            held = [tuple(x[cut:] for x in every)]
            rows = 0  # a long run is looked at again after as many rows
        if held:
            yield from each(*map(np.concatenate, zip(*held)))

    return run


def _paired(least: float, names: tuple[str, ...]):
    """Of rows sorted by file those that make a pair."""

    def each(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(len(columns[0]), dtype=bool)
        for a, b in _meetings(least, *columns):
            keep[a] = keep[b] = True
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], list(names))

    return _by_file(each)


def _set_pairs(least: float, sketched: bool):
    """Pairs of nodes of rows sorted by file; where the last column is a sketch, without those that sketches show to be less alike."""

    def each(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        sketches = Sketches(columns[-1].tolist()) if sketched else None
        columns = columns[:-1] if sketched else columns
        node, group, size = columns[2:5]
        for a, b in _meetings(least, *columns):
            if sketches:
                keep = (1 + least) * sketches.apart(a, b) <= (1 - least) * (size[a] + size[b]) + 1e-6
                a, b = a[keep], b[keep]
            turn = node[a] > node[b]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[a], node[b], group[a], group[b])], ["x", "y", "gx", "gy"])

    return _by_file(each)


def set_pairs(sets: DataFrame, least: float, run_rows: int = 5_000) -> DataFrame:
    """Distinct pairs `x`, `y` with groups `gx`, `gy`: among them all nodes of different groups that are alike by `least`.

    `sets` has node, group, size, rare and prefix. Common shingles are counted first: those of one group alone need no pairs, and those of many
    rows are dealt into blocks, each pair of which is a file of its own. A pair that shares many shingles is made about once, not once for each.
    If `sets` has sketches too, the rows that make a pair at all are written first and get them, and pairs whose sketches lie too far apart are
    not made: most of those that only share a passage, or are changed in many places.
    """
    rows = sets.select("node", "rare", F.posexplode("prefix").alias("place", "shingle"))
    groups = sets.select("node", "group", "size")
    lone = rows.filter("place < rare").select("shingle", "node", "place")
    met = parked(lone.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_met, "shingle long, node long, place int"), "met-shingles")
    common = rows.filter("place >= rare").select("shingle", "node", "place")
    sizes = common.join(groups, "node").groupBy("shingle").agg(F.count("*").alias("n"), F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
    sizes = parked(sizes.select("shingle", F.ceil(F.col("n") / run_rows).cast("int").alias("blocks")), "common-shingles")
    shared = met.withColumn("blocks", F.lit(1)).unionByName(common.join(sizes, "shingle")).join(groups, "node")
    before = Window.partitionBy("node").orderBy("place")
    names = [f"earlier{k}" for k in range(1, EARLIER + 1)]
    shared = shared.withColumns({c: F.coalesce(F.lag("shingle", k).over(before), "shingle") for k, c in enumerate(names, 1)})
    dealt = shared.filter("blocks > 1").withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("file", F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.withColumn("block", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")))
    short = shared.filter("blocks = 1").withColumns({"file": F.col("shingle"), "block": F.lit(-1)})
    columns = ("file", "shingle", "node", "group", "size", "place", "block", *names)
    filed = short.select(*columns).unionByName(dealt.select(*columns))
    spent = [met, sizes]
    if sketched := "sketch" in sets.columns:
        paired = filed.repartition("file").sortWithinPartitions("file").mapInArrow(_paired(least, columns), filed.schema)
        spent.append(paired := parked(paired, "paired"))
        filed = paired.join(sets.select("node", "sketch"), "node").select(*columns, "sketch")
    pairs = filed.repartition("file").sortWithinPartitions("file").mapInArrow(_set_pairs(least, sketched), "x long, y long, gx long, gy long").distinct()
    found = parked(pairs, "set-pairs")
    forget(*spent)
    return found


def _compared(words: int, least: float):
    """Of rows (cell, x, y, gx, gy, text) sorted by cell, a cell's texts (of x, without a y) first, the pairs whose texts are alike by `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for batch in batches:
            found = []
            rows = zip(*(batch.column(k).to_pylist() for k in range(6)))
            for at, (c, x, y, _, _, text) in enumerate(rows):
                if c != cell:
                    cell, sets = c, {}
                if y is None:
                    sets[x] = np.unique(hashes_of(text, words))
                    continue
                own, other = sets[x], sets[y]
                every = np.concatenate([own, other])
                every.sort(kind="stable")
                both = int((every[1:] == every[:-1]).sum())
                if both >= least * (len(every) - both) - 1e-9:
                    found.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(found, pa.int64())) for k in range(1, 5)], ["x", "y", "gx", "gy"])

    return run


def alike_pairs(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, least: float, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """Those of the (written) pairs of nodes `x`, `y` with groups `gx`, `gy` whose texts are alike by `least` or more, written.

    `nodes` has node, own and size, `rows` own and text. A pair is compared at the one of its groups that has more pairs, so that a group and all that is
    held against it meet, and each text goes there once and not with every pair. What has more than `cell_shingles` on one side is cut into
    cells, each with a part of either side.
    """
    counts = pairs.select(F.col("gx").alias("g")).unionByName(pairs.select(F.col("gy").alias("g"))).groupBy("g").agg(F.count("*").alias("n"))
    held = pairs.join(counts.select(F.col("g").alias("gx"), F.col("n").alias("nx")), "gx").join(counts.select(F.col("g").alias("gy"), F.col("n").alias("ny")), "gy")
    at_x = F.expr("nx > ny OR nx = ny AND gx <= gy")
    held = held.select("x", "y", "gx", "gy", F.when(at_x, F.col("gx")).otherwise(F.col("gy")).alias("hub"), F.when(at_x, F.col("x")).otherwise(F.col("y")).alias("inner"), F.when(at_x, F.col("y")).otherwise(F.col("x")).alias("outer"))
    held = parked(held, "held")
    sides = [held.select("hub", F.col(side).alias("node"), F.lit(side).alias("side")).distinct() for side in ("inner", "outer")]
    shingled = sides[0].unionByName(sides[1]).join(nodes.select("node", "size"), "node").groupBy("hub").pivot("side", ["inner", "outer"]).agg(F.sum("size"))
    cuts = shingled.select("hub", *[F.ceil(F.greatest(F.col(c), F.lit(1)) / cell_shingles).cast("int").alias(f"n_{c}") for c in ("inner", "outer")])
    parts = [F.pmod(F.xxhash64(c, F.lit("cell")), F.col(f"n_{c}")) for c in ("inner", "outer")]
    celled = parked(held.join(cuts, "hub").select(F.xxhash64("hub", *parts).alias("cell"), "x", "y", "gx", "gy"), "celled")
    there = celled.select("cell", F.col("x").alias("node")).unionByName(celled.select("cell", F.col("y").alias("node"))).distinct()
    wanted = nodes.select("node", "own").join(there.select("node").distinct(), "node")
    # One text of each node: copies meet by `own`, by which they are joined.
    texts = parked(rows.select("own", "text").join(wanted, "own").dropDuplicates(["own"]).select("node", "text"), "texts")
    read = there.join(texts, "node").select("cell", F.col("node").alias("x"), *[F.lit(None).cast("long").alias(c) for c in ("y", "gx", "gy")], "text")
    every = read.unionByName(celled.withColumn("text", F.lit(None).cast("string")))
    sorted_rows = every.repartition("cell").sortWithinPartitions("cell", F.col("y").isNotNull())
    found = parked(sorted_rows.mapInArrow(_compared(words, least), "x long, y long, gx long, gy long"), "alike")
    forget(held, celled, texts, pairs)
    return found


def alike_groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, within: int = 7, prints: int = 2, least: float = 0.8) -> DataFrame:
    """`key` and `component` for every row of `df`, over links of texts whose shingles are alike (Jaccard) by `least` or more.

    Texts with the same set of shingles are copies, one node. Candidates come from `prints` independent fingerprints, each searched to
    `within` bits; the nearest candidates that connect all others are verified on the texts, and so are nodes that share a fingerprint.
    What this links are groups, found cheaply. An exact join completes them: alike sets share one of their rarest shingles, so every pair of
    nodes of different groups that does is verified as well, but for those that sketches of the sets rule out. No link is lost, however the fingerprints fall. The rarest shingles are
    worked out from the texts only then. Tables are deleted once their last reader is written.
    """
    names = tuple(f"fp{k}" for k in range(prints))
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("own", F.xxhash64("text"))
    schema = ", ".join(f"{n} long" for n in (*names, "node", "size"))
    described = rows.withColumn("_d", F.pandas_udf(_described(words, prints), schema)("text")).select("key", "own", "_d.*")
    all_prints = parked(described, "prints")
    firsts = parked(all_prints.groupBy("node").agg(*[F.min(c).alias(c) for c in ("key", "own", "size", *names)]), "first-prints")
    pairs, searched = None, []
    for name in names:
        held = firsts.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("x"))
        near = parked(links(held.select("fp"), within), "near")
        searched.append(near)
        left, right = held.select(F.col("fp").alias("a"), "x"), held.select(F.col("fp").alias("b"), F.col("x").alias("y"))
        own = near.join(left, "a").join(right, "b").select("x", "y")
        same = firsts.select(F.col(name).alias("fp"), F.col("node").alias("y")).join(held, "fp").select("x", "y").filter("x != y")
        own = own.unionByName(same)
        pairs = own if pairs is None else pairs.unionByName(own)
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = parked(pairs.withColumns({"gx": F.col("x"), "gy": F.col("y")}), "pairs")
    forget(*searched)
    alike = alike_pairs(pairs, firsts, rows, words, least)
    roots = components(alike, "x", "y").withColumnRenamed("node", "of")
    grouped = firsts.join(roots, F.col("node") == F.col("of"), "left").withColumn("group", F.coalesce("root", "node"))
    grouped = parked(grouped.select("node", "key", "group", "size"), "groups")
    common = df.sparkSession.sparkContext.broadcast(_common_shingles(rows, words))
    rarest = rarest_shingles(rows, words, least, common)
    sets = parked(rarest.join(grouped.select("node", "group", "size"), "node"), "sets")
    candidates = set_pairs(sets, least)
    forget(sets)
    more = alike_pairs(candidates, firsts, rows, words, least)
    roots = components(more, "gx", "gy").withColumnRenamed("node", "of")
    rooted = grouped.join(roots, F.col("group") == F.col("of"), "left").select(F.col("node").alias("of"), F.col("key").alias("first"), F.coalesce("root", "group").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(lowest, "root").select(F.col("of").alias("node"), "component")
    forget(firsts, alike, more)
    return all_prints.join(named, "node").select(F.col("key").alias(key), "component")
