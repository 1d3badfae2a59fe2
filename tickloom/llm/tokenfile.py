"""Token ids in binary files: frequency-ranked numbers of one to four bytes, with the lengths in control bytes of their own.

`tokenised` gives each text's ids by a public tokenizer, `ranked` counts all ids of the corpus and numbers them by falling
count, and `write` writes a folder in ascending key order that `read` reads back. Format of a folder:

- `ranks.bin`: the id of each rank, little-endian 32 bits;
- files of blocks. A block holds whole documents: first the control bytes of all, then the data bytes of all. A control byte has
  two bits for each of four ids, low bits first: the number of bytes of its rank, less one; a document's last control byte
  may have unused places. Data bytes hold the ranks, little-endian;
- behind its blocks each file's index (keys, ids of each document, and sizes of the blocks) and its place;
- `manifest.json`: the files that the job committed, in order, with the number of ids before each.

A file's name has a random part, so a repeated or speculative task never writes over another's file, and only files of committed
tasks are named in the manifest, which is written last: a reader sees a whole folder or none.

Null and empty texts have the end id alone; texts are tokenised in parts cut where the tokenizer always cuts, so very long
ones need no more memory than their ids; ties of a key are ordered by row number (equal rows are alike anyway), null keys
come first; other columns are dropped. An empty table gives a folder without files, read as an empty table.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from tickloom.llm.common import forget, parked

MAGIC = b"TLTOKEN1"
# Bytes of a block, bytes of remembered words in one worker, the longest such word, characters of a text taken at a time, texts
# encoded together, and new words encoded as one line; they steer cost only.
BLOCK_BYTES, KEPT_BYTES, KEPT_CHARS, PART_CHARS, TEXTS, LINE = 1 << 20, 256 << 20, 64, 1 << 20, 64, 512
# The tokenizer always cuts between a character and white space behind it, and white space but its last character before a word
# is a unit of its own. So in a text in which no space stands between white space (or ends the text), it cuts before each space. Characters
# that Python and the tokenizer may not both take for white space, and marks of special tokens, count as unclear.
_ODD = ("  ", " \n", "<|", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
_ODD_WIDE = (*"\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff", *map(chr, range(0x2000, 0x200C)))
_CUT = re.compile("(?<=[^\\s\x1c-\x1f\x85\u180e\u200b\ufeff])(?=[ \n])")
BYTES_OF = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def unclear(text: str) -> bool:
    """Whether a text may be cut elsewhere than before its spaces; a search for each mark costs less than one pattern for all."""
    return text.endswith(" ") or any(x in text for x in _ODD) or not text.isascii() and any(x in text for x in _ODD_WIDE)


class Chunked:
    """A tokenizer that remembers the ids of words behind a space; every id comes from the library.

    Two generations are kept, so that words that are used again outlive a full memory.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        self.tokenizer = Tokenizer.from_str(definition)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(not s.startswith("<|") or re.search(r"\s", s) for s in special):
            raise ValueError("special tokens are expected to begin with <| and to hold no white space")
        vocabulary = self.tokenizer.get_vocab()
        # Ids that begin with a space, as byte-level tokenizers spell it. A space is one byte of one id.
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        # The ids of a full stop and a comma, if the tokenizer cuts between letters and them.
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str if self.tokenizer.pre_tokenizer and not self.tokenizer.normalizer else lambda text: []
        self.marks = {c: self.direct([c])[0] for c in ".," if [at for _, at in pieces(f" ab{c} c")] == [(0, 3), (3, 4), (4, 6)]}
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def behind_space(self, words: list[str]) -> list[bytes]:
        """The ids of each word behind a space. Many are encoded as one line, which the ids that begin with a space part again."""
        out: list[bytes] = []
        for at in range(0, len(words), LINE):
            part = words[at : at + LINE]
            line = self.direct([" " + " ".join(part)])[0]
            first = np.flatnonzero(self.spaced[np.frombuffer(line, dtype=np.uint32)])
            if len(first) == len(part) and first[0] == 0:
                edges = [*(4 * first).tolist(), len(line)]
                out += [line[a:b] for a, b in zip(edges, edges[1:])]
            else:  # a tokenizer that spells spaces otherwise
                out += self.direct([" " + w for w in part])
        return out

    def _learn(self, words: set[str]) -> list[str]:
        """Look up or encode new words; returns those that are too long to be kept."""
        again = words & self.old.keys() if self.old else ()
        self.known.update({w: self.old[w] for w in again})
        new = words.difference(again)
        # A mark behind Latin letters is a unit of its own, so such words need the letters alone from the library.
        marked = [w for w in new if w[-1:] in self.marks and w[:-1].isalpha() and w.isascii()]
        plain = new.difference(marked)
        plain.update({w[:-1] for w in marked}.difference(self.known))
        made = list(plain)
        self.known.update(zip(made, self.behind_space(made)))
        self.known.update([(w, self.known[w[:-1]] + self.marks[w[-1]]) for w in marked])
        self.held += 200 * (len(again) + len(made) + len(marked)) + 2 * (sum(map(len, words)) + sum(map(len, made)))
        return [w for w in {*made, *marked} if len(w) > KEPT_CHARS]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts, little-endian 32 bits each."""
        out: list[bytes | None] = [None] * len(texts)
        plain, split = [], []
        for k, text in enumerate(texts):
            if len(text) > PART_CHARS or unclear(text):
                out[k] = b"".join(ids for part in self._cut(text) for ids in self.direct([part]))
            else:
                plain.append(k)
                split.append(text.split(" "))
        firsts = self.direct([words[0] for words in split])
        for words in split:
            del words[0]
        long = self._learn(set().union(*split).difference(self.known))
        ids_of = self.known.__getitem__
        for k, first, words in zip(plain, firsts, split):
            out[k] = first + b"".join(map(ids_of, words))
        for w in long:
            del self.known[w]
        if self.held > KEPT_BYTES // 2:
            self.known, self.old, self.held = {}, self.known, 0
        return [np.frombuffer(b, dtype="<u4") for b in out]

    def _cut(self, text: str) -> list[str]:
        """A very long text in parts, cut where the tokenizer cuts as well."""
        out, at = [], 0
        while len(text) - at > PART_CHARS and (cut := _CUT.search(text, at + PART_CHARS)):
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]


_built: dict[int, Chunked] = {}


def _tokenizer(definition: str) -> Chunked:
    key = hash(definition)
    if key not in _built:
        _built[key] = Chunked(definition)
    return _built[key]


def definition_of(path: str, limit: int = 64 << 20) -> str:
    """A tokenizer's file, read where the driver runs; its size is checked, since every task gets it."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    return data.decode("utf-8")


def tokenised(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: int | None = 0) -> tuple[DataFrame, int]:
    """`key`, `row` (a row number) and `ids`, little-endian numbers of the given width in bytes; `end` is appended to each text."""
    definition = definition_of(path)
    width = 2 if Tokenizer.from_str(definition).get_vocab_size() <= 1 << 16 else 4
    held = df.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(held.value)
        tail = b"" if end is None else np.array([end], dtype=f"<u{width}").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = [x.astype(f"<u{width}").tobytes() + tail for x in tokenizer.encode_all([t or "" for t in part.column(2).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], ["key", "row", "ids"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, row long, ids binary"), width


def ranked(rows: DataFrame, width: int) -> np.ndarray:
    """The corpus's ids by falling count, then id. One number for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                n = np.bincount(np.frombuffer(ids, dtype=f"<u{width}"))
                if len(n) > len(total):
                    total = np.concatenate([total, np.zeros(len(n) - len(total), dtype=np.int64)])
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])

    counts = rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    order = np.lexsort((counts["id"].to_numpy(), -counts["n"].to_numpy()))
    return counts["id"].to_numpy(dtype=np.int64)[order].astype("<u4")


def coded(ranks: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of documents' ranks, which stand one after another."""
    raw = np.ascontiguousarray(ranks, dtype="<u4")
    size = 1 + (raw > 0xFF).astype(np.uint8) + (raw > 0xFFFF) + (raw > 0xFFFFFF)
    groups = -(-counts // 4)
    ahead = np.cumsum(4 * groups) - 4 * groups - (np.cumsum(counts) - counts)  # unused places before each document
    places = np.zeros(4 * int(groups.sum()), dtype=np.uint8)
    places[np.arange(len(raw)) + np.repeat(ahead, counts)] = size - 1
    control = places.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.sum(axis=1, dtype=np.uint8).tobytes(), raw.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decoded(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranks of a block's documents, one after another: byte counts by table lookup, then four shifted gathers."""
    groups = -(-counts // 4)
    size = BYTES_OF[control].ravel()
    ends = np.cumsum(groups) * 4
    unused = groups * 4 - counts
    for k in (1, 2, 3):
        size[ends[unused >= k] - k] = 0
    ends = np.cumsum(size, dtype=np.int64)
    used = np.flatnonzero(size)
    at, size = (ends - size)[used], size[used]
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.uint32)
    value = padded[at]
    for k in range(1, int(size.max()) if len(size) else 1):
        value |= padded[at + k] << np.uint32(8 * k)
    return value & MASKS[size]


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)


def _read_all(path: str, name: str) -> bytes:
    fs, base = _files(path)
    with fs.open_input_file(f"{base}/{name}") as f:
        return f.read()


def _write_all(path: str, name: str, data: bytes) -> None:
    """A whole file under a name that shows up at once."""
    fs, base = _files(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{name}.new") as f:
        f.write(data)
    fs.move(f"{base}/{name}.new", f"{base}/{name}")


@dataclass
class Committed(WriterCommitMessage):
    part: int
    file: str
    documents: int
    ids: int


class TokenWriter(DataSourceArrowWriter):
    """Codes rows `key`, `row`, `ids`, sorted within and over partitions, into one file for each task; `ranks.bin` is there."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        part, name = TaskContext.get().partitionId(), ""
        fs, base = _files(self.path)
        keys, nulls, counts, blocks = [], [], [], []
        held, size, out = [], 0, None
        order = np.frombuffer(_read_all(self.path, "ranks.bin"), dtype="<u4")
        rank = np.zeros(int(order.max()) + 1 if len(order) else 0, dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)

        def flush():
            nonlocal held, size
            own = np.array([len(b) for b in held]) // self.width
            c, d = coded(rank[np.frombuffer(b"".join(held), dtype=f"<u{self.width}")], own)
            out.write(c)
            out.write(d)
            counts.append(own)
            blocks.append((len(own), len(c), len(d)))
            held, size = [], 0

        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                name = f"part-{part:05d}-{uuid.uuid4().hex}.tok"
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}")
                out.write(MAGIC)
            key = batch.column(0)
            keys.append(key.fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(key.is_null().to_numpy(zero_copy_only=False))
            for ids in batch.column(2).to_pylist():
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_BYTES:
                    flush()
        if out is None:
            return Committed(part, "", 0, 0)
        if held:
            flush()
        counts = np.concatenate(counts)
        index = [np.concatenate(keys).astype("<i8"), np.concatenate(nulls).astype("u1"), counts.astype("<i8"), np.array(blocks, dtype="<i8").ravel()]
        for a in index:
            out.write(a.tobytes())
        out.write(np.array([len(counts), len(blocks)], dtype="<i8").tobytes() + MAGIC)
        out.close()
        return Committed(part, name, len(counts), int(counts.sum()))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.part):
            files.append({"file": m.file, "documents": m.documents, "ids": m.ids, "before": before})
            before += m.ids
        _write_all(self.path, "manifest.json", json.dumps({"version": 1, "ids": before, "files": files}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _files(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{base}/{m.file}")


@dataclass
class TokenPart(InputPartition):
    file: str
    before: int


class TokenReader(DataSourceReader):
    """Reads files block by block: `doc_id`, `start` (ids of all documents before), `n_tokens`, `ids` (little-endian 32 bits each)."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files = json.loads(_read_all(self.path, "manifest.json"))["files"]
        return [TokenPart(f["file"], f["before"]) for f in files] or [TokenPart("", 0)]

    def read(self, partition: TokenPart) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        ids_of = np.frombuffer(_read_all(self.path, "ranks.bin"), dtype="<u4")
        fs, base = _files(self.path)
        with fs.open_input_file(f"{base}/{partition.file}") as f:
            size = f.size()
            f.seek(size - 24)
            tail = f.read(24)
            if tail[16:] != MAGIC:
                raise ValueError(f"{partition.file} has no index")
            n, blocks = np.frombuffer(tail[:16], dtype="<i8").tolist()
            f.seek(size - 24 - 17 * n - 24 * blocks)
            index = f.read(17 * n + 24 * blocks)
            keys, nulls = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n).astype(bool)
            counts, table = np.frombuffer(index, "<i8", n, 9 * n), np.frombuffer(index, "<i8", 3 * blocks, 17 * n).reshape(-1, 3)
            f.seek(len(MAGIC))
            at, start = 0, partition.before
            for docs, control, data in table.tolist():
                own = counts[at : at + docs]
                ranks = decoded(np.frombuffer(f.read(control), np.uint8), np.frombuffer(f.read(data), np.uint8), own)
                ids = ids_of[ranks].astype("<u4").tobytes()
                ends = np.cumsum(own)
                edges = np.r_[0, ends].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[at : at + docs], mask=nulls[at : at + docs]),
                        pa.array(start + ends - own),
                        pa.array(own),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip(edges, edges[1:])], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )
                at, start = at + docs, start + int(ends[-1])


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenfiles"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return TokenReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokenWriter(self.options["path"], int(self.options["width"]))


def write(df: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end: int | None = 0, files: int | None = None) -> None:
    """Write the ids of a text table to a new folder, in ascending order of `key`; in about `files` files, else as many as the shuffle makes.

    Texts are tokenised once; the ids wait in the shared folder until all are counted, and are shuffled by ranges of key and
    row number, so that rows of one key spread as well.
    """
    spark = df.sparkSession
    made, width = tokenised(df, path, key, text, end)
    rows = parked(made, "ids", "zstd")
    ranks = ranked(rows, width)
    _write_all(folder, "ranks.bin", ranks.tobytes())
    spark.dataSource.register(TokenFiles)
    order = [F.col("key").asc_nulls_first(), F.col("row").asc()]
    ordered = (rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    ordered.write.format("tokenfiles").option("width", width).mode("append").save(folder)
    forget(rows)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """`doc_id`, `start`, `n_tokens` and `ids` (little-endian 32 bits each) of every document of a folder."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("tokenfiles").load(folder)
