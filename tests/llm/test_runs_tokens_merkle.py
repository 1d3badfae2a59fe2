"""Periodic runs, token files and Merkle manifests against brute force, and their defined results for odd input."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm import merkle, periods, tokenfile
from tickloom.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(words, least=24, exponent=3):
    """Every period, every maximal stretch; a stretch with a smaller period is no run of this one."""
    n, out = len(words), set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            whole = i > start and end - start >= max(least, exponent * q)
            if whole and not any(all(words[x] == words[x + p] for x in range(start, end - p)) for p in range(1, q)):
                out.add((start, end - start, q))
            i += i == start
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.randoms(use_true_random=False), st.sampled_from([(24, 3), (24, 4), (5, 3), (2, 3), (12, 5)]))
def test_runs_against_every_period(rng, limits):
    n, letters = rng.randrange(150), rng.choice([1, 2, 3, 10])
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 6 else 0):
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        for i in range(a, rng.choice([n, rng.randrange(a, n + 1)])):
            words[i] = words[a + (i - a) % p]
    assert periods.runs(words, *limits) == brute_runs(words, *limits)


def test_fibonacci_word_and_a_very_long_text():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    words = [c.encode() for c in b]
    assert periods.runs(words, 5, 3) == brute_runs(words, 5, 3) != []
    assert periods.runs([b"x", b"y"] * 300_000) == [(0, 600_000, 2)]


def corpus(spark):
    rng = random.Random(5)
    prose = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (0, 1, 23, 24, 60, 200, 400)]
    texts = [None, "", " \n\t ", *prose, "a " * 40, "Ein Wort Été 日本語 " * 12, "x y z\n" * 9 + "q " + "x y z\n" * 9, *prose[-2:], "A Big Word", "Two Big WORDS", "Big"]
    rows = [(k, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts * 4)]
    return rows + [(None, "Null Id", None, "s1", None), (7, "Again", "EN", "s1", 5), (7, "Again", "EN", "s1", 5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(spark), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def test_query_of_runs(spark, folder):
    got = sorted((tuple(r) for r in QUERIES["op11_periodic_runs"](spark, folder).collect()), key=str)
    want = []
    for doc_id, text, *_ in corpus(spark):
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute_runs(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        listed = "".join("%d,%d,%d\n" % r for r in found).encode()
        want.append((doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str) and sum(r[1] for r in want) > 12


def test_runs_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 20, "old", 3)], "runs int, text string, periodic string, start int")
    row = periods.periodic(df).first()
    assert (row.runs, row.start, [tuple(r) for r in row.periodic.runs], row.periodic.collapsed) == (1, 3, [(0, 40, 2)], "a b")
    assert periods.periodic(df.limit(0)).count() == 0


ALPHABET = [*"ab 1.'\n\t é日　\x0b\x0c\r\x1c\x85 ​!<|>s,²3½_", "'s", " don't", "<|endoftext|>", "🎉", "  ", "\n\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40))
def test_chunks_give_the_tokenizers_ids(parts):
    text = "".join(parts)
    tokenizer = tokenfile._tokenizer(tokenfile.definition_of(BPE))
    own = tokenizer.encode_all([text, text + "x"])
    assert [x.tolist() for x in own] == [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in (text, text + "x")]


def test_memory_of_chunks_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenfile, "KEPT_BYTES", 4000)
    monkeypatch.setattr(tokenfile, "PART_CHARS", 100)
    tokenizer = tokenfile.Chunked(tokenfile.definition_of(BPE))
    for k in range(50):
        text = " ".join(f"word{k}{j}" for j in range(20)) + " " + "y" * 500
        assert tokenizer.encode_all([text[:90], text])[1].tolist() == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
        assert tokenizer.encode_all([text[:90]])[0].tolist() == tokenizer.tokenizer.encode(text[:90], add_special_tokens=False).ids
        held = [*tokenizer.known, *tokenizer.old]
        assert len(held) < 60 and all(len(c) <= tokenfile.KEPT_CHARS for c in held)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=9), min_size=1, max_size=6))
def test_codes_round_trip(docs):
    flat, counts = [x for d in docs for x in d], np.array([len(d) for d in docs])
    control, data = (np.frombuffer(x, np.uint8) for x in tokenfile.coded(np.array(flat, dtype=np.int64), counts))
    assert tokenfile.decoded(control, data, counts).tolist() == flat and len(control) == sum(-(-counts // 4))


def test_query_of_token_files(spark, folder):
    tokenizer = Tokenizer.from_file(BPE)
    rows = sorted(corpus(spark), key=lambda r: (r[0] is not None, r[0]))
    want, at = [], 0
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    # Of rows with one id and different texts either may come first.
    got = sorted((tuple(r) for r in QUERIES["op12_token_files"](spark, folder).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in want] and sorted(r[0::3] for r in got if r[0]) == sorted(r[0::3] for r in want if r[0])
    assert [r[1] for r in got] == list(np.cumsum([0, *[r[2] for r in got]])[:-1]) and [r for r in got if r[0] and r[0] < 7] == [r for r in want if r[0] and r[0] < 7]


def test_token_folder(spark, tmp_path):
    docs = spark.createDataFrame([(k, "the cat " * (k % 7), k) for k in range(300)], "doc_id long, text string, ids int").repartition(6)
    folder = str(tmp_path / "tokens")
    tokenfile.write(docs, folder, BPE, files=4)
    manifest = json.loads((tmp_path / "tokens" / "manifest.json").read_text())
    assert sum(f["documents"] for f in manifest["files"]) == 300 and len(manifest["files"]) > 1
    ids = np.fromfile(f"{folder}/ranks.bin", "<u4")
    assert len(ids) == len(set(ids.tolist())) and 0 in ids[:4]  # frequent ids have the small numbers
    (tmp_path / "tokens" / f"part-00000-{'0' * 32}.tok").write_bytes(b"of a task that failed")
    rows = tokenfile.read(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(300)) and [r.n_tokens for r in rows] == [1 + 2 * (k % 7) + (k % 7 > 0) for k in range(300)]
    empty = str(tmp_path / "none")
    tokenfile.write(docs.limit(0), empty, BPE)
    assert tokenfile.read(spark, empty).count() == 0


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_levels(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def brute_path(levels, i, fan):
    out = []
    for nodes in levels[:-1]:
        a = i - i % fan
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + fan])))
        i //= fan
    return out


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, fan=16):
    """For rows (doc_id, text, lang, source, n_chars): row, leaf, subroot, root, path."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, digest(*[framed(r[k]) for k in (0, 3, 2, 4, 1)])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for name in names:
        own = sorted(groups[name], key=lambda x: (x[0][0] is not None, x[0][0], x[1]))
        made.append((own, brute_levels([leaf for _, leaf in own], fan)))
    top = brute_levels([levels[-1][0] for _, levels in made], fan)
    for j, (own, levels) in enumerate(made):
        for i, (row, leaf) in enumerate(own):
            yield row, leaf, levels[-1][0], top[-1][0], brute_path(levels, i, fan) + brute_path(top, j, fan)


def test_query_of_manifest(spark, folder):
    want = []
    for row, leaf, subroot, root, path in brute_manifest(corpus(spark)):
        doc_id, text, lang, source, n_chars = row
        own = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            own = digest(*map(framed, (doc_id, source, lang, n_chars, low)))
        for left, right in path:
            own = digest(left, own, right)
        want.append((doc_id, leaf, subroot, root, digest(*[a + b for a, b in path]), own, own == root))
    got = [tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and 0 < sum(not w[-1] for w in want) < len(want) / 2


@pytest.mark.parametrize("fan, stride", [(2, 3), (3, 1), (2, 2)])
def test_deep_trees(spark, fan, stride):
    rows = [(k, f"t{k}", None, f"s{k % 40}" if k % 2 else "hot", k) for k in range(150)] + [(k, None, "a", None, 0) for k in (1, 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x")).repartition(7)
    out = merkle.manifest(df, "source", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], fan, stride)
    got = {(r.doc_id, r.source): (r._leaf, r._subroot, r._root, [tuple(p) for p in r._path], r.node) for r in out.collect()}
    want = {(row[0], row[3]): (leaf, subroot, root, path, "x") for row, leaf, subroot, root, path in brute_manifest(rows, fan)}
    assert got == want


def test_no_rows_no_root(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(df, "source", "doc_id", ["doc_id", "text"]).count() == 0
