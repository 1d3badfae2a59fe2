"""The pipeline's stages on a small corpus against brute force, and on odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import pieces
from tickloom.llm.common import lower_words, plain_words, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    items = [prose(900 + k, 30) for k in range(4)]
    near = prose(1, 300).split()
    near[150] = "changed"
    texts = [
        prose(1, 300), prose(1, 300), " ".join(near), prose(2, 200), "short text", None, "", prose(3, 40) + " " + items[1] + " " + prose(4, 40),
        prose(5, 100) + " card 4111 1111 1111 1111 and a.b@mail.com", "### " * 60, " ".join([prose(6, 10)] * 9), prose(7, 100) + " " + items[2][:60], prose(8, 30000),
    ]
    rows = [(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path, texts, items


def brute(texts, items):
    def rejected(t):
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        again = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 8)} if len(words) < 2000 else set()
        symbols = sum(c in "#*$%&|<>" for c in t or "")
        return len(words) < 20 or 100 * len(again) > 30 * len(words) or 10 * symbols > 3 * len(words)

    kept = [k for k, t in enumerate(texts) if not rejected(t)]
    sets = {k: set(shingles(lower_words(texts[k]), 5)) for k in kept}
    firsts = []
    for k in kept:
        if all(len(sets[k] & sets[j]) < 0.8 * len(sets[k] | sets[j]) for j in firsts):
            firsts.append(k)
    item_sets = [set(shingles(plain_words(i), 5)) for i in items]
    clean = [k for k in firsts if all(len(s & set(shingles(plain_words(texts[k]), 5))) < 0.8 * len(s) for s in item_sets)]
    return kept, firsts, clean


def test_stages_against_brute_force(spark, folder):
    path, texts, items = folder
    kept, firsts, clean = brute(texts, items)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    after = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(docs.columns), name
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        after.append(sorted(r.doc_id for r in docs.collect()))
    assert after == [kept, firsts, clean, clean, clean] and 7 in firsts and 7 not in clean and 11 in clean
    masked = {r.doc_id: r for r in spark.read.parquet(f"{path}/stage3").collect()}
    assert masked[3].text == texts[3] and masked[8].n_chars == len(masked[8].text)
    assert "4111 1111 1111 1111" not in masked[8].text and "a.b@" not in masked[8].text and masked[8].text.startswith(prose(5, 100))
    codec = pieces.built(pieces.model_bytes())
    rows = docs.collect()
    assert all(r.exact and codec.decode(list(r.pieces)) == masked[r.doc_id].text and r.n_pieces == len(r.pieces) for r in rows)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()) == clean


def test_stages_on_odd_rows(spark, folder):
    path = folder[0]
    text = prose(50, 60)
    rows = [(None, text, "en", None, None), (None, text, None, "s", 1), (5, text, "en", "s", 1), (5, text, "en", "s", 1), (6, None, None, None, None), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("ledger", "fp", "key", "text2")})
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        assert stage(spark, docs.limit(0), path).count() == 0
        if k < 4:
            docs = spark.createDataFrame(out.collect(), out.schema)
            assert set(SCHEMA.replace(" long", "").replace(" string", "").split(", ")) <= set(docs.columns)
        counts.append(out.count())
    # Texts under 20 words go; rows without an id stay, of rows with one id a single one.
    assert counts == [4, 3, 3, 3, 3]


def test_rows_with_one_id_or_none_are_judged_by_their_texts(spark, folder):
    path, _, items = folder
    rows = [(1, prose(60, 80), "en", "s", 1), (1, prose(61, 80), "en", "s", 1), (2, prose(62, 80), "en", "s", 1), (None, prose(63, 30) + " " + items[0], "en", "s", 1), (None, prose(64, 80), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, path)
    assert sorted(r.text for r in kept.collect()) == sorted(r[1] for r in rows)
    clean = corpus_pipeline.decontamination(spark, docs, path)
    assert sorted(r.text for r in clean.collect()) == sorted(r[1] for r in rows if items[0] not in r[1])
