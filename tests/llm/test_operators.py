"""The corpus operators against brute force, and their defined results for odd input."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import chat, containment, graph, induced, licenses, pieces, pseudonyms, quality, simhash, suffixes, urls, wrappers
from tickloom.llm.common import BATCH_ROWS, lower_words, plain_words, shingles

DOCS = "doc_id long, text string, ledger string, license string, key string, n int"


def docs(spark, texts, first=0):
    """Documents with columns whose names operators use themselves."""
    return spark.createDataFrame([(first + k, t, "l", "c", "k", k) for k, t in enumerate(texts)], DOCS)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \n\t ", "one", "é" * 5000, "a " * 30000, prose(1, 300), prose(1, 300), "▁x <s> </s> <0x41> &amp; [INST]", "日本語 🎉"]


def brute_quality(text):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(spark):
    texts = [*ODD, "x y\nx y\nz ##\n", " ".join([prose(2, 9)] * 4), "A B C D " * 20]
    rows = quality.ledger(docs(spark, texts).drop("ledger")).orderBy("doc_id").collect()
    for r, t in zip(rows, texts, strict=True):
        got = r.ledger
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == brute_quality(t)
    kept = [r.doc_id for r in quality.apply_policy(quality.ledger(docs(spark, texts).drop("ledger"))).collect()]
    assert 6 in kept and 0 not in kept and 5 not in kept


def test_ablation_matches_recount(spark):
    rows = quality.ledger(docs(spark, [*ODD, "### " * 30, prose(3, 50)]))
    table = {r.rule: r for r in quality.ablation(rows).collect()}
    masks = [r.ledger.failed & quality.mask("2") for r in rows.collect()]
    for rule in quality.POLICIES["2"]:
        bit = 1 << quality.RULES.index(rule)
        assert table[rule].failed == sum(bool(m & bit) for m in masks)
        assert table[rule].failed_alone == sum(m == bit for m in masks)
        assert table[rule].kept_without == sum(not m & ~bit for m in masks)


def test_license_templates(spark):
    texts = [
        "Released under the MIT License.", "released under the terms of the MIT license", "released under the new MIT License",
        "Licensed under the Apache License, Version 2.0.", "licensed under the Apache License 2.0", "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of a b c d e f g and associated documentation files to deal in it without restriction",
        "gnu general public license " * 2000, None, "",
    ]
    got = [r.license for r in licenses.scans(docs(spark, texts).drop("license")).orderBy("doc_id").collect()]
    assert [g.labels for g in got] == ["mit,mit-notice", "mit,mit-notice", "mit", "apache,apache-2.0", "apache,apache-2.0", "cc-by,cc-by-nc-4.0", "mit-text", "", "gpl", "", ""]
    assert (got[8].n_base, got[8].first_word, got[8].last_word, got[8].n_words) == (2000, 0, 7996, 8000)
    assert [g.score for g in got[:4]] == [1.0, 1.0, 0.5, 1.0] and got[9].first_word is None


def test_automaton_against_regex():
    import re

    rng = random.Random(4)
    markup = "a <<beginOptional>>b <<beginOptional>>a<<endOptional>><<endOptional>> <<var;words=1-2>> c"
    pattern = re.compile(r"a (?:b (?:a )?)?(?:\w ){1,2}c ")
    automaton = licenses.Automaton(markup)
    for _ in range(500):
        words = [rng.choice("abc") for _ in range(rng.randrange(12))]
        for at, w in enumerate(words):
            if w == "a":
                assert (automaton.end([x.encode() for x in words], at) is not None) == bool(pattern.match(" ".join(words[at:]) + " "))
    with pytest.raises(ValueError):
        licenses.parse("a <<beginOptional>> b")


def test_url_filter(spark):
    rows = [
        (1, "https://WWW.Example.ORG/en/12?x#y"), (2, "http://a.example.org/es/1"), (3, "http://b.org"), (4, "http://b.org/"), (5, "http://x.com/de/"),
        (6, "no url"), (7, None), (8, "http://notexample.org/es/"), (9, "http://bad.net/a/?b=1&a=2&utm_source=q"), (10, "https://www.bad.net:443/a?a=2&b=1#f"), (11, "http://bad.net/b"), (11, "http://bad.net/b"),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, canonical string, _w string")
    listed = spark.createDataFrame([("bad.net/a?a=2&b=1",), (None,), ("other.net/",)], "canonical string")
    got = {r.page_id: r.filter for r in urls.judged(pages, listed).collect()}
    assert [got[k].rule for k in range(1, 9)] == ["example.org/en/1", "example.org/es/", None, "org/", "com/de/", None, None, "org/"]
    assert [got[k].verdict for k in range(1, 12)] == ["block", "block", "allow", "allow", "block", "allow", "allow", "allow", "block", "block", "allow"]
    assert got[6].host == got[7].path == "" and urls.judged(pages, listed).count() == 12
    assert urls.judged(pages, listed.limit(0)).filter("filter.listed").count() == 0
    many = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".net/")).alias("canonical"))
    probe = spark.range(10000).select(F.concat(F.lit("http://h"), "id", F.lit(".net")).alias("url"))
    assert urls.judged(probe, many).filter("filter.listed").count() == 5000


def test_feistel_pseudonyms(spark):
    texts = [
        "card 4111 1111 1111 1111, again 4111111111111111 and bad 4111111111111112", "ip 10.0.0.1 then 256.1.1.1 and 1.2.3.4.5",
        "2020-02-29 29.02.2020 29/02/2020 12/31/2001 2021-02-29", "tel +1 (017) 555-7713 x.y@mail.com", "123-45-6789 000-45-6789", "deadbeef" * 5, None, "", "4111111111111111 " * 300,
    ]
    out = [r for r in pseudonyms.pseudonymised(docs(spark, texts), found="kinds").orderBy("doc_id").collect()]
    again = [r for r in pseudonyms.pseudonymised(docs(spark, texts), found="kinds").orderBy("doc_id").collect()]
    other = pseudonyms.pseudonymised(docs(spark, texts), key="other").orderBy("doc_id").first()
    assert out == again and other.text != out[0].text
    assert [r.kinds for r in out] == [["card", "card"], ["ip"], ["date"] * 4, ["phone", "email"], ["ssn"], ["secret"], [], [], ["card"] * 300]
    first = out[0].text.split(" again ")
    spaced = first[0][5:24].replace(" ", "")
    assert first[1].startswith(spaced) and spaced != "4111111111111111" and luhn(spaced) and "4111111111111112" in out[0].text
    assert "256.1.1.1" in out[1].text and "10.0.0.1" not in out[1].text
    days = out[2].text.split(" ")
    assert days[0] == "-".join(reversed(days[1].split("."))) and days[1].replace(".", "/") == days[2] and days[4] == "2021-02-29"
    assert out[3].text.startswith("tel +1 (") and "x.y@" not in out[3].text and out[3].text.endswith("@mail.com")
    assert "000-45-6789" in out[4].text and "123-45-6789" not in out[4].text and out[6].text is None and out[7].text == ""
    assert pseudonyms.pseudonymised(docs(spark, texts).limit(0)).count() == 0


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_feistel_is_one_to_one(spark):
    numbers = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    got = [r[0] for r in numbers.select(pseudonyms.digits_permuted(F.col("d"), F.lit("t"))).collect()]
    assert sorted(got) == [f"{k:04d}" for k in range(10000)]
    days = spark.sql("select date_format(date_add(date'1920-01-01', cast(id as int)), 'yyyy-MM-dd') text from range(36525)")
    new = pseudonyms.pseudonymised(days).distinct()
    assert new.count() == 36525 and new.filter("text < '1920-01-01' or text > '2019-12-31'").count() == 0


def test_containment_against_brute_force(spark):
    items = [prose(100 + k, n, 5000) for k, n in enumerate((6, 15, 37, 60, 130, 300, 4))] + [None, ""]
    texts = [prose(k, 900, 5000) for k in range(6)]
    for k in range(6):
        words = texts[k].split()
        words[400:400] = items[k].upper().split()
        texts[k] = ", ".join(words)
    part = items[2].split()
    texts += [" ".join(part[:20]), " ".join(part[:36]), items[6], prose(9, 40000, 90000) + " " + items[3], None, ""]
    table = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id int, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in containment.contained(docs(spark, texts), table).collect()}
    want = set()
    for i, item in enumerate(items):
        own = set(shingles(plain_words(item), 5))
        for d, text in enumerate(texts):
            if own and len(own & set(shingles(plain_words(text), 5))) >= 0.8 * len(own):
                want.add((d, i))
    assert got == want and len(want) >= 9
    assert containment.contained(docs(spark, texts), table.limit(0)).count() == 0
    assert containment.contained(docs(spark, texts).limit(0), table).count() == 0


def test_containment_of_short_items_in_long_documents(spark):
    items = [prose(9000 + k, 5 + k % 16, 5000) for k in range(120)]
    texts = []
    for k in range(120):
        words = items[k].split()
        if len(words) >= 14 and k % 2:
            words[-1] = "changed"  # 0.9 to 0.94 is left
        texts.append(f"{prose(k, 900, 5000)} {' '.join(words)} {prose(300 + k, 900, 5000)}")
    table = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    sets = [set(shingles(plain_words(t), 5)) for t in texts]
    own = [set(shingles(plain_words(t), 5)) for t in items]
    want = {(d, i) for d, s in enumerate(sets) for i, o in enumerate(own) if len(o & s) >= 0.8 * len(o)}
    assert {(r.doc_id, r.item_id) for r in containment.contained(docs(spark, texts), table).collect()} == want and len(want) >= 120


def test_pieces_are_the_best_and_exact(spark):
    codec = pieces.built(pieces.model_bytes())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    score = {sp.id_to_piece(k): sp.get_score(k) for k in range(sp.get_piece_size()) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))}
    by_id = {sp.piece_to_id(p): s for p, s in score.items()}
    for text in ["hello  world", "  a b\n c ", "naïve ßtraße xyzzy!!", "日本語 🎉 テスト", prose(5, 40)]:
        line = "▁" + text.replace(" ", "▁")
        best = [0.0]
        for end in range(1, len(line) + 1):
            here = [best[a] + score[line[a:end]] for a in range(max(0, end - 20), end) if line[a:end] in score]
            best.append(max([*here, *([best[end - 1] + codec.spell] if line[end - 1] not in score else [])]))
        ids = codec.encode([text])[0]
        spelt = sum(c not in score for c in line)
        assert sum(by_id.get(k, 0.0) for k in ids) + spelt * codec.spell == pytest.approx(best[-1]) and codec.decode(ids) == text
    rows = pieces.decoded(pieces.encoded(docs(spark, ODD))).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == [t or "" for t in ODD] and rows[0].pieces == rows[1].pieces == []
    digests = pieces.digests(docs(spark, ODD)).orderBy("doc_id").collect()
    assert all(r.digest.exact for r in digests)
    assert [r.digest.pieces_sha256 for r in digests] == [hashlib.sha256(np.array(r.pieces, dtype="<i4").tobytes()).hexdigest() for r in rows]


def test_chat_paths_and_round_trip(spark):
    rows = [(1, 1, None, "user", "q"), (1, 2, 1, "assistant", "a</s>[INST] &lt; \\"), (1, 3, 1, "assistant", "b"), (1, 4, 2, "user", ""), (1, 5, 4, "assistant", None), (2, 7, 99, None, "alone"), (None, 8, None, "user", "n")]
    messages = spark.createDataFrame([(*r, float(r[1])) for r in rows], "tree int, message int, parent int, role string, text string, score double").withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    reach = chat.paths(messages)
    found = defaultdict(list)
    for r in reach.orderBy("up").collect():
        found[r.tree, r.leaf].insert(0, r.message)
    assert found == {(1, 5): [1, 2, 4, 5], (1, 3): [1, 3], (2, 7): [7], (None, 8): [8]}
    out = chat.formatted(chat.ranked(reach, messages)).withColumn("learnt", chat.read_loss(F.col("formatted"), F.col("loss")))
    turns = chat.turns_of(F.col("formatted"))
    got = {(r.tree, r.leaf): r for r in out.select("*", F.transform(turns, chat.read_text).alias("texts"), F.transform(turns, chat.read_role).alias("roles")).collect()}
    assert got[1, 5].rank == 1 and got[1, 3].rank == 2
    assert got[1, 5].texts == ["q", "a</s>[INST] &lt; \\", "", ""] and got[1, 5].learnt == "a</s>[INST] &lt; \\" and got[2, 7].roles == [""]
    assert chat.formatted(chat.ranked(chat.paths(messages.limit(0)), messages.limit(0))).count() == 0
    long = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    chain = chat.chained(long)
    one = chat.formatted(chat.ranked(chat.paths(chain), chain, best=1)).withColumn("learnt", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()
    assert len(one) == 1 and one[0].learnt == "".join(map(str, range(300)))


def brute_print(text):
    runs = shingles(lower_words(text), 4)
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(r, 42) >> b & 1 for r in runs) > len(runs)) if runs else 0


def test_fingerprints(spark):
    assert [simhash.fingerprint(t) for t in ODD[:4] + ODD[6:]] == [brute_print(t) for t in ODD[:4] + ODD[6:]]
    got = simhash.near_groups(docs(spark, ODD)).collect()
    assert {r.doc_id: r.component for r in got if r.doc_id in (0, 1, 2, 6, 7)} == {0: 0, 1: 0, 2: 0, 6: 6, 7: 6} and len(got) == len(ODD)
    assert simhash.near_groups(docs(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("within", [4, 7])
def test_links_find_all_components(spark, within):
    rng = np.random.default_rng(within)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = []
    for b in base:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 2 * within), replace=False)
            near.append(b ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64)) if len(flips) else b)
    fps = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)]))
    forest = simhash.Forest(len(fps))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= within):
            forest.join(i, i + 1 + int(j))
    want = {frozenset(np.flatnonzero(np.array([forest.root(k) for k in range(len(fps))]) == r).tolist()) for r in range(len(fps)) if forest.root(r) == r}
    place = {int(np.int64(np.uint64(f).view(np.int64))): k for k, f in enumerate(fps)}
    table = spark.createDataFrame([(k,) for k in place], "fp long")
    for run_rows in (20_000, 12):  # the second cuts every larger run again
        own = simhash.Forest(len(fps))
        for r in simhash.links(table, within, run_rows).collect():
            assert (int(fps[place[r.a]]) ^ int(fps[place[r.b]])).bit_count() <= within
            own.join(place[r.a], place[r.b])
        assert {frozenset(k for k in range(len(fps)) if own.root(k) == r) for r in range(len(fps)) if own.root(r) == r} == want


def test_plan_holds_for_every_count():
    sample = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    for within in (0, 3, 4, 7):
        how = simhash.plan(sample, 10**6, within)
        assert sorted(b for p in how.parts for b in p) == list(range(64)) and sum(t + 1 for t in how.thresholds) > within
    assert simhash.plan(sample[:0], 0, 4) and simhash.plan(sample[:1], 1, 4)


def test_alike_groups(spark):
    text = prose(20, 400, 10000)
    words = text.split()
    close, far = words.copy(), words.copy()
    close[100] = "x"
    for k in range(0, 400, 3):
        far[k] = "y"
    got = {r.doc_id: r.component for r in simhash.alike_groups(docs(spark, [text, " ".join(close), " ".join(far), text.upper(), None, "", prose(21, 300)])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4, 5: 4, 6: 6}


def test_alike_groups_keeps_long_texts_with_one_recurring_line(spark):
    line = " ".join(f"menu{k}" for k in range(11))
    long = [" ".join(f"{line} {prose(700 + 1000 * k + j, 6, 10**6)}" for j in range(800)) for k in range(3)]
    assert len({simhash.prints_of(t, 5)[0] for t in long}) == 1
    rows = docs(spark, [*long, long[1].upper(), long[2] + " end"])
    got = {r.doc_id: r.component for r in simhash.alike_groups(rows).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2}


def test_alike_groups_finds_every_pair_near_the_limit(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIR_ROWS", 300)  # runs go over many batches
    template, texts = prose(80, 60, 10**6), []
    for k in range(40):
        words = f"{template if k % 2 else prose(3000 + k, 60, 10**6)} {prose(5000 + k, 140, 10**6)}".split()
        texts.append(" ".join(words))
        for j in range(k % 3 + 1):  # J of 0.78 to 0.85 with the first, changed in other places
            at, n = 60 + 45 * j, 13 + k % 7
            texts.append(" ".join([*words[:at], *(f"new{k}x{j}x{i}" for i in range(n)), *words[at + n :]]))
    sets = [set(shingles(lower_words(t), 5)) for t in texts]
    own = simhash.Forest(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                own.join(i, j)
    got = {r.doc_id: r.component for r in simhash.alike_groups(docs(spark, texts)).collect()}
    assert got == {k: own.root(k) for k in range(len(texts))} and len(set(got.values())) < len(texts) - 30


def test_set_pairs_meet_all_alike_sets(spark):
    rng, nodes = random.Random(8), []
    for k in range(60):
        base = set(range(1000 * (k % 12), 1000 * (k % 12) + 40 + k % 5))
        nodes.append(np.array(sorted(base - {rng.choice(sorted(base)) for _ in range(k % 6)} | {10**6 + 7 * k}), dtype=np.uint64))
    common = np.arange(0, 12000, 3, dtype=np.uint64)
    rows = []
    for k, own in enumerate(nodes):
        first, rare = simhash.prefix(own, common, common.astype(np.int64) % 50 + 3, 0.8)
        rows.append((k, k % 7, len(own), rare, first.astype(np.int64).tolist()))
    table = spark.createDataFrame(rows, "node long, group long, size long, rare long, prefix array<bigint>")
    sets = [set(n.tolist()) for n in nodes]
    want = {(i, j) for j in range(60) for i in range(j) if i % 7 != j % 7 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    for run_rows in (5000, 2):  # the second deals common shingles into blocks
        assert want and want <= {(r.x, r.y) for r in simhash.set_pairs(table, 0.8, run_rows).collect()}


def test_set_pairs_make_a_pair_about_once(spark, monkeypatch):
    """Eight alike sets of eight groups share some 40 of their rarest shingles each; a pair was made once for each of them and each block."""
    sets = [np.array([j for j in range(200) if j % 50 != k] + [10**6 + k], dtype=np.uint64) for k in range(8)]
    for common in (np.zeros(0, dtype=np.uint64), np.arange(200, dtype=np.uint64)):
        rows = []
        for k, own in enumerate(sets):
            first, rare = simhash.prefix(own, common, common.astype(np.int64) + 3, 0.8)
            rows.append((k, k, len(own), rare, first.astype(np.int64).tolist()))
        table = spark.createDataFrame(rows, "node long, group long, size long, rare long, prefix array<bigint>")
        with monkeypatch.context() as patched:
            patched.setattr(type(table), "distinct", lambda self: self)
            for run_rows in (5000, 2):
                made = [(r.x, r.y) for r in simhash.set_pairs(table, 0.8, run_rows).collect()]
                assert {(i, j) for j in range(8) for i in range(j)} == set(made) and len(made) < 2 * 28


def test_sketches_never_count_too_many():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 20, 40, 300, 330, 9000)]
    sets += [np.unique(np.concatenate([s[: len(s) * k // 10], rng.integers(0, 2**63, 1 + len(s) // 20, dtype=np.uint64)])) for s in sets[1:] for k in (8, 9, 10)]
    sketches = simhash.Sketches([simhash.sketch(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    near = np.maximum(sketches.width[i], sketches.width[j]) <= 2 * np.minimum(sketches.width[i], sketches.width[j])
    i, j = i[near], j[near]
    alone = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    got = sketches.apart(i, j)
    assert (got <= alone).all() and (3 * got > alone)[alone < 500].all() and len({*sketches.width}) >= 4


def test_texts_just_not_alike_to_a_large_group_make_no_pairs(spark):
    """A group of 30 and 30 texts that share two thirds with each of it made 900 pairs, each of which carried both texts."""
    base, rows = set(range(300)), []
    sets = [base - {10 * k} | {10**6 + k} for k in range(30)] + [{j for j in base if j >= 80} | set(range(10**7 + 1000 * k, 10**7 + 1000 * k + 80)) for k in range(30)] + [base - {5} | {10**9}]
    rng = np.random.default_rng(6)
    hashed = {j: int(rng.integers(0, 2**63)) for s in sets for j in sorted(s)}
    sets = [np.array(sorted(hashed[j] for j in s), dtype=np.uint64) for s in sets]
    common = np.array(sorted(hashed[j] for j in range(300)), dtype=np.uint64)
    for k, own in enumerate(sets):
        # What the outer texts have alone stands last in this order, so that the first shingles are shared.
        counts = np.array([3 + (j % 7) for j in range(300)])
        first, rare = simhash.prefix(own, common, counts, 0.8) if k < 30 or k == 60 else simhash.prefix(own, np.setdiff1d(own, common), np.full(80, 100), 0.8)
        rows.append((k, -1 if k < 30 else k, len(own), 0, first.astype(np.int64).tolist(), bytearray(simhash.sketch(own))))
    table = spark.createDataFrame(rows, "node long, group long, size long, rare long, prefix array<bigint>, sketch binary")
    for run_rows in (5000, 7):
        with_all = {(r.x, r.y) for r in simhash.set_pairs(table.drop("sketch"), 0.8, run_rows).collect()}
        got = {(r.x, r.y) for r in simhash.set_pairs(table, 0.8, run_rows).collect()}
        assert sum(x < 30 <= y < 60 for x, y in with_all) == 900  # as all were made before
        assert got <= with_all and {(k, 60) for k in range(30)} <= got and not any(30 <= y < 60 and x < 30 for x, y in got)


@pytest.mark.parametrize("cell_shingles", [2_000_000, 150])
def test_alike_pairs_in_cells(spark, cell_shingles):
    base = prose(90, 60, 10**6).split()
    texts = [" ".join([*base[:k], f"a{k}", *base[k + 1 :]]) for k in range(12)] + [" ".join([*base[:40], *(f"b{k}x{j}" for j in range(k + 1)), *base[41 + k :]]) for k in range(12)]
    texts += [prose(91, 3), prose(91, 3).upper() + " more"]
    rows = docs(spark, [*texts, *texts[:5]]).select("text", F.xxhash64("text").alias("own"))  # copies
    sets = [set(shingles(lower_words(t), 5)) for t in texts]
    named = rows.select("own", "text").distinct().collect()
    own = {r.text: r.own for r in named}
    nodes = spark.createDataFrame([(k, own[t], len(sets[k])) for k, t in enumerate(texts)], "node long, own long, size long")
    every = [(x, y, -1 if x < 12 else x, -1 if y < 12 else y) for y in range(len(texts)) for x in range(y) if y >= 12]
    pairs = simhash.parked(spark.createDataFrame(every, "x long, y long, gx long, gy long"), "pairs")
    got = sorted(tuple(r) for r in simhash.alike_pairs(pairs, nodes, rows, 5, 0.8, cell_shingles).collect())
    want = [p for p in sorted(every) if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    assert got == want and 0 < len(want) < len(every)


def test_rarest_shingles_are_worked_out_once_for_a_text(spark):
    texts = [prose(k, 30) for k in range(6)] + [prose(0, 30)]
    common = spark.sparkContext.broadcast((np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
    groups = simhash.parked(spark.range(3).select(F.col("id").alias("node")), "groups")
    found = simhash.rarest_shingles(docs(spark, texts), 5, 0.8, common)
    assert found.join(groups, "node")._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.node: bytes(r.sketch) for r in found.collect()} == {simhash._node(s): simhash.sketch(s) for s in (np.unique(simhash.hashes_of(t, 5)) for t in texts)}


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {b.name() for b in map(blocks.apply, range(blocks.size())) if b.name().startswith("shuffle_")}
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    before = files()
    simhash.parked(spark.range(10**5).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    assert not files() - before


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: root(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_induced_sorting():
    rng = np.random.default_rng(1)
    for k in range(200):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60))).astype(np.uint8)
        t = np.tile(t, 3)[:150] if k % 3 == 0 else t
        b, sa = t.tobytes(), induced.suffix_array(t)
        order = sorted(range(len(t)), key=lambda i: b[i:])
        assert sa.tolist() == order
        prior, shared = induced.common_prefixes(t, sa)
        for x, y in zip(order, order[1:]):
            n = next((n for n in range(len(b)) if b[x + n : x + n + 1] != b[y + n : y + n + 1] or x + n == len(b)), 0)
            assert prior[y] == x and shared[y] == n


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def repeated_texts():
    passage = prose(30, 90)
    texts = [None, "", prose(31, 200), passage, "é" * 700, "ab" * 400, prose(32, 40) + passage + prose(33, 40), prose(34, 30) + passage[:230] + prose(35, 20)]
    texts += [texts[2], prose(36, 100) + passage[50:300] + "ö" + passage[50:300], "x" * 199, "x" * 199]
    return texts + [prose(40 + k, 30) + passage[k : 260 + k] + prose(60 + k, 30) for k in range(12)]


def test_suffix_dedup_against_brute_force(spark):
    texts = repeated_texts()
    got = {r.doc_id: r for r in suffixes.removed_digest(docs(spark, texts)).collect()}
    want = brute_removed([(t or "").encode() for t in texts], 200)
    assert [(got[k].n_removed, got[k].n_spans, got[k].kept_sha256) for k in range(len(texts))] == want
    assert [got[k].n_bytes for k in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert suffixes.removed_digest(docs(spark, texts).limit(0)).count() == 0


def test_suffix_dedup_in_small_arrays(spark, monkeypatch):
    texts = sorted({(t or "").encode() for t in repeated_texts() if t and len(t.encode()) >= 200})
    counts = [len(t) - 199 for t in texts]
    whole = suffixes.marked(texts, counts)
    monkeypatch.setattr(suffixes, "ARRAY_BYTES", 2000)
    for a, b in zip(whole, suffixes.marked(texts, counts), strict=True):
        assert (a == b).all()
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 300)
    pieces_ = list(suffixes._pieces(texts, 200))
    assert sum(len(suffixes.spans(b, ends, 200)[0] * 0) >= 0 for b, ends, _, _ in pieces_) == len(pieces_)
    assert sum(int(suffixes.spans(b, ends, 200)[1].sum()) for b, ends, _, _ in pieces_) == sum(counts)


PAGE = "<html><head><title>t</title><script>var a='</p><p>x';</script></head><body><div class='{c}'><a>m</a></div>{main}<div id='comments'><p>c</p></div><footer>f</footer></body></html>"


def test_main_text():
    assert wrappers.main_text("<body><nav>n</nav><article><h1>A &amp;amp; b</h1><p><b>x<br>\n y</b><p>z<aside>no</aside><form>q</form></article><p>out") == "A &amp; b\n\nx y\n\nz"
    assert wrappers.main_text(PAGE.format(c="menu", main="<div class='story'><p>one<li>two</div>")) == "one\n\ntwo"
    assert wrappers.main_text("plain <i>text</i> only") == "plain text only"
    assert wrappers.main_text(None) == wrappers.main_text("") == wrappers.main_text("<script>x") == ""
    assert wrappers.main_text("<article>a<!-- b --><style>c</style><p>d<img alt='>'>e<scri") == "a\n\nde"
    assert wrappers.main_text("<article>short</article><article>the longer one</article>") == "the longer one"


def test_article_text_is_not_taken_for_boilerplate():
    kept = [
        ('<div class="layout no-sidebar"><article><p>text</article></div>', "text"),
        ('<body class="has-header"><div class="page with-sidebar"><article>text</article></div>', "text"),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>text</article>', "Title\n\ntext"),
        ('<article><h2 class="section-header">Head</h2><p data-id="search">a<p class="legal">b<blockquote class="social-contract">c</blockquote><div class="alert">d</div></article>', "Head\n\na\n\nb\n\nc\n\nd"),
        ('<div class="sidebar-right"><main><p>text</main></div>', "text"),
        ('<p title="class=ad" data-class="ad">one<p>two', "one\n\ntwo"),
    ]
    for page, text in kept:
        assert wrappers.main_text(page, wrappers.NO_WRAPPER) == text
    for mark in ("ad", "inline-ad", "ad slot-2", "share-buttons", "post-comments", "related_posts", "newsletter", "notice", "cookie-notice"):
        assert wrappers.main_text(f'<article><p>a<div class="{mark}">no<p>no</div><p>b</article>', wrappers.NO_WRAPPER) == "a\n\nb"
    for mark in ("site-header", "sidebar", "alert", "page legal", "top-search-box"):
        assert wrappers.main_text(f'<body><div class="{mark}">no</div><p>b', wrappers.NO_WRAPPER) == "b"
    assert wrappers.main_text('<div class="related"><article>teaser</article></div><article>a</article>', wrappers.NO_WRAPPER) == "a"
    assert wrappers.main_text("<nav><main>no</main></nav><p>b", wrappers.NO_WRAPPER) == "b"


def test_pages_without_a_body_tag_keep_their_text():
    for page in ("<p>a<p>b", "<html><p>a<p>b", "<html><head><title>t</title><p>a</p>b", "<head><meta x></head>a<p>b</html>", "<title>t</title><div>a</div><script>no</script><div>b", "<body><p>a</body><p>b"):
        assert wrappers.main_text(page, wrappers.NO_WRAPPER) == "a\n\nb", page


def test_wrappers_align_and_find_the_main_element(spark):
    pages = [
        (k, f"http://h{k % 2}.net/{k}", f"<body><div class=x1>same</div><div class=box{k}><p>{prose(k, 30)}</p>" + "<p>more</p>" * (k % 3) + ("<h2>opt</h2>" if k % 4 == 0 else "") + "</div><div class=x2>always the same long line of words that no page changes</div></body>", "w")
        for k in range(40)
    ]
    table = spark.createDataFrame([*pages, (98, None, None, "w"), (99, "http://h0.net/", "", "w"), (99, "http://h0.net/", "", "w")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in wrappers.extracted(table).collect())
    want = [(k, "\n\n".join([prose(k, 30), *["more"] * (k % 3), *["opt"] * (k % 4 == 0)])) for k in range(40)]
    assert got == [*want, (98, ""), (99, ""), (99, "")]
    assert wrappers.extracted(table.limit(0)).count() == 0
    one = wrappers.tree("<ul><li>a<li>b</ul><h2>x</h2><p>y</p><h2>z</h2><p>w</p>")
    assert [(n[0], n[1]) for n in one[6]] == [("ul", False), ("h2", True), ("p", True)] and one[6][0][6][0][1]
    both = wrappers.merged(wrappers.tree("<p>same</p><div>a</div>"), wrappers.tree("<p>same</p><table></table><div>b</div>"))
    assert [(n[0], n[2], n[5]) for n in both[6]] == [("p", False, " same"), ("table", True, ""), ("div", False, None)]


def test_pages_keep_every_article_and_compare_whole_texts(spark):
    pages = [(k, f"http://a.net/{k}", f"<body><article class=x><p>short {k}</article><div class=ad>buy</div><article class=y><p>the longer one {k}</article></body>") for k in range(5)]
    table = spark.createDataFrame([*pages, (9, None, "<article>a</article><article>longer</article>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extracted(table).collect()}
    assert got == {**{k: f"short {k}\n\nthe longer one {k}" for k in range(5)}, 9: "a\n\nlonger"}
    start = "the same first words of a text " * 4
    both = wrappers.merged(wrappers.tree(f"<p>{start} one</p><div>{start}</div>"), wrappers.tree(f"<p>{start} two</p><div>{start}</div>"))
    assert both[6][0][5] is None and both[6][1][5] is not None


def test_pages_with_thousands_of_open_blocks(spark):
    pages = [(k, "http://deep.net/", "<body>" + "<div><blockquote>" * (2000 + k) + f"<p>deep text {k}") for k in range(4)]
    pages += [(8, "http://flat.net/", "<body><div><p>one</div>"), (9, "http://deep.net/", "<body>" + "<ul>" * 5000 + "<li>end")]
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {**{k: f"deep text {k}" for k in range(4)}, 8: "one", 9: "end"}
    built = wrappers.tree("<ul><li>a<li>b</ul><h2>x</h2><p>y<div><p>z</div>")
    assert wrappers._read(wrappers._json(built)) == built


def test_batches_are_small():
    assert BATCH_ROWS <= 1000
