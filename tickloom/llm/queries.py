"""The registered queries of the corpus operators over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import chat, containment, licenses, merkle, periods, pieces, pseudonyms, quality, simhash, suffixes, tokenfile, urls, wrappers
from tickloom.llm.common import fresh_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return rows.select("doc_id", *[F.col("license")[f].alias(f) for f in fields])


# The listed URLs of the query: those of hosts with one of these words between dots or hyphens.
SPAM_HOSTS = r"(^|[.-])(casino|pills|spam)([.-]|$)"


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(urls.host_of(F.col("url")).rlike(SPAM_HOSTS)).select(urls.canonical(F.col("url")).alias("canonical"))
    rows = urls.judged(pages, listed)
    return rows.select("page_id", *[F.col("filter")[f].alias(f) for f in ("host", "path", "rule", "verdict")])


@query
def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        "doc_id", *[F.col("ledger")[f].alias(f) for f in fields], (~quality.passes("base")).alias("base_failed"), quality.passes().alias("kept")
    )


@query
def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), found="kinds")
    counts = [(F.size("kinds") - F.size(F.array_remove("kinds", kind))).cast("long").alias(f"n_{kind}") for kind in pseudonyms.KINDS]
    return rows.select("doc_id", F.size("kinds").cast("long").alias("n_replaced"), *counts, "text")


@query
def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "digest.*")


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    messages = chat.chained(rows.unionByName(tricky))
    out = chat.formatted(chat.ranked(chat.paths(messages), messages, best=1))
    turns = chat.turns_of(F.col("formatted"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(chat.read_role(t), F.lit("\n"), chat.read_text(t), F.lit("\n"))), "")
    learnt = out.withColumn("learnt", chat.read_loss(F.col("formatted"), F.col("loss")))
    return learnt.select(
        F.col("tree").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wrappers.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periods.periodic(docs.withColumn("text", periods.with_cycles(F.col("doc_id"), F.col("text"))))
    found, best = F.col("periodic")["runs"], F.col("periodic")["strongest"]
    listed = F.transform(found, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size(found).cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * periodic.strongest.length div periodic.strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic")["collapsed"], 256).alias("collapsed_sha256"),
    )


@query
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "token-files")
    tokenfile.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.digest(*[F.col(c) for c in fields[:-1]], lower)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = merkle.manifest(docs.withColumn("claimed", F.when(hit, tampered)), "source", "doc_id", fields)
    out = rows.withColumn("folded_root", merkle.folded(F.coalesce("claimed", "_leaf"), F.col("_path")))
    return out.select(
        "doc_id",
        F.col("_leaf").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        F.sha2(merkle.siblings(F.col("_path")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("_root")).alias("verified"),
    )
