"""The corpus pipeline: stages over `documents`, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import containment, pieces, pseudonyms, quality, simhash
from tickloom.llm.common import parked, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the active policy."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # no column of the input can clash
    return quality.apply_policy(quality.ledger(rows)).select("row.*")


def text_key(text: str = "text") -> Column:
    """A key of the text alone, of two hashes, for rows whose ids are missing or repeated."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), F.col(text)).alias("b"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group that is alike by 0.8 or more on five-word shingles.

    Of rows with one id each text counts for itself; rows of one id and text are copies. A document without an id stays, as nothing
    else could stand for it.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", text_key().alias("t")))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), own.alias("key"), "text")
    groups = simhash.alike_groups(keyed.select("key", "text"), "key")
    first = parked(groups.filter(F.col("key") == F.col("component")).select("key").distinct(), "first-keys")
    keyed = keyed.withColumn("key", F.col("key").cast(first.schema["key"].dataType))  # read back, all fields may be null: the join would cast and deal twice
    named = keyed.join(first, "key", "left_semi").dropDuplicates(["key"])
    return named.select("row.*").unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold 0.8 or more of a benchmark item's five-word shingles, whatever their ids."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), text_key().alias("key"), "text")
    leaks = containment.contained(keyed.select("key", "text"), table(spark, sf_dir, "benchmark"), doc_id="key")
    return keyed.join(leaks.select("key").distinct(), "key", "left_anti").select("row.*")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in the texts; `n_chars` follows."""
    return pseudonyms.pseudonymised(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text's pieces, and whether decoding them gives the text."""
    rows = pieces.decoded(pieces.encoded(docs.select("doc_id", "lang", "source", "text")))
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces", exact.alias("exact"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]
# XXH64 fingerprints and the pieces' vocabulary have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = parked(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
