"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read its bits.

`ledger` adds the measurements and one `failed` bitmask to the rows of a text table (nulls count as empty texts, which
fail `few_words`; very long texts are measured whole; repeated rows are measured each; other columns pass through).
`apply_policy` turns the mask into a verdict by a versioned policy, and `ablation` recounts what a policy would keep
without each of its rules from a histogram of masks, so no text is read twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import SPACES, raw

WINDOW = 8
MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long"
SYMBOLS = b"#*$%&|<>"
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


# Bit k of `failed` belongs to rule k; new rules are appended, never inserted.
RULES = ("few_words", "repeated_phrases", "symbols", "shouting", "repeated_lines", "long_words")
# A version names the rules that reject a document; old versions stay, so that old verdicts can be had again.
POLICIES = {
    "base": ("few_words", "repeated_phrases"),
    "2": ("few_words", "repeated_phrases", "symbols", "shouting", "repeated_lines"),
}
ACTIVE = "2"


def mask(policy: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def repeated_words(codes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document, the words inside some run of WINDOW words that the document holds twice or more."""
    n = len(codes) - WINDOW + 1
    if n < 1:
        return np.zeros(docs, dtype=np.int64)
    names, size = codes.astype(np.int64), 1
    while size < WINDOW:  # names of runs of twice the length from pairs of names: equal names mean equal runs
        names = pd.factorize(names[: len(names) - size] * (int(names.max()) + 1) + names[size:])[0].astype(np.int64)
        size *= 2
    whole = doc[:n] == doc[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    group = pd.factorize(names[at] * docs + doc[at])[0]
    again = at[np.bincount(group)[group] > 1] if len(at) else at
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    inside = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[inside], minlength=docs).astype(np.int64)


def measure(texts: pd.Series) -> pd.DataFrame:
    rows, words, counts = [], [], []
    for text in texts:
        b = raw(text)
        own = b.split()
        words += own
        counts.append(len(own))
        chars = (0 if text is None else len(text)) - (len(b) - len(b.translate(None, SPACES)))
        seen, lines, again = set(), 0, 0
        for line in b.split(b"\n"):
            if line.strip(SPACES):
                lines += 1
                again += line in seen
                seen.add(line)
        letters = len(b) - len(b.translate(None, LETTERS))
        upper = len(b) - len(b.translate(None, UPPER))
        rows.append((len(own), chars, len(b) - len(b.translate(None, SYMBOLS)), lines, again, 0, upper, letters))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")], dtype="int64")
    if words:
        held = np.empty(len(words), dtype=object)
        held[:] = words
        doc = np.repeat(np.arange(len(counts)), counts)
        out["n_repeat_words"] = repeated_words(pd.factorize(held)[0], doc, len(counts))
    return out


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `df` with a struct `ledger` of all measurements and the bitmask `failed`."""
    names = [c.split()[0] for c in MEASURES.split(", ")]
    held = df.withColumn("ledger", F.pandas_udf(measure, MEASURES)(F.col(text).cast("string")))
    failed = F.lit(0).cast("long")
    for k, rule in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(_fails(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return held.withColumn("ledger", F.struct(*[F.col("ledger")[n].alias(n) for n in names], failed.alias("failed")))


def _fails(rule: str) -> Column:
    """The rule's condition read from the struct, so that columns of the input with the same names can't be meant."""
    fields = {n: F.col("ledger")[n] for n in [c.split()[0] for c in MEASURES.split(", ")]}
    w, up, let = fields["n_words"], fields["n_upper"], fields["n_letters"]
    return {
        "few_words": w < 20,
        "repeated_phrases": 100 * fields["n_repeat_words"] > 30 * w,
        "symbols": 10 * fields["n_symbols"] > 3 * w,
        "shouting": (let >= 40) & (10 * up > 8 * let),
        "repeated_lines": (fields["n_lines"] >= 4) & (2 * fields["n_dup_lines"] > fields["n_lines"]),
        "long_words": fields["word_chars"] > 60 * w,
    }[rule]


def passes(policy: str = ACTIVE) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("ledger")["failed"].bitwiseAND(F.lit(mask(policy))) == 0


def apply_policy(rows: DataFrame, policy: str = ACTIVE) -> DataFrame:
    """The rows that a policy keeps, without the ledger."""
    return rows.filter(passes(policy)).drop("ledger")


def ablation(rows: DataFrame, policy: str = ACTIVE) -> DataFrame:
    """For each rule of a policy: rows it fails, rows it fails alone, and rows kept without it; one row per rule.

    The ledger is reduced to counts per mask first, at most 2 ** len(RULES) rows.
    """
    whole = mask(policy)
    counts = rows.groupBy(F.col("ledger")["failed"].bitwiseAND(F.lit(whole)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).alias("bit")) for r in POLICIES[policy]]))
    each = counts.select("m", "n", rules.alias("r"))
    fails = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("m").bitwiseAND(F.lit(whole) - F.col("r.bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
