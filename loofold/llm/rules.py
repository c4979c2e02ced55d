"""Quality rules as a ledger of bits.

``ledger`` evaluates every rule once and stores the measurements and one failure bit per rule.
A policy is a version and a mask of rules; applying one, comparing several and asking what a
rule costs are bit operations on the ledger and never touch a text again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

#: Rule -> condition under which a document fails. The position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 34 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "few_letters": "2 * n_letters < word_chars",
    "capitals": "2 * n_capitals > n_letters",
}
BASE = ("few_words", "repeats")


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of the rules."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


POLICIES = (Policy(1, BASE), Policy(2, (*BASE, "symbols", "same_lines")), Policy(3, tuple(RULES)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole-text measurements of each row, without a shuffle.

    Repeated three-word windows are found by sorting a document's own windows by a 64-bit
    hash. Arrays that a later lambda reads are columns of an earlier step, so each is
    computed once.
    """
    text = F.coalesce(text_col, F.lit(""))
    hashes = F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.struct(
            F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    equal = lambda x, j: x["h"] == F.get("grams", j)["h"]
    twice = F.filter(
        "grams", lambda x, j: F.coalesce(equal(x, j + 1), F.lit(False)) | F.when(j > 0, equal(x, j - 1)).otherwise(False)
    )
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        .select(
            "doc_id",
            F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
            F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
            F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
            F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        )
        .withColumn("n", F.size("words"))
        .withColumn("grams", F.when(F.col("n") >= 3, F.array_sort(hashes)).otherwise(none))
        .withColumn("twice", twice)
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            "n_symbols",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.size(
                F.array_distinct(F.flatten(F.transform("twice", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
            ).cast("long").alias("n_repeat_words"),
            "n_letters",
            "n_capitals",
        )
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the measurements and ``failed`` bits.

    A null or empty text has no words and fails ``few_words`` only. Repeated rows are judged
    once each; other columns are not read; an empty table gives an empty ledger.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    return measured(docs, id_col, text_col).withColumn("failed", reduce(Column.bitwiseOR, bits).cast("long"))


def passes(policy: Policy, failed: str | Column = "failed") -> Column:
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy costs, from a ledger.

    rule, n_failed (documents that fail it), n_alone (that fail no other rule of the policy),
    n_kept and n_kept_without (documents kept with and without the rule). The ledger is first
    counted by its bits, of which there are at most two to the number of rules.
    """
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(Policy(0, (r,)).mask).alias("bit")) for r in policy.rules])
    bit, bits = F.col("r.bit"), F.col("bits")
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    return (
        counts.withColumn("r", F.explode(rules))
        .groupBy("r.rule")
        .agg(
            total(bits.bitwiseAND(bit) != 0).alias("n_failed"),
            total(bits == bit).alias("n_alone"),
            total(bits == 0).alias("n_kept"),
            total((bits == 0) | (bits == bit)).alias("n_kept_without"),
        )
    )
