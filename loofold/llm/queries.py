"""One query per operation, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from loofold.llm import rules, secrets, sql
from loofold.llm.balltree import search
from loofold.llm.fuzzyhash import edited_and_next
from loofold.llm.language import fold, identify, trained_on_folds
from loofold.llm.mixing import mix
from loofold.llm.neardup import near_duplicates
from loofold.llm.packing import packed_pieces
from loofold.llm.periodic import periodic_runs
from loofold.llm.registry import ORACLES, QUERIES, query, table
from loofold.llm.scoring import scored
from loofold.llm.substrings import without_repeats
from loofold.llm.toolcalls import records
from loofold.llm.toxicity import toxic_passages, trained

__all__ = ["ORACLES", "QUERIES"]


@query("op1_substring_dedup", sql.SUBSTRINGS)
def op1_substring_dedup(spark, folder):
    """What is left of each document; the kept words as their digest."""
    rows = without_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_document_fingerprints")
def op2_document_fingerprints(spark, folder):
    """Each text against its edit and against the next text."""
    return edited_and_next(table(spark, folder, "documents"))


@query("op3_lm_scoring")
def op3_lm_scoring(spark, folder):
    """Scores of every document, learned from those whose fold is not 1."""
    return scored(table(spark, folder, "documents"), fold() != 1)


@query("op4_quality_rules", sql.QUALITY_RULES)
def op4_quality_rules(spark, folder):
    """The ledger of all documents under the latest policy."""
    rows = rules.ledger(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(rules.POLICIES[0])).alias("base_failed"),
        rules.passes(rules.POLICIES[-1]).alias("kept"),
        "failed",
    )


@query("op5_minhash_neardup")
def op5_minhash_neardup(spark, folder):
    """Class of every document."""
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id", "class_size")


@query("op6_chat_formatting")
def op6_chat_formatting(spark, folder):
    """Records of all turns of all conversations: derived calls and results, and messages."""
    return records(table(spark, folder, "conversations"))


@query("op7_packing")
def op7_packing(spark, folder):
    """Every sequence of the whole table; the ids as their checksum."""
    return packed_pieces(table(spark, folder, "documents"))


@query("op8_mixing", sql.MIXING)
def op8_mixing(spark, folder):
    """Words that the mix takes of each document."""
    rows = mix(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op9_language_id")
def op9_language_id(spark, folder):
    """Language of every document; rows of fold 0 are never learned from."""
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(fold() == 0, F.lit(True)).alias("held_out")
    return identify(docs, trained_on_folds(docs)).select("doc_id", held_out, "lang_pred", "score", "n_switches")


@query("op10_secret_scan")
def op10_secret_scan(spark, folder):
    """Every candidate of every document with the forest's verdict; values as their digest."""
    docs = table(spark, folder, "documents")
    found = secrets.findings(docs, secrets.trained(docs))
    return found.select("doc_id", "nth", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@query("op11_toxicity")
def op11_toxicity(spark, folder):
    """Toxicity of every document; labels of rows of fold 2 of 4 are never learned from."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels").select("doc_id", "toxic")
    model = trained(docs.where(fold(folds=4) != 2), labels.where(fold(folds=4) != 2))
    rows = toxic_passages(docs, model)
    return rows.select(
        "doc_id", F.coalesce(fold(folds=4) == 2, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


@query("op12_lexical_search", sql.LEXICAL_SEARCH)
def op12_lexical_search(spark, folder):
    """The 50 best documents of every benchmark item."""
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def with_period(docs):
    """Texts of ids that hash to a multiple of ten, periodic from some word on; all others as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = docs.withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n = F.size("words").cast("long")
    turned = words.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.floor((n - F.col("a")) / (3 + g % 8)) + 1)
    text = F.expr("array_join(transform(sequence(0L, size(words) - 1L), i -> words[int(if(i < a, i, a + (i - a) % p))]), ' ')")
    return turned.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs", sql.PERIODIC_RUNS)
def op13_periodic_runs(spark, folder):
    """Runs of every document; all runs and the collapsed text as their digests."""
    rows = periodic_runs(with_period(table(spark, folder, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.reduce("runs", F.element_at("runs", 1), lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best))
    best = F.when(F.size("runs") > 0, longest)
    rows = rows.select("doc_id", "runs", "collapsed", best.alias("best"), F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).alias("lines"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.coalesce("lines", F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
