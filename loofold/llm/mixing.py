"""Mixing sources to target weights.

Sources are ranked by code point, null last, and weigh ``weights`` in turn. They share
``share`` times all words by weight; no target is above ``most`` times the source's words, and
what is above goes to the others by weight until none is above. A document is emitted
floor(rate) times, rate being target / words of its source, and once more with probability
equal to the fraction, drawn from a hash of its id and a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loofold.session import written_table

WORD = r"[^\x20\x09-\x0D]+"

#: A table of sources is broadcast up to this many bytes of names, counted first.
BROADCAST_BYTES = 32 << 20


def word_count(text: str | Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """Rows with ``rank`` from 0 by code point of ``name``, null last.

    Ranges of names are numbered apart and moved by the rows before them, so no task sees all.
    """
    order = F.col(name).asc_nulls_last()
    ranges = sources.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = written_table(
        sources.repartitionByRange(int(ranges), order).withColumn("__range", F.spark_partition_id()), "sources"
    )
    before = (
        dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # one row per range
        .withColumn("__before", F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    )
    here = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return (
        dealt.join(before, "__range")
        .withColumn("rank", here - 1 + F.coalesce("__before", F.lit(0)))
        .drop("__range", "__n", "__before")
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """source, source_size, weight and target of each source of a frame (source, size).

    A source without words has target 0. The level at which sources are filled is found by
    sums over the narrow table of sources; the driver sees three numbers a round.
    """
    if share > most:
        raise ValueError("share can't be above most")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written_table(ranked(totals, "source").select("source", "source_size", weight.alias("weight")), "targets")
    level, full = 0.0, None
    while True:
        above = F.lit(level) * F.col("weight") > F.lit(most) * F.col("source_size")
        n, words, capped, open_weight = table.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if n == full or not open_weight:
            break
        level, full = (share * words - most * capped) / open_weight, n
    target = F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("weight"))
    return table.withColumn("target", target)


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key, the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_targets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row of ``sizes`` beside its source's row.

    The table of sources is broadcast if its counted bytes allow; beyond that the rows of a
    source are dealt over salts, so that a hot source is not one task's.
    """
    targets = targets.select(F.col("source").alias("__source"), "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("__source"))
    held = targets.agg(F.sum(F.coalesce(F.octet_length("__source"), F.lit(0)) + 64)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        return sizes.join(F.broadcast(targets), same).drop("__source")
    salts = 16
    salted = sizes.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(salts)))
    copies = targets.withColumn("__copy", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return salted.join(copies, same & (F.col("__salt") == F.col("__copy"))).drop("__source", "__salt", "__copy")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_row: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target and copies of each row; with ``keep_row`` also ``row``.

    A null or empty text has size 0 and follows the same rates; in a source without words no
    row is taken. Null is a source of its own. Rows with equal ids share their draw. An empty
    table gives no rows. Columns of ``docs`` stay inside ``row``, so names can't clash.
    """
    row = [F.struct("*").alias("row")] if keep_row else []
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *row
    )
    targets = source_targets(sizes.select("source", "size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return (
        with_targets(sizes, targets)
        .withColumn("rate", rate)
        .withColumn("copies", F.floor("rate") + extra)
        .select("doc_id", "size", "source_size", "target", "copies", *["row"] * keep_row)
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the same columns."""
    copies = mix(docs, keep_row=True, **options).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
