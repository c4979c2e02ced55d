"""Evaluation metrics over frames that hold label and prediction in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Columns tp, tn, fp, fn, all bigint: one row, or one per group of ``by``."""
    y, z = F.col(label), F.col(prediction)
    return df.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (z == 1)).alias("tp"),
        F.count_if((y == 0) & (z == 0)).alias("tn"),
        F.count_if((y == 0) & (z == 1)).alias("fp"),
        F.count_if((y == 1) & (z == 0)).alias("fn"),
    )


def confusion_table(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row (label, prediction, n) per pair that occurs."""
    return df.groupBy(
        F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def mcc_of_counts(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation from four counts; 0 where a margin is empty.

    Counts are taken as double: the product of the four margins overflows bigint
    long before the table is large.
    """
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    margins = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(margins == 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(margins)) + F.lit(0.0)


def mcc_binary(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    counts = confusion_counts(df, label, prediction, by)
    return counts.withColumn("mcc", mcc_of_counts(*(F.col(c) for c in ("tp", "tn", "fp", "fn"))))


def mcc_multiclass(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Columns n, correct, mcc for any number of classes.

    The rows are counted once; both margins then come from that small table.
    """
    cells = confusion_table(df, label, prediction)
    n = F.col("n").cast("double")
    margins = (
        cells.select(
            F.explode(
                F.array(
                    F.struct(
                        F.col("label").alias("k"),
                        n.alias("t"),
                        F.lit(0.0).alias("p"),
                        F.when(F.col("label") == F.col("prediction"), n).otherwise(0.0).alias("c"),
                    ),
                    F.struct(
                        F.col("prediction").alias("k"),
                        F.lit(0.0).alias("t"),
                        n.alias("p"),
                        F.lit(0.0).alias("c"),
                    ),
                )
            ).alias("m")
        )
        .groupBy("m.k")
        .agg(F.sum("m.t").alias("t"), F.sum("m.p").alias("p"), F.sum("m.c").alias("c"))
    )
    sums = margins.agg(
        F.coalesce(F.sum("t"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum("c"), F.lit(0.0)).alias("c"),
        F.sum(F.col("t") * F.col("p")).alias("tp"),
        F.sum(F.col("t") * F.col("t")).alias("tt"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
    )
    s = F.col("s")
    spread = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.when(spread > 0, (F.col("c") * s - F.col("tp")) / spread).otherwise(0.0)
    return sums.select(
        s.cast("bigint").alias("n"),
        F.col("c").cast("bigint").alias("correct"),
        (mcc + F.lit(0.0)).alias("mcc"),
    )


def mean_absolute_error(df: DataFrame, label: str, prediction: str) -> DataFrame:
    error = F.abs(F.col(label) - F.col(prediction))
    return df.agg(F.avg(error).alias("mae"), F.avg(-error).alias("neg_mae"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def log_loss(df: DataFrame, label: str, p: str) -> DataFrame:
    from loofold.functions.scalars import log_loss_term

    return df.agg(F.avg(log_loss_term(F.col(label), F.col(p))).alias("log_loss"))
