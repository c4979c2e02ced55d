import math

import pytest
from pyspark.sql import functions as F

from loofold.functions import metrics, scalars
from loofold.operators.sets import as_set, concatenate, name_difference


def labelled(spark, tp, tn, fp, fn):
    rows = [(1, 1)] * tp + [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn
    return spark.createDataFrame(rows, "label int, prediction int")


@pytest.mark.parametrize(
    "counts, mcc",
    [((3, 4, 0, 0), 1.0), ((0, 0, 4, 3), -1.0), ((3, 0, 4, 0), 0.0), ((54, 69, 23, 23), 0.4512987012987013)],
)
def test_two_forms_agree(spark, counts, mcc):
    df = labelled(spark, *counts)
    row = metrics.mcc_binary(df).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == counts
    assert row["mcc"] == pytest.approx(mcc, abs=1e-12)
    many = metrics.mcc_multiclass(df.repartition(3)).first()
    assert many["mcc"] == pytest.approx(mcc, abs=1e-12)
    assert many["n"] == sum(counts) and many["correct"] == counts[0] + counts[1]


def test_large_counts_do_not_overflow(spark):
    big = [F.lit(10**9 * k).cast("bigint") for k in (5, 7, 2, 1)]
    value = spark.range(1).select(metrics.mcc_of_counts(*big)).first()[0]
    small = spark.range(1).select(metrics.mcc_of_counts(*[F.lit(k) for k in (5, 7, 2, 1)])).first()[0]
    assert value == pytest.approx(small, abs=1e-12)


def test_scalars(spark):
    df = spark.createDataFrame([(3.6e9, "mJ", -800.0), (2.0, "kWh", 800.0), (1.0, "cal", float("nan"))], "e double, u string, z double")
    out = df.select(
        scalars.to_kwh(F.col("e"), F.col("u")).alias("kwh"),
        scalars.sigmoid(F.col("z")).alias("p"),
        scalars.nan_to_null(F.col("z")).alias("n"),
        scalars.is_missing(F.col("z")).alias("m"),
        scalars.linspace(F.lit(0.0), F.lit(98.0)).alias("g"),
        scalars.plain_name(F.lit("a(b)=1")).alias("s"),
    ).collect()
    assert [r["kwh"] for r in out] == [1.0, 2.0, None]
    assert out[0]["p"] == 0.0 and out[1]["p"] == 1.0 and out[2]["n"] is None
    assert [r["m"] for r in out] == [False, False, True]
    assert out[0]["g"] == [2.0 * i for i in range(50)] and out[0]["s"] == "a_b__1"
    loss = spark.range(1).select(scalars.log_loss_term(F.lit(1), F.lit(0.0))).first()[0]
    assert loss == pytest.approx(-math.log(1e-15))


def test_sets(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y", 2.0)], "s string, v double")
    both = concatenate([a, b])
    assert both.columns == ["i", "s", "v"] and both.count() == 2
    one = spark.range(1).select(
        name_difference(F.array(*map(F.lit, "cab")), F.array(F.lit("a"))).alias("d"),
        as_set(F.array(*map(F.lit, "bab"))).alias("s"),
    ).first()
    assert one["d"] == ["b", "c"] and one["s"] == ["a", "b"]
