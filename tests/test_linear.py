import numpy as np
import pytest
from pyspark.sql import functions as F

from loofold.functions.metrics import mean_absolute_error
from loofold.operators.linear import fit_linear, loo_linear

# The leave-one-out example table: y, x1, x2.
EXAMPLE = [
    (6, 2, 14), (8, 5, 12), (12, 4, 12), (14, 3, 13), (14, 4, 7),
    (15, 6, 8), (17, 7, 7), (22, 5, 4), (24, 8, 6), (23, 9, 5),
]


def test_example_error(spark):
    df = spark.createDataFrame(EXAMPLE, "y int, x1 int, x2 int")
    out = loo_linear(df, fit_linear(df, ["x1", "x2"], "y"))
    row = mean_absolute_error(out, "y", "loo_prediction").first()
    assert row["mae"] == pytest.approx(3.146154808347, abs=1e-11)
    assert row["neg_mae"] == -row["mae"]


@pytest.mark.parametrize("d", [3, 20])
def test_equals_refits(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(60, d)) * 10 + 1000
    y = x @ rng.normal(size=d) + rng.normal(size=60)
    names = [f"f {i}" for i in range(d)]
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(60)], ["id", *names, "y"])
    fit = fit_linear(df, names, "y")
    design = np.column_stack([x - x.mean(axis=0), np.ones(60)])
    assert np.allclose(fit.coefficients, np.linalg.lstsq(design, y, rcond=None)[0][:-1], atol=1e-7)
    for r in loo_linear(df, fit).collect():
        keep = np.arange(60) != r["id"]
        w = np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]
        assert r["loo_prediction"] == pytest.approx(design[r["id"]] @ w, abs=1e-6)


def test_dependent_columns_and_nulls(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0), (2.0, 4.0, 5.0), (3.0, 6.0, 7.0), (4.0, 8.0, 9.0), (None, 1.0, 1.0)],
        "a double, b double, y double",
    )
    fit = fit_linear(df, ["a", "b"], "y")
    assert fit.n == 4
    assert np.allclose(fit.coefficients, [0.4, 0.8]) and fit.intercept == pytest.approx(1.0)
    assert df.select(fit.predict().alias("p")).where(F.col("p").isNull()).count() == 1


def test_row_that_carries_a_coefficient(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (1.0, 9.0)], "a double, y double")
    errors = {r["y"]: r["loo_error"] for r in loo_linear(df, fit_linear(df, ["a"], "y")).collect()}
    assert errors[9.0] is None and errors[1.0] == pytest.approx(-1.0)
