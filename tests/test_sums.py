import numpy as np
import pytest
from pyspark.sql import functions as F

from loofold.operators import sums
from loofold.operators.linear import fit_linear, loo_linear
from tests.conftest import plan_of


def moments(width):
    def add(totals, batch):
        x = batch.column(0).to_numpy()
        totals[:] += np.power.outer(x, np.arange(width) % 3).sum(axis=0)

    return add


@pytest.mark.parametrize("width", [3, 70, 1000])
def test_sums_and_their_rows(spark, monkeypatch, width):
    monkeypatch.setattr(sums, "PACKED", 64)
    rows = spark.range(0, 1000, numPartitions=11).select((F.col("id") / 7).alias("x"))
    x = np.arange(1000) / 7
    wanted = np.array([(x ** (i % 3)).sum() for i in range(width)])
    assert np.allclose(sums.summed(rows, moments(width), width), wanted)
    packs = sums.task_totals(rows, moments(width), width)
    assert packs.count() == 11 * -(-width // 64)  # tasks times stretches, not tasks times cells


def test_sums_of_nothing(spark):
    rows = spark.range(0).select(F.col("id").cast("double"))
    assert sums.summed(rows, moments(5), 5).tolist() == [0.0] * 5


def test_wide_linear_leave_one_out(spark):
    """200 columns: errors equal refits, and the plan is no longer than the table is wide."""
    rng = np.random.default_rng(2)
    n, d = 320, 200
    x = rng.normal(size=(n, d)) + 5
    y = x @ rng.normal(size=d) + rng.normal(size=n)
    names = [f"f {i}" for i in range(d)]
    df = spark.createDataFrame([(i, "kept", *map(float, x[i]), float(y[i])) for i in range(n)], ["id", "note", *names, "y"])
    df = df.unionByName(df.limit(1).withColumn("id", F.lit(-1)).withColumn("y", F.lit(None).cast("double"))).repartition(5)
    out = loo_linear(df, fit_linear(df, names, "y"))
    assert out.columns == [*df.columns, "loo_error", "loo_prediction"]
    assert len(plan_of(out)) < 60 * 4 * d
    rows = {r["id"]: r for r in out.collect()}
    assert len(rows) == n and rows[5]["note"] == "kept"
    design = np.column_stack([x - x.mean(axis=0), np.ones(n)])
    for i in range(0, n, 16):
        keep = np.arange(n) != i
        w = np.linalg.lstsq(design[keep], y[keep], rcond=None)[0]
        assert rows[i]["loo_prediction"] == pytest.approx(design[i] @ w, abs=1e-7)
        assert rows[i]["loo_error"] == pytest.approx(y[i] - design[i] @ w, abs=1e-7)


def test_wide_row_that_carries_a_coefficient(spark):
    d = 18
    rows = [(*[float(j == i) for j in range(d)], float(i)) for i in range(d)] + [(*[0.0] * d, 1.0)] * 3
    df = spark.createDataFrame(rows, [*[f"x{i}" for i in range(d)], "y"])
    found = loo_linear(df, fit_linear(df, [f"x{i}" for i in range(d)], "y")).collect()
    assert sum(r["loo_error"] is None for r in found) == d
