import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from loofold.operators.quantiles import exact_percentiles, lower_median, middle_median, order_statistics, percentiles_by


@pytest.mark.parametrize(
    "values, lower, middle",
    [([1], 1, 1), ([1, 2], 1, 1.5), ([1, 2, 3], 2, 2), ([1, 2, 3, 4], 2, 2.5), ([4, None, 1, 3, 2], 2, 2.5)],
)
def test_medians(spark, values, lower, middle):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    assert tuple(df.agg(lower_median("x"), middle_median("x")).first()) == (lower, middle)


def test_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert df.agg(lower_median("x")).first()[0] is None
    assert exact_percentiles(df, ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("kind", ["unique", "ties", "one hot value", "wide range"])
def test_narrowing_is_exact(spark, kind):
    """Forced to narrow down to a handful of rows, whatever the distribution."""
    rng = random.Random(5)
    values = {
        "unique": [rng.gauss(0, 1) for _ in range(3000)],
        "ties": [float(rng.randrange(7)) for _ in range(3000)],
        "one hot value": [1.5] * 1200 + [rng.random() * 3 for _ in range(1800)],
        "wide range": [rng.gauss(0, 1) * 10 ** rng.randrange(-200, 200) for _ in range(3000)],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 10, "x double").repartition(5)
    ranks = [("x", k) for k in (1, 2, 700, 1500, 1501, 2999, 3000)]
    found = order_statistics(df, ranks, {"x": 3000}, exact_rows=20, accuracy=50)
    ordered = sorted(values)
    assert found == {("x", k): ordered[k - 1] for _, k in ranks}


def test_interpolated_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=501), rng.integers(0, 9, size=501).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "`a.b` double, b double")
    found = exact_percentiles(df, ["a.b", "b"], [0.1, 0.25, 0.5, 0.9], exact_rows=30)
    assert np.allclose(found["a.b"], np.quantile(a, [0.1, 0.25, 0.5, 0.9]), rtol=1e-12)
    assert np.allclose(found["b"], np.quantile(b, [0.1, 0.25, 0.5, 0.9]), rtol=1e-12)
    assert df.agg(F.count("b")).first()[0] == 501


def test_percentiles_by_hot_groups(spark):
    """One group holds most rows; nulls, NaN, ties, a null group and one without values."""
    rng = random.Random(8)
    groups = ["hot"] * 900 + ["a"] * 40 + [None] * 30 + ["one"]
    rows = [(g, i % 3, rng.choice([rng.gauss(0, 1), float(rng.randrange(4))])) for i, g in enumerate(groups)]
    extra = [("hot", 0, None), ("hot", 1, float("nan")), ("empty", 0, None)]
    df = spark.createDataFrame(rows + extra, "`g.x` string, h int, v double").repartition(7)
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    for by in (["g.x"], ["g.x", "h"]):
        found = percentiles_by(df, by, "v", shares)
        plan = plan_of(found).lower()
        assert "percentile" not in plan and "collect" not in plan
        got = {tuple(r[c] for c in by): r for r in found.collect()}
        wanted = {}
        for g, h, v in rows:
            wanted.setdefault((g, h)[: len(by)], []).append(v)
        assert got.keys() == wanted.keys()
        for key, values in wanted.items():
            assert got[key]["n"] == len(values)
            assert np.allclose(got[key]["middle"], np.quantile(values, shares), rtol=1e-12)
            assert got[key]["lower"] == [float(v) for v in np.quantile(values, shares, method="inverted_cdf")]
