import numpy as np
import pytest
from pyspark.sql import functions as F

from loofold.operators import loo, wide
from loofold.operators.logistic import fit_logistic
from loofold.operators.prep import fit_prep
from tests import brute

ROWS = "key string, at array<int>, value array<double>, y double"


def one_hot(n, sizes, seed, noise=1.0):
    """Rows of one level per column and a number; labels follow both."""
    rng = np.random.default_rng(seed)
    begin = np.cumsum([1, *sizes])
    at = np.column_stack([np.zeros(n, int), *[rng.integers(0, s, n) + b for s, b in zip(sizes, begin, strict=False)]])
    value = np.column_stack([rng.normal(size=n).round(1), np.ones((n, len(sizes)))])
    eta = (rng.normal(size=begin[-1])[at] * value).sum(axis=1)
    y = (eta + noise * rng.logistic(size=n) > 0).astype(float)
    return at, value, y, int(begin[-1])


def frame(spark, at, value, y):
    rows = [(f"k{i:05d}", a.tolist(), v.tolist(), float(t)) for i, (a, v, t) in enumerate(zip(at, value, y, strict=True))]
    return spark.createDataFrame(rows, ROWS).repartition(6)


def dense(at, value, d):
    x = np.zeros((len(at), d))
    x[np.arange(len(at))[:, None], at] = value
    return x


def test_fit_of_5000_features(spark):
    at, value, y, d = one_hot(7000, [3000, 1500, 499], 1)
    assert d == 5000
    fit = wide.fit_wide(frame(spark, at, value, y).persist(), d)
    eta = (fit.weights[at] * value).sum(axis=1) + fit.weights[-1]
    r = 1 / (1 + np.exp(-eta)) - y
    gradient = np.append(np.bincount(at.ravel(), (r[:, None] * value).ravel(), minlength=d) + fit.weights[:-1], r.sum())
    assert np.abs(gradient).max() < 1e-7  # the objective is strictly convex, so this is its optimum
    assert (fit.n, fit.positives) == (7000, y.sum())


def test_equals_the_dense_fit(spark):
    at, value, y, d = one_hot(300, [6, 5], 2)
    x = dense(at, value, d)
    fit = wide.fit_wide(frame(spark, at, value, y), d)
    assert np.allclose(fit.weights, brute.logistic(x, y), atol=1e-8)
    found = frame(spark, at, value, y).select("key", fit.eta().alias("eta")).collect()
    assert np.allclose([r["eta"] for r in sorted(found)], x @ fit.weights[:-1] + fit.weights[-1])


@pytest.mark.parametrize("n, sizes, noise", [(120, [2500, 2000, 499], 1.0), (150, [4, 3], 5.0)])
def test_left_out_classes_equal_refits(spark, n, sizes, noise):
    """At 5,000 features, and where rows have copies and little signal."""
    at, value, y, d = one_hot(n, sizes, n, noise)
    if len(sizes) == 2:
        value[:, 0] = np.sign(value[:, 0])
    used, place = np.unique(at, return_inverse=True)
    x = dense(place.reshape(at.shape), value, len(used))  # other features have weight 0 throughout
    rows = {r["key"]: r for r in wide.loo_wide(frame(spark, at, value, y), "key", d).predictions.collect()}
    assert len(rows) == n
    for i in range(n):
        keep = np.arange(n) != i
        eta = np.append(x[i], 1.0) @ brute.logistic(x[keep], y[keep])
        r = rows[f"k{i:05d}"]
        assert r["label"] == y[i] and r["status"] == "ok" and r["prediction"] == int(eta >= 0)
        if r["refitted"]:
            assert r["eta"] == pytest.approx(eta, abs=1e-7)


def test_copies_settle_classes_without_solves(spark, monkeypatch):
    at, value, y, d = one_hot(4000, [5, 3], 9)
    value[:, 0] = np.sign(value[:, 0])
    solved = []
    whole = wide.leverages
    monkeypatch.setattr(wide, "leverages", lambda rows, wanted, *more: solved.append(wanted.count()) or whole(rows, wanted, *more))
    df = frame(spark, at, value, y)
    found = {r["key"]: r["prediction"] for r in wide.loo_wide(df, "key", d).predictions.collect()}
    names = [f"x{i}" for i in range(d)]
    flat = df.select("key", "y", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(F.array_contains("at", i), F.get("value", (F.array_position("at", i) - 1).cast("int"))).otherwise(0.0)).alias("x"))
    flat = flat.select("key", "y", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    wanted = {r["key"]: r["prediction"] for r in loo.loo_logistic(flat, "key", names, "y").predictions.collect()}
    assert found == wanted
    distinct = len({(*a, *v) for a, v in zip(at.tolist(), value.tolist(), strict=True)})
    assert sum(solved) < distinct  # the others needed no solve


def test_one_class_lone_rows_and_nothing(spark):
    at, value, y, d = one_hot(30, [4], 3)
    rows = wide.loo_wide(frame(spark, at, value, np.ones(30)), "key", d).predictions.collect()
    assert {(r["prediction"], r["status"]) for r in rows} == {(1, "single_class")}
    lone = (np.arange(30) == 7).astype(float)
    rows = {r["key"]: r for r in wide.loo_wide(frame(spark, at, value, lone), "key", d).predictions.collect()}
    assert rows["k00007"]["prediction"] == 0 and rows["k00007"]["status"] == "single_class"
    assert {r["status"] for k, r in rows.items() if k != "k00007"} == {"ok"}
    with pytest.raises(ValueError):
        wide.fit_wide(spark.createDataFrame([], ROWS), d)


def test_rows_of_a_preparation(spark):
    df = spark.createDataFrame([(1, 2.0, "b", 1), (2, 4.0, "a", 0), (3, None, None, 1), (4, 6.0, "b", 0)], "key int, x double, g string, y int")
    prep = fit_prep(df, ["x"], ["g"])
    rows, d = wide.sparse_rows(df, prep, F.col("y"), ["key"])
    assert d == len(prep.feature_names) == 3
    flat = {r["key"]: r for r in prep.transform(df, ["key"]).collect()}
    for r in rows.collect():
        x = np.zeros(d)
        x[r["at"]] = r["value"]
        assert np.allclose(x, [flat[r["key"]][n] for n in prep.feature_names])
    names = ["x0", "x1", "x2"]
    flat = prep.transform(df, ["key", "y"], names)
    assert np.allclose(wide.fit_wide(rows, d).weights, fit_logistic(flat, names, "y").weights, atol=1e-8)
