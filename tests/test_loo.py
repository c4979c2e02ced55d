import numpy as np
import pytest
from pyspark.sql import functions as F

from loofold.functions.metrics import mcc_binary
from loofold.operators import loo, nearby, softmax
from loofold.operators.logistic import fit_logistic, mllib_start
from loofold.operators.multiclass import kfold_in_fold_prep, kfold_multinomial
from tests import brute
from tests.conftest import plan_of


def binary_table(spark, n, d, seed, noise=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=d) + noise * rng.logistic(size=n) > 0.3).astype(int)
    names = [f"f.{i}" for i in range(d)]
    df = spark.createDataFrame(
        [(f"k{i:04d}", *map(float, x[i]), int(y[i])) for i in range(n)], ["key", *names, "y"]
    )
    return df.repartition(4), names, x, y


def refits(x, y):
    eta = np.empty(len(y))
    for i in range(len(y)):
        keep = np.arange(len(y)) != i
        eta[i] = np.append(x[i], 1.0) @ brute.logistic(x[keep], y[keep])
    return eta


def test_bound_of_the_logarithm():
    s = np.linspace(1e-4, 0.75, 20000)
    exact = -np.log1p(-np.exp(s) * (np.expm1(s) - s))
    assert (exact <= 0.5 * s * s * np.exp(2.24 * s) * (1 + 1e-9)).all()


@pytest.mark.parametrize("n, d", [(80, 2), (80, 20)])
def test_fit(spark, n, d):
    df, names, x, y = binary_table(spark, n, d, 1)
    fit = fit_logistic(df, names, "y")
    assert np.allclose(fit.weights, brute.logistic(x, y), atol=1e-9)
    again = fit_logistic(df, names, "y", start=mllib_start(df, names, "y", 1.0))
    assert np.allclose(again.weights, fit.weights, atol=1e-9) and again.passes < fit.passes


@pytest.mark.parametrize("n, d, noise", [(70, 2, 1.0), (60, 3, 8.0), (60, 18, 1.0), (50, 2, 0.01)])
def test_classes_equal_refits(spark, n, d, noise):
    """Also with no signal, with none to spare, and with separable rows."""
    df, names, x, y = binary_table(spark, n, d, n * d, noise)
    eta = refits(x, y)
    found = loo.loo_logistic(df, "key", names, "y")
    rows = {r["key"]: r for r in found.predictions.collect()}
    assert len(rows) == n and sum(r["refitted"] for r in rows.values()) == found.refitted
    for i in range(n):
        r = rows[f"k{i:04d}"]
        assert r["label"] == y[i] and r["prediction"] == int(eta[i] >= 0) and r["status"] == "ok"
        if r["refitted"]:
            assert r["eta"] == pytest.approx(eta[i], abs=1e-8)
    exact = loo.loo_exact(df, "key", names, "y")
    for r in exact.predictions.collect():
        assert r["eta"] == pytest.approx(eta[int(r["key"][1:])], abs=1e-8)
    with pytest.raises(loo.TooMuchWork):
        loo.loo_exact(df, "key", names, "y", limit=n)


def test_bound_holds_for_every_row(spark):
    """The refit never lies farther from the first step than the bound says."""
    df, names, x, y = binary_table(spark, 60, 3, 11, 3.0)
    fit = fit_logistic(df, names, "y")
    a = np.column_stack([x, np.ones(60)])
    inverse = np.linalg.inv(fit.hessian)
    p = 1 / (1 + np.exp(-(a @ fit.weights)))
    q = np.einsum("ij,jk,ik->i", a, inverse, a)
    t = (p - y) / (1 - p * (1 - p) * q)
    s = np.sqrt(q.max() * q) * np.abs(t)
    bound = np.sqrt(q / q.max()) * 0.5 * s * s * np.exp(2.24 * s)
    off = np.abs(refits(x, y) - (a @ fit.weights + q * t))
    assert (s <= 0.75).sum() > 20
    assert (off <= bound + 1e-9)[s <= 0.75].all()


def test_batches_of_refits(spark, monkeypatch):
    df, names, x, y = binary_table(spark, 40, 2, 4)
    monkeypatch.setattr(loo, "block_size", lambda width: 7)
    eta = refits(x, y)
    found = loo.loo_exact(df, "key", names, "y").predictions.collect()
    assert len(found) == 40
    for r in found:
        assert r["eta"] == pytest.approx(eta[int(r["key"][1:])], abs=1e-8) and r["refitted"]


def test_scores_without_refits_over_all_rows(spark, monkeypatch):
    """The expansion gives nearly every converged score; what is left to refit does not grow with the rows."""
    df, names, x, y = binary_table(spark, 300, 2, 5)
    seen, refit = [], loo.refit_folds
    monkeypatch.setattr(loo, "refit_folds", lambda rows, a, labels, fit: seen.append(len(a)) or refit(rows, a, labels, fit))
    eta = refits(x, y)
    for r in loo.loo_exact(df, "key", names, "y").predictions.collect():
        assert r["refitted"] and r["eta"] == pytest.approx(eta[int(r["key"][1:])], abs=1e-10)
    assert sum(seen) < 30
    copies = df.crossJoin(spark.range(40)).withColumn("key", F.concat("key", F.lit("-"), "id")).drop("id")
    few, seen[:] = sum(seen), []
    found = loo.loo_exact(copies, "key", names, "y")
    assert found.predictions.where("refitted").count() == found.refitted == 12000 and sum(seen) <= few


def test_expansion_bound_holds(spark, monkeypatch):
    """No score is farther from its refit than proven, however few terms the expansion has."""
    df, names, x, y = binary_table(spark, 60, 2, 12, 2.0)
    fit = fit_logistic(df, names, "y")
    rows = loo.model_rows(df, names, "y", ["key"])
    a, eta = np.column_stack([x, np.ones(60)]), refits(x, y)
    for terms in (2, 3, 6):
        monkeypatch.setattr(nearby, "MOST_TERMS", terms)
        expansion = nearby.Expansion(rows, fit)
        assert expansion.terms == terms
        _, found, bound = expansion.left_out(a, y.astype(float), nearby.largest_q(rows, expansion))
        assert np.isfinite(bound).sum() > 40 and (np.abs(found - eta) <= bound + 1e-11).all()


def test_single_class_and_lone_row(spark):
    df = spark.createDataFrame([(i, float(i), 1) for i in range(6)], "id int, x double, y int")
    rows = loo.loo_logistic(df, "id", ["x"], "y").predictions.collect()
    assert {(r["prediction"], r["status"]) for r in rows} == {(1, "single_class")}
    one = df.withColumn("y", (F.col("id") == 5).cast("int"))
    rows = {r["id"]: r for r in loo.loo_logistic(one, "id", ["x"], "y").predictions.collect()}
    assert rows[5]["prediction"] == 0 and rows[5]["status"] == "single_class" and rows[5]["eta"] is None
    x, y = np.arange(6.0)[:, None], (np.arange(6) == 5).astype(int)
    for i in range(5):
        keep = np.arange(6) != i
        w = brute.logistic(x[keep], y[keep])
        assert rows[i]["prediction"] == int(np.append(x[i], 1) @ w >= 0) and rows[i]["status"] == "ok"


def test_order_and_partitions_do_not_matter(spark):
    df, names, _, _ = binary_table(spark, 60, 2, 9)
    counts = [tuple(mcc_binary(loo.loo_logistic(d, "key", names, "y").predictions).first())
              for d in (df, df.orderBy(F.desc("key")).coalesce(1))]
    assert counts[0][:4] == counts[1][:4]


def test_kfold(spark):
    for d in (2, 18):
        df, names, x, y = binary_table(spark, 60, d, 21 + d)
        fold = (F.substring("key", 2, 4).cast("int") % 4).cast("int")
        rows = loo.kfold_logistic(df, "key", names, "y", 4, fold=fold).predictions.collect()
        assert len(rows) == 60
        for r in rows:
            i = int(r["key"][1:])
            keep = np.arange(60) % 4 != i % 4
            eta = np.append(x[i], 1.0) @ brute.logistic(x[keep], y[keep])
            assert r["fold"] == i % 4 and r["eta"] == pytest.approx(eta, abs=1e-8)


def test_kfold_with_one_class_left(spark):
    df = spark.createDataFrame([(i, float(i), int(i % 2 == 0)) for i in range(8)], "id int, x double, y int")
    rows = loo.kfold_logistic(df, "id", ["x"], "y", 2, fold=(F.col("id") % 2).cast("int")).predictions.collect()
    assert {(r["label"], r["prediction"], r["status"]) for r in rows} == {
        (1, 0, "single_class"), (0, 1, "single_class")
    }


def many_table(spark, n, d, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=(d, k)) + rng.gumbel(size=(n, k))).argmax(axis=1)
    df = spark.createDataFrame(
        [(i, *map(float, x[i]), "abcd"[y[i]]) for i in range(n)], ["id", *[f"f{j}" for j in range(d)], "kind"]
    )
    return df, [f"f{j}" for j in range(d)], x, y


def test_many_classes_equal_refits(spark):
    df, names, x, y = many_table(spark, 60, 2, 3, 1)
    found = softmax.loo_softmax(df, "id", names, "kind")
    assert 0 < found.refitted < 60
    for r in found.predictions.collect():
        i = r["id"]
        keep = np.arange(60) != i
        p = brute.probabilities(np.append(x[i], 1) @ brute.softmax(x[keep], y[keep], 3).T)
        assert r["prediction"] == "abcd"[p.argmax()] and r["label"] == "abcd"[y[i]]
        if r["refitted"]:
            assert r["p"] == pytest.approx(p.max(), abs=1e-9)


def test_only_row_of_a_class(spark):
    df, names, x, y = many_table(spark, 45, 2, 3, 2)
    df = df.withColumn("kind", F.when(F.col("id") == 7, "d").otherwise(F.col("kind")))
    rows = {r["id"]: r for r in softmax.loo_softmax(df, "id", names, "kind").predictions.collect()}
    keep = np.arange(45) != 7
    p = brute.probabilities(np.append(x[7], 1) @ brute.softmax(x[keep], y[keep], 3).T)
    assert rows[7]["status"] == "lost_class" and rows[7]["prediction"] == "abcd"[p.argmax()]
    assert len(rows) == 45


def test_kfold_many_classes(spark):
    df, names, x, y = many_table(spark, 60, 2, 3, 5)
    fold = (F.col("id") % 3).cast("int")
    shared = {r["id"]: r for r in softmax.kfold_softmax(df, "id", names, "kind", 3, fold=fold).collect()}
    single = {r["id"]: r for r in kfold_multinomial(df, "id", names, "kind", 3, fold=fold).collect()}
    for i in range(60):
        keep = np.arange(60) % 3 != i % 3
        p = brute.probabilities(np.append(x[i], 1) @ brute.softmax(x[keep], y[keep], 3).T)
        assert shared[i]["p"] == pytest.approx(p.max(), abs=1e-8)
        assert single[i]["p"] == pytest.approx(p.max(), abs=1e-2)
        assert shared[i]["prediction"] == "abcd"[p.argmax()]


def test_prep_within_folds(spark):
    rows = [(i, float(i % 7) if i % 5 else None, i % 3 if i < 18 else 9, int(i % 7 > 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, c int, y int")
    out = kfold_in_fold_prep(df, "id", ["a"], ["c"], "y", 3, fold=(F.col("id") % 3).cast("int"))
    found = out.collect()
    assert len(found) == 60 and sum(r["label"] == r["prediction"] for r in found) > 45


def test_plan_has_no_cartesian_product(spark):
    df, names, _, _ = binary_table(spark, 40, 2, 3)
    plan = plan_of(loo.loo_logistic(df, "key", names, "y").predictions)
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "MapInArrow" not in plan and "EvalPython" not in plan


@pytest.mark.parametrize("d", [2, 18])
def test_missing_values_are_refused(spark, d):
    df, names, _, _ = binary_table(spark, 40, d, 3)
    holed = df.withColumn(names[0], F.when(F.col("key") != "k0003", F.col(f"`{names[0]}`")))
    with pytest.raises(ValueError, match="impute"):
        loo.loo_logistic(holed, "key", names, "y")
