import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loofold.operators import prep, profile, rows
from loofold.operators.split import fold_of, holdout_split, key_bucket
from loofold.queries import QUERIES
from tests.conftest import plan_of


def frame(spark):
    return spark.createDataFrame(
        [(1, 1.0, 2, "x", 0), (2, None, 1, "y", None), (3, 3.0, None, "y", 1), (4, 8.0, 1, None, 1)],
        "id int, `a.b` double, `c,d` int, e string, t int",
    )


def test_fit_and_transform(spark):
    df = frame(spark)
    model = prep.fit_prep(df, ["a.b"], ["c,d", "e"], "t")
    assert model.feature_names == ["a.b", "c,d_1", "c,d_2", "e_x", "e_y"]
    assert model.numeric["a.b"].mean == 4.0
    assert model.categorical["c,d"].median == 1 and model.categorical["c,d"].nulls == 1
    assert model.categorical["e"].median == "y"
    assert model.classes == [0, 1] and model.target_stats.median == 1
    out = model.transform(df, ["id"])
    scaled = out.agg(F.avg("`a.b`"), F.stddev_pop("`a.b`")).first()
    assert scaled[0] == pytest.approx(0) and scaled[1] == pytest.approx(1)
    groups = out.select(F.expr("`c,d_1` + `c,d_2`"), F.expr("e_x + e_y"), "t").collect()
    assert [tuple(r) for r in groups] == [(1, 1, 0), (1, 1, 1), (1, 1, 1), (1, 1, 1)]
    filled = {r["id"]: r for r in model.impute(df).collect()}
    assert filled[2]["a.b"] == 4.0 and filled[3]["c,d"] == 1 and filled[4]["e"] == "y"


def test_scaling_rules(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = prep.fit_prep(df, ["a", "b"], []).transform(df)
    assert sorted(map(tuple, out.collect())) == [(-1.0, 0.0), (1.0, 0.0)]


def filled_and_whole(found, filled, whole):
    """Counts of missing values, of those filled by the mean, and of those whose own value is scaled too."""
    missing = found.where("l_orderkey % 7 = 0")
    return missing.agg(
        F.count(F.lit(1)), F.count(F.when(F.col(filled) == 0, 1)), F.count(F.when(F.col(whole) != 0, 1))
    ).first()


def test_scaled_prices_are_filled_first(spark, tables):
    n, filled, whole = filled_and_whole(QUERIES["zscore"](spark, tables), "l_extendedprice", "whole_price")
    assert n == filled > 0 and whole > 0.9 * n


def test_matrix_is_filled_first(spark, tables):
    n, filled, whole = filled_and_whole(QUERIES["prepared_matrix"](spark, tables), "l_discount", "whole_discount")
    assert n == filled > 0 and whole > 0.9 * n


def test_unseen_level_and_limits(spark):
    df = frame(spark)
    model = prep.fit_prep(df.where("id = 1"), [], ["c,d"])
    assert [r[0] for r in model.transform(df).orderBy("`c,d_2`").collect()] == [0.0, 0.0, 1.0, 1.0]
    with pytest.raises(prep.TooManyLevels):
        prep.fit_prep(spark.range(50), [], ["id"], max_levels=20)
    with pytest.raises(prep.AllNull):
        prep.fit_prep(df.withColumn("z", F.lit(None).cast("double")), ["z"], [])


def test_sparse_one_hot(spark):
    df = frame(spark)
    codes = {r["id"]: list(r["v"]) for r in
             prep.sparse_one_hot(df, ["e", "c,d"]).withColumn("v", vector_to_array("onehot")).collect()}
    assert codes == {1: [1, 0, 0, 1], 2: [0, 1, 1, 0], 3: [0, 1, 0, 0], 4: [0, 0, 1, 0]}


def test_plans_stay_in_the_jvm(spark, tables):
    lineitem = spark.read.parquet(f"{tables}/lineitem.parquet")
    model = prep.fit_prep(lineitem, ["l_quantity", "l_tax"], ["l_returnflag"], "l_linenumber")
    plan = plan_of(model.transform(lineitem))
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_tax:double,l_returnflag:string>" in plan
    counted = plan_of(prep.level_table(lineitem, ["l_returnflag", "l_linestatus"]))
    assert counted.count("Exchange\n") <= 2 and "Python" not in counted
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in counted


def test_split_depends_on_key_only(spark):
    df = spark.range(5000)
    a = {r["id"] for r in holdout_split(df, "id", 0.1, 3).where("is_test").collect()}
    b = {r["id"] for r in holdout_split(df.repartition(7), "id", 0.1, 3).where("is_test").collect()}
    assert a == b and 400 < len(a) < 600
    folds = df.select(key_bucket(F.col("id"), 5).alias("a"), fold_of(F.col("id"), 5).alias("b"))
    assert [r[0] for r in folds.select("a").distinct().orderBy("a").collect()] == [0, 1, 2, 3, 4]
    assert folds.groupBy("b").count().count() == 5


def test_row_picks(spark):
    df = frame(spark)
    assert [r["id"] for r in rows.tail_rows(df, "id", 2).collect()] == [4, 3]
    assert [r["id"] for r in rows.slice_rows(df, "id", 2, 4).collect()] == [2, 3]
    assert rows.rows_at_max(df, "a.b").first()["id"] == 4
    assert rows.split_target(df) == (["id", "a.b", "c,d", "e"], "t")
    assert rows.numeric_features(df, ["e", "c,d"], "t") == ["id", "a.b"]
    typed = rows.normalise_types(df.withColumn("n", F.lit(float("nan"))), ["c,d", "e", "t"])
    assert dict(typed.dtypes) == {
        "id": "double", "a.b": "double", "c,d": "int", "e": "string", "t": "int", "n": "double"
    }
    assert typed.where("n IS NULL").count() == 4
    assert rows.table_shape(df) == (4, 5)


def test_binary_rule(spark):
    df = spark.createDataFrame(
        [(0, 0, 1, 1, 0, None), (1, 1, 1, 2, 1, None), (1, 2, 1, 1, None, None)],
        "a int, b int, c int, d int, e int, f int",
    )
    found = {r["column"]: r["is_binary"] for r in profile.binary_check(df, list("abcdef")).collect()}
    assert found == {"a": True, "b": False, "c": False, "d": False, "e": True}
