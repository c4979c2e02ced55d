"""Least squares and its leave-one-out errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loofold.functions.metrics import mean_absolute_error
from loofold.functions.scalars import linspace
from loofold.operators.linear import fit_linear, loo_linear, simple_ols
from loofold.queries.registry import query, r6, table

PRICE = ["l_quantity", "l_discount"]

# Two features by Cramer's rule on covariances.
TWO_FEATURES = """
WITH s AS (
  SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my,
         covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_quantity, l_discount) AS s12,
         covar_pop(l_discount, l_discount) AS s22, covar_pop(l_quantity, l_extendedprice) AS s1y,
         covar_pop(l_discount, l_extendedprice) AS s2y
  FROM lineitem),
b AS (
  SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
         (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2
  FROM s),
e AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS y, my + b1 * (l_quantity - m1) + b2 * (l_discount - m2) AS f,
         1.0 / n + (s22 * (l_quantity - m1) ** 2 - 2 * s12 * (l_quantity - m1) * (l_discount - m2)
                    + s11 * (l_discount - m2) ** 2) / (n * (s11 * s22 - s12 * s12)) AS h
  FROM lineitem, b)
"""


@query("""
SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept,
       CAST(regr_count(p_retailprice, p_size) AS BIGINT) AS n
FROM part
""")
def simple_ols_fit(spark, folder):
    fit = simple_ols(table(spark, folder, "part"), "p_size", "p_retailprice")
    return fit.select(r6("slope").alias("slope"), r6("intercept").alias("intercept"), F.col("n").cast("bigint").alias("n"))


@query("""
WITH f AS (
  SELECT regr_slope(p_retailprice, p_size) AS m, regr_intercept(p_retailprice, p_size) AS b,
         min(p_size) AS lo, max(p_size) AS hi FROM part)
SELECT round(lo + (hi - lo) / 49.0 * i, 6) AS x, round(m * (lo + (hi - lo) / 49.0 * i) + b, 6) AS y
FROM f, range(50) t(i)
""")
def ols_grid(spark, folder):
    """The fitted line over fifty evenly spaced sizes."""
    part = table(spark, folder, "part").select(F.col("p_size").cast("double"), "p_retailprice")
    line = part.agg(
        F.regr_slope("p_retailprice", "p_size").alias("m"),
        F.regr_intercept("p_retailprice", "p_size").alias("b"),
        F.min("p_size").alias("lo"),
        F.max("p_size").alias("hi"),
    )
    grid = line.select("m", "b", F.explode(linspace(F.col("lo"), F.col("hi"))).alias("x"))
    return grid.select(r6("x").alias("x"), r6(F.col("m") * F.col("x") + F.col("b")).alias("y"))


@query(TWO_FEATURES + """
SELECT 'l_quantity' AS term, round(b1, 4) AS weight FROM b UNION ALL SELECT 'l_discount', round(b2, 4) FROM b
UNION ALL SELECT 'intercept', round(my - b1 * m1 - b2 * m2, 4) FROM b
""")
def multi_ols(spark, folder):
    fit = fit_linear(table(spark, folder, "lineitem"), PRICE, "l_extendedprice")
    terms = [*zip(fit.features, map(float, fit.coefficients), strict=True), ("intercept", fit.intercept)]
    return spark.createDataFrame(terms, "term string, weight double").withColumn("weight", F.round("weight", 4))


@query(TWO_FEATURES + "SELECT l_orderkey, l_linenumber, l_partkey, round(f, 4) AS predicted FROM e")
def ols_predict(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    fit = fit_linear(lineitem, PRICE, "l_extendedprice")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(fit.predict(), 4).alias("predicted"))


@query(TWO_FEATURES + "SELECT l_orderkey, l_linenumber, l_partkey, round((y - f) / (1 - h), 4) AS loo_error FROM e")
def press_errors(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    errors = loo_linear(lineitem, fit_linear(lineitem, PRICE, "l_extendedprice"))
    return errors.select("l_orderkey", "l_linenumber", "l_partkey", F.round("loo_error", 4).alias("loo_error"))


@query(TWO_FEATURES + """
SELECT round(avg(abs((y - f) / (1 - h))), 5) AS mae, round(avg(-abs((y - f) / (1 - h))), 5) AS neg_mae FROM e
""")
def press_mae(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    errors = loo_linear(lineitem, fit_linear(lineitem, PRICE, "l_extendedprice"))
    mae = mean_absolute_error(errors, "l_extendedprice", "loo_prediction")
    return mae.select(F.round("mae", 5).alias("mae"), F.round("neg_mae", 5).alias("neg_mae"))
