"""Column statistics and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loofold.operators import profile
from loofold.operators.quantiles import exact_percentile_pairs, lower_median, middle_median, percentiles_by
from loofold.queries.registry import query, r6, table

PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(column: str, value: str) -> str:
    return f"""
SELECT '{column}' AS "column", count({value}) AS n, count(*) - count({value}) AS nulls,
       round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS std, round(stddev_pop({value}), 6) AS std_pop,
       round(CAST(min({value}) AS DOUBLE), 6) AS min, round(quantile_cont({value}, 0.25), 6) AS q25,
       round(quantile_cont({value}, 0.5), 6) AS q50, round(quantile_cont({value}, 0.75), 6) AS q75,
       round(CAST(max({value}) AS DOUBLE), 6) AS max
FROM lineitem"""


@query(
    " UNION ALL ".join(
        _profile_sql(c, c) for c in PROFILED
    )
)
def column_profile(spark, folder):
    stats = profile.column_profile(table(spark, folder, "lineitem"), PROFILED)
    return stats.select("column", "n", "nulls", *[r6(c).alias(c) for c in stats.columns[3:]])


@query("""
SELECT p_brand, quantile_disc(p_size, 0.5) AS p_size
FROM part GROUP BY p_brand
""")
def lower_median_by_level(spark, folder):
    part = table(spark, folder, "part")
    return part.groupBy("p_brand").agg(lower_median("p_size").cast("int").alias("p_size"))


@query("""
SELECT p_brand, quantile_cont(p_size, 0.5) AS p_size
FROM part GROUP BY p_brand
""")
def middle_median_by_level(spark, folder):
    part = table(spark, folder, "part")
    return part.groupBy("p_brand").agg(middle_median("p_size").alias("p_size"))


SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({p} AS DOUBLE) AS share, CAST(quantile_disc({c}, {p}) AS DOUBLE) AS lower, "
        f"round(CAST(quantile_cont({c}, {p}) AS DOUBLE), 6) AS middle FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
        for p in SHARES
    )
)
def exact_quantiles(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    names = ["l_extendedprice", "l_quantity"]
    size = lineitem.agg(*[F.count(c).alias(c) for c in names]).first().asDict()
    lower, middle = exact_percentile_pairs(lineitem, names, SHARES, counts=size)
    values = [(c, p, lower[c][i], middle[c][i]) for c in names for i, p in enumerate(SHARES)]
    found = spark.createDataFrame(values, "column string, share double, lower double, middle double")
    return found.withColumn("middle", r6("middle"))


@query("""
SELECT 'l_returnflag' AS "column", l_returnflag AS level, count(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2
""")
def level_counts(spark, folder):
    return profile.level_counts(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("""
SELECT 'l_partkey' AS "column", count(DISTINCT l_partkey) AS n_levels FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem
""")
def distinct_counts(spark, folder):
    return profile.distinct_counts(table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"])


@query("""
WITH v AS (
  SELECT 'quality' AS "column", quality AS x FROM labels
  UNION ALL SELECT 'toxic', toxic FROM labels
  UNION ALL SELECT 'n', quality + toxic FROM labels
)
SELECT "column", count(DISTINCT x) AS n_classes, bool_and(x IN (0, 1)) AS all_zero_one,
       count(DISTINCT x) = 2 AND bool_and(x IN (0, 1)) AS is_binary
FROM v WHERE x IS NOT NULL GROUP BY "column"
""")
def binary_targets(spark, folder):
    labels = table(spark, folder, "labels").select(
        "quality", "toxic", (F.col("quality") + F.col("toxic")).alias("n")
    )
    return profile.binary_check(labels, ["quality", "toxic", "n"])


@query("""
SELECT level, n, round(lower, 6) AS lower, round(middle, 6) AS middle, round(ninth, 6) AS ninth FROM (
  SELECT level, count(*) AS n, quantile_disc(price, 0.5) AS lower, quantile_cont(price, 0.5) AS middle, quantile_disc(price, 0.9) AS ninth
  FROM (SELECT CASE WHEN l_orderkey % 10 = 0 THEN l_returnflag ELSE 'rest' END AS level, l_extendedprice::DOUBLE AS price FROM lineitem)
  GROUP BY level)
""")
def median_by_hot_level(spark, folder):
    """Exact medians and ninth tenths of the price by level, of which one holds nine tenths of the rows."""
    level = F.when(F.col("l_orderkey") % 10 == 0, F.col("l_returnflag")).otherwise("rest").alias("level")
    rows = table(spark, folder, "lineitem").select(level, "l_extendedprice")
    found = percentiles_by(rows, ["level"], "l_extendedprice", [0.5, 0.9])
    return found.select("level", "n", r6(F.get("lower", F.lit(0))).alias("lower"), r6(F.get("middle", F.lit(0))).alias("middle"), r6(F.get("lower", F.lit(1))).alias("ninth"))
