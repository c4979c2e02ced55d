"""Imputation, scaling, encoding, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from loofold.operators import prep
from loofold.operators.split import holdout_split
from loofold.queries.registry import hole, query, r6, table

ITEM = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("""
SELECT l_orderkey, l_linenumber, l_partkey,
       round(coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END,
             (SELECT avg(l_extendedprice) FROM lineitem WHERE l_orderkey % 7 <> 0)), 6) AS l_extendedprice,
       round(coalesce(CASE WHEN l_partkey % 7 <> 0 THEN l_discount END,
             (SELECT avg(l_discount) FROM lineitem WHERE l_partkey % 7 <> 0)), 6) AS l_discount
FROM lineitem
""")
def impute_mean(spark, folder):
    lineitem = table(spark, folder, "lineitem").select(
        *ITEM,
        hole("l_orderkey", "l_extendedprice").alias("l_extendedprice"),
        hole("l_partkey", "l_discount").alias("l_discount"),
    )
    filled = prep.fit_prep(lineitem, ["l_extendedprice", "l_discount"], []).impute(lineitem)
    return filled.select(*ITEM, r6("l_extendedprice").alias("l_extendedprice"), r6("l_discount").alias("l_discount"))


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_size END,
       (SELECT quantile_disc(p_size, 0.5) FROM part WHERE p_partkey % 7 <> 0)) AS p_size
FROM part
""")
def impute_lower_median(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", hole("p_partkey", "p_size").alias("p_size"))
    return prep.fit_prep(part, [], ["p_size"]).impute(part)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey,
       round(coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END,
             (SELECT avg(l_tax) FROM lineitem WHERE l_orderkey % 7 <> 0)), 6) AS l_tax,
       coalesce(CASE WHEN l_suppkey % 7 <> 0 THEN l_linestatus END,
             (SELECT quantile_disc(l_linestatus, 0.5) FROM lineitem WHERE l_suppkey % 7 <> 0)) AS l_linestatus
FROM lineitem
""")
def impute_by_role(spark, folder):
    lineitem = table(spark, folder, "lineitem").select(
        *ITEM,
        hole("l_orderkey", "l_tax").alias("l_tax"),
        hole("l_suppkey", "l_linestatus").alias("l_linestatus"),
    )
    filled = prep.fit_prep(lineitem, ["l_tax"], ["l_linestatus"]).impute(lineitem)
    return filled.withColumn("l_tax", r6("l_tax"))


@query("""
SELECT doc_id, coalesce(CASE WHEN doc_id % 7 <> 0 THEN quality END,
       (SELECT quantile_disc(quality, 0.5) FROM labels WHERE doc_id % 7 <> 0)) AS quality
FROM labels
""")
def fill_target(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", hole("doc_id", "quality").alias("quality"))
    return prep.fit_prep(labels, [], [], "quality").impute(labels)


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_size END,
       CAST(floor((SELECT quantile_cont(p_size, 0.5) FROM part WHERE p_partkey % 7 <> 0)) AS INTEGER)) AS p_size
FROM part
""")
def fill_floor_median(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", hole("p_partkey", "p_size").alias("p_size"))
    middle = part.select(F.floor(F.median("p_size")).cast("int")).scalar()
    return part.withColumn("p_size", F.coalesce("p_size", middle))


@query("""
WITH f AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice AS whole,
         coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END,
                  (SELECT avg(l_extendedprice) FROM lineitem WHERE l_orderkey % 7 <> 0)) AS price
  FROM lineitem),
s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(price) AS mp, stddev_pop(price) AS sp,
             avg(whole) AS mw, stddev_pop(whole) AS sw FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity,
       round((price - mp) / sp, 6) + 0.0 AS l_extendedprice, round((whole - mw) / sw, 6) + 0.0 AS whole_price
FROM f, s
""")
def zscore(spark, folder):
    """Quantity and price scaled, the price as filled by its mean where missing and as it is."""
    lineitem = table(spark, folder, "lineitem").select(
        *ITEM,
        "l_quantity",
        hole("l_orderkey", "l_extendedprice").alias("l_extendedprice"),
        F.col("l_extendedprice").alias("whole_price"),
    )
    columns = ["l_quantity", "l_extendedprice", "whole_price"]
    scaled = prep.fit_prep(lineitem, columns, []).transform(lineitem, ITEM)
    return scaled.select(*ITEM, *[r6(c).alias(c) for c in columns])


@query("""
SELECT c_custkey, coalesce((length(c_name) - m) / nullif(s, 0), 0.0) AS flat
FROM customer, (SELECT avg(length(c_name)) AS m, stddev_pop(length(c_name)) AS s FROM customer)
""")
def zero_variance(spark, folder):
    """Names of customers are equally long in the tables, so their length has no spread."""
    names = table(spark, folder, "customer").select("c_custkey", F.length("c_name").alias("flat"))
    return prep.fit_prep(names, ["flat"], []).transform(names, ["c_custkey"])


@query("""
WITH v AS (SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM v)), 6) AS value FROM v
""")
def impute_nan(spark, folder):
    """NaNs and nulls alike are filled by the mean of the others."""
    nan = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 != 0, F.col("value"))
    events = table(spark, folder, "events").select("event_id", nan.alias("value"))
    return prep.fit_prep(events, ["value"], []).impute(events).withColumn("value", r6("value"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey,
       CAST(l_returnflag = 'A' AS DOUBLE) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS DOUBLE) AS "l_returnflag_N",
       CAST(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag_R", CAST(l_linestatus = 'F' AS DOUBLE) AS "l_linestatus_F",
       CAST(l_linestatus = 'O' AS DOUBLE) AS "l_linestatus_O"
FROM lineitem
""")
def one_hot(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return prep.fit_prep(lineitem, [], ["l_returnflag", "l_linestatus"]).transform(lineitem, ITEM)


@query("""
SELECT event_id, CAST(event_type = 'click' AS DOUBLE) AS event_type_click,
       CAST(event_type = 'purchase' AS DOUBLE) AS event_type_purchase, CAST(event_type = 'view' AS DOUBLE) AS event_type_view
FROM events
""")
def one_hot_unknown(spark, folder):
    """Levels learnt where there was no error or signup; those two become all zeros."""
    events = table(spark, folder, "events")
    seen = events.where(~F.col("event_type").isin("error", "signup"))
    return prep.fit_prep(seen, [], ["event_type"]).transform(events, ["event_id"])


@query("""
WITH levels AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS at FROM (SELECT DISTINCT p_brand FROM part)),
n AS (SELECT count(*) AS n FROM levels),
types AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS at FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, CAST(levels.at AS INTEGER) AS brand_at, CAST(n.n + types.at AS INTEGER) AS type_at
FROM part JOIN levels USING (p_brand) JOIN types USING (p_type), n
""")
def sparse_one_hot(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    encoded = prep.sparse_one_hot(part, ["p_brand", "p_type"], positions="at")
    return encoded.select("p_partkey", F.get("at", F.lit(0)).alias("brand_at"), F.get("at", F.lit(1)).alias("type_at"))


@query("""
WITH f AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus, l_discount AS whole,
         coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_discount END,
                  (SELECT avg(l_discount) FROM lineitem WHERE l_orderkey % 7 <> 0)) AS d
  FROM lineitem),
s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(d) AS md, stddev_pop(d) AS sd,
             avg(whole) AS mw, stddev_pop(whole) AS sw FROM f)
SELECT l_orderkey, l_partkey, round((l_quantity - mq) / sq, 6) + 0.0 AS l_quantity, round((d - md) / sd, 6) + 0.0 AS l_discount,
       round((whole - mw) / sw, 6) + 0.0 AS whole_discount,
       CAST(l_returnflag = 'A' AS DOUBLE) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS DOUBLE) AS "l_returnflag_N",
       CAST(l_returnflag = 'R' AS DOUBLE) AS "l_returnflag_R", CAST(l_linestatus = 'F' AS DOUBLE) AS "l_linestatus_F",
       CAST(l_linestatus = 'O' AS DOUBLE) AS "l_linestatus_O", l_linenumber
FROM f, s
""")
def prepared_matrix(spark, folder):
    """Numbers scaled, the discount as filled by its mean where missing and as it is, and indicators of levels."""
    lineitem = table(spark, folder, "lineitem").withColumns(
        {"l_discount": hole("l_orderkey", "l_discount"), "whole_discount": F.col("l_discount")}
    )
    columns = ["l_quantity", "l_discount", "whole_discount"]
    model = prep.fit_prep(lineitem, columns, ["l_returnflag", "l_linestatus"], "l_linenumber")
    matrix = model.transform(lineitem, ["l_orderkey", "l_partkey"])
    return matrix.withColumns({c: r6(c) for c in columns})


@query("""
WITH a AS (SELECT o_orderkey, ((o_orderkey + 42) % 2147483648 * 1103515245 + 12345) % 2147483648 AS s FROM orders),
b AS (SELECT o_orderkey, (s * 1103515245 + 12345) % 2147483648 AS s FROM a)
SELECT o_orderkey, floor(s * 1000 / 2147483648.0) < 100 AS is_test FROM b
""")
def holdout_split_orders(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return holdout_split(orders, "o_orderkey", 0.1, seed=42)
