"""Projections, filters, positions, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loofold.operators import profile, rows, sets
from loofold.queries.registry import hole, query, table


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def drop_columns(spark, folder):
    return table(spark, folder, "part").drop("p_name", "p_type")


@query("SELECT r_regionkey, r_name FROM region")
def trim_column_names(spark, folder):
    padded = table(spark, folder, "region").toDF(" r_regionkey", "r_name ")
    return rows.trim_names(padded)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 32")
def filter_range(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return lineitem.where(F.col("l_quantity") >= 32).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")
def max_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rows.rows_at_max(orders, "o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000007'")
def key_lookup(spark, folder):
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rows.lookup(customer, "c_name", "Customer#000000007")


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 100")
def head_rows(spark, folder):
    return rows.head_rows(table(spark, folder, "events").select("event_id", "user_id", "event_type", "value"), "event_id", 100)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def tail_rows(spark, folder):
    return rows.tail_rows(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 5)


@query("SELECT event_id, user_id, value FROM events WHERE event_id >= 200 AND event_id < 500")
def slice_rows(spark, folder):
    return rows.slice_rows(table(spark, folder, "events").select("event_id", "user_id", "value"), "event_id", 200, 500)


@query("""
SELECT event_id, CAST(trunc(value) AS INTEGER) AS whole, CAST(user_id AS DOUBLE) AS user_number,
       TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS no_number
FROM events
""")
def cast_columns(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        F.col("value").cast("int").alias("whole"),
        F.col("user_id").cast("double").alias("user_number"),
        F.regexp_extract("props", "[0-9]+", 0).try_cast("double").alias("k"),
        F.col("event_type").try_cast("double").alias("no_number"),
    )


@query("""
SELECT count(*) FILTER (WHERE l_orderkey % 7 = 0) AS l_quantity, CAST(0 AS BIGINT) AS l_tax,
       count(*) FILTER (WHERE l_partkey % 7 = 0) AS l_discount
FROM lineitem
""")
def null_counts(spark, folder):
    lineitem = table(spark, folder, "lineitem").select(
        hole("l_orderkey", "l_quantity").alias("l_quantity"),
        hole("l_partkey", "l_discount").alias("l_discount"),
        "l_tax",
    )
    return profile.null_counts(lineitem, ["l_quantity", "l_tax", "l_discount"])


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 7 <> 0")
def drop_nulls(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", hole("p_partkey", "p_size").alias("p_size"))
    return part.where(F.col("p_size").isNotNull())


@query("SELECT 'lineitem' AS name, count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, max(l_quantity) AS top FROM lineitem")
def table_shape(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return lineitem.agg(
        F.lit("lineitem").alias("name"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(lineitem.columns)).cast("bigint").alias("n_columns"),
        F.max("l_quantity").alias("top"),
    )


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_pairs(spark, folder):
    return sets.duplicated(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def ordered_distinct(spark, folder):
    return sets.ordered_distinct(table(spark, folder, "events"), "user_id", "event_id")


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS words, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, CAST(len(list_distinct(words)) AS INTEGER) AS n_words,
       CAST(len(list_distinct(words)) - len(list_intersect(list_distinct(words), list_distinct(lines))) AS INTEGER) AS n_other
FROM w
""")
def name_difference(spark, folder):
    words, lines = F.split("text", " "), F.split("text", "\n")
    return table(spark, folder, "documents").select(
        "doc_id",
        F.size(sets.as_set(words)).alias("n_words"),
        F.size(sets.name_difference(words, lines)).alias("n_other"),
    )


@query("""
SELECT event_id, user_id, value, CAST(NULL AS VARCHAR) AS props FROM events WHERE event_type = 'click'
UNION ALL
SELECT event_id, user_id, CAST(NULL AS DOUBLE) AS value, props FROM events WHERE event_type <> 'click'
""")
def merge_runs(spark, folder):
    events = table(spark, folder, "events")
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "value")
    others = events.where("event_type <> 'click'").select("props", "user_id", "event_id")
    return sets.concatenate([clicks, others])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest_runs(spark, folder):
    orders = table(spark, folder, "orders")
    return rows.newest(orders, "o_orderdate", 20, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")
