"""Catalog, requests, runs and energy readings, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loofold.functions import scalars
from loofold.plans.energy import attach_energy, cells_of, last_reading, marker_energy, nth_match, number_of
from loofold.queries.registry import query, table
from loofold.session import scratch_folder
from loofold.sources import catalog as cat
from loofold.streaming.readings import live_energy, store_live_energy


def _source_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Each document source as a dataset whose columns are its languages, the ones with
    labelled documents in the categorical role."""
    labels = table(spark, folder, "labels").select("doc_id", F.lit(1).alias("hit"))
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang").join(labels, "doc_id", "left")
    return documents.groupBy(F.col("source").alias("dataset"), F.col("lang").alias("column")).agg(
        F.concat(F.lit("/data/"), F.first("source"), F.lit(".csv")).alias("path"),
        F.when(F.max("hit") == 1, "categorical").otherwise("numeric").alias("role"),
        F.min(F.ascii("lang")).alias("ordinal"),
    )


CATALOG = """
catalog AS (
  SELECT source AS dataset, lang AS "column", '/data/' || source || '.csv' AS path,
         CASE WHEN count(l.doc_id) > 0 THEN 'categorical' ELSE 'numeric' END AS role, ascii(lang) * 1000 + ascii(substr(lang, 2)) AS ordinal
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source, lang)"""


@query("WITH " + CATALOG + """
SELECT dataset, path, count(*) AS n_columns,
       coalesce(string_agg("column", ',' ORDER BY ordinal) FILTER (WHERE role = 'categorical'), '') AS categorical,
       max("column") AS default_target
FROM catalog GROUP BY dataset, path
""")
def catalog_columns(spark, folder):
    listed = cat.list_datasets(_ordered_catalog(spark, folder))
    return listed.withColumn("categorical", F.concat_ws(",", "categorical"))


def _ordered_catalog(spark: SparkSession, folder: str) -> DataFrame:
    code = F.ascii("column") * 1000 + F.ascii(F.substring("column", 2, 1))
    return _source_catalog(spark, folder).withColumn("ordinal", code)


@query("WITH " + CATALOG + """,
pairs AS (
  SELECT event_id AS position, 'src' || (user_id % 25) AS dataset,
         CASE event_type WHEN 'click' THEN 'en' WHEN 'view' THEN 'fr' WHEN 'purchase' THEN 'it' WHEN 'signup' THEN 'de' END AS target
  FROM events),
r AS (
  SELECT p.position, p.dataset, coalesce(p.target, d.last) AS target, d.dataset AS known
  FROM pairs p LEFT JOIN (SELECT dataset, max("column") AS last FROM catalog GROUP BY dataset) d ON d.dataset = p.dataset),
j AS (
  SELECT r.*, c.role, row_number() OVER (PARTITION BY r.dataset, r.target ORDER BY r.position) AS rn
  FROM r LEFT JOIN catalog c ON c.dataset = r.dataset AND c."column" = r.target)
SELECT position, dataset, target,
       CASE WHEN known IS NULL THEN 'unknown_dataset' WHEN role IS NULL THEN 'unknown_column'
            WHEN role <> 'categorical' THEN 'not_categorical' WHEN rn > 1 THEN 'duplicate' ELSE 'ok' END AS status,
       CASE WHEN known IS NULL THEN 'no dataset named ' || dataset WHEN role IS NULL THEN dataset || ' has no column ' || target
            WHEN role <> 'categorical' THEN target || ' is not categorical' WHEN rn > 1 THEN 'requested before' END AS reason
FROM j
""")
def pair_status(spark, folder):
    target = (
        F.when(F.col("event_type") == "click", "en")
        .when(F.col("event_type") == "view", "fr")
        .when(F.col("event_type") == "purchase", "it")
        .when(F.col("event_type") == "signup", "de")
    )
    pairs = table(spark, folder, "events").select(
        F.col("event_id").alias("position"),
        F.concat(F.lit("src"), F.col("user_id") % 25).alias("dataset"),
        target.alias("target"),
    )
    return cat.pair_status(pairs, _ordered_catalog(spark, folder))


@query("""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS lines, string_split(text, ' ') AS words FROM documents),
b AS (SELECT doc_id, words, unnest(range(len(lines))) AS i FROM a)
SELECT doc_id, count(*) AS n_pairs, count(*) FILTER (WHERE words[i + 1] IS NULL) AS n_defaults,
       max(length(words[i + 1])) AS longest
FROM b GROUP BY doc_id
""")
def paired_requests(spark, folder):
    """Pairs by position: lines of a document with its words, missing partners null."""
    pairs = cat.pair_up(F.split("text", "\n"), F.split("text", " "))
    paired = table(spark, folder, "documents").select("doc_id", pairs.alias("pairs"))
    return paired.select(
        "doc_id",
        F.size("pairs").cast("bigint").alias("n_pairs"),
        F.size(F.filter("pairs", lambda p: p["target"].isNull())).cast("bigint").alias("n_defaults"),
        F.array_max(F.transform("pairs", lambda p: F.length(p["target"]))).cast("bigint").alias("longest"),
    )


@query("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g') AS name FROM pages")
def plain_names(spark, folder):
    return table(spark, folder, "pages").select("page_id", scalars.plain_name(F.col("url")).alias("name"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d_%Hh-%Mm-%Ss') AS stamp, printf('%.4f', value) AS shown,
       CASE WHEN event_type = 'click' THEN 'None' WHEN user_id % 2 = 0 THEN 'Intel''s VTune Profiler' ELSE 'RAPL interface' END AS method,
       event_type || '_' || CAST(user_id AS VARCHAR) AS level, value * 1000.0 AS time_ms, CAST(value AS DOUBLE) / 3.6e9 AS energy_kwh,
       coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE user_id END, 1) AS runs
FROM events
""")
def run_labels(spark, folder):
    platform = F.when(F.col("user_id") % 2 == 0, "Windows").otherwise("Linux")
    return table(spark, folder, "events").select(
        "event_id",
        scalars.run_stamp(F.col("ts")).alias("stamp"),
        scalars.fixed_decimals(F.col("value"), 4).alias("shown"),
        scalars.method_label(platform, F.col("event_type") != "click").alias("method"),
        scalars.level_name(F.col("event_type"), F.col("user_id")).alias("level"),
        scalars.seconds_to_ms(F.col("value")).alias("time_ms"),
        scalars.mj_to_kwh(F.col("value")).alias("energy_kwh"),
        scalars.fill_null(F.when(F.col("event_type") != "view", F.col("user_id")), F.lit(1)).alias("runs"),
    )


LAST = "SELECT user_id, arg_max(value, row(ts, value)) AS value, max(ts) AS ts FROM events GROUP BY user_id"


@query(LAST)
def energy_last(spark, folder):
    return last_reading(table(spark, folder, "events"), "value", "ts", ["user_id"])


@query("""
WITH m AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type LIKE '%purchase%')
SELECT u.user_id, coalesce(m.value, 0.0) AS energy_mj
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m ON m.user_id = u.user_id AND m.rn = 2
""")
def energy_marker_row(spark, folder):
    """Third cell of the second marked line per report; a user's events are the report."""
    lines = table(spark, folder, "events").select(
        "user_id",
        F.col("event_id").alias("line_no"),
        F.array("event_type", "props", F.col("value").cast("string")).alias("cells"),
    )
    return marker_energy(lines, ["user_id"], marker="purchase")


@query(f"""
WITH e AS ({LAST})
SELECT o_orderkey, o_custkey, e.value / 3.6e9 AS energy_kwh FROM orders LEFT JOIN e ON e.user_id = o_custkey
""")
def energy_per_run(spark, folder):
    runs = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    readings = last_reading(table(spark, folder, "events"), "value", "ts", ["user_id"])
    readings = readings.withColumnRenamed("user_id", "o_custkey").withColumn("unit", F.lit("mJ"))
    return attach_energy(runs, readings, ["o_custkey"], "value", "unit").select("o_orderkey", "o_custkey", "energy_kwh")


@query("""
SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, arg_max(value, row(ts, value)) AS value FROM events GROUP BY 1, 2
""")
def energy_stream(spark, folder):
    """The readings as a stream: newest value per run and day, stored batch by batch."""
    schema = table(spark, folder, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    live = live_energy(arriving.withColumn("ts", F.col("ts").cast("timestamp")), "value", "ts", "user_id", idle="3650 days")
    out = scratch_folder(spark, "live-energy")
    store_live_energy(live, out, scratch_folder(spark, "live-energy-state")).awaitTermination()
    stored = spark.read.parquet(out)
    return stored.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.struct("ts", "value"))["value"].alias("value"))


#: Lines of documents, as far as a comma makes them reports.
LINES = """
lines AS (
  SELECT doc_id, i AS line_no, regexp_extract_all(line || ',', '((?:[^,"]|"[^"]*"|")*),', 1) AS cells
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"""


def _report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document as a line of a ragged report."""
    docs = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs.select("doc_id", F.col("line_no").cast("long").alias("line_no"), cells_of(F.col("line")).alias("cells"))


@query("WITH " + LINES + """
SELECT doc_id, count(*) AS n_lines, sum(len(cells))::BIGINT AS n_cells, max(len(cells))::BIGINT AS widest,
       sum(len(list_filter(cells, lambda c: regexp_matches(c, '^ *[0-9]+([.][0-9]+)? *$'))))::BIGINT AS n_numbers,
       sum(len(list_filter(cells, lambda c: contains(c, '"'))))::BIGINT AS n_quoted
FROM lines GROUP BY doc_id
""")
def report_cells(spark, folder):
    """Lines and cells of ragged reports, and the cells that are numbers."""
    lines = _report_lines(spark, folder)
    plain = lambda c: number_of(c).isNotNull() & c.rlike("^ *[0-9]+([.][0-9]+)? *$")
    total = lambda c: F.sum(c).cast("long")
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        total(F.size("cells")).alias("n_cells"),
        F.max(F.size("cells").cast("long")).alias("widest"),
        total(F.size(F.filter("cells", plain))).alias("n_numbers"),
        total(F.size(F.filter("cells", lambda c: c.contains('"')))).alias("n_quoted"),
    )


@query("WITH " + LINES + """,
marked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines
  WHERE len(list_filter(cells, lambda c: contains(c, 'the'))) > 0)
SELECT doc_id, line_no, cells[1] AS cell, len(cells)::BIGINT AS n_cells FROM marked WHERE n = 2
""")
def report_second_marker(spark, folder):
    """The second line of each report that holds the marker, its first cell and its width."""
    marked = _report_lines(spark, folder).where(F.exists("cells", lambda c: c.contains("the")))
    found = nth_match(marked, ["doc_id"], "line_no", 2)
    return found.select("doc_id", "line_no", F.try_element_at("cells", F.lit(1)).alias("cell"), F.size("cells").cast("long").alias("n_cells"))
