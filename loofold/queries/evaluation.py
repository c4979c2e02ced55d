"""Logistic fits, out-of-fold predictions and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loofold.functions import metrics
from loofold.functions.scalars import decide, sigmoid
from loofold.operators.logistic import fit_logistic, score
from loofold.operators.loo import kfold_logistic, loo_exact, loo_logistic
from loofold.operators.multiclass import kfold_in_fold_prep, kfold_multinomial
from loofold.operators.prep import fit_prep
from loofold.operators.softmax import kfold_softmax, loo_softmax
from loofold.operators.split import key_bucket
from loofold.plans.evaluate import evaluate
from loofold.queries.newton_sql import MCC, SCORED, fold_bucket, newton3_ctes, newton_ctes
from loofold.queries.registry import query, r6, table
from loofold.session import written_table

FOLDS = 5
TEXT = ["odd_share", "distinct_share"]


def text_measures(spark: SparkSession, folder: str, *targets: str) -> DataFrame:
    """doc_id, two text measures and targets of each labelled document.

    The texts are read once, and only their measures meet the labels: no text is shuffled.
    What later passes scan is a table of a few numbers per labelled document.
    """
    words = F.split("text", " ")
    odd = F.length(F.regexp_replace("text", "[A-Za-z ]+", "")) / F.length("text")
    measures = table(spark, folder, "documents").select(
        "doc_id", odd.alias("odd_share"), (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share")
    )
    labels = table(spark, folder, "labels").select("doc_id", *targets)
    return written_table(measures.join(labels, "doc_id"), "text-measures")


def text_model(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, the text measures standardised, quality."""
    measured = text_measures(spark, folder, "quality")
    return fit_prep(measured, TEXT, [], "quality").transform(measured, ["doc_id"])


FULL = newton_ctes(None)
FULL_SCORED = FULL + ", o AS (" + SCORED.format(on="true") + ")"
BY_FOLD = newton_ctes(fold_bucket(FOLDS)) + ", o AS (" + SCORED.format(on="x.fold = w.f") + ")"
BY_ROW = newton_ctes("doc_id") + ", o AS (" + SCORED.format(on="x.fold = w.f") + ")"
LABELLED = "SELECT y, CAST(eta >= 0 AS INTEGER) AS z FROM o"


@query(FULL + """
SELECT 'odd_share' AS term, round(a, 6) AS weight FROM w UNION ALL SELECT 'distinct_share', round(b, 6) FROM w
UNION ALL SELECT 'intercept', round(c, 6) FROM w
""")
def logit_fit(spark, folder):
    fit = fit_logistic(text_model(spark, folder), TEXT, "quality")
    terms = [*zip(fit.features, map(float, fit.coefficients), strict=True), ("intercept", fit.intercept)]
    return spark.createDataFrame(terms, "term string, weight double").withColumn("weight", r6("weight"))


@query(FULL_SCORED + """
SELECT doc_id, round(eta, 6) AS eta, round(1 / (1 + exp(-eta)), 6) AS p, CAST(eta >= 0 AS INTEGER) AS prediction FROM o
""")
def logit_scores(spark, folder):
    model = text_model(spark, folder)
    scored = score(model, fit_logistic(model, TEXT, "quality"))
    return scored.select("doc_id", r6("eta").alias("eta"), r6("p").alias("p"), "prediction")


@query(FULL_SCORED + "SELECT round(avg(CAST((eta >= 0) = (y = 1) AS DOUBLE)), 6) AS accuracy FROM o")
def logit_accuracy(spark, folder):
    model = text_model(spark, folder)
    scored = score(model, fit_logistic(model, TEXT, "quality"))
    return metrics.accuracy(scored, "quality").select(r6("accuracy").alias("accuracy"))


@query(FULL_SCORED + """
, p AS (SELECT y, 1 / (1 + exp(-eta)) AS p FROM o)
SELECT round(avg(-(y * ln(p + 1e-15) + (1 - y) * ln(1 - p + 1e-15))), 6) AS log_loss FROM p
""")
def log_loss(spark, folder):
    model = text_model(spark, folder)
    scored = score(model, fit_logistic(model, TEXT, "quality"))
    return metrics.log_loss(scored, "quality", "p").select(r6("log_loss").alias("log_loss"))


@query(BY_ROW + "SELECT doc_id, CAST(y AS INTEGER) AS label, CAST(eta >= 0 AS INTEGER) AS prediction FROM o")
def loo_predictions(spark, folder):
    result = loo_logistic(text_model(spark, folder), "doc_id", TEXT, "quality")
    return result.predictions.select("doc_id", "label", "prediction")


@query(BY_ROW + MCC.format(labelled=LABELLED))
def loo_mcc(spark, folder):
    """Flagship: Matthews correlation of leave-one-out predictions."""
    result = loo_logistic(text_model(spark, folder), "doc_id", TEXT, "quality")
    return metrics.mcc_binary(result.predictions).withColumn("mcc", r6("mcc"))


@query(BY_ROW + """
SELECT doc_id, CAST(y AS INTEGER) AS label, round(eta, 6) + 0.0 AS eta, round(1 / (1 + exp(-eta)), 6) AS p FROM o
""")
def loo_scores(spark, folder):
    """Converged left-out scores: every row refitted without itself."""
    result = loo_exact(text_model(spark, folder), "doc_id", TEXT, "quality", limit=1 << 62)
    return result.predictions.select("doc_id", "label", r6("eta").alias("eta"), r6("p").alias("p"))


def _ledger_sql(target: str) -> str:
    rows = BY_ROW.replace("l.quality", f"l.{target}")
    return f"""SELECT 'documents' AS dataset, '{target}' AS target, tp + tn + fp + fn AS n_rows, 2::INTEGER AS n_features, mcc, 'ok' AS status
FROM ({rows} {MCC.format(labelled=LABELLED)})"""


@query(_ledger_sql("quality") + " UNION ALL " + _ledger_sql("toxic"))
def ledger_of_targets(spark, folder):
    """Leave-one-out evaluation of two targets over the same measures, as ledger rows."""
    measured = text_measures(spark, folder, "quality", "toxic")
    rows = []
    for target, other in (("quality", "toxic"), ("toxic", "quality")):
        found = evaluate(measured.drop(other), [target], target, "doc_id")
        rows.append(("documents", target, found.n_rows, found.n_features, found.mcc, "ok"))
    schema = "dataset string, target string, n_rows bigint, n_features int, mcc double, status string"
    return spark.createDataFrame(rows, schema).withColumn("mcc", r6("mcc"))


@query(BY_FOLD + """
SELECT doc_id, fold, CAST(y AS INTEGER) AS label, round(1 / (1 + exp(-eta)), 6) AS p, CAST(eta >= 0 AS INTEGER) AS prediction FROM o
""")
def kfold_predictions(spark, folder):
    result = kfold_logistic(
        text_model(spark, folder), "doc_id", TEXT, "quality", FOLDS, fold=key_bucket(F.col("doc_id"), FOLDS)
    )
    return result.predictions.select("doc_id", "fold", "label", r6("p").alias("p"), "prediction")


@query(BY_FOLD + MCC.format(labelled=LABELLED))
def kfold_mcc(spark, folder):
    result = kfold_logistic(
        text_model(spark, folder), "doc_id", TEXT, "quality", FOLDS, fold=key_bucket(F.col("doc_id"), FOLDS)
    )
    return metrics.mcc_binary(result.predictions).withColumn("mcc", r6("mcc"))


@query()
def loo_wide(spark, folder):
    """Leave-one-out with many features: is a vector of class 0, from all its coordinates."""
    vectors = table(spark, folder, "embeddings")
    size = len(vectors.select("embedding").first()[0])
    names = [f"e{i}" for i in range(size)]
    model = vectors.select(
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
        (F.col("label") == 0).cast("int").alias("is_first"),
    )
    result = loo_logistic(model, "vec_id", names, "is_first")
    return metrics.mcc_binary(result.predictions).withColumn("mcc", r6("mcc"))


LETTERS = "eai"


def letter_model(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """doc_id, standardised letter shares, lang. The texts are read once."""
    shares = {
        f"share_{c}": (F.length("low") - F.length(F.replace("low", F.lit(c), F.lit("")))) / F.length("low")
        for c in LETTERS
    }
    shares["share_marked"] = 1 - F.length(F.regexp_replace("low", "[^\\x00-\\x7F]+", "")) / F.length("low")
    documents = table(spark, folder, "documents").select("doc_id", F.lower("text").alias("low"), "lang")
    measured = written_table(
        documents.select("doc_id", *[c.alias(n) for n, c in shares.items()], "lang"), "letter-shares"
    )
    return fit_prep(measured, list(shares), [], "lang").transform(measured, ["doc_id"]), list(shares)


@query()
def loo_many_classes(spark, folder):
    """Left-out language of every document from letter shares."""
    model, features = letter_model(spark, folder)
    return loo_softmax(model, "doc_id", features, "lang").predictions.select("doc_id", "label", "prediction", "status")


@query()
def kfold_many_classes(spark, folder):
    """Out-of-fold language of every document; the fits share their passes."""
    model, features = letter_model(spark, folder)
    folds = key_bucket(F.col("doc_id"), FOLDS)
    return kfold_softmax(model, "doc_id", features, "lang", FOLDS, fold=folds).select(
        "doc_id", "fold", "label", "prediction"
    )


@query()
def kfold_multinomial_mllib(spark, folder):
    """The same by one MLlib fit per fold, the way for very many classes or features."""
    model, features = letter_model(spark, folder)
    folds = key_bucket(F.col("doc_id"), FOLDS)
    return kfold_multinomial(model, "doc_id", features, "lang", FOLDS, fold=folds).select(
        "doc_id", "fold", "label", "prediction"
    )


@query()
def kfold_prep_in_fold(spark, folder):
    """Order status from price and priority, all statistics taken within training folds."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return kfold_in_fold_prep(
        orders, "o_orderkey", ["o_totalprice"], ["o_orderpriority"], "o_orderstatus", FOLDS,
        fold=key_bucket(F.col("o_orderkey"), FOLDS),
    ).select("o_orderkey", "fold", "label", "prediction")


KINDS = """
  SELECT l.doc_id AS key, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS y,
         length(regexp_replace(text, '[A-Za-z ]', '', 'g')) * 1.0 / length(text) AS f1
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
STATUSES = "SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y, o_totalprice AS f1 FROM orders"


@query(newton3_ctes(KINDS, "key") + "SELECT key AS doc_id, y::INTEGER AS label, z::INTEGER AS prediction FROM judged")
def loo_three_classes(spark, folder):
    """Left-out kind of every labelled document (poor, good, toxic), each as refitted without it."""
    measured = text_measures(spark, folder, "quality", "toxic")
    kind = F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).cast("int")
    measured = measured.select("doc_id", "odd_share", kind.alias("kind"))
    model = fit_prep(measured, ["odd_share"], [], "kind").transform(measured, ["doc_id"])
    found = loo_softmax(model, "doc_id", ["odd_share"], "kind").predictions
    return found.select("doc_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query(newton3_ctes(STATUSES, fold_bucket(FOLDS).replace("doc_id", "key")) + """
SELECT key AS o_orderkey, fold, substr('FOP', (y + 1)::INT, 1) AS label, substr('FOP', z + 1, 1) AS prediction, round(p, 6) AS p FROM judged
""")
def kfold_three_classes(spark, folder):
    """Out-of-fold status of every order from its price, with the probability of the class; all fits share their passes."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    model = fit_prep(orders, ["o_totalprice"], [], "o_orderstatus").transform(orders, ["o_orderkey"])
    found = kfold_softmax(model, "o_orderkey", ["o_totalprice"], "o_orderstatus", FOLDS, fold=key_bucket(F.col("o_orderkey"), FOLDS))
    return found.withColumn("p", r6("p"))


def _flagged_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders above a price, told from their priority by rule."""
    return table(spark, folder, "orders").select(
        "o_custkey",
        (F.col("o_totalprice") > 250000).cast("int").alias("label"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("prediction"),
    )


FLAGGED = """
SELECT CAST(o_totalprice > 250000 AS INTEGER) AS y, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS z, o_custkey
FROM orders
"""


@query(f"SELECT y AS label, z AS prediction, count(*) AS n FROM ({FLAGGED}) GROUP BY 1, 2")
def confusion(spark, folder):
    return metrics.confusion_table(_flagged_orders(spark, folder))


@query(MCC.format(labelled=FLAGGED))
def mcc_two_classes(spark, folder):
    return metrics.mcc_binary(_flagged_orders(spark, folder)).withColumn("mcc", r6("mcc"))


@query(f"""
WITH c AS (
  SELECT c_mktsegment, count(*) FILTER (WHERE y = 1 AND z = 1) AS tp, count(*) FILTER (WHERE y = 0 AND z = 0) AS tn,
         count(*) FILTER (WHERE y = 0 AND z = 1) AS fp, count(*) FILTER (WHERE y = 1 AND z = 0) AS fn
  FROM ({FLAGGED}) JOIN customer ON c_custkey = o_custkey GROUP BY 1),
d AS (SELECT *, (tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE AS d FROM c)
SELECT c_mktsegment, tp, tn, fp, fn,
       round(CASE WHEN d = 0 THEN 0 ELSE (tp * 1.0 * tn - fp * 1.0 * fn) / sqrt(d) END, 6) + 0.0 AS mcc
FROM d
""")
def mcc_by_segment(spark, folder):
    segments = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    flagged = _flagged_orders(spark, folder).join(segments, "o_custkey")
    return metrics.mcc_binary(flagged, by=["c_mktsegment"]).withColumn("mcc", r6("mcc"))


@query("""
WITH e AS (
  SELECT event_type AS y, CASE WHEN value < 15 THEN 'click' WHEN value < 40 THEN 'view' WHEN value < 80 THEN 'purchase' ELSE 'error' END AS z
  FROM events),
s AS (SELECT count(*)::DOUBLE AS s, count(*) FILTER (WHERE y = z)::DOUBLE AS c FROM e),
t AS (SELECT y AS k, count(*)::DOUBLE AS n FROM e GROUP BY 1), p AS (SELECT z AS k, count(*)::DOUBLE AS n FROM e GROUP BY 1),
m AS (SELECT sum(coalesce(t.n, 0) * coalesce(p.n, 0)) AS tp, sum(coalesce(t.n, 0) ** 2) AS tt, sum(coalesce(p.n, 0) ** 2) AS pp
      FROM t FULL JOIN p ON t.k = p.k)
SELECT CAST(s AS BIGINT) AS n, CAST(c AS BIGINT) AS correct,
       round((c * s - tp) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) + 0.0 AS mcc
FROM s, m
""")
def mcc_many_classes(spark, folder):
    guess = (
        F.when(F.col("value") < 15, "click").when(F.col("value") < 40, "view").when(F.col("value") < 80, "purchase").otherwise("error")
    )
    events = table(spark, folder, "events").select(F.col("event_type").alias("label"), guess.alias("prediction"))
    return metrics.mcc_multiclass(events).withColumn("mcc", r6("mcc"))


@query("""
SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p,
       CAST(1 / (1 + exp(-(value - 50) / 10)) >= 0.5 AS INTEGER) AS prediction,
       round(sqrt(abs(value - 50)), 6) AS root
FROM events
""")
def scalar_scores(spark, folder):
    z = (F.col("value") - 50) / 10
    return table(spark, folder, "events").select(
        "event_id",
        r6(sigmoid(z)).alias("p"),
        decide(sigmoid(z)).alias("prediction"),
        r6(F.sqrt(F.abs(F.col("value") - 50))).alias("root"),
    )
