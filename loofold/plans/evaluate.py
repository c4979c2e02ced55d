"""Evaluation runs: (dataset, target) requests in, ledger rows out."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loofold.functions.metrics import mcc_binary, mcc_multiclass
from loofold.functions.scalars import METHOD_NONE, quoted
from loofold.operators.logistic import MAX_FEATURES, NotConverged
from loofold.operators.loo import loo_logistic
from loofold.operators.multiclass import kfold_in_fold_prep, kfold_multinomial
from loofold.operators.prep import AllNull, PrepModel, TooManyLevels, fit_prep
from loofold.operators.rows import normalise_types, numeric_features
from loofold.operators.softmax import TooManyWeights, loo_softmax
from loofold.operators.wide import loo_wide, sparse_rows
from loofold.plans.ledger import append_ledger, ledger_rows
from loofold.sources.catalog import pair_status, path_of, roles_of, schema_of
from loofold.sources.tables import last_rows, read_csv, with_row_id


@dataclass
class Evaluation:
    """Outcome of one target: its predictions stay a distributed frame."""

    predictions: DataFrame
    classes: list
    mcc: float
    n_rows: int
    n_features: int
    seconds: float


def prepare(df: DataFrame, categorical: list[str], target: str, key: str) -> tuple[DataFrame, PrepModel]:
    """The table with types normalised, and the preparation fitted to it."""
    typed = normalise_types(df, [*categorical, key])
    features = [c for c in categorical if c != target]
    numeric = [c for c in numeric_features(typed, categorical, target) if c != key]
    return typed, fit_prep(typed, numeric, features, target)


METHODS, PREPS = ("loo", "kfold"), ("all", "in_fold")


class NotNumeric(ValueError):
    """Feature columns that are neither numbers nor in the categorical role."""


class NoRows(ValueError):
    """A dataset without rows, or without a row that has a target."""


def evaluate(
    df: DataFrame,
    categorical: list[str],
    target: str,
    key: str,
    c: float = 1.0,
    folds: int = 10,
    method: str = "loo",
    prep: str = "all",
) -> Evaluation:
    """Out-of-fold classes of one target by the method the caller asks for, and no other.

    ``method`` is ``loo`` or ``kfold``, ``prep`` is ``all`` (statistics of all rows) or
    ``in_fold`` (of training rows only; with ``kfold``). Two classes can have any number of features.
    What cannot be done raises: more classes times features than a dense Hessian holds ``TooManyWeights``, text features ``NotNumeric``, no rows ``NoRows``.
    The clock covers the evaluation, not the preparation, but for ``in_fold`` both.
    """
    if method not in METHODS or prep not in PREPS or (method, prep) == ("loo", "in_fold"):
        raise ValueError(f"no evaluation by {method} with preparation {prep}")
    if df.where(F.col(quoted(target)).isNotNull()).isEmpty():
        raise NoRows(target)
    text = [n for n, t in df.dtypes if t == "string" and n not in categorical and n not in (target, key)]
    if text:
        raise NotNumeric(", ".join(text))
    if prep == "in_fold":
        begun = time.monotonic()
        typed = normalise_types(df, [*categorical, key])
        numeric = [n for n in numeric_features(typed, categorical, target) if n != key]
        features = [n for n in categorical if n != target]
        predictions = kfold_in_fold_prep(typed, key, numeric, features, target, folds, c)
        classes, n_features = [], len(numeric) + len(features)
        return _judged(predictions, classes, n_features, begun)
    typed, fitted = prepare(df, categorical, target, key)
    names = [f"x{i}" for i in range(len(fitted.feature_names))]
    begun = time.monotonic()
    classes = fitted.classes
    two = method == "loo" and len(classes) <= 2
    if two and len(names) > MAX_FEATURES:  # too wide for a Hessian: sparse rows, no column per feature
        label = (fitted.imputed(target) == F.lit(classes[-1])).cast("int")
        rows, width = sparse_rows(typed, fitted, label, [key])
        return _judged_two(loo_wide(rows, key, width, c).predictions, classes, width, begun)
    model = fitted.transform(typed, [key], names)
    if method == "kfold":
        return _judged(kfold_multinomial(model, key, names, target, folds, c), classes, len(names), begun)
    if two:
        coded = model.withColumn("__y", (F.col(quoted(target)) == F.lit(classes[-1])).cast("int"))
        return _judged_two(loo_logistic(coded, key, names, "__y", c).predictions, classes, len(names), begun)
    return _judged(loo_softmax(model, key, names, target, c).predictions, classes, len(names), begun)


def _judged_two(predictions: DataFrame, classes: list, n_features: int, begun: float) -> Evaluation:
    row = mcc_binary(predictions).first()
    n = row["tp"] + row["tn"] + row["fp"] + row["fn"]
    return Evaluation(predictions, classes, row["mcc"], n, n_features, time.monotonic() - begun)


def _judged(predictions: DataFrame, classes: list, n_features: int, begun: float) -> Evaluation:
    row = mcc_multiclass(predictions).first()
    return Evaluation(predictions, classes, row["mcc"], row["n"], n_features, time.monotonic() - begun)


def preview(catalog: DataFrame, dataset: str, n: int = 5) -> DataFrame:
    """The last rows of a dataset with their numbers, without any modelling.

    The rows come from the ends of its last files; all others are only counted.
    """
    spark, path = catalog.sparkSession, path_of(catalog, dataset)
    table = read_csv(spark, path, schema_of(catalog, dataset))
    rows, total = last_rows(spark, path, n, table.schema), table.count()
    schema = T.StructType([T.StructField("row_id", T.LongType()), *table.schema.fields])
    return spark.createDataFrame([(total - len(rows) + i, *r) for i, r in enumerate(rows)], schema)


def run_pairs(
    catalog: DataFrame,
    pairs: DataFrame,
    platform: str,
    c: float = 1.0,
    folds: int = 10,
    method: str = "loo",
    prep: str = "all",
    ledger: str | None = None,
) -> DataFrame:
    """One ledger row per request; a request that cannot run gets a status, not an error.

    With ``ledger``, a folder, each row is appended there as soon as it is done, so a run that
    ends early keeps what it has. A dataset is read once for all its targets. The loop is over
    requests, a handful of names; each evaluation is a set of Spark jobs.
    """
    spark = catalog.sparkSession
    rows, staged = [], {}
    for request in pair_status(pairs, catalog).orderBy("position").toLocalIterator():
        dataset, target = request["dataset"], request["target"]
        status, reason = request["status"], request["reason"]
        result = None
        if status == "ok":
            try:
                roles = roles_of(catalog, dataset)
                if dataset not in staged:
                    staged[dataset] = with_row_id(read_csv(spark, path_of(catalog, dataset), schema_of(catalog, dataset)), "row_id")
                marked = [name for name, role in roles.items() if role == "categorical"]
                result = evaluate(staged[dataset], marked, target, "row_id", c, folds, method, prep)
            except AllNull as e:
                status, reason = "all_null", f"{e} has no values"
            except TooManyLevels as e:
                status, reason = "too_many_levels", str(e)
            except TooManyWeights as e:
                status, reason = "too_wide", str(e)
            except NotNumeric as e:
                status, reason = "not_numeric", f"text in {e}"
            except NoRows as e:
                status, reason = "no_rows", f"no row has a {e}"
            except NotConverged as e:
                status, reason = "not_converged", str(e)
            except AnalysisException as e:  # the file went since it was registered
                status, reason = "unreadable", e.getCondition() or "file"
        row = (
            dataset, target, datetime.now(timezone.utc), platform,
            result.n_rows if result else None, result.n_features if result else None,
            result.seconds if result else None, result.seconds * 1000.0 if result else None,
            result.mcc if result else None, None, METHOD_NONE, f"{method}/{prep}", status, reason,
        )
        rows.append(row)
        if ledger:
            append_ledger(ledger_rows(spark, [row]), ledger)
    return ledger_rows(spark, rows)
