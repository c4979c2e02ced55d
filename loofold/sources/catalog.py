"""Catalog of datasets and checks of (dataset, target) requests against it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_SCHEMA = "dataset string, path string, column string, role string, ordinal int"

# Columns in the categorical role of the known clinical datasets.
KNOWN_CATEGORICAL = {
    "sepsis": ["sex_woman", "diagnosis_0EC_1M_2_AC", "Group", "Mortality"],
    "neuroblastoma": [
        "age", "sex", "site", "stage", "risk", "autologous_stem_cell_transplantation", "radiation",
        "degree_of_differentiation", "UH_or_FH", "MYCN_status ", "surgical_methods", "outcome",
    ],
    "heart_failure": [
        "Male (1=Yes, 0=No)", "Etiology HF(1=Yes, 0=No)", "Death (1=Yes, 0=No)", "Hospitalized (1=Yes, 0=No)",
    ],
    "cardiac_arrest": [
        "Exitus", "sex_woman", "Endotracheal_intubation", "Functional_status", "Asystole", "Bystander",
        "Cardiogenic", "Cardiac_arrest_at_home",
    ],
    "diabetes": ["sex_0man_1woman", "insulin_regimen_binary"],
}


def register(
    spark: SparkSession, paths: Mapping[str, str], categorical: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Catalog rows for CSV files, one per column; only headers are read.

    ``categorical`` names the columns in that role per dataset; the known datasets have
    theirs built in. A dataset whose file cannot be read gets one row without a column.
    """
    from pyspark.errors import AnalysisException

    roles = {**KNOWN_CATEGORICAL, **(categorical or {})}
    rows: list[tuple] = []
    for dataset, path in paths.items():
        try:
            columns = spark.read.csv(path, header=True).columns
        except AnalysisException:
            rows.append((dataset, path, None, None, None))
            continue
        marked = set(roles.get(dataset, ()))
        rows += [
            (dataset, path, name, "categorical" if name in marked else "numeric", i)
            for i, name in enumerate(columns)
        ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def list_datasets(catalog: DataFrame) -> DataFrame:
    """dataset, path, number of columns, categorical columns in order, default target."""
    ordered = F.array_sort(
        F.collect_list(F.when(F.col("role") == "categorical", F.struct("ordinal", "column")))
    )
    return catalog.groupBy("dataset", "path").agg(
        F.count("column").alias("n_columns"),
        F.transform(ordered, lambda s: s["column"]).alias("categorical"),
        F.max_by("column", "ordinal").alias("default_target"),
    )


def columns_of(catalog: DataFrame, dataset: str) -> DataFrame:
    return catalog.where(F.col("dataset") == dataset).orderBy("ordinal")


def path_of(catalog: DataFrame, dataset: str) -> str | None:
    row = catalog.where(F.col("dataset") == dataset).select("path").first()
    return row[0] if row else None


def roles_of(catalog: DataFrame, dataset: str) -> dict[str, str]:
    """Column -> role in column order, for one dataset."""
    return {r["column"]: r["role"] for r in columns_of(catalog, dataset).collect() if r["column"] is not None}


def schema_of(catalog: DataFrame, dataset: str) -> T.StructType | None:
    """Schema of a known dataset, whose columns are all numbers: no pass to infer it. Others have none.

    Codes in the categorical role come back to whole numbers when types are normalised.
    """
    if dataset not in KNOWN_CATEGORICAL:
        return None
    names = list(roles_of(catalog, dataset))
    return T.StructType([T.StructField(name, T.DoubleType()) for name in names]) if names else None


def pair_up(datasets: Column, targets: Column) -> Column:
    """Array of (dataset, target) structs by position; missing targets are null."""
    zipped = F.arrays_zip(datasets.alias("dataset"), targets.alias("target"))
    # each array is named once: inside a lambda its expression would run again for every element
    return F.slice(zipped, 1, F.size(datasets))


def pair_status(pairs: DataFrame, catalog: DataFrame, position: str = "position") -> DataFrame:
    """Requests with the resolved target, ``status`` and ``reason``.

    A null target means the last column. Every request keeps its row; of equal requests
    the first is judged and the others are marked ``duplicate``. Both joins are on the
    dataset or column name, so many requests for one dataset meet a small aggregated side.
    """
    defaults = catalog.groupBy("dataset").agg(
        F.max_by("column", "ordinal").alias("default_target"), F.count("column").alias("n_columns")
    )
    resolved = pairs.join(defaults, "dataset", "left").withColumn(
        "target", F.coalesce("target", "default_target")
    )
    columns = catalog.where("column IS NOT NULL").select("dataset", F.col("column").alias("target"), "role")
    first = resolved.groupBy("dataset", "target").agg(F.min(position).alias("__first"))
    judged = first.join(columns, ["dataset", "target"], "left")
    joined = resolved.alias("r").join(
        judged.alias("j"),
        F.col("r.dataset").eqNullSafe(F.col("j.dataset")) & F.col("r.target").eqNullSafe(F.col("j.target")),
        "left",
    )
    status = (
        F.when(F.col("n_columns").isNull(), "unknown_dataset")
        .when(F.col("n_columns") == 0, "missing_source")
        .when(F.col("role").isNull(), "unknown_column")
        .when(F.col("role") != "categorical", "not_categorical")
        .when(F.col(f"r.{position}") != F.col("__first"), "duplicate")
        .otherwise("ok")
    )
    reason = (
        F.when(F.col("status") == "unknown_dataset", F.concat(F.lit("no dataset named "), "dataset"))
        .when(F.col("status") == "missing_source", F.concat(F.lit("no file for "), "dataset"))
        .when(F.col("status") == "unknown_column", F.concat("dataset", F.lit(" has no column "), "target"))
        .when(F.col("status") == "not_categorical", F.concat("target", F.lit(" is not categorical")))
        .when(F.col("status") == "duplicate", F.lit("requested before"))
    )
    return joined.select(
        F.col(f"r.{position}").alias(position),
        F.col("r.dataset").alias("dataset"),
        F.col("r.target").alias("target"),
        status.alias("status"),
    ).withColumn("reason", reason)
