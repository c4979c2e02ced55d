"""Scalar expressions. Each takes and returns Spark columns and stays in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MILLIJOULE_PER_KWH = 3.6e9
LOG_GUARD = 1e-15

# Labels of the measuring method in the results table.
METHOD_WINDOWS = "Intel's VTune Profiler"
METHOD_OTHER = "RAPL interface"
METHOD_NONE = "None"


def seconds_to_ms(seconds: Column) -> Column:
    return seconds * F.lit(1000.0)


def mj_to_kwh(millijoule: Column) -> Column:
    return millijoule.cast("double") / F.lit(MILLIJOULE_PER_KWH)


def to_kwh(value: Column, unit: Column) -> Column:
    """Energy in kWh from a reading and the unit it was taken in; unknown units give null."""
    return F.when(unit == "kWh", value.cast("double")).when(unit == "mJ", mj_to_kwh(value))


def sigmoid(z: Column) -> Column:
    """Logistic function in the branch form that cannot overflow."""
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def log_loss_term(label: Column, p: Column) -> Column:
    y = label.cast("double")
    return -(y * F.ln(p + F.lit(LOG_GUARD)) + (1.0 - y) * F.ln(1.0 - p + F.lit(LOG_GUARD)))


def linear_predictor(features: Sequence[Column | str], weights: Sequence[float], intercept: float) -> Column:
    """Dot product with literal weights plus the intercept."""
    total = F.lit(float(intercept))
    for feature, weight in zip(features, weights, strict=True):
        column = F.col(quoted(feature)) if isinstance(feature, str) else feature
        total = total + F.lit(float(weight)) * column
    return total


def decide(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """Standard score; a column without spread scores 0, a null stays null."""
    spread = F.nullif(std, F.lit(0.0))
    return F.when(value.isNotNull(), F.coalesce((value - mean) / spread, F.lit(0.0)))


def fill_null(value: Column, default: Column) -> Column:
    return F.coalesce(value, default)


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def is_missing(value: Column) -> Column:
    """True for null and for NaN (double columns)."""
    return value.isNull() | F.isnan(value)


def level_name(column: Column, level: Column) -> Column:
    return F.concat_ws("_", column, level.cast("string"))


def level_indicator(value: Column, level: Column) -> Column:
    """1.0 where the value is this level, 0.0 elsewhere, also for nulls and unseen levels."""
    return F.coalesce((value == level).cast("double"), F.lit(0.0))


def plain_name(text: Column) -> Column:
    """Everything but ASCII letters and digits becomes an underscore."""
    return F.regexp_replace(text, "[^a-zA-Z0-9]", "_")


def method_label(platform: Column, measured: Column | None = None) -> Column:
    """Label of the measuring method for a platform; unmeasured runs are labelled too."""
    label = F.when(F.lower(platform) == "windows", METHOD_WINDOWS).otherwise(METHOD_OTHER)
    if measured is None:
        return label
    return F.when(measured, label).otherwise(METHOD_NONE)


def run_stamp(ts: Column) -> Column:
    """Timestamp as used in names of results, e.g. ``2024-01-31_09h-05m-00s``."""
    return F.date_format(ts, "yyyy-MM-dd_HH'h'-mm'm'-ss's'")


def fixed_decimals(value: Column, digits: int) -> Column:
    """Plain decimal notation with a fixed number of digits and no grouping."""
    return F.format_string(f"%.{digits}f", value)


def linspace(start: Column, stop: Column, points: int = 50) -> Column:
    """Array of evenly spaced numbers, both ends included."""
    step = (stop - start) / F.lit(float(points - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: start + step * i)


def quoted(name: str) -> str:
    """A column name as a reference: dots, commas and blanks stay part of the name."""
    return "`" + name.replace("`", "``") + "`"
