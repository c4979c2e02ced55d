"""Feature preparation: impute by role, standardise, one-hot.

``fit_prep`` runs two aggregates, one over the numeric columns and one over the levels
of the categorical columns, and keeps a few numbers per column on the driver.
``PrepModel.transform`` is then a single ``select`` of literal expressions: no join, no
shuffle, and the scan reads only the columns in use.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loofold.functions.scalars import fill_null, level_indicator, nan_to_null, quoted, z_score
from loofold.operators.profile import distinct_counts

MAX_LEVELS = 2_000
MAX_INDEXED = 1_000_000


class TooManyLevels(ValueError):
    """A column in the categorical role has more levels than indicator columns can hold."""


class AllNull(ValueError):
    """A column has no value to impute from."""


@dataclass
class NumericStats:
    n: int
    mean: float
    std: float
    """Population deviation of the column after mean imputation."""


@dataclass
class LevelStats:
    levels: list
    median: object
    nulls: int


@dataclass
class PrepModel:
    """Fitted statistics; ``transform`` applies them to any frame with the same columns."""

    numeric: dict[str, NumericStats] = field(default_factory=dict)
    categorical: dict[str, LevelStats] = field(default_factory=dict)
    target: str | None = None
    target_stats: LevelStats | None = None

    @property
    def feature_names(self) -> list[str]:
        names = list(self.numeric)
        for column, stats in self.categorical.items():
            names += [f"{column}_{level}" for level in stats.levels]
        return names

    @property
    def classes(self) -> list:
        return self.target_stats.levels if self.target_stats else []

    def imputed(self, name: str) -> Column:
        """The column with its fill value in place of nulls."""
        c = F.col(quoted(name))
        if name in self.numeric:
            return fill_null(nan_to_null(c.cast("double")), F.lit(self.numeric[name].mean))
        stats = self.target_stats if name == self.target else self.categorical[name]
        return fill_null(c, F.lit(stats.median))

    def scaled(self, name: str) -> Column:
        stats = self.numeric[name]
        return z_score(self.imputed(name), F.lit(stats.mean), F.lit(stats.std))

    def indicators(self, name: str) -> list[Column]:
        value = self.imputed(name)
        return [
            level_indicator(value, F.lit(level)).alias(f"{name}_{level}")
            for level in self.categorical[name].levels
        ]

    def impute(self, df: DataFrame) -> DataFrame:
        """All columns of ``df``, the fitted ones filled by role."""
        known = {*self.numeric, *self.categorical, *([self.target] if self.target else [])}
        return df.select(
            *[self.imputed(c).alias(c) if c in known else F.col(quoted(c)) for c in df.columns]
        )

    def transform(
        self, df: DataFrame, keep: Sequence[str] = (), names: Sequence[str] | None = None
    ) -> DataFrame:
        """Kept columns, scaled and indicator features, and the filled target last.

        ``names`` renames the features in order, for callers that want plain names.
        """
        features = [self.scaled(c).alias(c) for c in self.numeric]
        for c in self.categorical:
            features += self.indicators(c)
        if names is not None:
            features = [f.alias(n) for f, n in zip(features, names, strict=True)]
        tail = [self.imputed(self.target).alias(self.target)] if self.target else []
        return df.select(*[F.col(quoted(c)) for c in keep], *features, *tail)


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, NumericStats]:
    """Mean and deviation after mean imputation, for all columns in one aggregate.

    Filling with the mean leaves the mean as it is and adds nothing to the sum of
    squared deviations, so the deviation shrinks by sqrt(non-null share): one pass
    gives the statistics of the imputed column.
    """
    if not columns:
        return {}
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        c = nan_to_null(F.col(quoted(name)).cast("double"))
        parts += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    row = df.agg(*parts).first()
    stats = {}
    for i, name in enumerate(columns):
        n = row[f"n{i}"]
        if n == 0:
            raise AllNull(name)
        stats[name] = NumericStats(n, row[f"m{i}"], row[f"s{i}"] * math.sqrt(n / row["rows"]))
    return stats


def level_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (i, num, txt, n): count of every level of column ``i``, nulls included."""
    types = dict(df.dtypes)
    entries = []
    for i, name in enumerate(columns):
        c = F.col(quoted(name))
        text = types[name] == "string"
        entries.append(
            F.struct(
                F.lit(i).alias("i"),
                (F.lit(None) if text else c).cast("double").alias("num"),
                (c if text else F.lit(None)).cast("string").alias("txt"),
            )
        )
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.i", "e.num", "e.txt")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def level_stats(
    df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS
) -> dict[str, LevelStats]:
    """Sorted levels, lower median and null count of each categorical column.

    The counting is distributed; what reaches the driver is checked to be at most
    ``max_levels`` rows per column before it is used.
    """
    if not columns:
        return {}
    limit = (max_levels + 1) * len(columns) + 1
    rows = level_table(df, columns).limit(limit).collect()
    types = dict(df.dtypes)
    found: dict[int, list[tuple]] = {i: [] for i in range(len(columns))}
    nulls = dict.fromkeys(range(len(columns)), 0)
    for r in rows:
        level = r["txt"] if types[columns[r["i"]]] == "string" else r["num"]
        if level is None:
            nulls[r["i"]] = r["n"]
        else:
            found[r["i"]].append((level, r["n"]))
    stats = {}
    for i, name in enumerate(columns):
        counted = sorted(found[i])
        if len(counted) > max_levels or len(rows) == limit:
            raise TooManyLevels(f"{name}: more than {max_levels} levels, use sparse_one_hot")
        if not counted:
            raise AllNull(name)
        if types[name] in ("tinyint", "smallint", "int", "bigint"):
            counted = [(int(level), n) for level, n in counted]
        stats[name] = LevelStats([level for level, _ in counted], _lower_middle(counted), nulls[i])
    return stats


def _lower_middle(counted: list[tuple]) -> object:
    """Lower median of a sorted list of (value, count)."""
    half = (sum(n for _, n in counted) + 1) // 2
    seen = 0
    for value, n in counted:
        seen += n
        if seen >= half:
            return value
    raise AllNull


def fit_prep(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str | None = None,
    max_levels: int = MAX_LEVELS,
) -> PrepModel:
    """Statistics for every column in use. The target is filled like a categorical one."""
    levels = level_stats(df, [*categorical, *([target] if target else [])], max_levels)
    return PrepModel(
        numeric=numeric_stats(df, numeric),
        categorical={c: levels[c] for c in categorical},
        target=target,
        target_stats=levels[target] if target else None,
    )


def sparse_one_hot(
    df: DataFrame, columns: Sequence[str], output: str = "onehot", positions: str | None = None
) -> DataFrame:
    """All levels of wide columns as one sparse vector; unseen levels and nulls are zeros.

    ``positions`` names a further column: the place of each column's level in the vector, null
    where it is unseen, without ever building the vector's zeros.

    The dictionary of levels is held in memory, so their number is counted first and
    refused beyond ``MAX_INDEXED``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    n_levels = distinct_counts(df, columns).agg(F.sum("n_levels")).first()[0] or 0
    if n_levels > MAX_INDEXED:
        raise TooManyLevels(f"{n_levels} levels in {list(columns)}")
    index = [f"__i{i}" for i in range(len(columns))]
    codes = [f"__v{i}" for i in range(len(columns))]
    text = [f"__t{i}" for i in range(len(columns))]
    named = df.withColumns({t: F.col(quoted(c)).cast("string") for t, c in zip(text, columns, strict=True)})
    fitted = Pipeline(
        stages=[
            StringIndexer(
                inputCols=text, outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep"
            ),
            # "keep" gives unseen values a last index of their own; dropping it leaves zeros.
            OneHotEncoder(inputCols=index, outputCols=codes, dropLast=True),
            VectorAssembler(inputCols=codes, outputCol=output),
        ]
    ).fit(named)
    out = fitted.transform(named)
    if positions:
        sizes = [len(labels) for labels in fitted.stages[0].labelsArray]
        at = [
            F.when(F.col(i) < n, F.col(i).cast("int") + sum(sizes[:k]))
            for k, (i, n) in enumerate(zip(index, sizes, strict=True))
        ]
        out = out.withColumn(positions, F.array(*at))
    return out.drop(*index, *codes, *text)


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Adds the feature columns as one vector column for MLlib."""
    from pyspark.ml.functions import array_to_vector

    array = F.array(*[F.col(quoted(c)).cast("double") for c in features])
    return df.withColumn(output, array_to_vector(array))
