"""Cleaning and encoding: typed fills, one-hot columns, imputation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.feature import Imputer, ImputerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.config import CleaningRules
from strandline.functions.columns import quoted


def drop_columns(df: DataFrame, names) -> DataFrame:
    """Drop the named columns; names the table lacks are ignored."""
    return df.drop(*names)


def fill_constants(df: DataFrame, values: dict) -> DataFrame:
    """Replace nulls column by column. A value of the wrong type is refused, not ignored."""
    types = {f.name: f.dataType for f in df.schema.fields}
    for name, value in values.items():
        if name not in types:
            raise ValueError(f"no column {name!r} to fill")
        fits = isinstance(types[name], T.StringType if isinstance(value, str) else T.NumericType)
        if not fits:
            raise ValueError(f"{value!r} does not fit column {name!r} of type {types[name].simpleString()}")
    return df.na.fill(values)


def level_name(column: str, level: str, text: bool) -> str:
    """``D_64_-1`` for the level ``-1``; whole numbers lose their fraction, other marks become underscores."""
    if not text and float(level).is_integer():
        level = str(int(float(level)))
    return f"{column}_{re.sub('[^A-Za-z0-9_-]', '_', level)}"


@dataclass(frozen=True)
class OneHot:
    """Category levels learned once and applied to any later table."""

    levels: dict[str, list]

    @staticmethod
    def fit(df: DataFrame, columns, max_levels: int = 1000) -> "OneHot":
        """All levels but the last in sorted order; nulls are no level.

        One pass serves all columns. Columns with more than ``max_levels`` values
        are refused: they are not categories.
        """
        if not columns:
            return OneHot({})
        types = dict(df.dtypes)
        found = (df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])
                 .unpivot([], quoted(columns), "column", "value")
                 .where(F.col("value").isNotNull()).distinct()
                 .limit(max_levels * len(columns) + 1).collect())
        levels: dict[str, list] = {c: [] for c in columns}
        for r in found:
            levels[r["column"]].append(r["value"])
        crowded = max(levels, key=lambda c: len(levels[c]))
        if len(levels[crowded]) > max_levels:
            raise ValueError(f"column {crowded!r} has more than {max_levels} distinct values")
        for c, values in levels.items():
            values.sort(key=None if types[c] == "string" else float)
        return OneHot({c: v[:-1] for c, v in levels.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        """Integer columns ``<column>_<level>``; the source columns are dropped. A null is 0 everywhere.

        Two levels, or a level and another column, that would bear one name are refused.
        """
        types = dict(df.dtypes)
        named = [(level_name(c, v, types[c] == "string"), c, v) for c, values in self.levels.items() for v in values]
        kept = [c for c in df.columns if c not in self.levels]
        names = [c.lower() for c in kept] + [name.lower() for name, _, _ in named]
        if len(set(names)) < len(names):
            raise ValueError(f"two columns would be named {max(names, key=names.count)!r}")
        flags = [F.when(F.col(f"`{c}`").cast("string") == v, 1).otherwise(0).alias(name) for name, c, v in named]
        return df.select([F.col(f"`{c}`") for c in kept] + flags)


@dataclass(frozen=True)
class Cleaning:
    """Drop, fill and one-hot encode with levels fitted on the training panel."""

    rules: CleaningRules
    one_hot: OneHot

    @staticmethod
    def fit(df: DataFrame, rules: CleaningRules = CleaningRules()) -> "Cleaning":
        encoded = [c for c in rules.one_hot if c in df.columns]
        fills = {c: v for c, v in rules.fill.items() if c in encoded}
        return Cleaning(rules, OneHot.fit(fill_constants(df.select(encoded), fills), encoded))

    def transform(self, df: DataFrame) -> DataFrame:
        kept = drop_columns(df, self.rules.drop)
        fills = {c: v for c, v in self.rules.fill.items() if c in kept.columns}
        return self.one_hot.transform(fill_constants(kept, fills))


def fit_imputer(df: DataFrame, columns: list[str], strategy: str = "mean",
                outputs: list[str] | None = None) -> ImputerModel:
    """Fill values for all columns: ``mean`` in one aggregation, exact ``median`` or ``mode`` on request.

    The median is a value of the column, the lower of two in the middle. A column without a single value has no surrogate, which Spark reports as an error.
    """
    return Imputer(inputCols=columns, outputCols=outputs or columns, strategy=strategy,
                   relativeError=0.0).fit(df)
