"""Per-entity statistics of panel columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.config import PanelSpec
from strandline.functions.columns import blocks, numeric_columns


def in_blocks(df: DataFrame, key: str, parts: list[list[Column]]) -> DataFrame:
    """Aggregates of the groups of ``key``, each part on a scan of its own columns, side by side.

    The null key is a group like any other, for one part and for many. Parts are
    joined on the columns that they are grouped and so already partitioned by.
    """
    if len(parts) == 1:
        return df.groupBy(key).agg(*parts[0])
    kind = df.schema[key].dataType
    dated = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    stand_in = F.lit("" if isinstance(kind, T.StringType) else "1970-01-01" if dated else "0").cast(kind)
    known = df.withColumns({"__null": F.col(key).isNull(), "__key": F.coalesce(F.col(key), stand_in)})
    joined = reduce(lambda a, b: a.join(b, ["__null", "__key"]),
                    [known.groupBy("__null", "__key").agg(*part) for part in parts])
    return joined.select(F.when(~F.col("__null"), F.col("__key")).alias(key),
                         *[F.col(f"`{c}`") for c in joined.columns if c not in ("__null", "__key")])


def aggregate(df: DataFrame, key: str, functions: dict[str, str]) -> DataFrame:
    """``{column: function}`` grouped by ``key``; results are named ``function(column)``."""
    def call(name, column):
        return F.call_function(name, F.col(f"`{column}`")).alias(f"{name}({column})")

    return in_blocks(df, key, [[call(fn, c) for c, fn in part] for part in blocks(list(functions.items()))])


def value_columns(df: DataFrame, spec: PanelSpec, exclude=()) -> list[str]:
    """Numeric panel columns, one-hot flags and category codes included."""
    return numeric_columns(df, exclude={*spec.keys, *exclude})


def entity_means(df: DataFrame, spec: PanelSpec, exclude=()) -> DataFrame:
    return aggregate(df, spec.entity, {c: "avg" for c in value_columns(df, spec, exclude)})


def entity_stddevs(df: DataFrame, spec: PanelSpec, exclude=()) -> DataFrame:
    return aggregate(df, spec.entity, {c: "stddev_samp" for c in value_columns(df, spec, exclude)})


def entity_statistics(df: DataFrame, spec: PanelSpec, exclude=()) -> DataFrame:
    """Means and sample deviations of all value columns.

    Very wide panels are aggregated in blocks of columns, each reading its own
    columns, and joined on the entity they are already partitioned by. Beyond
    ``spark.sql.codegen.maxFields`` (100) fields an aggregation leaves generated
    code: 180 columns at once took 26 s where blocks of 30 took 10 s, join included.

    Every buffer has a fixed width, so rows are combined before the shuffle: an
    entity sends one partial row per task however many statements it has.
    """
    columns = value_columns(df, spec, exclude)
    joined = in_blocks(df, spec.entity, [
        [call(f"`{c}`").alias(f"{name}({c})") for name, call in (("avg", F.avg), ("stddev_samp", F.stddev_samp)) for c in part]
        for part in blocks(columns, 3)])
    return joined.select(spec.entity, *[F.col(f"`{fn}({c})`") for fn in ("avg", "stddev_samp") for c in columns])
