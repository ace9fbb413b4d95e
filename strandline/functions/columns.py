"""Column expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Aggregations of more fields than spark.sql.codegen.maxFields (100) leave generated code.
FIELDS_PER_AGGREGATION = 90


def blocks(items: list, fields_each: int = 1) -> list[list]:
    """The items in groups whose fields together fit one generated aggregation."""
    size = max(1, FIELDS_PER_AGGREGATION // fields_each)
    return [items[i:i + size] for i in range(0, len(items), size)]


def quoted(names) -> list[str]:
    """Column names as references, whatever marks they hold."""
    return [f"`{name}`" for name in names]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def feature_name(name: str) -> str:
    """``avg(D_39)`` becomes ``avg_D_39_impt``."""
    return re.sub("[^A-Za-z0-9]+", "_", name) + "impt"


def feature_names(names: list[str]) -> dict[str, str]:
    """New names for aggregate columns; refuses two columns ending up with one name."""
    out: dict[str, str] = {}
    taken: dict[str, str] = {}
    for name in names:
        new = feature_name(name)
        if new.lower() in taken:
            raise ValueError(f"{name!r} and {taken[new.lower()]!r} would both be named {new!r}")
        taken[new.lower()] = name
        out[name] = new
    return out


def _digest(length: int, *parts: Column) -> Column:
    """A whole number from the first hex digits of the MD5 of the joined parts."""
    text = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(text, 1, length), 16, 10).cast("long")


def hash_bucket(keys: list[str], seed: int, buckets: int) -> Column:
    """A bucket in [0, buckets) that depends on the key and the seed alone.

    Unlike ``randomSplit`` it does not change with partitioning or retries.
    """
    return (_digest(8, F.lit(seed), *[F.col(k) for k in keys]) % buckets).cast("int")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) drawn from a hash of the given columns."""
    return _digest(13, *parts) / F.lit(float(2**52))


def months_tenure(latest: Column, earliest: Column) -> Column:
    return F.months_between(latest, earliest)


def null_safe_equal(left: str, right: str, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond
