"""The most frequent category value of each entity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.config import PanelSpec
from strandline.functions.columns import quoted

ROWS_TOGETHER = 2_000_000  # rows of an entity that a task may be given at once
VALUES_PER_TASK = 2_000_000  # values counted in the memory of a task, where rows are brought together


def _moment(df: DataFrame, spec: PanelSpec) -> Column:
    """A value that orders records as (time, row id) does, nulls first.

    Dates or timestamps with integer ids become one number: its minimum has a buffer of
    fixed width, so values are counted in a hash table. A minimum of structs would sort
    all rows, times the columns, before anything is combined.
    """
    time = df.schema[spec.time].dataType
    row = df.schema[spec.row].dataType if spec.row else None
    if not (isinstance(time, (T.DateType, T.TimestampType)) and (row is None or isinstance(row, T.IntegralType))):
        return F.struct(*spec.keys[1:])
    at = (F.unix_date if isinstance(time, T.DateType) else F.unix_micros)(F.col(spec.time))

    def number(value: int) -> Column:
        return F.lit(str(value)).cast("decimal(20,0)")

    # Below any time there is, and below any id once these are moved to start at 1.
    at = F.coalesce(at.cast("decimal(20,0)"), number(-10**18))
    if row is None:
        return at
    place = F.coalesce(F.col(spec.row).cast("decimal(20,0)") + number(2**63 + 1), number(0))
    # Less than 10 ** 38 for any time up to the year 9999.
    return at * number(2**65) + place


def _gathered(df: DataFrame, spec: PanelSpec, columns: list[str], rows_together: int) -> DataFrame | None:
    """The keys and columns partitioned by entity, or None if an entity has more than ``rows_together`` rows."""
    each = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("n"))
    size = each.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (size["most"] or 0) > rows_together:
        return None
    rows, tasks = df.select(*spec.keys, *quoted(columns)), math.ceil((size["all"] or 0) * len(columns) / VALUES_PER_TASK)
    if tasks <= 1:
        return rows.repartition(spec.entity)
    # A fixed number: what adaptive execution merges by bytes may be too many values to count in memory.
    return rows.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), spec.entity)


def entity_modes(df: DataFrame, spec: PanelSpec, columns: list[str], ties: str = "first_seen",
                 gather: bool = False, rows_together: int = ROWS_TOGETHER) -> DataFrame:
    """``mode_<column>`` per entity for any number of columns, with two shuffles in all.

    Null counts as a value. Among equally frequent values the one seen first wins, by
    time and row id, then the lowest; with ``ties="lowest"`` the lowest wins at once and nulls are
    left out, as in the built-in ``mode``.

    Values are counted per (entity, column, value) before they meet on the entity,
    and the best of them is found map-side, so an entity with very many rows or
    values sends one row per task.

    Where entities have few rows there is little to combine, and a row is sent for each
    of its values. With ``gather`` the rows of each entity are counted first; if none has
    more than ``rows_together``, a row is sent once, as it is, and nothing after it.
    """
    if ties not in ("first_seen", "lowest"):
        raise ValueError(f"unknown tie rule {ties!r}")
    types = dict(df.dtypes)
    common = "double" if all(types[c] not in ("string", "date") for c in columns) else "string"
    alike = [F.col(f"`{c}`").cast(common).alias(c) for c in columns]
    together = _gathered(df, spec, columns, rows_together) if gather else None
    if together is None:
        values = (df.select(spec.entity, _moment(df, spec).alias("__moment"), *alike)
                  .unpivot([spec.entity, "__moment"], quoted(columns), "column", "value"))
    else:
        # Unlike ``unpivot`` this keeps the rows partitioned by entity.
        pairs = [F.struct(F.lit(c).alias("column"), value.alias("value")) for c, value in zip(columns, alike)]
        values = together.select(spec.entity, _moment(df, spec).alias("__moment"), F.inline(F.array(*pairs)))
    counts = values.groupBy(spec.entity, "column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("__moment").alias("first"))
    parts = [(-F.col("n")).alias("n"), *(["first"] if ties == "first_seen" else []), F.col("value")]
    usable = F.col("value").isNotNull() if ties == "lowest" else F.lit(True)
    best = counts.withColumn("candidate", F.when(usable, F.struct(*parts)))
    per_column = best.groupBy(spec.entity).agg(*[
        F.min(F.when(F.col("column") == c, F.col("candidate"))).alias(c) for c in columns])
    return per_column.select(spec.entity, *[
        F.col(f"`{c}`.value").cast(types[c]).alias(f"mode_{c}") for c in columns])
