"""Running totals, ranks and exact quantiles over a global order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import quoted
from strandline.session import staged

RANGE, START = "__range", "__start"


def _in_ranges(df: DataFrame, groups: list[str], order: list[Column], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows range-sorted and written with the number of their range, and the sums of each group before each range.

    The number of ranges follows the session's shuffle partitions, and so the data.
    """
    ranged = staged(df.repartitionByRange(*[F.col(c) for c in groups], *order)
                    .withColumn(RANGE, F.spark_partition_id()), "ranges")
    # As many rows as there are ranges, more only where several groups share one.
    earlier = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(RANGE, *groups).agg(*[F.sum(v).alias(v) for v in values])
    starts = sums.select(RANGE, *groups, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in values],
                         *[F.sum(v).over(Window.partitionBy(*groups)).alias(f"all_{v}") for v in values])
    return ranged, starts.withColumn(START, F.lit(True))


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same group that come before the row.

    The start of a group in each range enters the range as a row of its own, and a
    window inside the range adds up the rest. A crowded group is spread over many
    ranges if its order columns differ. Null groups are a group. Rows that are equal
    in all order columns may come in any order.
    """
    ranged, starts = _in_ranges(df, groups, [F.col(c) for c in order], [value])
    inside = (Window.partitionBy(RANGE, *groups).orderBy(F.col(START).desc(), *order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (ranged.withColumn(START, F.lit(False)).unionByName(starts.drop(f"all_{value}"), allowMissingColumns=True)
            .withColumn(name, F.sum(value).over(inside))
            .where(~F.col(START)).drop(RANGE, START))


def running_totals(df: DataFrame, order: str, totals: list[str], group: str | None = None,
                   descending: bool = False) -> DataFrame:
    """Sums of the totals per distinct value, running sums ``cum_<total>`` and overall sums ``all_<total>``.

    Equal values are added up first, and nulls are left out; NaN counts as the
    largest value. The type of the value is kept. With ``group`` every group is
    ordered for itself. No rows give no rows.
    """
    groups = [group] if group else []
    values = df.where(F.col(order).isNotNull()).groupBy(*groups, order).agg(*[F.sum(t).alias(t) for t in totals])
    direction = F.col(order).desc() if descending else F.col(order).asc()
    ranged, starts = _in_ranges(staged(values, "distinct-values"), groups, [direction], totals)
    inside = Window.partitionBy(RANGE, *groups).orderBy(F.col(START).desc(), direction)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ranged.withColumn(START, F.lit(False)).unionByName(starts, allowMissingColumns=True)
            .select(*groups, order, START, *totals, *[F.sum(t).over(upto).alias(f"cum_{t}") for t in totals],
                    *[F.first(f"all_{t}").over(upto).alias(f"all_{t}") for t in totals])
            .where(~F.col(START)).drop(START))


def exact_quantiles(df: DataFrame, columns: list[str], points: dict[str, float]) -> DataFrame:
    """Interpolated quantiles, as a median is commonly taken: one row per column, all columns from one scan."""
    values = df.select([F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], quoted(columns), "column", "value")
    ranked = running_totals(values.withColumn("n", F.lit(1)), "value", ["n"], "column")
    out = []
    for name, q in points.items():
        # Ranks start at 0; a value fills the ranks from cum_n - n to cum_n - 1.
        position = F.lit(q) * (F.col("all_n") - 1)
        low, part = F.floor(position), position - F.floor(position)
        high = F.least(low + 1, F.col("all_n") - 1)
        at = [F.max(F.when((F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n")), F.col("value")))
              for rank in (low, high)]
        out.append((at[0] + F.max(part) * (at[1] - at[0])).alias(name))
    return ranked.groupBy("column").agg(*out)


def previous_values(df: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the ``value`` of the row before in the same group, null in its first row.

    ``value`` is the first of the order columns. Rows are range-sorted, and the last value
    before a range enters it as a row of its own, so a crowded group is spread over many
    ranges if its order columns differ. A null group is a group, null values come first.
    """
    ranged = staged(df.repartitionByRange(*[F.col(c) for c in [*groups, *order]])
                    .withColumn(RANGE, F.spark_partition_id()), "ranges")
    # As many rows as there are ranges for a group that fills them.
    ranges = Window.partitionBy(*groups).orderBy(RANGE)
    starts = (ranged.groupBy(RANGE, *groups).agg(F.max(value).alias(value))
              .withColumn(value, F.lag(value).over(ranges)).withColumn(START, F.lit(True)))
    inside = Window.partitionBy(RANGE, *groups).orderBy(F.col(START).desc(), *order)
    return (ranged.withColumn(START, F.lit(False)).unionByName(starts, allowMissingColumns=True)
            .withColumn(name, F.lag(value).over(inside)).where(~F.col(START)).drop(RANGE, START))


def positions(df: DataFrame, hashed: str, tie: str) -> DataFrame:
    """``position`` 0, 1, 2, … in the order of a hash value; ``tie`` breaks equal hashes."""
    counted = prefix_sums(df.withColumn("__one", F.lit(1)), [], [hashed, tie], "__one", "position")
    return counted.withColumn("position", F.coalesce("position", F.lit(0))).drop("__one")
