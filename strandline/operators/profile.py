"""Profiling of wide tables: shapes, null rates, frequencies, key and calendar checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import PanelSpec
from strandline.functions.columns import blocks, numeric_columns, quoted


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def family_columns(df: DataFrame, prefix: str, *extra: str) -> DataFrame:
    """The columns starting with ``prefix``, then the extra ones (each column once)."""
    family = [c for c in df.columns if c.startswith(prefix)]
    return df.select(family + [c for c in extra if c not in family])


def per_column(df: DataFrame, columns: list[str], stats: dict[str, Callable[[str], Column]],
               by: Column | None = None) -> DataFrame:
    """One row per column with the given statistics, and one per group if ``by`` is given.

    All statistics of a block of columns come from one aggregation; a block reads its own columns only.
    """
    if not columns:
        raise ValueError("no columns to profile")

    def rows_of(part):
        # Flat aggregates first: an aggregate inside a struct would keep them out of the hash buffers.
        flat = [fn(c).alias(f"{i}_{s}") for i, c in enumerate(part) for s, fn in stats.items()]
        wide = df.groupBy(by).agg(*flat) if by is not None else df.agg(*flat)
        rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{s}").alias(s) for s in stats])
                for i, c in enumerate(part)]
        return wide.select(*wide.columns[:1 if by is not None else 0], F.inline(F.array(*rows)))

    return reduce(DataFrame.unionAll, [rows_of(part) for part in blocks(columns, len(stats))])


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return per_column(df, columns or df.columns, {
        "n_null": lambda c: F.count_if(F.col(f"`{c}`").isNull()),
        "null_rate": lambda c: F.avg(F.col(f"`{c}`").isNull().cast("int")),
    })


def null_columns(df: DataFrame) -> DataFrame:
    """How many columns hold at least one null."""
    return null_rates(df).agg(F.count_if(F.col("n_null") > 0).alias("columns_with_nulls"))


def sparse_columns(df: DataFrame, threshold: float, keep: tuple[str, ...] = ()) -> list[str]:
    """Columns whose null rate exceeds the threshold."""
    rates = null_rates(df, [c for c in df.columns if c not in keep])
    return [r["column"] for r in rates.where(F.col("null_rate") > threshold).collect()]


def _number(column: str) -> Column:
    return F.col(f"`{column}`").cast("double")


SUMMARY = {
    "n": lambda c: F.count(F.col(f"`{c}`")),
    "mean": lambda c: F.avg(_number(c)),
    "stddev": lambda c: F.stddev_samp(_number(c)),
    "min": lambda c: F.min(_number(c)),
    "max": lambda c: F.max(_number(c)),
}


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return per_column(df, columns or numeric_columns(df), SUMMARY)


def describe_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or [n for n, t in df.dtypes if t == "string"]
    return per_column(df, names, {"n": lambda c: F.count(F.col(f"`{c}`")), "min": lambda c: F.min(f"`{c}`"), "max": lambda c: F.max(f"`{c}`")})


def quartiles(df: DataFrame, columns: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Approximate 25/50/75 % points of many columns in one pass; ``exact_quantiles`` has the exact ones."""
    def point(q):
        return lambda c: F.percentile_approx(_number(c), F.lit(q), accuracy)

    return per_column(df, columns or numeric_columns(df), {"q25": point(0.25), "q50": point(0.5), "q75": point(0.75)})


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Frequency of every value of every listed column; null is a value of its own."""
    return (df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])
            .unpivot([], quoted(columns), "column", "value")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(columns).distinct()


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return (df.groupBy(keys).agg(F.count(keys[0]).alias("same_date_entries"))
            .where(F.col("same_date_entries") > 1))


def records_per_date(df: DataFrame, spec: PanelSpec) -> DataFrame:
    day = F.to_date(spec.time).alias(spec.time)
    return (df.groupBy(day).agg(F.count(spec.entity).alias("records_per_date"))
            .orderBy(spec.time))


def monthly_records(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.groupBy(spec.entity, F.month(spec.time).alias("month"), F.year(spec.time).alias("year")).agg(
        F.count(spec.time).alias("monthly_records"))


def monthly_duplicates(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return monthly_records(df, spec).where(F.col("monthly_records") > 1)


def months_observed(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return monthly_records(df, spec).groupBy(spec.entity).agg(F.count("month").alias("months_observed"))


def category_instability(df: DataFrame, spec: PanelSpec, columns: list[str]) -> DataFrame:
    """Entities whose category changes over time, with the number of its values (nulls not counted).

    Distinct (entity, column, value) triples are formed before they meet on the
    entity, so an entity with very many rows never gathers in one task.
    """
    values = (df.select(spec.entity, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
              .unpivot([spec.entity], quoted(columns), "column", "value")
              .where(F.col("value").isNotNull())
              .distinct())
    return (values.groupBy(spec.entity, "column").agg(F.count("value").alias("n_values"))
            .where(F.col("n_values") > 1))


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two tables and how many are missing on either side."""
    seen = (left.select(key, F.lit(1).alias("in_left"), F.lit(0).alias("in_right"))
            .unionAll(right.select(key, F.lit(0), F.lit(1)))
            .groupBy(key).agg(F.max("in_left").alias("in_left"), F.max("in_right").alias("in_right")))
    return seen.agg(
        F.sum("in_left").alias("left_keys"),
        F.sum("in_right").alias("right_keys"),
        F.count_if((F.col("in_left") == 1) & (F.col("in_right") == 0)).alias("only_left"),
        F.count_if((F.col("in_left") == 0) & (F.col("in_right") == 1)).alias("only_right"),
    )


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks, each once."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def null_key_rows(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNull())


def describe_by_null(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """Column summaries of the rows where ``flag`` is null and of those where it is not."""
    return per_column(df, columns, SUMMARY, by=F.col(flag).isNull().alias("is_null"))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, nulls left out pair by pair. For a few dozen columns."""
    def rows_of(part):
        wide = df.agg(*[F.corr(_number(a), _number(b)).alias(f"p{i}") for i, (a, b) in enumerate(part)])
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"p{i}").alias("correlation"))
            for i, (a, b) in enumerate(part)])))

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    return reduce(DataFrame.unionAll, [rows_of(part) for part in blocks(pairs, 2)])


def _merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joint moments of two sets of rows (Chan, Golub and LeVeque); the first axis holds those of ``_MOMENTS``."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    both = a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * both,
                     a[4] + b[4] + dy * dy * both, a[5] + b[5] + dx * dy * both])


#: Of the rows that have both columns: their number, the means, the squared deviations of each and their product.
_MOMENTS = ("n", "mean_first", "mean_second", "square_first", "square_second", "product")
GRAM_ROWS = 4_096


def _block_moments(values: np.ndarray) -> np.ndarray:
    """The moments of all pairs of columns over some rows, by matrix products of values and of what is known."""
    known = ~np.isnan(values)
    there = known.astype(float)
    counts = there.sum(axis=0)
    centre = np.divide(np.where(known, values, 0).sum(axis=0), counts, out=np.zeros(values.shape[1]), where=counts > 0)
    x = np.where(known, values - centre, 0.0)  # near zero, so that nothing cancels
    n, sums, squares, products = there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x
    mean = np.divide(sums, n, out=np.zeros_like(n), where=n > 0)
    square = np.maximum(squares - mean * sums, 0)
    return np.stack([n, mean + centre[:, None], mean.T + centre[None, :], square, square.T, products - n * mean * mean.T])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(first, second, n, correlation)`` of every pair of columns, nulls and NaN left out pair by pair.

    The table is scanned once for any number of columns. Each task adds up the joint
    moments of its rows block by block; they are merged row of the matrix by row, in two
    steps, so no task holds the matrices of all others. A pair with fewer than two rows
    or a constant column has a null correlation.
    """
    if not columns:
        raise ValueError("no columns to profile")
    size, width = len(columns), len(_MOMENTS)

    def of_tasks(batches):
        total = np.zeros((width, size, size))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            for start in range(0, len(values), GRAM_ROWS):
                total = _merged_moments(total, _block_moments(values[start:start + GRAM_ROWS]))
        if total[0].any():
            yield pa.RecordBatch.from_pydict({
                "place": pa.array(np.arange(size, dtype=np.int32)), "lot": pa.array(np.full(size, TaskContext.get().partitionId() % 64, np.int32)),
                "moments": pa.array([total[:, i].ravel().tolist() for i in range(size)], pa.list_(pa.float64()))})

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((width, size))
        for moments in sorted(parts["moments"].tolist(), key=lambda m: tuple(m[:size])):
            total = _merged_moments(total, np.asarray(moments).reshape(width, size))
        return pd.DataFrame({"place": parts["place"].iloc[:1], "lot": [0], "moments": [total.ravel().tolist()]})

    schema = "place int, lot int, moments array<double>"
    found = df.select([_number(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(of_tasks, schema)
    for keys in (["place", "lot"], ["place"]):
        found = found.groupBy(*keys).applyInPandas(merge, schema)
    names = F.array(*[F.lit(c) for c in columns])

    def moment(i: int) -> Column:
        return F.element_at("moments", F.col("other") + 1 + i * size)

    pairs = found.select("place", "moments", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("other")).where("other > place")
    spread = F.sqrt(moment(3)) * F.sqrt(moment(4))
    return pairs.select(
        F.element_at(names, F.col("place") + 1).alias("first"), F.element_at(names, F.col("other") + 1).alias("second"),
        moment(0).cast("long").alias("n"), F.when((moment(0) > 1) & (spread > 0), moment(5) / spread).alias("correlation"))
