"""Calendar features: gaps between records, tenure, first and last dates.

Nothing here gathers the rows of one entity in a task. Gaps are measured between
calendar days, so the rows of a day are condensed first; what is left of an
entity is at most one entry per day of the panel's period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.config import PanelSpec
from strandline.functions.columns import months_tenure, null_safe_equal
from strandline.operators.joins import attach_group_facts
from strandline.operators.ranking import previous_values
from strandline.session import staged


def calendar_parts(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumns({"month": F.month(spec.time), "year": F.year(spec.time)})


def date_summary(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Per entity: record count, span, tenure, and mean and deviation of the days between records.

    The rows of a day are condensed map-side to one; records of one day add gaps of
    zero. The mean gap follows from the first and last day, the deviation needs the
    squared gaps between the entity's days. Buffers have a fixed width throughout.
    """
    days = df.groupBy(spec.entity, F.unix_date(F.to_date(spec.time)).alias("day")).agg(
        F.count(spec.time).alias("n"), F.min(spec.time).alias("first"), F.max(spec.time).alias("last"))
    gap = F.col("day") - F.lag("day").over(Window.partitionBy(spec.entity).orderBy("day"))
    per_entity = days.withColumn("gap", gap.cast("double")).groupBy(spec.entity).agg(
        F.sum("n").alias("n_records"), F.min("first").alias("earliest_date"), F.max("last").alias("latest_date"),
        F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0.0)).alias("squares"))
    gaps = per_entity.select(
        spec.entity, "n_records", "earliest_date", "latest_date",
        F.datediff("latest_date", "earliest_date").alias("span_days"),
        months_tenure(F.col("latest_date"), F.col("earliest_date")).alias("months_tenure"),
        (F.col("n_records") - 1).alias("n_gaps"),
        "squares")
    mean = F.try_divide(F.col("span_days"), F.col("n_gaps"))
    variance = F.try_divide(
        F.greatest(F.col("squares") - mean * F.col("span_days"), F.lit(0.0)), F.col("n_gaps") - 1)
    return gaps.select(
        spec.entity, "n_records", "earliest_date", "latest_date", "span_days", "months_tenure",
        mean.cast("double").alias("avg_lag_days"),
        F.when(F.col("n_gaps") > 1, F.sqrt(variance)).alias("std_lag_days"))


def date_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Tenure and gap statistics; entities with too few records get 0."""
    return date_summary(df, spec).select(
        spec.entity, "months_tenure", "avg_lag_days", "std_lag_days",
    ).na.fill(0.0, ["avg_lag_days", "std_lag_days"])


def with_previous_date(df: DataFrame, spec: PanelSpec, bucketed: bool = False,
                       rows_per_day: int = 2_000_000) -> DataFrame:
    """Every row with the time of the entity's previous record (``lag_date``) and the days since then.

    Records follow each other by time, then by row id; without a row id, equal times
    are told apart by the other columns. Only the rows of one day of an entity are
    ordered together: the last time of its previous day enters the day as a row of
    its own, so an entity with very many rows is spread over its days. Days above
    ``rows_per_day`` are range-sorted and spread over tasks; there are at most
    rows / rows_per_day of them, which bounds what is broadcast. ``bucketed`` says
    that the panel is bucketed by entity: a task then reads its entities whole, and
    one window over each needs no exchange.
    """
    day = F.to_date(spec.time)
    tie = F.col(spec.row) if spec.row else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    if bucketed:
        records = Window.partitionBy(spec.entity).orderBy(spec.time, tie)
        return df.withColumn("lag_date", F.lag(spec.time).over(records)).withColumn(
            "lag_days", F.datediff(spec.time, "lag_date"))
    by_day = Window.partitionBy(spec.entity).orderBy("__day")
    days = staged(df.groupBy(spec.entity, day.alias("__day")).agg(F.max(spec.time).alias(spec.time), F.count(F.lit(1)).alias("__n"))
                  .withColumn(spec.time, F.lag(spec.time).over(by_day)).withColumn("__before", F.lit(True)), "days")
    rows = df.withColumns({"__day": day, "__before": F.lit(False), "__tie": tie})
    crowded = days.where(F.col("__n") > rows_per_day)
    if crowded.isEmpty():
        lagged = _lagged_in_days(rows, days.drop("__n"), spec)
    else:
        same_day = null_safe_equal("r", "c", [spec.entity, "__day"])

        def part(table: DataFrame, how: str) -> DataFrame:
            return table.alias("r").join(F.broadcast(crowded.select(spec.entity, "__day").alias("c")), same_day, how)

        # The last time of the day before comes first in a crowded day, as it is smaller than all of it.
        ends = part(days, "left_semi").drop("__n")
        spread = previous_values(part(rows, "left_semi").unionByName(ends, allowMissingColumns=True),
                                 [spec.entity, "__day"], [spec.time, "__tie"], spec.time, "lag_date")
        lagged = _lagged_in_days(part(rows, "left_anti"), part(days, "left_anti").drop("__n"), spec).unionByName(
            spread.where(~F.col("__before")))
    return lagged.select(*[F.col(f"`{c}`") for c in df.columns], "lag_date").withColumn(
        "lag_days", F.datediff(spec.time, "lag_date"))


def _lagged_in_days(rows: DataFrame, before: DataFrame, spec: PanelSpec) -> DataFrame:
    """``rows`` with the time of the row before in the same day; ``before`` has the last earlier time of each day."""
    inside = Window.partitionBy(spec.entity, "__day").orderBy(F.col("__before").desc(), spec.time, "__tie")
    return (rows.unionByName(before, allowMissingColumns=True)
            .withColumn("lag_date", F.lag(spec.time).over(inside)).where(~F.col("__before")))


def with_first_last_date(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Every row with the first and last date of its entity."""
    facts = staged(df.groupBy(spec.entity).agg(
        F.min(spec.time).alias("earliest_date"), F.max(spec.time).alias("latest_date"),
        F.count(F.lit(1)).alias("__rows")), "first-last")
    return attach_group_facts(df, facts, [spec.entity], spec.keys, "__rows").drop("__rows")
