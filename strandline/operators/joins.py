"""Joins of per-entity tables, and a join for rows whose key may be very frequent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import null_safe_equal


def outer_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, on=key, how="outer")


def outer_join_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Full outer join of tables that hold each key once, with one shuffle for any number of tables.

    As in ``outer_join`` a null key matches nothing: such rows stay by themselves.
    """
    if len(frames) == 1:
        return frames[0]
    alone = F.col(key).isNull()
    marked = [f.withColumn("__alone", F.when(alone, F.lit(i)).otherwise(F.lit(-1))) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    return stacked.groupBy(key, "__alone").agg(
        *[F.max(F.col(f"`{c}`")).alias(c) for c in stacked.columns if c not in (key, "__alone")]).drop("__alone")


def inner_join_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner join of tables that hold each key once; a null key matches nothing."""
    return reduce(lambda a, b: a.join(b, on=key), frames)


def attach_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return features.join(labels, on=key)


def attach_group_facts(rows: DataFrame, facts: DataFrame, keys: list[str], row_hash: list[str],
                       count: str, rows_per_split: int = 2_000_000) -> DataFrame:
    """Give every row the facts of its group, where a group may hold a large part of all rows.

    ``facts`` has one row per group with its row count in ``count``. Groups above
    ``rows_per_split`` are spread over that many salts, and only their facts are
    repeated. There are at most rows / rows_per_split such groups, which bounds
    what is broadcast: two million keys would need four trillion rows.
    """
    splits = F.ceil(F.col(count) / rows_per_split).cast("int")
    hot = facts.where(F.col(count) > rows_per_split).select(*keys, splits.alias("__splits"))
    salted = (rows.alias("r")
              .join(F.broadcast(hot.alias("h")), null_safe_equal("r", "h", keys), "left")
              .select("r.*", F.pmod(F.xxhash64(*[F.col(f"r.{c}") for c in row_hash]),
                                    F.coalesce(F.col("h.__splits"), F.lit(1))).cast("int").alias("__salt")))
    spread = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(splits, F.lit(1)) - 1)))
    on = null_safe_equal("r", "f", [*keys, "__salt"])
    new = [c for c in facts.columns if c not in rows.columns]
    return (salted.alias("r").join(spread.alias("f"), on, "left")
            .select(*[F.col(f"r.`{c}`") for c in rows.columns], *[F.col(f"f.`{c}`") for c in new]))
