"""Synthetic minority oversampling (Chawla, Bowyer, Hall and Kegelmeyer, 2002)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.columns import unit_hash
from strandline.operators.neighbours import nearest_neighbours
from strandline.operators.ranking import positions


def minority(df: DataFrame, target: str = "target") -> tuple[int, int, int]:
    """The rarer of the labels 0 and 1, its row count, and how many rows it lacks."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(target), F.lit(0)).alias("ones")).first()
    ones, zeros = int(row["ones"]), int(row["n"] - row["ones"])
    return (1, ones, zeros - ones) if ones <= zeros else (0, zeros, ones - zeros)


def oversample(df: DataFrame, key: str, columns: list[str], target: str = "target", k: int = 5,
               seed: int = 0, search: Callable[..., DataFrame] = nearest_neighbours) -> DataFrame:
    """The rows plus as many synthetic minority rows as balance the classes exactly.

    A synthetic row lies between a minority row and one of its k nearest minority
    rows. Base rows share the new rows evenly; which neighbour and how far along
    are drawn from hashes of the key, so a recomputed task draws the same. ``search``
    finds the neighbours: exactly by default, or ``approximate_neighbours`` for very many
    wide rows (most rows of the rarer class must then have as many as ``k`` neighbours found).
    It is asked for the drawn neighbours (``pairs``) alone.
    Result: ``key``, ``copy`` (0 for the original rows), the columns and the target.
    """
    label, size, missing = minority(df, target)
    originals = df.select(key, F.lit(0).alias("copy"), *columns, target)
    if missing == 0:
        return originals
    if size < 2:
        raise ValueError("oversampling needs at least two rows of the rarer class")
    neighbours = min(k, size - 1)
    rare = df.where(F.col(target) == label).select(
        F.col(key).alias("key"), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("vector"))
    drawn = positions(rare.select("key", unit_hash(F.lit(seed), F.col("key")).alias("draw")), "draw", "key")
    share = F.expr(f"cast((position + 1) * {missing} div {size} - position * {missing} div {size} as int)")
    new = (drawn.withColumn("new", share).where(F.col("new") > 0)
           .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("new"))))
           .withColumn("rank", (F.floor(unit_hash(F.lit(seed), F.lit("rank"), F.col("key"), F.col("copy")) * neighbours) + 1)
                       .cast("int")).select("key", "copy", "rank"))
    along = unit_hash(F.lit(seed), F.lit("along"), F.col("key"), F.col("copy"))
    point = F.zip_with("vector", "neighbour_vector", lambda a, b: a + F.col("along") * (b - a))
    found = search(rare, "key", "vector", k, pairs=new).select("key", "copy", "vector", "neighbour_vector")
    synthetic = (found.withColumn("along", along).withColumn("point", point)
                 .select(F.col("key").alias(key), "copy",
                         *[F.col("point")[i].alias(c) for i, c in enumerate(columns)],
                         F.lit(label).cast(df.schema[target].dataType).alias(target)))
    return originals.unionAll(synthetic)
