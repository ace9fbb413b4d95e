"""Preparing training data: scaling, stable splits and folds."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.config import FOLDS, SAMPLE_SEED, SPLIT_SEED
from strandline.functions.columns import blocks, hash_bucket


@dataclass(frozen=True)
class MinMax:
    """Column ranges learned once; scales to [0, 1] on the data they were learned from."""

    ranges: dict[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "MinMax":
        ranges = {}
        for part in blocks(columns, 2):
            row = df.agg(*[F.min(F.col(f"`{c}`").cast("double")).alias(f"lo{i}") for i, c in enumerate(part)],
                         *[F.max(F.col(f"`{c}`").cast("double")).alias(f"hi{i}") for i, c in enumerate(part)]).first()
            ranges |= {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(part)}
        return MinMax(ranges)

    def transform(self, df: DataFrame) -> DataFrame:
        """A constant column becomes 0; nulls stay null."""
        def scaled(c):
            low, high = self.ranges[c]
            value = F.col(f"`{c}`").cast("double")
            if low is None or high == low:
                return F.when(value.isNotNull(), 0.0).alias(c)
            return ((value - F.lit(low)) / F.lit(high - low)).alias(c)

        return df.select([scaled(c) if c in self.ranges else F.col(f"`{c}`") for c in df.columns])

    def to_json(self) -> str:
        return json.dumps(self.ranges)

    @staticmethod
    def from_json(text: str) -> "MinMax":
        return MinMax({c: tuple(r) for c, r in json.loads(text).items()})


def with_split(df: DataFrame, key: str, seed: int = SPLIT_SEED) -> DataFrame:
    """``split`` is train, valid or test for about 80, 10 and 10 % of the keys."""
    bucket = hash_bucket([key], seed, 100)
    return df.withColumn("split", F.when(bucket < 80, "train").when(bucket < 90, "valid").otherwise("test"))


def tuning_sample(df: DataFrame, key: list[str], seed: int = SAMPLE_SEED, percent: int = 25) -> DataFrame:
    return df.where(hash_bucket(key, seed, 100) < percent)


def with_fold(df: DataFrame, key: list[str], folds: int = FOLDS, seed: int = SAMPLE_SEED) -> DataFrame:
    return df.withColumn("fold", hash_bucket([*key], seed + 1, folds))


def class_balance(df: DataFrame, target: str = "target", by=()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(target).alias("positives"),
        F.avg(target).alias("positive_rate"))


def assemble(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The columns as one vector ``features`` next to the kept columns; nulls are an error."""
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df).select(*keep, "features")
