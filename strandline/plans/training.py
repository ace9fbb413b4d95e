"""From labelled features to a fitted, evaluated and saved model."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.ml.base import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.config import FOLDS, SAMPLE_SEED, SEARCH_PARALLELISM, SPLIT_SEED
from strandline.functions.columns import unit_hash
from strandline.operators.metrics import top_coefficients
from strandline.operators.models import Scorer, coefficients, logistic_regression, score
from strandline.operators.prepare import MinMax, assemble, tuning_sample, with_fold, with_split
from strandline.operators.search import Fold
from strandline.operators.smote import oversample
from strandline.session import in_parallel, staged

ROWS_PER_TASK = 20_000


@dataclass
class TrainingData:
    """Scaled rows with their split, and the oversampled training rows."""

    key: str
    columns: list[str]
    scaler: MinMax
    rows: DataFrame
    target: str = "target"
    k: int = 5
    fit_rows: int | None = None

    @cached_property
    def resampled(self) -> DataFrame:
        """The training rows with synthetic ones, written at the first use."""
        used = bounded_rows(self.part("train"), [self.key], self.fit_rows)
        return staged(oversample(used, self.key, self.columns, self.target, self.k), "resampled")

    def part(self, split: str) -> DataFrame:
        return self.rows.where(F.col("split") == split)


def bounded_rows(df: DataFrame, key: list[str], most: int | None, seed: int = SAMPLE_SEED) -> DataFrame:
    """About ``most`` rows, drawn by the hash of their key; all rows if there are no more, or no bound is given."""
    n = df.count() if most else 0
    if not most or n <= most:
        return df
    return df.where(unit_hash(F.lit(seed), F.lit("fit"), *[F.col(c) for c in key]) < most / n)


def prepare_training(features: DataFrame, key: str, target: str = "target", seed: int = SPLIT_SEED,
                     scale_on: str = "train", k: int = 5, fit_rows: int | None = None) -> TrainingData:
    """Split, scale and oversample. ``scale_on="all"`` learns the ranges before the split.

    The split rows are written, because every model reads them often; so are the oversampled rows once a fit wants them.
    ``fit_rows`` bounds the training rows that are oversampled and fitted on: the
    neighbour search costs the square of the rarer class where there are many
    columns. There is no bound unless it is given; scoring always covers all rows.
    """
    columns = [c for c in features.columns if c not in (key, target)]
    split = staged(with_split(features, key, seed), "split-features")
    scaler = MinMax.fit(split if scale_on == "all" else split.where(F.col("split") == "train"), columns)
    return TrainingData(key, columns, scaler, scaler.transform(split), target, k, fit_rows)


def fit(data: TrainingData, columns: list[str] | None = None, estimator: Estimator | None = None) -> Model:
    """Fit on the oversampled training rows, by default the chosen logistic regression."""
    vectors = assemble(data.resampled, columns or data.columns, ["target"])
    return (estimator or logistic_regression(data.resampled.count())).fit(vectors)


def largest_gradient(data: TrainingData, model: Model, columns: list[str] | None = None) -> float:
    """The largest slope of the penalised mean loss at the weights of a logistic model; zero at its minimum.

    At a weight of zero the L1 part of the penalty holds any slope up to its strength;
    only what goes beyond counts.
    """
    columns = columns or data.columns
    scored = score(model, data.resampled, columns, ["target", *columns])
    error = F.col("probability") - F.col("target")
    intercept, *slopes = scored.agg(F.avg(error), *[F.avg(error * F.col(f"`{c}`")) for c in columns]).first()
    strength, share = model.getRegParam(), model.getElasticNetParam()

    def beyond(slope: float, weight: float) -> float:
        if weight == 0.0:
            return max(0.0, abs(slope) - strength * share)
        return abs(slope + strength * ((1 - share) * weight + share * math.copysign(1.0, weight)))

    return max(abs(intercept), *[beyond(s, w) for s, w in zip(slopes, map(float, model.coefficients))])


def scorer(data: TrainingData, limit: int | None = None, estimator: Estimator | None = None, model: Model | None = None) -> Scorer:
    """A model on all features, or a logistic one on the ``limit`` strongest of those above the mean weight.

    ``model`` is the model on all features, if it is fitted already.
    """
    model = model or fit(data, estimator=estimator)
    columns = data.columns
    if limit:
        columns = select_features(data, model, limit)
        model = fit(data, columns)
    return Scorer(model, columns, MinMax({c: data.scaler.ranges[c] for c in columns}))


def select_features(data: TrainingData, model: Model, limit: int) -> list[str]:
    """Names of the strongest features, in table order."""
    weights = coefficients(data.rows.sparkSession, model, data.columns)
    chosen = {r["feature"] for r in top_coefficients(weights, limit).collect()}
    return [c for c in data.columns if c in chosen]


def evaluate(data: TrainingData, model: Model, columns: list[str], split: str = "test") -> DataFrame:
    """Scored rows of one split, ready for the metrics."""
    return score(model, data.part(split), columns, [data.key, "target"])


def tuning_folds(data: TrainingData, percent: int = 25, folds: int = FOLDS, seed: int = SAMPLE_SEED,
                 resample: str = "inside", target: str = "target", k: int = 5) -> list[Fold]:
    """The training and held-out rows of each fold, as vectors, written once for all folds and trials.

    With ``resample="inside"`` a sample of the training rows is divided into folds and
    each training part oversampled by itself, so no synthetic row has a parent in the
    held-out part. ``"before"`` samples and divides the rows oversampled beforehand.
    """
    if resample not in ("inside", "before"):
        raise ValueError(f"unknown order of resampling {resample!r}")
    if resample == "before":
        key = [data.key, "copy"]
        chosen = with_fold(tuning_sample(data.resampled, key, seed, percent), key, folds, seed)
    else:
        chosen = with_fold(tuning_sample(data.part("train"), [data.key], seed, percent), [data.key], folds, seed)
    chosen = staged(chosen, "tuning-sample")
    # Every step of every fit starts all tasks, so a small sample takes few.
    tasks = max(1, math.ceil(chosen.count() / ROWS_PER_TASK))
    everyone = (1 << folds) - 1
    own = F.expr("shiftleft(1L, fold)")

    def with_masks(rows: DataFrame, trained_in: Column, held_out_in: Column) -> DataFrame:
        marked = rows.withColumns({"trained_in": trained_in.cast("long"), "held_out_in": held_out_in.cast("long")})
        return assemble(marked, data.columns, [target, "trained_in", "held_out_in"])

    parts = [with_masks(chosen, F.lit(everyone).cast("long").bitwiseXOR(own), own)]
    if resample == "inside":
        def synthetic(i: int) -> DataFrame:
            made = oversample(chosen.where(F.col("fold") != i), data.key, data.columns, target, k).where(F.col("copy") > 0)
            return staged(with_masks(made, F.lit(1 << i), F.lit(0)), "synthetic")

        parts += in_parallel(chosen.sparkSession, synthetic, range(folds), SEARCH_PARALLELISM)
    # One table for all folds: a bit for each fold says whether a row is trained on or held out there.
    matrix = staged(reduce(DataFrame.unionAll, parts).coalesce(tasks), "tuning-rows")

    def members(mask: str, i: int) -> DataFrame:
        return matrix.where(F.col(mask).bitwiseAND(F.lit(1 << i).cast("long")) != 0).select(target, "features")

    return [Fold(members("trained_in", i), members("held_out_in", i)) for i in range(folds)]
