"""Search over classifier families by cross-validated accuracy, sequential or of given trials."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import SEARCH_PARALLELISM, SEARCH_TRIALS
from strandline.operators.in_task import binned, forest_classes, logistic, logistic_classes, numbered, one_task_each, packed, unpacked
from strandline.operators.models import RandomCuts, SplitBoundForest, decision_tree, logistic_regression, random_forest
from strandline.operators.tpe import Choice, LogNormal, Sampler, Uniform
from strandline.session import in_parallel, in_thread, release

# The families of the search space and the penalties each may draw.
FAMILIES = ("dtree", "rf", "logreg", "logregnone", "logregLl", "logregSG", "logregSGN")
PENALTIES = {
    "logreg": ["l2"],
    "logregnone": ["none"],
    "logregLl": ["l1", "l2"],
    "logregSG": ["l1", "l2"],
    "logregSGN": ["none", "elasticnet"],
}


# The largest iterations of a logistic fit and the steps of its and the trees' ranges.
ITERATIONS, ITERATION_STEP, SHARE_STEP = (100, 3000), 100, 0.001


def draw_trials(n: int = SEARCH_TRIALS, seed: int = 0) -> list[dict]:
    """``n`` points of the search space, the same for the same seed."""
    rng = random.Random(seed)

    def step(low, high, width):
        return round(rng.uniform(low, high) / width) * width

    trials = []
    for _ in range(n):
        family = rng.choice(FAMILIES)
        if family in PENALTIES:
            trial = {"family": family, "penalty": rng.choice(PENALTIES[family]),
                     "C": rng.lognormvariate(0.0, 1.0), "max_iter": int(step(*ITERATIONS, ITERATION_STEP))}
            if family in ("logregnone", "logregSGN"):
                trial["l1_ratio"] = rng.random()
        else:
            named = rng.choice(["auto", "sqrt", "log2"])
            trial = {"family": family, "criterion": rng.choice(["gini", "entropy"]),
                     "min_samples_split": step(0, 1, SHARE_STEP), "min_samples_leaf": step(0, 1, SHARE_STEP),
                     "max_features": rng.choice([named, step(0, 1, SHARE_STEP)])}
        trials.append(trial)
    return trials


#: The same space for the sequential search, with the tree family's way of splitting.
_TREE = {
    "criterion": Choice(("gini", "entropy")),
    "min_samples_split": Uniform(0, 1, SHARE_STEP), "min_samples_leaf": Uniform(0, 1, SHARE_STEP),
    "max_features": Choice((Choice(("auto", "sqrt", "log2")), Uniform(0, 1, SHARE_STEP))),
}
SPACE = {"family": Choice((
    {"family": "dtree", **_TREE, "splitter": Choice(("best", "random"))},
    {"family": "rf", **_TREE},
    *({"family": family, "penalty": Choice(tuple(penalties)), "C": LogNormal(0.0, 1.0),
       "max_iter": Uniform(*ITERATIONS, ITERATION_STEP),
       **({"l1_ratio": Uniform(0, 1)} if family in ("logregnone", "logregSGN") else {})}
      for family, penalties in PENALTIES.items()),
))}


def build(trial: dict, n_rows: int) -> Estimator:
    if trial["family"] in PENALTIES:
        ratio = {"l1": 1.0, "elasticnet": trial.get("l1_ratio", 0.0)}.get(trial["penalty"], 0.0)
        return logistic_regression(n_rows, trial["C"], int(trial["max_iter"]), ratio, trial["penalty"] != "none")
    limits = trial["criterion"], trial["min_samples_split"], trial["min_samples_leaf"], trial["max_features"]
    if trial["family"] == "dtree":
        return decision_tree(*limits, splitter=trial.get("splitter", "best"))
    return random_forest(*limits)


@dataclass(frozen=True)
class Fold:
    """What is fitted on and what is held out (``features``, ``target``); both are read by every trial."""

    train: DataFrame
    held_out: DataFrame


METRICS = ("accuracy", "precision", "recall", "f1")
#: Coordinates that a task holds to fit on; a search on larger folds takes the distributed fits of Spark ML.
FIT_BYTES = 320 << 20


def _fold_metrics(scored: DataFrame) -> dict[str, float] | None:
    """The metrics of class 1 over some held-out rows, None if there are none; 0 where a share has no base."""
    hit, said, true = F.col("predicted") == F.col("target"), F.col("predicted") == 1, F.col("target") == 1
    return _metrics(*scored.agg(F.count(F.lit(1)), *[F.count_if(c) for c in (hit, said & true, said, true)]).first())


def _metrics(n: int, right: int, both: int, claimed: int, there: int) -> dict[str, float] | None:
    if not n:
        return None
    return {"accuracy": right / n, "precision": both / claimed if claimed else 0.0,
            "recall": both / there if there else 0.0, "f1": 2 * both / (claimed + there) if claimed + there else 0.0}


def cross_validated(folds: list[Fold], make: Callable[[int], Estimator], rows: list[int] | None = None) -> dict[str, float]:
    """Means of the metrics over the folds; folds without held-out rows do not count, without any all are NaN.

    ``make`` builds the estimator for a number of training rows; ``rows`` has these
    numbers, if they are known already. The folds run at the same time: a fit is many
    short jobs of few tasks, which leave most cores idle if one fold waits for another.
    """
    def measured(case: tuple[Fold, int]) -> dict[str, float] | None:
        fold, n = case
        return _fold_metrics(make(n).fit(fold.train).transform(fold.held_out))

    cases = list(zip(folds, rows or [f.train.count() for f in folds]))
    return _mean_metrics(in_parallel(folds[0].train.sparkSession, measured, cases, len(cases)) if cases else [])


def _mean_metrics(found: list[dict[str, float] | None]) -> dict[str, float]:
    present = [m for m in found if m]
    return {name: sum(m[name] for m in present) / len(present) if present else float("nan") for name in METRICS}


def cross_validated_accuracy(folds: list[Fold], make: Callable[[int], Estimator],
                             rows: list[int] | None = None) -> float:
    return cross_validated(folds, make, rows)["accuracy"]


def classes_in_task(estimator: Estimator, width: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """What a task does to fit ``estimator`` on some rows of ``width`` features and their classes, and to classify others."""
    if isinstance(estimator, LogisticRegression):
        settings = estimator.getRegParam(), estimator.getElasticNetParam(), estimator.getMaxIter()
        return lambda x, y, others: logistic_classes(others, logistic(x, y, *settings))
    cuts, min_split = None, 0.0
    if isinstance(estimator, Pipeline):
        cuts, estimator = estimator.getStages()
    if isinstance(estimator, SplitBoundForest):
        estimator, min_split = estimator.forest, estimator.min_split
    if not isinstance(estimator, RandomForestClassifier) or not isinstance(cuts, RandomCuts | None):
        raise ValueError(f"no fit in a task for {estimator!r}")
    settings = dict(trees=estimator.getNumTrees(), bagged=estimator.getBootstrap(), criterion=estimator.getImpurity(),
                    max_depth=estimator.getMaxDepth(), min_leaf=estimator.getMinWeightFractionPerNode(), min_split=min_split,
                    max_features=estimator.getFeatureSubsetStrategy(), seed=estimator.getSeed())

    thresholds = [np.array(t) for t in cuts.thresholds(width)] if cuts else None

    def classes(x, y, others):
        if thresholds:
            x, others = binned(x, thresholds), binned(others, thresholds)
        return forest_classes(x, y, others, **settings)

    return classes


@contextmanager
def evaluator(spark: SparkSession, folds: list[Fold]) -> Iterator[Callable[[dict], dict[str, float]]]:
    """What gives the metrics of a trial: one job in which a task fits on each fold, if folds fit into a task.

    The folds are packed once, so that a task reads its own through Spark without a
    shuffle. Larger folds are fitted by Spark ML, in hundreds of jobs.
    """
    counts = in_parallel(spark, lambda df: df.count(), [df for f in folds for df in (f.train, f.held_out)], SEARCH_PARALLELISM)
    sizes, most = counts[::2], max((a + b for a, b in zip(counts[::2], counts[1::2])), default=0)
    width = len(folds[0].train.first()["features"]) if folds and min(sizes) else 0
    kind = next((k for k in ("f8", "f4") if most * width * int(k[1]) <= FIT_BYTES), None)
    if not width or kind is None:
        yield lambda trial: cross_validated(folds, lambda n: build(trial, n), sizes)
        return
    target = next(c for c in folds[0].train.columns if c != "features")

    def pack(fold: Fold) -> DataFrame:
        both = fold.train.withColumn("held", F.lit(False)).unionAll(fold.held_out.withColumn("held", F.lit(True)))
        return packed(both, target, "held", kind, "packed-fold")

    tables = in_parallel(spark, pack, folds, SEARCH_PARALLELISM)
    rows = one_task_each(tables)

    def evaluate(trial: dict) -> dict[str, float]:
        # Trees are built alike for any number of rows.
        fits = [classes_in_task(build(trial, n), width) for n in (sizes if trial["family"] in PENALTIES else sizes[:1])]

        def measured(batches):
            fold: list[int] = []
            parts = unpacked(numbered(batches, fold), kind)
            if fold:
                (x, y), (others, true) = parts[False], parts[True]
                said = fits[fold[0] % len(fits)](x, y, others) if len(others) else true
                yield pa.RecordBatch.from_pydict({"fold": fold, "n": [len(true)], "right": [int((said == true).sum())], "both": [
                    int((said & true).sum())], "claimed": [int(said.sum())], "there": [int(true.sum())]})

        found = rows.mapInArrow(measured, "fold long, n long, right long, both long, claimed long, there long").collect()
        return _mean_metrics([_metrics(*r[1:]) for r in sorted(found)])

    try:
        yield evaluate
    finally:
        release(*tables)


def _table(spark: SparkSession, trials: list[dict], found: list[dict[str, float]]) -> DataFrame:
    """One row for each trial and metric, best accuracy first; of equal ones the earlier trial."""
    order = sorted(range(len(trials)), key=lambda i: (-found[i]["accuracy"], i))
    rows = [(place, i, trials[i]["family"], {k: str(v) for k, v in trials[i].items() if k != "family"}, name, float(found[i][name]))
            for place, i in enumerate(order, 1) for name in METRICS]
    return spark.createDataFrame(
        rows, "rank int, trial int, family string, params map<string,string>, metric string, value double")


def search(spark: SparkSession, folds: list[Fold], trials: list[dict], parallelism: int = SEARCH_PARALLELISM) -> DataFrame:
    """Given trials with their metrics, best first; a few run at a time."""
    with evaluator(spark, folds) as evaluate:
        return _table(spark, trials, in_parallel(spark, evaluate, trials, parallelism))


def sequential_search(spark: SparkSession, folds: list[Fold], n: int = SEARCH_TRIALS, seed: int = 0,
                      parallelism: int = SEARCH_PARALLELISM, space: dict = SPACE,
                      evaluate: Callable[[dict], dict[str, float]] | None = None) -> DataFrame:
    """``n`` trials, each proposed from the results of those before it, best first.

    ``parallelism`` trials run at a time: a trial is proposed once the one that many
    places earlier has ended, and knows all up to that one. So the search is the same
    for the same seed, however long each fit takes.
    """
    if evaluate is None:
        with evaluator(spark, folds) as measured:
            return sequential_search(spark, folds, n, seed, parallelism, space, measured)
    sampler, trials, places, running, found = Sampler(space, seed), [], [], [], []
    with ThreadPool(parallelism) as pool:
        for i in range(n):
            if i >= parallelism:
                found.append(running[i - parallelism].get())
                sampler.tell(places[i - parallelism], found[-1]["accuracy"])
            trial, place = sampler.propose()
            trials.append(trial)
            places.append(place)
            running.append(pool.apply_async(in_thread(spark, evaluate), (trial,)))
        found += [job.get() for job in running[len(found):]]
    return _table(spark, trials, found)


def record_run(results: DataFrame, run: str, path: str) -> DataFrame:
    """Record the results of a run at ``path`` and return the whole record.

    The record is partitioned by run and a run replaces its own partition, so a job that
    is repeated after a failure leaves one copy. Other runs are not touched.
    """
    named = results.withColumn("run", F.lit(run))
    (named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path))
    return results.sparkSession.read.schema(named.schema).parquet(path)
