"""Fits inside a task against those of Spark ML, and the search that takes them."""

import numpy as np
import pyarrow as pa
import pytest

from strandline.operators import search
from strandline.operators.in_task import numbered, one_task_each
from strandline.plans import training


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 3)).round(2)
    target = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=900) > 0.8).astype(int)
    rows = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, target))], "id long, u double, v double, w double, target int")
    return training.prepare_training(rows, "id")


LOGISTIC = {"max_iter": 900, "C": 0.3}
TREE = {"max_features": 1.0, "min_samples_leaf": 0.01}
TRIALS = [
    {"family": "logreg", "penalty": "l2", **LOGISTIC}, {"family": "logregnone", "penalty": "none", **LOGISTIC},
    {"family": "logregLl", "penalty": "l1", **LOGISTIC}, {"family": "logregSGN", "penalty": "elasticnet", "l1_ratio": 0.4, **LOGISTIC},
    {"family": "dtree", "criterion": "gini", "min_samples_split": 0.05, "splitter": "best", **TREE},
    {"family": "dtree", "criterion": "entropy", "min_samples_split": 0.0, "splitter": "random", **TREE},
    {"family": "dtree", "criterion": "gini", "min_samples_split": 0.3, "splitter": "best", **TREE, "min_samples_leaf": 0.6}]


def test_a_trial_is_one_job_with_the_metrics_of_spark(spark, data):
    folds = training.tuning_folds(data, percent=80, folds=3)
    sizes = [f.train.count() for f in folds]
    with search.evaluator(spark, folds) as evaluate:
        for i, trial in enumerate(TRIALS):
            spark.sparkContext.setJobGroup(f"trial {i}", "")
            found = evaluate(trial)
            spark.sparkContext.setJobGroup("other", "")
            assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trial {i}")) <= 2  # the second: thresholds drawn at random
            assert found == pytest.approx(search.cross_validated(folds, lambda n: search.build(trial, n), sizes))
        forest = evaluate({"family": "rf", "criterion": "gini", "min_samples_split": 0.02, "min_samples_leaf": 0.01, "max_features": "sqrt"})
        assert forest == evaluate({"family": "rf", "criterion": "gini", "min_samples_split": 0.02, "min_samples_leaf": 0.01, "max_features": "sqrt"})
        assert forest["accuracy"] > 0.75


def test_folds_too_large_for_a_task_are_fitted_by_spark(spark, data, monkeypatch):
    folds = training.tuning_folds(data, percent=80, folds=2)
    with search.evaluator(spark, folds) as evaluate:
        want = evaluate(TRIALS[0])
    monkeypatch.setattr(search, "FIT_BYTES", 1_000)
    monkeypatch.setattr(search, "packed", None)
    with search.evaluator(spark, folds) as evaluate:
        assert evaluate(TRIALS[0]) == pytest.approx(want)


def test_tables_have_a_task_each(spark):
    tables = [spark.range(100 * i, 100 * i + 50, 1, 3) for i in range(5)]

    def seen(batches):
        task = []
        total = sum(sum(b["id"].to_pylist()) for b in numbered(batches, task))
        if task:
            yield pa.RecordBatch.from_pydict({"task": task, "total": [total]})

    found = dict(map(tuple, one_task_each(tables).mapInArrow(seen, "task long, total long").collect()))
    assert found == {i: sum(range(100 * i, 100 * i + 50)) for i in range(5)}
