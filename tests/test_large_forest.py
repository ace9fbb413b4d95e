"""Forests of deep trees whose trees never reach the driver."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import functions as F

from strandline.operators import large_forest, models
from strandline.plans import training


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 3)).round(2)
    target = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=900) > 0.8).astype(int)
    rows = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, target))], "id long, u double, v double, w double, target int")
    return training.prepare_training(rows, "id")


def test_large_forest_learns_saves_and_stays_out_of_the_driver(spark, data, monkeypatch, tmp_path):
    def right(model):
        scored = training.evaluate(data, model, data.columns)
        return scored.count(), scored.agg(F.avg((F.col("predicted") == F.col("target")).cast("int"))).first()[0]

    own = training.fit(data, estimator=models.random_forest(trees=30))
    assert isinstance(own, RandomForestClassificationModel)
    monkeypatch.setattr(models, "MANY_ROWS", 100)
    large = training.fit(data, estimator=models.random_forest(trees=30))
    assert isinstance(large, large_forest.LargeForestModel) and large.nodes.count() == 30
    (n, a), (m, b) = right(own), right(large)
    assert n == m == data.part("test").count() and abs(a - b) < 0.08
    large.write().overwrite().save(str(tmp_path / "forest"))
    again = DefaultParamsReader.loadParamsInstance(str(tmp_path / "forest"), spark)
    scores = [{r["id"]: r["probability"] for r in training.evaluate(data, x, data.columns).collect()} for x in (large, again)]
    assert scores[0] == scores[1] and len(set(scores[0].values())) > 20
    # Shallow trees are small, and stay those of Spark.
    assert isinstance(training.fit(data, estimator=models.random_forest(trees=3, max_depth=5)), RandomForestClassificationModel)


@pytest.mark.parametrize("min_split", [0.0, 0.1])
def test_large_tree_is_that_of_spark(spark, data, monkeypatch, min_split):
    def scores():
        model = training.fit(data, estimator=models.decision_tree(min_split=min_split))
        return {r["id"]: round(r["probability"], 9) for r in training.evaluate(data, model, data.columns).collect()}

    want = scores()
    monkeypatch.setattr(models, "MANY_ROWS", 100)
    assert scores() == want


def test_candidate_splits_use_all_rows(spark):
    values = [float(i % 20) for i in range(5_000)]
    wide = np.random.default_rng(1).permutation(40_000) / 40_000
    few = spark.createDataFrame([([v],) for v in values], "x array<double>").repartition(3)
    assert large_forest.candidate_splits(few)[0].tolist() == [i + 0.5 for i in range(19)]
    many = spark.createDataFrame([([float(v)],) for v in wide], "x array<double>").repartition(4)
    assert large_forest.candidate_splits(many)[0] == pytest.approx([i / 32 for i in range(1, 32)], abs=0.004)
