"""Classifiers, scoring and feature selection with Spark ML."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline
from pyspark.ml.base import Estimator, Model, Transformer
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import LOGISTIC_C, LOGISTIC_MAX_ITER
from strandline.operators.in_task import MAX_BINS
from strandline.operators.large_forest import LargeForestModel, grow_forest
from strandline.operators.prepare import MinMax, assemble
from strandline.session import new_path
from strandline.sources.statements import read_names, write_names

#: Memory for the statistics of the nodes that one pass over the rows splits: deep trees take a pass for each share of it.
#: Each task of an executor holds as much, and its rows and the merged statistics besides.
NODE_MEMORY_MB = 512
#: The trees searched through have no limit of depth; this is the deepest that Spark grows.
MAX_DEPTH = 30
#: Beyond so many rows, trees deeper than this are grown by tasks; their bytes, one for each coordinate, must fit into a task.
MANY_ROWS, DEEP, TASK_BYTES = 50_000, 12, 512 << 20
ROLES = {"featuresCol": "features", "labelCol": "target", "predictionCol": "predicted"}


def logistic_regression(n_rows: int, c: float = LOGISTIC_C, max_iter: int = LOGISTIC_MAX_ITER,
                        l1_ratio: float = 0.0, penalised: bool = True) -> LogisticRegression:
    """Logistic regression with the inverse penalty strength ``c``.

    With ``c`` the total loss is weighed against the penalty, Spark weighs the mean
    loss against it; hence the division by the number of rows.
    """
    return LogisticRegression(
        **ROLES, maxIter=max_iter, standardization=False,
        regParam=1.0 / (c * n_rows) if penalised else 0.0, elasticNetParam=l1_ratio if penalised else 0.0)


def _subset(max_features) -> str:
    if max_features is None:
        return "all"
    if isinstance(max_features, str):
        return "sqrt" if max_features == "auto" else max_features
    return str(min(1.0, max(0.001, float(max_features))))


def _leaf_limits(min_leaf: float, max_depth: int) -> dict:
    """The fraction of the rows that a leaf must hold, as Spark states it.

    Two leaves of more than half the rows cannot be: the tree stays a single leaf.
    """
    if min_leaf > 0.5:
        return {"maxDepth": 0, "minWeightFractionPerNode": 0.0}
    return {"maxDepth": max_depth, "minWeightFractionPerNode": min(min_leaf, 0.4999999)}


_NODES = "treeID int, id int, leftChild int, rightChild int, leaf boolean"


def _cut_below(tree: pd.DataFrame, share: float) -> pd.DataFrame:
    """The nodes that stay of a tree (``id``, children, ``rawCount``), numbered anew from the root down, left first.

    A node of fewer rows than ``share`` of the root's, or than two, becomes a leaf.
    """
    nodes = {r.id: r for r in tree.itertuples()}
    least = max(2, math.ceil(share * nodes[0].rawCount - 1e-9))
    out, stack, children = [], [(0, -1, 0)], {}
    while stack:
        at, parent, side = stack.pop()
        number = len(out)
        if parent >= 0:
            children[parent, side] = number
        node = nodes[at]
        leaf = node.leftChild < 0 or node.rawCount < least
        out.append((at, leaf))
        if not leaf:
            stack += [(node.rightChild, number, 1), (node.leftChild, number, 0)]
    return pd.DataFrame([(at, number, children.get((number, 0), -1), children.get((number, 1), -1), leaf)
                         for number, (at, leaf) in enumerate(out)], columns=["was", "id", "leftChild", "rightChild", "leaf"])


def undo_small_splits(model: RandomForestClassificationModel, share: float) -> RandomForestClassificationModel:
    """The forest with no split of a node below ``share`` of its tree's rows.

    Such a node was split only if its parent was, so cutting the grown trees gives what
    growing with the bound would. The saved node table is changed and read again.
    """
    spark = SparkSession.active()
    grown, cut = new_path(spark, "forest"), new_path(spark, "cut-forest")
    model.write().save(grown)
    nodes = spark.read.parquet(f"{grown}/data")

    def kept(tree: pd.DataFrame) -> pd.DataFrame:
        return _cut_below(tree, share).assign(treeID=tree["treeID"].iloc[0])

    stays = (nodes.select("treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.rawCount")
             .groupBy("treeID").applyInPandas(kept, f"was int, {_NODES}"))
    data = F.col("nodeData")
    no_split = F.struct(F.lit(-1).alias("featureIndex"), F.array().cast("array<double>").alias("leftCategoriesOrThreshold"),
                        F.lit(-1).alias("numCategories"))
    changed = (nodes.join(stays.withColumnRenamed("id", "now"), (nodes["treeID"] == stays["treeID"]) & (data["id"] == stays["was"]))
               .select(nodes["treeID"], F.struct(
                   F.col("now").alias("id"), data["prediction"].alias("prediction"), data["impurity"].alias("impurity"),
                   data["impurityStats"].alias("impurityStats"), data["rawCount"].alias("rawCount"),
                   F.when(F.col("leaf"), F.lit(-1.0)).otherwise(data["gain"]).alias("gain"),
                   F.col("leftChild"), F.col("rightChild"),
                   F.when(F.col("leaf"), no_split).otherwise(data["split"]).alias("split")).alias("nodeData")))
    changed.write.parquet(f"{cut}/data")
    spark.read.parquet(f"{grown}/treesMetadata").write.parquet(f"{cut}/treesMetadata")
    spark.read.text(f"{grown}/metadata").coalesce(1).write.text(f"{cut}/metadata")
    return RandomForestClassificationModel.load(cut)


class Forest(RandomForestClassifier):
    """A forest of Spark ML; deep trees over many rows are grown by tasks instead, as their nodes do not fit into the driver."""

    def _fit(self, dataset: DataFrame) -> Model:
        return self.grown(dataset, 0.0)

    def grown(self, dataset: DataFrame, min_split: float) -> Model:
        """The forest in which no node below a share of its tree's rows is split."""
        if self.getMaxDepth() > DEEP and self.getMaxBins() == MAX_BINS:
            vectors = dataset.select(F.col(self.getFeaturesCol()).alias("features"), self.getLabelCol())
            rows = vectors.count()
            if rows > MANY_ROWS and rows * len(vectors.first()["features"]) <= TASK_BYTES:
                return grow_forest(
                    vectors, self.getLabelCol(), self.getNumTrees(), self.getBootstrap(), self.getImpurity(), self.getMaxDepth(),
                    self.getMinWeightFractionPerNode(), min_split, self.getFeatureSubsetStrategy(), self.getSeed())
        model = super()._fit(dataset)
        return undo_small_splits(model, min_split) if min_split > 0 else model


class SplitBoundForest(Estimator):
    """A forest in which nodes below a share of the rows are never split."""

    def __init__(self, forest: Forest, min_split: float):
        super().__init__()
        self.forest, self.min_split = forest, min_split

    def _fit(self, dataset: DataFrame) -> Model:
        return self.forest.grown(dataset, self.min_split)


class RandomCuts(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Each feature of a vector in [0, 1] as its place among ``cuts`` random thresholds of its own."""

    cuts = Param(Params._dummy(), "cuts", "thresholds of each feature", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, seed=0, cuts=8):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None}, **{
            k: v for k, v in {"seed": seed, "cuts": cuts}.items() if k not in self._input_kwargs})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        seed, cuts = self.getSeed(), self.getOrDefault(self.cuts)
        places = F.transform(vector_to_array(self.getInputCol()), lambda x, feature: reduce(
            lambda a, b: a + b, [(x > _random_cut(seed, feature, i)).cast("double") for i in range(cuts)]))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(places))

    def thresholds(self, width: int) -> list[list[float]]:
        """The thresholds of each of so many features, ascending."""
        cuts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda feature: F.array_sort(F.array(
            *[_random_cut(self.getSeed(), feature, i) for i in range(self.getOrDefault(self.cuts))])))
        return SparkSession.active().range(1).select(cuts).first()[0]


def _random_cut(seed: int, feature: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), feature, F.lit(i)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def decision_tree(criterion: str = "gini", min_split: float = 0.0, min_leaf: float = 0.0,
                  max_features=None, max_depth: int = MAX_DEPTH, seed: int = 0, splitter: str = "best") -> Estimator:
    """One tree on all rows; a forest of one, because only forests can restrict the features of a split.

    With ``splitter="random"`` the best of eight random thresholds for each feature is
    taken, drawn once for the tree (scaled features are expected).
    """
    roles = ROLES if splitter == "best" else ROLES | {"featuresCol": "cut_features"}
    forest = Forest(
        **roles, numTrees=1, bootstrap=False, impurity=criterion, seed=seed, maxMemoryInMB=NODE_MEMORY_MB, cacheNodeIds=True,
        featureSubsetStrategy=_subset(max_features), **_leaf_limits(min_leaf, max_depth))
    tree = SplitBoundForest(forest, min_split) if min_split > 0 else forest
    if splitter == "best":
        return tree
    return Pipeline(stages=[RandomCuts(inputCol="features", outputCol="cut_features", seed=seed), tree])


def random_forest(criterion: str = "gini", min_split: float = 0.0, min_leaf: float = 0.0,
                  max_features="sqrt", trees: int = 100, max_depth: int = MAX_DEPTH,
                  seed: int = 0) -> Estimator:
    forest = Forest(
        **ROLES, numTrees=trees, impurity=criterion, seed=seed, maxMemoryInMB=NODE_MEMORY_MB, cacheNodeIds=True,
        featureSubsetStrategy=_subset(max_features), **_leaf_limits(min_leaf, max_depth))
    return SplitBoundForest(forest, min_split) if min_split > 0 else forest


def score(model: Model, df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``probability`` of class 1 and the predicted class next to the kept columns."""
    scored = model.transform(assemble(df, columns, keep))
    return scored.select(*keep, vector_to_array("probability")[1].alias("probability"),
                         F.col("predicted").cast("int").alias("predicted"))


def linear_score(df: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """Probability of a given linear model, without loading one."""
    total = F.lit(float(intercept))
    for c, w in weights.items():
        total = total + F.lit(float(w)) * F.col(f"`{c}`")
    return df.withColumn("probability", 1.0 / (1.0 + F.exp(-total)))


def submission(scored: DataFrame, key: str) -> DataFrame:
    """Key and probability, rounded half to even at two places."""
    return scored.select(key, F.bround("probability", 2).alias("prediction"))


def coefficients(spark: SparkSession, model: LogisticRegressionModel, columns: list[str]) -> DataFrame:
    rows = [(c, float(w)) for c, w in zip(columns, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "feature string, weight double")


@dataclass
class Scorer:
    """A fitted model of any kind with the feature list and the scaling it was trained with."""

    model: Model
    columns: list[str]
    scaler: MinMax

    def score(self, df: DataFrame, keep: list[str], refit: bool = False) -> DataFrame:
        """Score unscaled features; ``refit`` learns the ranges from these rows instead of the training rows."""
        scaler = MinMax.fit(df, self.columns) if refit else self.scaler
        return score(self.model, scaler.transform(df.select(*keep, *self.columns)), self.columns, keep)

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        write_names(spark, self.columns, f"{path}/feature_name")
        write_names(spark, [self.scaler.to_json()], f"{path}/ranges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scorer":
        return Scorer(DefaultParamsReader.loadParamsInstance(f"{path}/model", spark),
                      read_names(spark, f"{path}/feature_name"),
                      MinMax.from_json(read_names(spark, f"{path}/ranges")[0]))
