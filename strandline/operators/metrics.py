"""Evaluation of classifiers as aggregations over scored rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ranking import running_totals


def _record(**values) -> Column:
    return F.struct(*[v.alias(name) for name, v in values.items()])


def confusion_matrix(df: DataFrame, target: str = "target", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(target).alias("target"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, target: str = "target", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.avg((F.col(target) == F.col(predicted)).cast("int")).alias("accuracy"))


def classification_report(df: DataFrame, target: str = "target", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the plain and weighted means.

    The rows are read once; everything follows from the confusion matrix.
    """
    cells = confusion_matrix(df, target, predicted)
    hit = F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = cells.select(F.inline(F.array(
        _record(label=F.col("target").cast("string"), support=F.col("n"), hits=hit, claimed=none),
        _record(label=F.col("predicted").cast("string"), support=none, hits=none, claimed=F.col("n")))))
    counts = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "hits", "claimed")])

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    per_class = counts.select(
        "label", "hits",
        ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"),
        "support")
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    summary = per_class.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[ratio(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}") for c in names],
        ratio(F.sum("hits"), total).alias("accuracy"), total.alias("support"))
    nothing = F.lit(None).cast("double")
    means = summary.select(F.inline(F.array(
        _record(label=F.lit("accuracy"), precision=nothing, recall=nothing, f1=F.col("accuracy"),
                support=F.col("support")),
        *[_record(label=F.lit(f"{kind} avg"), **{c: F.col(f"{kind}_{c}") for c in names},
                  support=F.col("support")) for kind in ("macro", "weighted")])))
    return per_class.select("label", *names, "support").unionAll(means)


def _threshold_counts(df: DataFrame, score: str, target: str) -> DataFrame:
    marked = df.select(F.col(score).alias("score"), F.col(target).cast("long").alias("pos"),
                       (1 - F.col(target)).cast("long").alias("neg"))
    return running_totals(marked, "score", ["pos", "neg"], descending=True)


def roc_points(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """One point per distinct score: the rates when everything from that score upwards is called positive."""
    return _threshold_counts(df, score, target).select(
        F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.try_divide("cum_pos", "all_pos").alias("tpr"), F.try_divide("cum_neg", "all_neg").alias("fpr"))


def pr_points(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    return _threshold_counts(df, score, target).select(
        F.col("score").alias("threshold"),
        F.try_divide("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.try_divide("cum_pos", "all_pos").alias("recall"))


def auc(df: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Area under the ROC curve by trapezoids, tied scores counting half."""
    counts = _threshold_counts(df, score, target)
    won = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    return counts.agg(F.sum(won).alias("won"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n")).select(
        F.try_divide("won", F.col("p").cast("double") * F.col("n")).alias("auc"))


@dataclass(frozen=True)
class ScoreSketch:
    """Counts of both classes in a bounded number of bins of the score, for curves without a sort of all scores.

    The bins follow the scores: their edges are approximate quantiles, which come from
    a mergeable summary, and a score that equals an edge is counted apart, so a score
    that very many rows share is exact. Then one aggregation, combined map-side, counts
    the bins, ``2 * bins + 1`` rows at most. Sketches over the same edges add up.
    """

    edges: list[float]
    counts: DataFrame  # bin, low (a score of the bin, or its lower edge), tied, pos, neg

    @staticmethod
    def fit(df: DataFrame, score: str = "score", target: str = "target", bins: int = 1024,
            edges: list[float] | None = None) -> ScoreSketch:
        """Rows with a null score are left out; NaN is the largest score. ``edges`` adds a table to an earlier sketch's bins."""
        known = df.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("score"), target)
        if edges is None:
            shares = [i / bins for i in range(1, bins)]
            found = known.where(~F.isnan("score")).approxQuantile("score", shares, 1 / (4 * bins))
            edges = sorted({float(e) for e in found if math.isfinite(e)}) or [0.0]
        splits = [-math.inf, *edges, math.inf]
        binned = Bucketizer(splits=splits, inputCol="score", outputCol="bucket", handleInvalid="keep").transform(known)
        bucket = F.col("bucket").cast("int")
        low = F.when(F.isnan("score"), F.lit(float("nan"))).otherwise(
            F.element_at(F.array(*[F.lit(s) for s in splits]), bucket + 1))
        # NaN equals NaN here, so the scores that are not numbers are a tie of their own.
        counts = (binned.withColumn("low", low)
                  .groupBy("bucket", "low", (F.col("score") == F.col("low")).alias("tied"))
                  .agg(F.sum(F.col(target).cast("long")).alias("pos"), F.sum((1 - F.col(target)).cast("long")).alias("neg")))
        place = (2 * F.col("bucket") + F.when(F.col("tied"), 0).otherwise(1)).cast("int")
        return ScoreSketch(edges, counts.select(place.alias("bin"), "low", "tied", "pos", "neg"))

    def merged(self, other: ScoreSketch) -> ScoreSketch:
        """The sketch of both tables."""
        if self.edges != other.edges:
            raise ValueError("sketches over different edges do not add up")
        both = self.counts.unionAll(other.counts).groupBy("bin", "low", "tied").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        return ScoreSketch(self.edges, both.select("bin", "low", "tied", "pos", "neg"))

    def _curve(self) -> DataFrame:
        above = Window.partitionBy(F.lit(0)).orderBy(F.col("bin").desc())  # the bins of the sketch, not the rows
        return self.counts.select("bin", "low", "tied", "pos", "neg", *[F.sum(c).over(above).alias(f"cum_{c}") for c in ("pos", "neg")])

    def roc_points(self) -> DataFrame:
        """The points of the exact curve at the lower ends of the bins: ``threshold, tp, fp, tpr, fpr``."""
        last = F.max(F.struct("cum_pos", "cum_neg")).over(Window.partitionBy(F.lit(0)))
        return self._curve().withColumn("all", last).select(
            F.col("low").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
            F.try_divide("cum_pos", "all.cum_pos").alias("tpr"), F.try_divide("cum_neg", "all.cum_neg").alias("fpr"))

    def pr_points(self) -> DataFrame:
        """Precision and recall at the lower ends of the bins; points of the exact curve."""
        return self.roc_points().select("threshold", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"),
                                        F.col("tpr").alias("recall"))

    def auc(self) -> DataFrame:
        """``auc`` and ``error``: the exact area is within ``error`` of it.

        Pairs of different bins are decided and those with the same score count half.
        Only pairs within an untied bin are unknown; they count half, and may count 0 or 1.
        """
        won = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
        unknown = F.when(F.col("tied"), 0.0).otherwise(F.col("pos") * F.col("neg") / 2)
        sums = self._curve().agg(F.sum(won).alias("won"), F.sum(unknown).alias("unknown"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        pairs = F.col("p").cast("double") * F.col("n")
        return sums.select(F.try_divide("won", pairs).alias("auc"), F.try_divide("unknown", pairs).alias("error"))


def top_coefficients(coefficients: DataFrame, limit: int) -> DataFrame:
    """Features whose absolute weight reaches the mean absolute weight, the strongest ``limit`` of them.

    ``coefficients`` has one row per feature (feature, weight), so it is small by nature.
    """
    weight = F.abs("weight")
    bar = coefficients.agg(F.avg(weight)).first()[0]
    return (coefficients.where(weight >= F.lit(bar))
            .orderBy(weight.desc(), "feature").limit(limit))
