"""From raw statements to one feature row per entity."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml.feature import ImputerModel
from pyspark.sql import DataFrame, SparkSession

from strandline.config import CleaningRules, PanelSpec
from strandline.functions.columns import feature_names
from strandline.operators.aggregate import entity_statistics
from strandline.operators.clean import Cleaning, OneHot, fit_imputer
from strandline.operators.dates import date_features
from strandline.operators.joins import attach_labels, inner_join_all
from strandline.operators.modes import entity_modes
from strandline.session import staged
from strandline.sources.statements import read_names, write_names


class FeaturePlan:
    """Cleaning levels and imputation means learned on a training panel, applied to any panel."""

    def __init__(self, spec: PanelSpec, rules: CleaningRules = CleaningRules()):
        self.spec, self.rules = spec, rules
        self.cleaning: Cleaning | None = None
        self.imputer = None
        self.names: dict[str, str] = {}

    def fit_transform(self, panel: DataFrame) -> DataFrame:
        """Learn and return the features of the same panel.

        The aggregated table is written once: the means and the features both read
        it, and the wide panel is scanned and shuffled a single time.
        """
        self.cleaning = Cleaning.fit(panel, self.rules)
        statistics = staged(self._statistics(panel), "entity-statistics")
        self.names = feature_names([c for c in statistics.columns if c != self.spec.entity])
        self.imputer = fit_imputer(statistics, list(self.names), "mean", list(self.names.values()))
        return self._features(panel, statistics)

    def transform(self, panel: DataFrame) -> DataFrame:
        return self._features(panel, self._statistics(panel))

    def save(self, path: str) -> None:
        """Keep the fill values and levels, so that later panels are treated like the training panel."""
        spark = self.imputer.surrogateDF.sparkSession
        self.imputer.write().overwrite().save(f"{path}/imputer")
        write_names(spark, [json.dumps(self._settings())], f"{path}/learned")

    def learned(self) -> str:
        """All that decides what the plan makes of a panel; plans that are equal in it give the same features."""
        return json.dumps([self._settings(), self.imputer.surrogateDF.first().asDict()], sort_keys=True)

    def _settings(self) -> dict:
        return {"spec": asdict(self.spec), "rules": asdict(self.rules), "levels": self.cleaning.one_hot.levels, "names": self.names}

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeaturePlan":
        learned = json.loads(read_names(spark, f"{path}/learned")[0])
        rules = CleaningRules(**{k: tuple(v) if isinstance(v, list) else v for k, v in learned["rules"].items()})
        plan = FeaturePlan(PanelSpec(**learned["spec"]), rules)
        plan.cleaning, plan.names = Cleaning(rules, OneHot(learned["levels"])), learned["names"]
        plan.imputer = ImputerModel.load(f"{path}/imputer")
        return plan

    def _statistics(self, panel: DataFrame) -> DataFrame:
        return entity_statistics(self.cleaning.transform(panel), self.spec, self.rules.drop_aggregated)

    def _features(self, panel: DataFrame, statistics: DataFrame) -> DataFrame:
        parts = [self.imputer.transform(statistics).drop(*self.names)]
        modes = [c for c in self.rules.modes if c in panel.columns]
        if modes:
            parts.append(entity_modes(self.cleaning.transform(panel), self.spec, modes, gather=True))
        return inner_join_all([*parts, date_features(panel, self.spec)], self.spec.entity)


def feature_table(panel: DataFrame, spec: PanelSpec, rules: CleaningRules = CleaningRules(),
                  labels: DataFrame | None = None) -> DataFrame:
    """Means, deviations, modes and date features per entity, with the labels if given."""
    features = FeaturePlan(spec, rules).fit_transform(panel)
    return attach_labels(features, labels, spec.entity) if labels is not None else features
