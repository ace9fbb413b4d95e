"""Scoring a new panel with what was learned on the training panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandline.operators.models import Scorer, submission
from strandline.plans.features import FeaturePlan
from strandline.sources.statements import read_csv, write_parts, write_single


def score_panel(plan: FeaturePlan, scorer: Scorer, panel: DataFrame, refit: bool = False) -> DataFrame:
    """Entity and rounded probability for every entity of a panel."""
    key = plan.spec.entity
    return submission(scorer.score(plan.transform(panel), [key], refit), key)


def write_submission(result: DataFrame, path: str, single: bool = False) -> DataFrame:
    """Write the scores as CSV, in parts or as one file, and return what was written."""
    (write_single if single else write_parts)(result, path)
    return read_csv(result.sparkSession, path, result.schema)
