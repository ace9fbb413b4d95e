"""From statement files to a submission file, with the default cleaning rules."""

import csv
import datetime as dt
import json
import random
import subprocess
import sys
from pathlib import Path

import pytest

from strandline.config import MODE_COLUMNS, ONE_HOT_COLUMNS, SPARSE_COLUMNS, PanelSpec
from strandline.operators import metrics, models
from strandline.plans import artefact, scoring, training
from strandline.plans.features import FeaturePlan
from strandline.sources import statements as io

NUMBERS = ["P_2", "S_3", "B_1", "D_39", "D_41", "R_1", "D_144"]
HEADER = ["customer_ID", "S_2", *NUMBERS, *ONE_HOT_COLUMNS, *MODE_COLUMNS, *SPARSE_COLUMNS]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """300 customers with 1 to 13 monthly statements; P_2 falls for those who default."""
    rng = random.Random(11)
    folder = tmp_path_factory.mktemp("statements")
    (folder / "train").mkdir()
    labels = []
    for part in range(3):
        with open(folder / "train" / f"part-0000{part}.csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(HEADER)
            for i in range(100):
                customer, default = f"{part:02d}{i:062x}", int(rng.random() < 0.3)
                labels.append((customer, default))
                for month in range(rng.randint(1, 13)):
                    day = dt.date(2017, 3, 1) + dt.timedelta(days=30 * month + rng.randrange(4))
                    numbers = [round(rng.gauss(0.8 - 0.4 * default, 0.1), 4), *[
                        "" if rng.random() < 0.1 else round(rng.random(), 4) for _ in NUMBERS[1:-1]],
                        rng.choice(["", 0.0, 1.0])]
                    codes = [rng.choice(["", 0.0, 1.0, 2.0]) for _ in MODE_COLUMNS]
                    sparse = ["" if rng.random() < 0.95 else rng.random() for _ in SPARSE_COLUMNS]
                    out.writerow([customer, day, *numbers, rng.choice(["CO", "CR", "CL"]),
                                  rng.choice(["", "O", "R", "U"]), *codes, *sparse])
    with open(folder / "labels.csv", "w", newline="") as f:
        csv.writer(f).writerows([("customer_ID", "target"), *labels])
    return folder


def test_from_statements_to_submission(spark, files, tmp_path):
    panel = io.read_statements(spark, str(files / "train"))
    assert dict(panel.dtypes)["S_2"] == "date"
    plan = FeaturePlan(PanelSpec())
    features = plan.fit_transform(panel)
    assert features.count() == 300
    kept = [*NUMBERS, *MODE_COLUMNS, "D_63_CL", "D_63_CO", "D_64_1", "D_64_O", "D_64_R"]
    assert set(features.columns) == {
        "customer_ID", *[f"{fn}_{c}_impt" for fn in ("avg", "stddev_samp") for c in kept],
        *[f"mode_{c}" for c in MODE_COLUMNS], "months_tenure", "avg_lag_days", "std_lag_days"}

    labels = io.read_labels(spark, str(files / "labels.csv"))
    data = training.prepare_training(features.join(labels, "customer_ID"), "customer_ID")
    scorer = training.scorer(data, limit=5)
    assert "avg_P_2_impt" in scorer.columns
    valid = training.evaluate(data, scorer.model, scorer.columns, "valid")
    assert metrics.accuracy(valid).first()[0] > 0.85

    plan.save(str(tmp_path / "plan"))
    scorer.save(spark, str(tmp_path / "scorer"))
    later, reloaded = FeaturePlan.load(spark, str(tmp_path / "plan")), models.Scorer.load(spark, str(tmp_path / "scorer"))
    few = io.read_statements(spark, str(files / "train" / "part-00001.csv"))
    written = scoring.write_submission(scoring.score_panel(later, reloaded, few), str(tmp_path / "submission"))
    assert written.columns == ["customer_ID", "prediction"] and written.count() == 100
    assert sorted(written.collect()) == sorted(scoring.score_panel(plan, scorer, few).collect())


@pytest.mark.parametrize("kind", ["forest", "tree", "logistic"])
def test_one_artefact_scores_in_a_new_session(spark, files, tmp_path, kind):
    """Saved here, loaded and applied by another process."""
    panel = io.read_statements(spark, str(files / "train"))
    plan = FeaturePlan(PanelSpec())
    features = plan.fit_transform(panel)
    data = training.prepare_training(features.join(io.read_labels(spark, str(files / "labels.csv")), "customer_ID"), "customer_ID")
    estimator = {"forest": models.random_forest(trees=5, max_depth=4), "logistic": None,
                 "tree": models.decision_tree(min_split=0.1, splitter="random", max_depth=5)}[kind]
    whole = artefact.whole_pipeline(plan, training.scorer(data, estimator=estimator))
    whole.write().save(str(tmp_path / "artefact"))
    want = {r["customer_ID"]: (round(r["probability"], 9), r["predicted"]) for r in artefact.scored(whole, panel).collect()}
    code = """
import json, sys
from pyspark.ml import PipelineModel
from strandline.plans import artefact
from strandline.session import local_session
from strandline.sources import statements as io
spark = local_session(2, memory="2g")
rows = artefact.scored(PipelineModel.load(sys.argv[1]), io.read_statements(spark, sys.argv[2])).collect()
json.dump({r["customer_ID"]: (round(r["probability"], 9), r["predicted"]) for r in rows}, open(sys.argv[3], "w"))
"""
    subprocess.run([sys.executable, "-c", code, str(tmp_path / "artefact"), str(files / "train"), str(tmp_path / "out.json")], check=True,
                   cwd=Path(__file__).resolve().parents[1], capture_output=True)
    found = {k: tuple(v) for k, v in json.loads((tmp_path / "out.json").read_text()).items()}
    assert found == want and len(want) == 300 and len({p for p, _ in want.values()}) > 1
