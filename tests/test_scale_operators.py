"""Operators in bounded memory against exact or plain ones: forest neighbours, score sketches, joint moments."""

import io
from contextlib import redirect_stdout
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.config import PanelSpec
from strandline.operators import approximate, metrics, modes, neighbours, profile, smote
from strandline.session import staging


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def frame(spark, points, ids=None):
    return spark.createDataFrame([(i, p.tolist()) for i, p in zip(ids or range(len(points)), points)],
                                 f"id {'string' if ids else 'long'}, vector array<double>")


def test_forest_is_exact_for_few_points(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(120, 6)), np.zeros((40, 6))])  # a quarter are copies of one point
    for ids in (None, [f"k{i:03}" for i in range(160)]):
        df = frame(spark, points, ids)
        found = approximate.approximate_neighbours(df, "id", "vector", 4).select("key", "rank", "neighbour").collect()
        assert sorted(found) == sorted(neighbours.nearest_neighbours(df, "id", "vector", 4).select("key", "rank", "neighbour").collect())


def test_forest_finds_most_neighbours_of_wide_rows(spark, monkeypatch):
    """In several cells a tree and in leaves of a fraction of the points; what is sent is trees times points."""
    monkeypatch.setattr(approximate, "CELL_ROWS", 600)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(3000, 8)) @ rng.normal(size=(8, 45))  # 45 columns of 8 dimensions
    with staging(spark):
        df = frame(spark, points)
        found = approximate.approximate_neighbours(df, "id", "vector", 5)
        got = approximate.recall(found, neighbours.nearest_neighbours(df, "id", "vector", 5)).first()
        again = approximate.approximate_neighbours(df.repartition(3), "id", "vector", 5)
        assert got["n_rows"] == 3000 and got["recall"] > 0.9
        assert sorted(map(str, found.drop("neighbour_vector").collect())) == sorted(map(str, again.drop("neighbour_vector").collect()))


def test_crowded_cells_are_divided(spark, monkeypatch):
    monkeypatch.setattr(approximate, "MOST_CELL_ROWS", 100)
    rng = np.random.default_rng(3)
    found = approximate.approximate_neighbours(frame(spark, rng.normal(size=(900, 3))), "id", "vector", 3, leaf_rows=50).collect()
    assert len({r["key"] for r in found}) == 900 and all(r["key"] != r["neighbour"] for r in found)


def test_forest_refuses_and_takes_odd_input(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [None, 1.0])], "id long, vector array<double>")
    with pytest.raises(ValueError):
        approximate.approximate_neighbours(df, "id", "vector", 1)
    with pytest.raises(ValueError):
        approximate.approximate_neighbours(df.limit(1), "id", "vector", 5, leaf_rows=6)
    assert approximate.approximate_neighbours(df.limit(0), "id", "vector", 2).count() == 0
    assert approximate.approximate_neighbours(df.limit(1), "id", "vector", 2).count() == 0


def test_forest_writes_no_point_for_each_tree(spark, monkeypatch):
    """Trees share their upper cuts by fours, and the points sent to their cells are not written."""
    monkeypatch.setattr(approximate, "CELL_ROWS", 300)
    sent, build = [], approximate._upper_cuts
    monkeypatch.setattr(approximate, "_upper_cuts", lambda *args: (sent.append(args[-1]), build(*args))[1])
    points = np.random.default_rng(5).normal(size=(1200, 40))
    with staging(spark) as staged:
        found = approximate.approximate_neighbours(frame(spark, points), "id", "vector", 5).select("key", "rank").collect()
        written = sum(f.stat().st_size for p in staged for f in Path(p).glob("*.parquet"))
    assert len(found) == len(set(found)) == 5 * 1200
    assert sent == [0, 1, 2, 3] and written < 4 * points.nbytes


def test_oversampling_with_the_forest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, p), int(i % 5 == 0)) for i, p in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "id long, u double, v double, target int")
    made = smote.oversample(df, "id", ["u", "v"], search=approximate.approximate_neighbours)
    assert made.where("target = 1").count() == made.where("target = 0").count() == 480


scores = st.lists(st.tuples(st.one_of(st.sampled_from([0.0, 0.25, 0.5, float("nan"), float("inf"), -1.0]),
                                      st.floats(0, 1, width=32)), st.integers(0, 1)), max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scores)
def test_sketched_area_is_within_its_error(spark, rows):
    df = spark.createDataFrame(rows, "score double, target int")
    sketch = metrics.ScoreSketch.fit(df, bins=4)
    found, exact = sketch.auc().first(), metrics.auc(df).first()["auc"]
    if exact is None:
        assert found["auc"] is None
    else:
        assert abs(found["auc"] - exact) <= found["error"] + 1e-12
    assert sketch.counts.count() <= 2 * 4 + 2
    points = {(r["tp"], r["fp"]) for r in metrics.roc_points(df).collect()}
    assert {(r["tp"], r["fp"]) for r in sketch.roc_points().collect()} <= points


def test_sketches_add_up_and_shared_scores_are_exact(spark):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(4000) < 0.4, 0.5, rng.random(4000))  # two fifths share one score
    df = spark.createDataFrame([(float(v), int(rng.random() < v)) for v in values], "score double, target int")
    whole = metrics.ScoreSketch.fit(df, bins=128)
    parts = [metrics.ScoreSketch.fit(df.where(c), edges=whole.edges) for c in ("score < 0.5", "score >= 0.5")]
    assert sorted(parts[0].merged(parts[1]).counts.collect()) == sorted(whole.counts.collect())
    assert whole.auc().first()["error"] < 1 / 128
    with pytest.raises(ValueError):
        parts[0].merged(metrics.ScoreSketch.fit(df, bins=4))
    assert "Sort" not in plan_of(whole.counts)


def test_joint_moments_equal_plain_correlations(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5000, 6)) @ rng.normal(size=(6, 6)) * [1, 1e-3, 1e4, 1, 1, 1] + [0, 5, 1e9, -3, 0, 0]
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 4] = 7.0
    x[1:, 5] = np.nan
    names = ["a b", "c.d", "e", "f", "constant", "once"]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x],
                               ", ".join(f"`{n}` double" for n in names)).repartition(7)
    found = {(r["first"], r["second"]): r for r in profile.correlation_matrix(df, names).collect()}
    assert len(found) == 15
    for i, a in enumerate(names):
        for j in range(i + 1, 6):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = found[a, names[j]]
            assert r["n"] == both.sum()
            if r["n"] < 2 or "constant" in (a, names[j]):
                assert r["correlation"] is None
            else:
                assert r["correlation"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert profile.correlation_matrix(df.limit(0), names).count() == 0
    with pytest.raises(ValueError):
        profile.correlation_matrix(df, [])


def test_many_columns_take_one_scan(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(200).select([(F.xxhash64("id", F.lit(i)) % 1000).cast("double").alias(f"x{i}") for i in range(180)]).write.parquet(path)
    found = profile.correlation_matrix(spark.read.parquet(path), [f"x{i}" for i in range(180)])
    assert plan_of(found).count("Scan parquet") == 2  # in the tree and in its details, once each
    assert found.count() == 180 * 179 // 2


def test_values_of_modes_are_counted_without_a_sort(spark):
    """Records order by time, then id, nulls first, at the ends of both ranges too."""
    rows = spark.sql("""select * from values (1, date'2020-01-01', 5L, 'a'), (1, date'2020-01-01', -9223372036854775808L, 'b'),
        (2, null, 3L, 'x'), (2, date'0001-01-01', 1L, 'w'), (3, date'9999-12-31', 9223372036854775807L, 'q'),
        (3, date'9999-12-31', null, 'r'), (4, null, null, 'n'), (4, null, 1L, 'm') as t(e, d, r, v)""")
    for df in (rows, rows.withColumn("d", F.col("d").cast("timestamp"))):
        found = modes.entity_modes(df, PanelSpec("e", "d", "r"), ["v"])
        assert sorted(found.collect()) == [(1, "b"), (2, "x"), (3, "r"), (4, "n")]
        counting = plan_of(found).split("Expand")[0].rsplit("Exchange", 1)[1]  # between the rows and the first shuffle
        assert "HashAggregate" in counting and "SortAggregate" not in counting
    # Ids of other types keep the order that they have.
    named = rows.withColumn("r", F.concat(F.lit("k"), F.col("r")))
    assert dict(modes.entity_modes(named, PanelSpec("e", "d", "r"), ["v"]).collect())[3] == "r"
