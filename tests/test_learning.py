"""Scaling, splitting, neighbours, oversampling, metrics, models and search."""

import random
import threading
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.config import SEARCH_TRIALS
from strandline.operators import metrics, models, neighbours, prepare, ranking, search, smote, tpe
from strandline.plans import catalogue, training
from strandline.session import in_parallel, new_path, staging

COLUMNS = ["u", "v"]


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 2))
    target = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.4, size=1200) > 0.9).astype(int)
    rows = [(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, target))]
    return spark.createDataFrame(rows, "id long, u double, v double, target int")


@pytest.fixture(scope="module")
def data(features):
    return training.prepare_training(features, "id")


def test_split_is_complete_and_stable(features):
    split = {r["id"]: r.split for r in prepare.with_split(features, "id").collect()}
    again = {r["id"]: r.split for r in prepare.with_split(features.repartition(7), "id").collect()}
    assert split == again and set(split.values()) == {"train", "valid", "test"} and len(split) == 1200
    assert 0.76 < sum(s == "train" for s in split.values()) / 1200 < 0.84


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, k double")
    scaler = prepare.MinMax.fit(df, ["a", "k"])
    assert [tuple(r) for r in scaler.transform(df).collect()] == [(0.0, 0.0), (1.0, 0.0), (None, 0.0)]
    assert prepare.MinMax.from_json(scaler.to_json()) == scaler


def brute_force(points, k):
    out = {}
    for i, a in points:
        found = sorted((sum((x - y) ** 2 for x, y in zip(a, b)), j) for j, b in points if j != i)
        out[i] = [j for _, j in found[:k]]
    return out


@pytest.mark.parametrize("shape", ["spread", "copies", "grid"])
def test_neighbours_match_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(neighbours, "VISITOR_ROWS", 16)
    monkeypatch.setattr(neighbours, "POINT_ROWS", 32)
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 20)
    rng = np.random.default_rng(1)
    if shape == "spread":
        vectors = rng.normal(size=(240, 3)).tolist()
    elif shape == "copies":  # a third of all rows is one point
        vectors = [[0.5, 0.5, 0.5]] * 80 + rng.normal(size=(160, 3)).round(1).tolist()
    else:  # many equal distances
        vectors = rng.integers(0, 4, size=(240, 3)).astype(float).tolist()
    # Customers are known by texts, orders by numbers.
    points = [(f"{i * 37 % 1009:x}" if shape == "grid" else i * 3, v) for i, v in enumerate(vectors)]
    kind = "string" if shape == "grid" else "long"
    found = {}
    for r in neighbours.nearest_neighbours(
            spark.createDataFrame(points, f"id {kind}, vector array<double>"), "id", "vector", 4).collect():
        found.setdefault(r.key, []).append((r["rank"], r.neighbour))
    assert {i: [n for _, n in sorted(v)] for i, v in found.items()} == brute_force(points, 4)


def test_neighbours_in_many_columns(spark):
    """Nothing can be ruled out here, and what is written stays linear in the points."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(2_500, 45))
    with staging(spark) as staged:
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")
        found = neighbours.nearest_neighbours(df, "id", "vector", 5).select("key", "rank", "neighbour").collect()
        written = sum(f.stat().st_size for p in staged for f in Path(p).glob("*.parquet"))
    far = ((points[:, None, :] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    assert sorted(map(tuple, found)) == [
        (i, n + 1, j) for i, row in enumerate(np.argsort(far, axis=1)[:, :5].tolist()) for n, j in enumerate(row)]
    assert written < (5 + 12) * points.nbytes  # the five neighbours of each point, and a few copies of the points


def test_coordinates_are_joined_to_drawn_neighbours_only(spark):
    """What the search writes does not grow with the neighbours of a row, nor with the copies of a point."""
    rng = np.random.default_rng(11)
    points = np.repeat(rng.normal(size=(300, 40)), 6, axis=0)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")
    asked = spark.createDataFrame([(i, 1 + i % 5, i // 7) for i in range(0, 1800, 7)], "key long, rank int, copy int")
    with staging(spark) as staged:
        found = neighbours.nearest_neighbours(df, "id", "vector", 5, pairs=asked)
        got = {r["key"]: r for r in found.collect()}
        places = [p for p in staged if "neighbour-found" in p]
        written = sum(f.stat().st_size for p in places for f in Path(p).glob("*.parquet"))
        every = {(r["key"], r["rank"]): r for r in neighbours.nearest_neighbours(df, "id", "vector", 5).collect()}
    assert len(got) == asked.count() and len(every) == 5 * 1800
    for key, r in got.items():
        assert r["copy"] == key // 7 and r["vector"] == points[key].tolist()
        assert r["neighbour"] == every[key, r["rank"]]["neighbour"]
        assert r["neighbour_vector"] == every[key, r["rank"]]["neighbour_vector"] == points[r["neighbour"]].tolist()
    assert written < 2 * 300 * 40 * 8  # one vector a point, not one for each candidate besides


def test_rough_distances_are_ranked_once(monkeypatch):
    """Far from the origin, with copies and ties, the nearest rows are exact; only a first chunk is partitioned in full."""
    rng = np.random.default_rng(12)
    sizes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **named: (sizes.append(a.size), partition(a, *rest, **named))[1])
    for points in (rng.normal(size=(20_000, 20)), rng.normal(size=(9_000, 2)).round(1), 1e6 + rng.normal(size=(9_000, 3)) / 1e3):
        ids, own = np.arange(len(points)) * 2, rng.choice(len(points), 40, replace=False)
        sizes.clear()
        found = neighbours.nearest_rows(ids[own], points[own], np.full(40, np.inf), ids, points, 5)
        far = ((points[own, None, :] - points[None]) ** 2).sum(axis=2)
        far[np.arange(40), own] = np.inf
        exact = np.sort(far, axis=1)[:, :5]
        assert np.allclose(found["distance2"].to_numpy().reshape(40, 5), exact, rtol=1e-9, atol=0)
        assert found["rep"].tolist() == np.repeat(ids[own], 5).tolist()
    assert sum(sizes) < 2 * 40 * 9_000


def test_points_are_sent_to_blocks_of_cells(spark, monkeypatch):
    """In many columns each point matters to each cell; it is sent once to a block of cells, not to each of them."""
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 20)
    rows = []

    def counted(visitors, sizes, points, lows, used, group_of, *rest):
        rows.append((len(used), int(group_of.max()) + 1))
        return search(visitors, sizes, points, lows, used, group_of, *rest)

    search = neighbours._search
    monkeypatch.setattr(neighbours, "_search", counted)
    points = np.random.default_rng(8).normal(size=(600, 30))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")
    found = neighbours.nearest_neighbours(df, "id", "vector", 5).select("key", "rank", "neighbour").collect()
    far = ((points[:, None, :] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(far, np.inf)
    assert sorted(map(tuple, found)) == [
        (i, n + 1, j) for i, row in enumerate(np.argsort(far, axis=1)[:, :5].tolist()) for n, j in enumerate(row)]
    assert rows[0][0] == rows[0][1] > 20 and rows[1][1] == 1


def test_blocks_are_full_and_as_many_at_six_times_the_rows(spark, monkeypatch):
    """Points are sent to each block of the other side: few blocks, and no more of them before memory asks for it."""
    monkeypatch.setattr(neighbours, "BLOCKS_PER_CORE", 36 / spark.sparkContext.defaultParallelism)
    rng = np.random.default_rng(13)
    pivots, shares, sent = rng.normal(size=(1_000, 47)), rng.uniform(0.2, 1.8, size=1_000), []
    for points in (235_000, 1_410_000):
        sizes = (shares * points / 1_000).astype(int)
        visitors, asked = neighbours._block_rows(spark, int(sizes.sum()), 47)
        group = neighbours._near_cells(pivots, sizes, visitors)
        held = np.bincount(group, sizes)
        assert held.max() * 47 * 8 <= neighbours.BLOCK_BYTES * 1.1
        blocks = sum(neighbours._parts(int(n), visitors) for n in held)
        sent.append(blocks + neighbours._parts(int(sizes.sum()), asked))
    assert sent == [12, 12]


def test_crowded_cells_take_blocks_of_their_own():
    sizes = np.array([10] * 50 + [5_000] + [10] * 49)
    group = neighbours._near_cells(np.arange(100.0)[:, None], sizes, 100)
    held = np.bincount(group, sizes)
    assert sorted(set(group)) == list(range(len(held))) and held.sum() == sizes.sum()
    assert sorted(held)[-2] <= 120 and 10 <= len(held) <= 15


def test_reach_of_a_point_is_written_without_its_coordinates(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "POINTS_PER_CELL", 100)
    points = np.random.default_rng(14).normal(size=(1_200, 40))
    with staging(spark) as staged:
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")
        assert neighbours.nearest_neighbours(df, "id", "vector", 5).count() == 5 * 1_200
        found = [spark.read.parquet(p).columns for p in staged if "neighbour-reach" in p]
    assert found == [["rep", "reach"]]


def test_unusable_coordinates_are_refused(spark):
    for bad in ([None, 1.0], [float("nan"), 1.0], None):
        df = spark.createDataFrame([(1, [0.0, 0.0]), (2, bad)], "id long, vector array<double>")
        with pytest.raises(ValueError):
            neighbours.nearest_neighbours(df, "id", "vector", 1)
    assert neighbours.nearest_neighbours(df.limit(0), "id", "vector", 1).count() == 0


def test_neighbours_in_one_cell(spark):
    rng = np.random.default_rng(4)
    points = [(i, v) for i, v in enumerate(rng.normal(size=(90, 2)).tolist())]
    found = neighbours.nearest_neighbours(
        spark.createDataFrame(points, "id long, vector array<double>"), "id", "vector", 3)
    assert {(r.key, r["rank"], r.neighbour) for r in found.collect()} == {
        (i, n + 1, j) for i, near in brute_force(points, 3).items() for n, j in enumerate(near)}


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, vector array<double>")
    assert {(r.key, r.neighbour) for r in neighbours.nearest_neighbours(df, "id", "vector", 5).collect()} == {(1, 2), (2, 1)}


def test_oversampling_balances_and_interpolates(features):
    rows = [r.asDict() for r in smote.oversample(features, "id", COLUMNS, seed=1).collect()]
    again = smote.oversample(features.repartition(5), "id", COLUMNS, seed=1)
    assert sum(r["target"] for r in rows) * 2 == len(rows)
    assert len([r for r in rows if r["copy"] == 0]) == 1200
    assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in again.collect())
    rare = {r["id"]: np.array([r["u"], r["v"]]) for r in rows if r["copy"] == 0 and r["target"] == 1}
    for r in [r for r in rows if r["copy"]][:60]:
        base, point = rare[r["id"]], np.array([r["u"], r["v"]])
        near = sorted((o for i, o in rare.items() if i != r["id"]), key=lambda o: ((o - base) ** 2).sum())[:5]
        on_segment = [np.linalg.norm(point - base) + np.linalg.norm(o - point) - np.linalg.norm(o - base) for o in near]
        assert min(on_segment) < 1e-9


def test_running_totals_and_quantiles(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.full(300, 7.0), rng.normal(size=600).round(2)])
    df = spark.createDataFrame([(float(v), 1) for v in values], "x double, n int").repartition(5)
    found = {r.x: r.cum_n for r in ranking.running_totals(df, "x", ["n"], descending=True).collect()}
    assert found == {v: int((values >= v).sum()) for v in set(values)}
    row = ranking.exact_quantiles(df, ["x"], {"q25": 0.25, "q50": 0.5, "q90": 0.9}).first()
    assert row[1:] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.9]))


def test_running_totals_keep_the_type_and_take_anything(spark):
    big = 2**53
    df = spark.createDataFrame([(big, 1), (big + 1, 1), (None, 1)], "x long, n int")
    assert [tuple(r) for r in ranking.running_totals(df, "x", ["n"]).orderBy("x").collect()] == [
        (big, 1, 1, 2), (big + 1, 1, 2, 2)]
    nan = spark.createDataFrame([(float("nan"), 1), (1.0, 2)], "x double, n int")
    assert [r.cum_n for r in ranking.running_totals(nan, "x", ["n"], descending=True).collect()] in ([1, 3], [3, 1])
    assert ranking.running_totals(nan.limit(0), "x", ["n"]).count() == 0
    assert metrics.auc(spark.createDataFrame([], "score double, target int")).first()[0] is None
    grouped = spark.createDataFrame([(g, v, 1) for g in ("a", None) for v in range(50)], "g string, x int, n int")
    assert {(r.g, r.x): r.cum_n for r in ranking.running_totals(grouped, "x", ["n"], "g").collect()} == {
        (g, v): v + 1 for g in ("a", None) for v in range(50)}


def test_roc_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.3, 0), (0.1, 1)], "score double, target int")
    points = {r.threshold: (r.tp, r.fp) for r in metrics.roc_points(df).collect()}
    assert points == {0.9: (1, 0), 0.8: (2, 1), 0.3: (2, 3), 0.1: (3, 3)}
    won = sum((p > n) + (p == n) / 2 for p in (0.9, 0.8, 0.1) for n in (0.8, 0.3, 0.3))
    assert metrics.auc(df).first()[0] == pytest.approx(won / 9)


def test_report_without_predictions_of_a_class(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (0, 0)], "target int, predicted int")
    rows = {r.label: r for r in metrics.classification_report(df).collect()}
    assert (rows["1"].precision, rows["1"].recall, rows["1"].f1) == (0.0, 0.0, 0.0)
    assert rows["accuracy"].f1 == pytest.approx(2 / 3) and rows["macro avg"].recall == 0.5


def test_top_coefficients(spark):
    df = spark.createDataFrame([("a", -4.0), ("b", 1.0), ("c", 3.0), ("d", 3.5)], "feature string, weight double")
    assert [r.feature for r in metrics.top_coefficients(df, 2).collect()] == ["a", "d"]
    assert [r.feature for r in metrics.top_coefficients(df, 9).collect()] == ["a", "d", "c"]


def test_model_learns_and_reloads(spark, data, features, tmp_path):
    chosen = training.scorer(data, limit=1)
    assert chosen.columns == ["u"]
    full = training.scorer(data)
    scored = training.evaluate(data, full.model, full.columns)
    assert metrics.auc(scored, "probability").first()[0] > 0.9
    full.save(spark, str(tmp_path / "scorer"))
    before = full.score(features, ["id"]).orderBy("id").collect()
    assert before == models.Scorer.load(spark, str(tmp_path / "scorer")).score(features, ["id"]).orderBy("id").collect()
    rounded = models.submission(full.score(features, ["id"]), "id").collect()
    assert all(0 <= r.prediction <= 1 and round(r.prediction * 100) == pytest.approx(r.prediction * 100) for r in rounded)


def test_independent_labels_cannot_be_learned(features):
    noise = features.withColumn("target", (F.abs(F.hash("id")) % 2).cast("int"))
    data = training.prepare_training(noise, "id")
    scored = training.evaluate(data, training.fit(data), data.columns, "train")
    assert abs(metrics.auc(scored, "probability").first()[0] - 0.5) < 0.08


def test_penalty_follows_the_total_loss():
    """With C the loss of all rows is weighed: doubling the rows halves the weight of the penalty per row."""
    assert models.logistic_regression(100, c=2.0).getRegParam() == pytest.approx(1 / 200)
    assert models.logistic_regression(100, penalised=False).getRegParam() == 0.0


def test_tree_limits():
    assert models.decision_tree(min_leaf=0.6).getMaxDepth() == 0
    bounded = models.decision_tree(min_split=0.2, min_leaf=0.05)
    assert bounded.min_split == 0.2 and bounded.forest.getMinWeightFractionPerNode() == pytest.approx(0.05)
    assert models.random_forest(max_features="auto").getFeatureSubsetStrategy() == "sqrt"


def hand_tree(rows, least, columns=(0,), total=None):
    """A tree by Gini grown on whole numbers, its thresholds half-way, as nested tuples; nodes below ``least`` are leaves."""
    n, ones = len(rows), sum(y for _, y in rows)
    leaf = (n, ones)
    if n < max(2, least) or ones in (0, n):
        return leaf

    def gini(part):
        p = sum(y for _, y in part) / len(part)
        return len(part) * 2 * p * (1 - p)

    best = None
    for c in columns:
        for t in sorted({x[c] for x, _ in rows})[:-1]:
            left, right = [r for r in rows if r[0][c] <= t], [r for r in rows if r[0][c] > t]
            loss = gini(left) + gini(right)
            if best is None or loss < best[0] - 1e-12:
                best = loss, c, left, right
    if best is None or best[0] >= gini(rows) - 1e-12:
        return leaf
    return (n, ones, best[1], hand_tree(best[2], least, columns), hand_tree(best[3], least, columns))


def grown_tree(spark, model):
    path = new_path(spark, "tree")
    model.write().save(path)
    nodes = {r["nodeData"]["id"]: r["nodeData"] for r in spark.read.parquet(f"{path}/data").collect()}

    def at(i):
        d = nodes[i]
        own = (d["rawCount"], int(d["impurityStats"][1]))
        return own if d["leftChild"] < 0 else (*own, d["split"]["featureIndex"], at(d["leftChild"]), at(d["rightChild"]))

    assert sorted(nodes) == list(range(len(nodes)))
    return at(0)


@pytest.mark.parametrize("share", [0.05, 0.2, 0.45, 0.9])
def test_splits_are_bounded_by_the_node_and_not_by_its_leaves(spark, share):
    """Uneven splits of large nodes stay, as in a tree written by hand."""
    rows = [((x,), int(x in (1, 2, 3, 17) or 30 <= x < 34 or x == 60)) for x in range(64)]
    df = prepare.assemble(spark.createDataFrame([(float(x[0]), y) for x, y in rows], "x double, target int"), ["x"], ["target"])
    forest = models.decision_tree(min_split=share)
    forest.forest.setMaxBins(64)
    want = hand_tree(rows, -(-share * 64 // 1))
    assert grown_tree(spark, forest.fit(df)) == want
    if share == 0.2:
        assert min(want[3][0], want[4][0]) < 0.1 * 64  # half the bound on each leaf would have refused it


def test_random_splitter_takes_other_thresholds(spark, data):
    vectors = prepare.assemble(data.resampled, COLUMNS, ["target"])
    fits = [models.decision_tree(max_depth=3, splitter=s, seed=seed).fit(vectors) for s, seed in (("best", 0), ("random", 0), ("random", 1))]
    right = [m.transform(vectors).agg(F.avg((F.col("predicted") == F.col("target")).cast("int"))).first()[0] for m in fits]
    assert all(r > 0.75 for r in right) and len(set(right)) == 3
    again = models.decision_tree(max_depth=3, splitter="random", seed=1).fit(vectors)
    assert again.transform(vectors).where("predicted = target").count() == fits[2].transform(vectors).where("predicted = target").count()


def test_search_is_repeatable_and_ranked(spark, data):
    assert search.draw_trials(9, seed=4) == search.draw_trials(9, seed=4)
    assert {t["family"] for t in search.draw_trials()} == set(search.FAMILIES)
    folds = training.tuning_folds(data, folds=2)
    found = search.search(spark, folds, search.draw_trials(2, seed=1)).collect()
    accuracy = [r.value for r in found if r.metric == "accuracy"]
    assert accuracy == sorted(accuracy, reverse=True) and len(found) == 2 * len(search.METRICS)
    assert all(0 <= r.value <= 1 for r in found)


PLANTED = {"kind": tpe.Choice((
    {"kind": "a", "x": tpe.Uniform(0, 1), "y": tpe.Uniform(0, 1, 0.001)},
    {"kind": "b", "c": tpe.LogNormal(0, 1), "p": tpe.Choice(("l1", "l2"))},
    {"kind": "c", "z": tpe.Uniform(0, 1)}))}


def planted(trial):
    """At most 0.9, where ``c`` is the square root of e under ``l2``."""
    if trial["kind"] == "a":
        return 0.7 - abs(trial["x"] - 0.2) - abs(trial["y"] - 0.9)
    if trial["kind"] == "b":
        return 0.9 - abs(np.log(trial["c"]) - 0.5) / 2 - (0.2 if trial["p"] == "l1" else 0)
    return 0.4 * trial["z"]


def test_sequential_search_beats_random_draws():
    def best(seed, **options):
        sampler, waiting, values = tpe.Sampler(PLANTED, seed, **options), [], []
        for _ in range(SEARCH_TRIALS):
            trial, places = sampler.propose()
            waiting.append((places, planted(trial)))
            values.append(planted(trial))
            if len(waiting) == 4:
                sampler.tell(*waiting.pop(0))
        return max(values)

    sequential = [best(seed) for seed in range(20)]
    drawn = [best(seed, random_first=SEARCH_TRIALS) for seed in range(20)]
    assert np.mean(sequential) > np.mean(drawn) + 0.03
    assert sum(a >= b for a, b in zip(sequential, drawn)) >= 17


def test_sequential_search_repeats_whatever_the_fits_take(spark):
    def evaluate(wait):
        def run(trial):
            time.sleep(wait.random() * 0.02)
            return {name: planted(trial) for name in search.METRICS}
        return run

    runs = [search.sequential_search(spark, [], 40, 3, space={"family": tpe.Choice(tuple(
        {"family": o["kind"], **o} for o in PLANTED["kind"].options))}, evaluate=evaluate(random.Random(wait))).collect() for wait in (1, 2)]
    assert runs[0] == runs[1] and len({r.trial for r in runs[0]}) == 40


def test_parallel_calls_do_not_share_local_properties(spark):
    """Else a call may find the SQL execution that it just began ended by another, and its fit fails."""
    together = threading.Barrier(4)

    def own(i):
        together.wait(60)
        spark.sparkContext.setLocalProperty("strandline.own", str(i))
        together.wait(60)
        return spark.sparkContext.getLocalProperty("strandline.own") == str(i)

    assert all(in_parallel(spark, own, range(4), 4))
    seen = search.sequential_search(spark, [], 4, parallelism=4, evaluate=lambda trial: {
        name: float(own(id(trial))) for name in search.METRICS}).collect()
    assert {r["value"] for r in seen} == {1.0}


def test_proposals_keep_to_the_space():
    sampler = tpe.Sampler(search.SPACE, 5)
    for i in range(150):
        trial, places = sampler.propose()
        assert trial["family"] in search.FAMILIES
        if trial["family"] in search.PENALTIES:
            assert trial["penalty"] in search.PENALTIES[trial["family"]] and trial["C"] > 0
            assert 100 <= trial["max_iter"] <= 3000 and trial["max_iter"] % 100 == 0
            assert ("l1_ratio" in trial) == (trial["family"] in ("logregnone", "logregSGN"))
        else:
            assert trial["max_features"] in ("auto", "sqrt", "log2") or 0 <= trial["max_features"] <= 1
            assert ("splitter" in trial) == (trial["family"] == "dtree")
        search.build(trial, 100)
        sampler.tell(places, float("nan") if i % 10 == 0 else random.Random(i).random())


def test_folds_share_one_table(data):
    folds = training.tuning_folds(data, percent=80, folds=3)
    assert len({name for f in folds for part in (f.train, f.held_out) for name in part.inputFiles()}) == len(folds[0].train.inputFiles())
    for fold in folds:
        ones, n = fold.train.agg(F.sum("target"), F.count(F.lit(1))).first()
        assert 2 * ones == n


def test_recording_a_run_twice_leaves_it_once(spark, tmp_path):
    def results(value):
        return spark.createDataFrame([(i, value) for i in range(3)], "trial int, value double")

    path = str(tmp_path / "runs")
    for run, value in (("a", 0.1), ("2024", 0.2), ("a", 0.3)):
        record = search.record_run(results(value), run, path)
    assert sorted(map(tuple, record.collect())) == [(i, v, r) for i in range(3) for v, r in ((0.2, "2024"), (0.3, "a"))]


def test_no_synthetic_row_has_a_parent_among_the_held_out(data):
    """Resampled inside the fold, held-out rows are original and every training row lies among training rows."""
    original = {tuple(r.features) for r in prepare.assemble(data.part("train"), COLUMNS, []).collect()}
    for fold in training.tuning_folds(data, percent=60, folds=2):
        held_out = {tuple(r.features) for r in fold.held_out.collect()}
        train = [tuple(r.features) for r in fold.train.where("target = 1").collect()]
        assert held_out <= original and not held_out & set(train)
        parents = np.array([t for t in train if t in original])
        for t in [t for t in train if t not in original][:40]:
            away = np.linalg.norm(parents - t, axis=1)
            between = np.linalg.norm(parents[:, None] - parents[None], axis=2)
            detour = away[:, None] + away[None] - between
            np.fill_diagonal(detour, np.inf)
            assert detour.min() < 1e-9
    before = training.tuning_folds(data, folds=2, resample="before")
    assert sum(f.held_out.count() for f in before) == prepare.tuning_sample(data.resampled, ["id", "copy"]).count()


def test_rows_to_fit_on_can_be_bounded(features):
    few = training.prepare_training(features, "id", fit_rows=400)
    kept = few.resampled.where("copy = 0").count()
    assert 300 < kept < 500 and few.rows.count() == 1200


def test_run_log_records_the_full_search(spark, monkeypatch):
    def search_stub(spark, folds, n=SEARCH_TRIALS, **settings):
        rows = [(i + 1, i, "rf", {}, "accuracy", 0.5) for i in range(n)]
        return spark.createDataFrame(rows, "rank int, trial int, family string, params map<string,string>, metric string, value double")

    monkeypatch.setattr(catalogue, "once_per_session", lambda spark, name, inputs, make: make())
    monkeypatch.setattr(catalogue, "_training", lambda spark, sf: None)
    monkeypatch.setattr(catalogue.search, "sequential_search", search_stub)
    monkeypatch.setattr(catalogue.training, "tuning_folds", lambda data: [])
    rows = catalogue.run_log(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["trial"] for r in rows) == list(range(SEARCH_TRIALS)) and {r["run"] for r in rows} == {"run-0"}
