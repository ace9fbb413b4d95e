"""Cleaning, dates, modes and joins on small hand-made panels."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.config import CleaningRules, PanelSpec
from strandline.functions import columns
from strandline.functions.columns import feature_names
from strandline.operators import aggregate, clean, dates, joins, modes, profile, ranking
from strandline.plans.features import FeaturePlan, feature_table

SPEC = PanelSpec("id", "day", "row")


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([
        ("a", day("2017-03-01"), 1, "CR", None, None, 2.0, 1.0),
        ("a", day("2017-04-02"), 2, "CO", "O", 3.0, None, 2.0),
        ("a", day("2017-06-30"), 3, None, "R", None, 1.0, 4.0),
        ("b", day("2017-05-05"), 4, "CR", "O", 1.0, 1.0, None),
        ("c", day("2018-02-28"), 5, "CL", None, 1.0, 1.0, 5.0),
        ("c", day("2018-03-31"), 6, "CL", "U", 1.0, 1.0, 6.0),
    ], "id string, day date, row long, D_63 string, D_64 string, D_117 double, B_38 double, x double")


RULES = CleaningRules(drop=("absent",), fill={"D_64": "-1", "D_117": -1, "B_38": 2}, modes=("B_38",),
                      drop_aggregated=())


def test_fills_and_one_hot(tiny):
    cleaned = clean.Cleaning.fit(tiny, RULES).transform(tiny)
    assert [c for c in cleaned.columns if c.startswith("D_6")] == [
        "D_63_CL", "D_63_CO", "D_64_-1", "D_64_O", "D_64_R"]
    rows = {r["row"]: r.asDict() for r in cleaned.collect()}
    assert rows[1]["D_64_-1"] == 1 and rows[1]["D_117"] == -1 and rows[2]["B_38"] == 2
    assert rows[3]["D_63_CL"] == 0 and rows[3]["D_63_CO"] == 0  # a null category is no level
    assert rows[6]["D_64_O"] == rows[6]["D_64_R"] == rows[6]["D_64_-1"] == 0  # the last level has no column


def test_levels_stay_as_fitted(spark, tiny):
    fitted = clean.Cleaning.fit(tiny, RULES)
    unseen = tiny.where("id = 'b'").withColumn("D_63", F.lit("new"))
    assert fitted.transform(unseen).columns == fitted.transform(tiny).columns


def test_wrong_fill_is_refused(tiny):
    with pytest.raises(ValueError):
        clean.fill_constants(tiny, {"D_64": -1})
    with pytest.raises(ValueError):
        clean.fill_constants(tiny, {"nothing": 1})


def test_too_many_levels_are_refused(spark):
    with pytest.raises(ValueError):
        clean.OneHot.fit(spark.range(20).select(F.col("id").cast("string").alias("c")), ["c"], max_levels=10)


def test_all_null_column_cannot_be_imputed(spark):
    with pytest.raises(Exception, match="surrogate"):
        clean.fit_imputer(spark.createDataFrame([(None,), (None,)], "z double"), ["z"])


def test_impute_mean_and_mode(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (4.0,), (None,)], "v double")
    filled = {s: [r.v for r in clean.fit_imputer(df, ["v"], s).transform(df).collect()][-1] for s in ("mean", "mode")}
    assert filled == {"mean": 2.0, "mode": 1.0}


def test_feature_names_refuse_clashes():
    assert feature_names(["avg(D_39)", "avg(D_64_-1)"]) == {
        "avg(D_39)": "avg_D_39_impt", "avg(D_64_-1)": "avg_D_64_1_impt"}
    with pytest.raises(ValueError):
        feature_names(["avg(D_64_-1)", "avg(D_64_1)"])


def test_tenure_and_gaps(tiny):
    rows = {r["id"]: r for r in dates.date_features(tiny, SPEC).collect()}
    assert rows["a"].months_tenure == pytest.approx(3.93548387)
    assert rows["c"].months_tenure == 1.0  # both month ends
    assert (rows["a"].avg_lag_days, rows["b"].avg_lag_days) == (60.5, 0.0)
    assert rows["a"].std_lag_days == pytest.approx(40.3050865)
    assert rows["b"].std_lag_days == rows["c"].std_lag_days == 0.0


def test_gaps_match_row_by_row(spark):
    rng = random.Random(5)
    rows = [(e, day("2020-01-01") + dt.timedelta(days=rng.randrange(40)), i)
            for i, e in enumerate(rng.choices("abcd", [60, 20, 5, 1], k=300))]
    df = spark.createDataFrame(rows, "id string, day date, row long")
    found = {r.row: r.lag_days for r in dates.with_previous_date(df, SPEC).collect()}
    gaps, expected = {}, {}
    for e in "abcd":
        before = None
        for _, d, i in sorted(r for r in rows if r[0] == e):
            expected[i] = None if before is None else (d - before).days
            gaps.setdefault(e, []).append(expected[i])
            before = d
    assert found == expected
    for r in dates.date_summary(df, SPEC).collect():
        values = [g for g in gaps[r["id"]] if g is not None]
        mean = sum(values) / len(values)
        assert r.avg_lag_days == pytest.approx(mean)
        assert r.std_lag_days == pytest.approx((sum((g - mean) ** 2 for g in values) / (len(values) - 1)) ** 0.5)


def test_crowded_groups_are_spread(spark):
    """A group above the limit is split over salts, and no row is lost or doubled."""
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id") % 50)).alias("id"), F.col("id").alias("row"))
    facts = rows.groupBy("id").agg(F.count("*").alias("n"), F.max("row").alias("last"))
    joined = joins.attach_group_facts(rows, facts, ["id"], ["row"], "n", rows_per_split=100)
    expected = rows.join(facts, "id").select("id", "row", "n", "last")
    assert joined.count() == 1000
    assert joined.select("id", "row", "n", "last").exceptAll(expected).count() == 0


def test_rows_with_null_entity_are_kept(spark):
    df = spark.createDataFrame([(None, day("2020-01-01"), 1), (None, day("2020-01-05"), 2), ("a", day("2020-01-01"), 3)],
                               "id string, day date, row long")
    assert {r.row: r.lag_days for r in dates.with_previous_date(df, SPEC).collect()} == {1: None, 2: 4, 3: None}


def test_lags_follow_the_time_of_day(spark):
    at = lambda d, h: dt.datetime(2020, 1, d, h)
    df = spark.createDataFrame([("a", at(1, 9), 5), ("a", at(3, 8), 9), ("a", at(3, 20), 2), (None, at(2, 1), 1)],
                               "id string, day timestamp_ntz, row long")
    found = {r.row: (r.lag_date, r.lag_days) for r in dates.with_previous_date(df, SPEC).collect()}
    assert found == {5: (None, None), 9: (at(1, 9), 2), 2: (at(3, 8), 0), 1: (None, None)}


@pytest.mark.parametrize("row", ["row", None])
def test_crowded_days_are_spread(spark, row):
    """Days above the limit are divided inside; every row has the lag that one window gives."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 8, None).otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("id"),
        F.when(F.col("id") % 97 > 0, F.timestamp_seconds(F.lit(1_600_000_000) + F.when(F.col("id") % 10 < 6, F.col("id") % 400)
                                                         .otherwise(F.col("id") * 997))).alias("day"),
        F.col("id").alias("row"))
    spec = PanelSpec("id", "day", row)
    order = F.col("row") if row else F.xxhash64("id", "day", "row")
    plain = df.withColumn("lag_date", F.lag("day").over(Window.partitionBy("id").orderBy("day", order)))
    found = dates.with_previous_date(df, spec, rows_per_day=100)
    assert found.columns == ["id", "day", "row", "lag_date", "lag_days"]
    expected = sorted(map(str, plain.withColumn("lag_days", F.datediff("day", "lag_date")).collect()))
    assert sorted(map(str, found.collect())) == expected
    assert sorted(map(str, dates.with_previous_date(df, spec).collect())) == expected


def test_previous_values_of_odd_rows(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 3, 2), (None, 5, 3), (None, 5, 4), ("a", 1, 5)], "g string, v long, id long")
    found = ranking.previous_values(df, ["g"], ["v", "id"], "v", "before")
    assert {r.id: r.before for r in found.collect()} == {1: None, 5: None, 2: 1, 3: None, 4: 5}
    assert ranking.previous_values(df.limit(0), ["g"], ["v", "id"], "v", "before").count() == 0


def test_lags_without_a_row_id(spark):
    df = spark.createDataFrame([("a", day("2020-01-01"), "x"), ("a", day("2020-01-05"), "x"), ("a", day("2020-01-05"), "x")],
                               "id string, day date, note string")
    lagged = dates.with_previous_date(df, PanelSpec("id", "day"))
    assert sorted((r.lag_days for r in lagged.collect()), key=str) == [0, 4, None]
    assert dates.date_summary(df, PanelSpec("id", "day")).first().avg_lag_days == 2.0


def test_mode_ties_of_one_day_go_to_the_first_row(spark):
    df = spark.createDataFrame([("a", day("2020-01-01"), 1, "z"), ("a", day("2020-01-01"), 2, "b")],
                               "id string, day date, row long, cat string")
    assert modes.entity_modes(df, SPEC, ["cat"]).first().mode_cat == "z"


def test_mode_ties(spark):
    df = spark.createDataFrame([
        ("a", day("2020-01-03"), 1, "x"), ("a", day("2020-01-01"), 2, "y"),
        ("b", day("2020-01-01"), 3, "z"), ("b", day("2020-01-02"), 4, "w"), ("b", day("2020-01-03"), 5, "w"),
        ("c", day("2020-01-01"), 6, None), ("c", day("2020-01-02"), 7, None), ("c", day("2020-01-03"), 8, "q"),
    ], "id string, day date, row long, cat string")
    first = {r["id"]: r.mode_cat for r in modes.entity_modes(df, SPEC, ["cat"]).collect()}
    lowest = {r["id"]: r.mode_cat for r in modes.entity_modes(df, SPEC, ["cat"], ties="lowest").collect()}
    assert first == {"a": "y", "b": "w", "c": None}
    assert lowest == {"a": "x", "b": "w", "c": "q"}


def test_outer_joins_agree(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, a string")
    b = spark.createDataFrame([(2, 5), (3, 6)], "id int, b int")
    pair = joins.outer_join(a, b, "id").collect()
    assert sorted(pair) == sorted(joins.outer_join_all([a, b], "id").select("id", "a", "b").collect())
    assert len(pair) == 3
    a, b = a.unionAll(spark.createDataFrame([(None, "n")], a.schema)), b.unionAll(spark.createDataFrame([(None, 7)], b.schema))
    pair = joins.outer_join(a, b, "id").collect()
    assert len(pair) == 5  # a null key matches nothing
    assert sorted(map(str, pair)) == sorted(map(str, joins.outer_join_all([a, b], "id").select("id", "a", "b").collect()))


def test_blocks_of_columns_give_the_same(tiny, monkeypatch):
    def results():
        stats = aggregate.entity_statistics(tiny, SPEC).orderBy("id").collect()
        return stats, sorted(profile.describe_by_null(tiny, "D_64", ["D_117", "B_38", "x"]).collect())

    whole = results()
    monkeypatch.setattr(columns, "FIELDS_PER_AGGREGATION", 1)
    assert results() == whole


@pytest.mark.parametrize("kind", ["string", "long", "date"])
def test_the_null_entity_is_a_group_for_any_number_of_columns(spark, monkeypatch, kind):
    some = {"string": "a", "long": 0, "date": day("1970-01-01")}[kind]
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 3.0, 4.0), (some, 5.0, 6.0)], f"id {kind}, x double, y double")
    whole = sorted(map(str, aggregate.aggregate(df, "id", {"x": "avg", "y": "max"}).collect()))
    monkeypatch.setattr(columns, "FIELDS_PER_AGGREGATION", 1)
    assert sorted(map(str, aggregate.aggregate(df, "id", {"x": "avg", "y": "max"}).collect())) == whole
    assert len(whole) == 2


def test_numeric_levels_give_plain_names(spark):
    df = spark.createDataFrame([(1.0, "x y", "a"), (2.5, "x.y", "b"), (3.0, "z", None)], "`a.b` double, t string, e string")
    one_hot = clean.OneHot.fit(df, ["a.b", "t"])
    with pytest.raises(ValueError, match="t_x_y"):
        one_hot.transform(df)
    assert clean.OneHot.fit(df, ["a.b"]).transform(df).columns == ["t", "e", "a.b_1", "a.b_2_5"]
    assert {r["column"]: r.n_null for r in profile.null_rates(df).collect()} == {"a.b": 0, "t": 0, "e": 1}
    assert profile.describe_numeric(df).first()["column"] == "a.b"


def test_transform_reuses_what_was_fitted(tiny):
    plan = FeaturePlan(SPEC, RULES)
    whole = {r["id"]: r for r in plan.fit_transform(tiny).collect()}
    part = plan.transform(tiny.where("id = 'b'")).collect()
    assert part == [whole["b"]]
    assert whole["b"].avg_x_impt == pytest.approx((7 / 3 + 5.5) / 2)  # mean of the other entities


def test_label_join_and_names(spark, tiny):
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "id string, target int")
    out = feature_table(tiny, SPEC, RULES, labels)
    assert sorted(r.target for r in out.collect()) == [0, 1]
    assert {"avg_D_117_impt", "stddev_samp_x_impt", "mode_B_38", "months_tenure", "avg_lag_days", "std_lag_days",
            "target"} <= set(out.columns)


def test_profile(spark, tiny):
    rates = {r["column"]: r.null_rate for r in profile.null_rates(tiny).collect()}
    assert rates["D_64"] == pytest.approx(1 / 3) and rates["id"] == 0
    assert profile.sparse_columns(tiny, 0.3) == ["D_64", "D_117"]
    assert profile.family_columns(tiny, "D_", "id", "D_63").columns == ["D_63", "D_64", "D_117", "id"]
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert profile.key_coverage(left, right, "k").first() == (2, 2, 1, 1)
    assert [r.k for r in profile.missing_keys(left, right, "k").collect()] == [1]


def test_correlations_agree(spark):
    df = spark.createDataFrame([(1.0, 2.0, 9.0), (2.0, 3.0, 1.0), (3.0, 5.0, 4.0)], "a double, b double, c double")
    matrix = np.corrcoef(np.array(df.collect()).T)
    pairs = {(r.first, r.second): r.correlation for r in profile.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert pairs["a", "b"] == pytest.approx(matrix[0][1]) and pairs["b", "c"] == pytest.approx(matrix[1][2])
