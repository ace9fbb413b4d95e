"""Readers, writers, the shared folder and the shape of the physical plans."""

import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from strandline import session
from strandline.config import PanelSpec
from strandline.operators import aggregate, dates, modes, ranking
from strandline.plans import scoring
from strandline.plans.catalogue import QUERIES
from strandline.sources import statements as io
from strandline.sources import tables
from strandline.sources.tables import ORDERS

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_csv_with_schema_and_inferred(spark, tmp_path):
    panel = tables.order_dates(spark, DATA)
    io.write_parts(panel, str(tmp_path / "parts"))
    assert io.read_csv(spark, str(tmp_path / "parts"), panel.schema).exceptAll(panel).count() == 0
    assert dict(io.read_csv(spark, str(tmp_path / "parts" / "part-0000*.csv")).dtypes)["S_2"] == "date"


def test_single_file_on_request_only(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).withColumn("prediction", F.lit(0.5))
    for single, expected in ((True, 1), (False, 4)):
        path = str(tmp_path / str(single))
        assert scoring.write_submission(df, path, single).count() == 100
        assert len(glob.glob(f"{path}/part-*")) == expected


def test_headers_must_name_the_schema(spark, tmp_path):
    (tmp_path / "swapped.csv").write_text("target,customer_ID\n1,a\n")
    with pytest.raises(Exception, match="[Hh]eader"):
        io.read_labels(spark, str(tmp_path / "swapped.csv")).collect()
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "a.csv").write_text("customer_ID,S_2,x,y\na,2020-01-01,1,2\n")
    (tmp_path / "parts" / "b.csv").write_text("customer_ID,S_2,y,x\nb,2020-01-01,1,2\n")
    with pytest.raises(Exception, match="[Hh]eader"):
        io.read_statements(spark, str(tmp_path / "parts")).collect()


def test_names_keep_their_order(spark, tmp_path):
    names = ["z", "avg_D_39_impt", "a"]
    io.write_names(spark, names, str(tmp_path / "names"))
    assert io.read_names(spark, str(tmp_path / "names")) == names


def test_sample_keeps_entities_whole(spark):
    panel = tables.order_dates(spark, DATA)
    sample = io.sample_entities(panel, "customer_ID", 30)
    again = io.sample_entities(panel.repartition(5), "customer_ID", 30)
    assert sample.exceptAll(again).count() == 0
    whole = panel.join(sample.select("customer_ID").distinct(), "customer_ID")
    assert 0 < sample.count() == whole.count() < panel.count()


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default):
                return default

        class sparkContext:
            master = "spark://somewhere"
    for master in ("spark://somewhere", "yarn", "local-cluster[2,1,1024]"):
        Cluster.sparkContext.master = master
        with pytest.raises(RuntimeError):
            session.shared_folder(Cluster)


def test_staged_tables_go_with_their_scope(spark):
    with session.staging(spark):
        first = session.staged(spark.range(5), "first")
        second = session.staged(spark.range(7), "second")
        assert first.count() == 5 and second.count() == 7
        session.release(first)
        assert not os.path.exists(first.staged_path) and os.path.exists(second.staged_path)
        kept = session.staged(second, "kept").count()
    assert kept == 7 and not os.path.exists(second.staged_path)


def test_settings_follow_the_size():
    big = session.scale_settings(100 * 2**40, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 102_400
    assert int(session.scale_settings(2**20, 8)["spark.sql.shuffle.partitions"]) == 24


def test_statistics_take_one_shuffle(spark):
    panel = spark.read.parquet(f"{DATA}/orders.parquet").select(
        F.col("o_custkey").alias("customer_ID"), F.to_date("o_orderdate").alias("S_2"),
        F.col("o_orderkey").alias("row_id"), "o_totalprice")
    df = aggregate.entity_statistics(panel, ORDERS)
    assert exchanges(df) == 1 and "partial_avg" in plan(df) and "Sort" not in plan(df)


def test_dates_condense_days_before_entities_meet(spark):
    df = dates.date_features(tables.order_dates(spark, DATA), ORDERS)
    text = plan(df)
    assert exchanges(df) == 2 and "ObjectHashAggregate" not in text and "SortAggregate" not in text
    assert "partial_count" in text[text.index("Window"):]  # the days are formed map-side, below the window


def test_quantiles_scan_once_for_any_number_of_columns(spark):
    panel = tables.statements(spark, DATA)
    scans = [plan(ranking.exact_quantiles(panel, columns, {"q50": 0.5})).count("FileScan")
             for columns in (["B_1"], ["B_1", "B_17", "D_39", "D_117", "B_38", "P_2"])]
    assert scans[0] == scans[1]


def test_feature_table_shuffles(spark):
    """Modes and days need two shuffles each; statistics are read as written."""
    df = QUERIES["feature_table"](spark, DATA)
    assert exchanges(df) <= 5 and "Cartesian" not in plan(df)


def test_modes_take_two_shuffles_for_any_number_of_columns(spark):
    panel = tables.events(spark, DATA).withColumns({f"c{i}": F.col("event_type") for i in range(6)})
    df = modes.entity_modes(panel, tables.EVENTS, [f"c{i}" for i in range(6)])
    assert exchanges(df) == 2 and "Join" not in plan(df)


def test_gathered_rows_are_sent_once_for_all_modes(spark, monkeypatch):
    """The same modes as of values that are sent one by one; a crowded entity is not brought together."""
    panel = spark.createDataFrame(
        [(e, dt.date(2020, 1, d), r, a, b) for e, d, r, a, b in [
            (1, 3, 1, "x", 1.0), (1, 1, 2, "y", 2.0), (1, 2, 3, None, None), (2, 1, 4, None, 1.0), (2, 1, 5, None, 3.0),
            (None, 1, 6, "z", 1.0), (None, 2, 7, "w", 1.0), (None, 2, 8, "w", None), (3, 5, 9, "q", 2.0), (3, 5, 10, "p", 2.0)]],
        "e long, d date, r long, `a.b` string, c double")
    spec, columns = PanelSpec("e", "d", "r"), ["a.b", "c"]
    for ties in ("first_seen", "lowest"):
        sent = modes.entity_modes(panel, spec, columns, ties)
        together = modes.entity_modes(panel, spec, columns, ties, gather=True)
        assert (exchanges(sent), exchanges(together)) == (2, 1)
        expected = sorted(sent.collect(), key=str)
        assert sorted(together.collect(), key=str) == expected and len(expected) == 4
        crowded = modes.entity_modes(panel, spec, columns, ties, gather=True, rows_together=2)
        assert exchanges(crowded) == 2 and sorted(crowded.collect(), key=str) == expected
        with monkeypatch.context() as patch:
            patch.setattr(modes, "VALUES_PER_TASK", 5)
            spread = modes.entity_modes(panel, spec, columns, ties, gather=True)
            assert exchanges(spread) == 1 and sorted(spread.collect(), key=str) == expected
    assert modes.entity_modes(panel.limit(0), spec, columns, gather=True).count() == 0


def test_feature_table_sends_a_row_once_for_its_modes(spark):
    assert "Expand" not in plan(QUERIES["feature_table"](spark, DATA))


def test_only_needed_columns_are_read_and_filters_reach_the_scan(spark):
    text = plan(QUERIES["filter_entity"](spark, DATA))
    assert "EqualTo(o_custkey,99)" in text
    text = plan(QUERIES["project_columns"](spark, DATA))
    assert "l_shipdate" not in text and "l_suppkey" not in text


@pytest.mark.parametrize("name", ["feature_table", "lag_days", "first_last_date", "category_instability", "roc_points",
                                  "classification_report", "key_coverage", "smote_neighbours"])
def test_no_cross_joins_or_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_flagship_entry(spark):
    import __spark_entry__ as contract
    df = contract.entry(spark)
    assert df.count() == 150 and len(df.columns) == 48


def test_scopes_of_threads_do_not_meet(spark):
    """A scope that ends first leaves the tables of another thread's scope alone."""
    import threading

    one_staged, other_ended, seen = threading.Event(), threading.Event(), []

    def one():
        with session.staging(spark):
            table = session.staged(spark.range(3), "one")
            one_staged.set()
            other_ended.wait(60)
            seen.append(table.count())

    def other():
        one_staged.wait(60)
        with session.staging(spark):
            session.staged(spark.range(4), "other")
        other_ended.set()

    threads = [threading.Thread(target=f) for f in (one, other)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert seen == [3]


def test_parallel_work_belongs_to_the_scope_around_it(spark):
    with session.staging(spark) as paths:
        found = session.in_parallel(spark, lambda n: session.staged(spark.range(n), "part").count(), [1, 2, 3], 2)
        assert found == [1, 2, 3] and len(paths) == 3
    assert not any(os.path.exists(p) for p in paths)


def test_shared_results_outlive_scopes_and_follow_their_files(spark, tmp_path):
    path, made = str(tmp_path / "input"), []

    def make():
        made.append(1)
        return session.staged(spark.read.parquet(path), "shared")

    spark.range(5).write.parquet(path)
    for _ in range(2):
        with session.staging(spark):
            assert session.once_per_session(spark, "shared", [path], make).count() == 5
    spark.range(6).write.mode("overwrite").parquet(path)
    assert session.once_per_session(spark, "shared", [path], make).count() == 6 and len(made) == 2


def test_bucketed_panels_need_no_exchange(spark, tmp_path):
    spec = PanelSpec("id", "day", "row")
    rows = [(None if i % 50 == 0 else 7 if i % 3 == 0 else i % 11, dt.date(2020, 1, 1) + dt.timedelta(days=i % 40), i, float(i)) for i in range(900)]
    panel = spark.createDataFrame(rows, "id int, day date, row int, x double")
    written = io.write_bucketed(panel, "bucketed_panel", str(tmp_path / "panel"), 4, spec, rows_per_file=100)
    assert sorted(map(str, written.collect())) == sorted(map(str, panel.collect()))
    assert len(list((tmp_path / "panel").glob("*.parquet"))) > 4  # the crowded entity has several files of its bucket
    spark.sql("DROP TABLE bucketed_panel")
    again = io.read_bucketed(spark, "registered_panel", str(tmp_path / "panel"), panel.schema, 4, spec)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stats = again.groupBy("id").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"))
        joined = stats.join(dates.date_features(again, spec), "id")
        lagged = dates.with_previous_date(again, spec, bucketed=True)
        for df in (stats, joined, lagged):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, lagged.collect())) == sorted(map(str, dates.with_previous_date(panel, spec).collect()))
        plain = panel.groupBy("id").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation")).join(
            dates.date_features(panel, spec), "id")
        assert [pytest.approx(tuple(r)) for r in sorted(joined.collect())] == [tuple(r) for r in sorted(plain.collect())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE registered_panel")
