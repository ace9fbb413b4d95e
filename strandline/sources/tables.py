"""Statement panels derived from the order, line item, event and label tables.

The order history of a customer stands in for a customer's statements: the
columns carry the names and roles the cleaning rules expect, including sparse
columns, categories with gaps and numeric codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import PanelSpec

ORDERS = PanelSpec(entity="customer_ID", time="S_2", row="row_id")
EVENTS = PanelSpec(entity="user_id", time="ts", row="event_id")
LABEL_LIMIT = 480_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def code(condition):
        return condition.cast("double")

    def lines_with(flag):
        return F.count_if(F.col("l_returnflag") == flag)

    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_tax").alias("P_2"),
        F.sum("l_discount").alias("S_3"),
        F.sum("l_quantity").alias("B_1"),
        F.min("l_extendedprice").alias("B_17"),
        F.max("l_quantity").alias("most_of_a_part"),
        F.count(F.lit(1)).cast("double").alias("D_117"),
        F.max("l_linenumber").cast("double").alias("D_126"),
        lines_with("R").cast("double").alias("D_68"),
        code(F.count_if(F.col("l_linestatus") == "O") > 0).alias("D_120"),
        code(lines_with("A") > 1).alias("B_30"),
        code(lines_with("N") > 0).alias("D_114"),
        code(F.count_if(F.col("l_quantity") > 40) > 0).alias("D_116"),
        lines_with("N").cast("double").alias("B_38"),
        code(F.count(F.lit(1)) > 4).alias("D_144"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, keyed by customer and date."""
    orders = table(spark, sf_dir, "orders")
    lines = _order_lines(spark, sf_dir)
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_custkey").alias("customer_ID"),
        F.to_date("o_orderdate").alias("S_2"),
        F.col("o_orderkey").alias("row_id"),
        "P_2", "S_3", "B_1", "B_17",
        F.when(status != "P", price).alias("D_39"),
        F.when((status == "P") & (priority == "1-URGENT"), price).alias("D_42"),
        F.when((status == "F") & (priority == "5-LOW"), F.col("most_of_a_part")).alias("B_39"),
        F.expr("nullif(substr(o_orderpriority, 3), 'NOT SPECIFIED')").alias("D_63"),
        F.expr("nullif(o_orderstatus, 'P')").alias("D_64"),
        "D_117", "D_126", "D_68", "D_120", "B_30", "D_114", "D_116", "B_38", "D_144",
    )


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the key columns of the statements: no line items are read for them."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_ID"), F.to_date("o_orderdate").alias("S_2"),
        F.col("o_orderkey").alias("row_id"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for customers who ever placed an order above the limit."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_ID")).agg(
        (F.max("o_totalprice") > LABEL_LIMIT).cast("int").alias("target"))


def account_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for customers with a negative balance: imbalanced, and independent of the orders."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_ID"), (F.col("c_acctbal") < 0).cast("int").alias("target"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second panel, with times of day."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with a score: the text length as evidence of quality."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", F.col("quality").alias("target"), F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") > 800).cast("int").alias("predicted"))
