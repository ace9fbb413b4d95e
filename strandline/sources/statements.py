"""Readers and writers for statement panels, labels, features and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.config import SAMPLE_SEED, PanelSpec
from strandline.functions.columns import hash_bucket

LABEL_SCHEMA = T.StructType([
    T.StructField("customer_ID", T.StringType()),
    T.StructField("target", T.IntegerType()),
])


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. ``path`` may be a folder, a list or a glob (``part-0000*.csv``).

    Every file's header must name the columns of the schema in their order, else the
    read fails. Without a schema the types are inferred, which costs a second pass.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)


def read_labels(spark: SparkSession, path, schema: T.StructType = LABEL_SCHEMA) -> DataFrame:
    return read_csv(spark, path, schema)


def statement_schema(columns: list[str], text: tuple[str, ...] = ("D_63", "D_64"),
                     spec: PanelSpec = PanelSpec()) -> T.StructType:
    """The schema of a statement file, from its header names."""
    kinds = {spec.entity: T.StringType(), spec.time: T.DateType(), **{c: T.StringType() for c in text}}
    return T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in columns])


def read_statements(spark: SparkSession, path, text: tuple[str, ...] = ("D_63", "D_64"),
                    spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Statement CSV in one pass: the header gives the names, the roles of the columns their types."""
    names = spark.read.option("header", True).csv(path).columns
    return read_csv(spark, path, statement_schema(names, text, spec))


def sample_entities(df: DataFrame, entity: str, percent: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """All rows of about ``percent`` % of the entities (a sample of part files may split an entity)."""
    return df.where(hash_bucket([entity], seed, 100) < percent)


def write_parts(df: DataFrame, path: str, fmt: str = "csv", rows_per_file: int = 0) -> None:
    """Overwrite ``path`` with one or more files per task, as the data is already partitioned."""
    writer = df.write.mode("overwrite").option("header", True)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.format(fmt).save(path)


def write_single(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Overwrite ``path`` with one file, for results that are small by nature: one task writes all rows.

    ``repartition`` rather than ``coalesce``: the work that produces the rows stays parallel.
    """
    write_parts(df.repartition(1), path, fmt)


def write_names(spark: SparkSession, names: list[str], path: str) -> None:
    """A feature list as text, one name per line."""
    spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_names(spark: SparkSession, path: str) -> list[str]:
    return [r.value for r in spark.read.text(path).collect()]


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, spec: PanelSpec = PanelSpec(),
                   rows_per_file: int = 5_000_000) -> DataFrame:
    """Write a panel as a table bucketed by entity, its files sorted by entity and time, and return the table.

    Whoever groups, joins or windows it by entity reads it without an exchange. Files
    hold ``rows_per_file`` rows or so: an entity with more is spread over several files
    of its bucket by a hash of the row, so no task writes or sorts all of it. A reader's
    task still takes a whole bucket, so buckets should follow the size of the panel.
    """
    counted = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("__rows"))
    crowded = counted.where(F.col("__rows") > rows_per_file).select(
        spec.entity, F.ceil(F.col("__rows") / rows_per_file).cast("int").alias("__files"))
    # As many entities as the panel has files, at most; a null entity stays with the others of its bucket.
    marked = df.join(F.broadcast(crowded), spec.entity, "left")
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    file = F.pmod(row, F.coalesce("__files", F.lit(1)))
    spread = marked.withColumn("__bucket", F.pmod(F.hash(spec.entity), F.lit(buckets))).withColumn("__file", file)
    (spread.repartition(buckets, "__bucket", "__file").drop("__bucket", "__file", "__files")
     .write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, spec.entity).sortBy(*spec.keys).saveAsTable(name))
    return df.sparkSession.table(name)


def read_bucketed(spark: SparkSession, name: str, path: str, schema: T.StructType, buckets: int,
                  spec: PanelSpec = PanelSpec()) -> DataFrame:
    """A bucketed panel written by another session: its files are registered under ``name`` with their bucketing."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    keys = ", ".join(f"`{k}`" for k in spec.keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY (`{spec.entity}`) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
