"""From raw documents to packed training sequences, one operator a stage.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns
a DataFrame; all but the last return the columns of ``documents``. The quality stages
learn from the labelled documents of ``sf_dir``, whatever earlier stages left of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import mixing, packing, quality_net, rules, simhash
from strandline.llm.common import table
from strandline.llm.queries import tokenizer_path
from strandline.session import new_path, staging

#: Learned verdicts, a near-duplicate search and a tokenizer: none of them can be said in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the learned rules reject; a null or empty text is too short and goes.

    In every stage no rows give no rows, other columns pass through, and rows with the
    same id are documents of their own.
    """
    return rules.keep_good(docs, rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the network scores below its threshold; a null text is scored as an empty one."""
    return quality_net.keep_good(docs, quality_net.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; wordless documents are copies of each other."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; one without words is not taken, a null source is a source."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null text is its end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage has staged for itself is deleted once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with staging(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
