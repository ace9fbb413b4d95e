"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of characters other than space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Arrow batches that go to Python tasks hold about this much, whatever the length of the texts.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_shipped: set[str] = set()


def python_tasks(spark: SparkSession) -> None:
    """Make a session ready for this package's Python tasks.

    Arrow batches are bounded by bytes, as 10,000 very long texts would not fit a
    worker, and the package goes to the workers, wherever the driver has it from.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "strandline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets between them; a null counts as an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def documents(texts: pa.Array):
    """Each text as bytes; a null counts as an empty text."""
    raw, ends = utf8(texts)
    view = memoryview(raw)
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield bytes(view[start:end])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder_is(key: Column, divisor: int, value: int) -> Column:
    """Whether crc32 of the key as text leaves ``value``; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(divisor)) == value, F.lit(False))


def hash_share(*keys: Column) -> Column:
    """A number in [0, 1) drawn from the hash of the keys, the same in every run."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


#: Labelled documents of all classes together, about; so many classes, the most frequent, can be learned.
MOST_LABELLED = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, allowed: Column,
                    key: str = "doc_id") -> DataFrame:
    """``(key, label, text)`` of about ``per_class`` labelled documents of each class.

    Keys are drawn by hash, with a share that follows from the counts per class, so
    the sample is bounded whatever the number of labels, and every run draws the
    same. With very many classes each has fewer documents, so that ``MOST_LABELLED``
    holds for all together, but one at least. ``allowed`` says which labels may be learned from. Null
    keys and labels are left out; repeated rows count once.
    """
    known = labels.where(allowed & F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label)
    share = hash_share(F.col(key))
    counted = known.groupBy(label).agg(F.count_distinct(key).alias("n"), F.min(share).alias("least"))
    counts = counted.orderBy(F.col("n").desc(), label).limit(MOST_LABELLED).collect()
    if not counts:
        return docs.select(key, F.lit(None).cast("int").alias(label), "text").limit(0)
    per_class = min(per_class, MOST_LABELLED // len(counts))
    below, least = fresh(known, "below", "least")
    rows = [(r[label], per_class / r["n"], r["least"]) for r in counts]
    limits = docs.sparkSession.createDataFrame(rows, T.StructType([
        known.schema[label], T.StructField(below, T.DoubleType()), T.StructField(least, T.DoubleType())]))
    drawn = known.join(F.broadcast(limits), label).where((share < F.col(below)) | (share == F.col(least)))
    picked = drawn.select(key, label).dropDuplicates([key, label]).limit(2 * MOST_LABELLED)
    return (docs.select(key, "text").join(F.broadcast(picked), key)
            .groupBy(key, label).agg(F.min("text").alias("text")))


def spread_bytes(text: Column, most: int, parts: int = 16) -> Column:
    """The bytes of a text, and of one above ``most`` bytes ``parts`` equal stretches from all over it, ``most`` in all."""
    raw, size, part = text.cast("binary"), F.octet_length(text), most // parts
    starts = [F.floor((size - part) * i / (parts - 1)).cast("int") + 1 for i in range(parts)]
    return F.when(size <= most, raw).otherwise(F.concat(*[F.substring(raw, start, F.lit(part)) for start in starts]))


def hashable(df: DataFrame) -> list[Column]:
    """All columns that can be hashed (maps cannot)."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
