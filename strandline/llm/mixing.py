"""Mixing sources to target weights, by DataFrame operations alone.

Each document gets a hash-random key. Documents are range-sorted by key within their
source, distributed prefix sums of their word counts place every document on its
source's line of words, and the line is cut at the source's exact budget: whole
epochs first, then a last one that ends inside a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import WORD, fresh, hash_share, hashable
from strandline.operators.ranking import prefix_sums
from strandline.session import staged

#: A source gives at most this many times its words.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_before(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``before``: the words of its source's documents that come before, by ``order`` within ``rank``.

    The rows are range-sorted by source and order and written with the number of their
    range. The words of a source before each range enter the range as a row of their own,
    and a window inside the range adds up the rest, so a source may fill many ranges.
    """
    ranged = staged(rows.repartitionByRange("rank", *order).withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("range", "rank").agg(F.sum("size").alias("words"))
              .select("range", "rank", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("size"), F.lit(True).alias("start")))
    inside = Window.partitionBy("range", "rank").orderBy(F.col("start").desc(), *order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("start", F.lit(False)).unionByName(starts, allowMissingColumns=True)
            .withColumn("before", F.sum("size").over(inside)).where(~F.col("start")).drop("range", "start"))


def ranked_weights(sources: DataFrame) -> DataFrame:
    """``sources`` (one row each) with ``rank`` by code point, null last, and weights 1, 2, 3, repeating."""
    ordered = sources.withColumns({"unnamed": F.col("source").isNull(), "one": F.lit(1)})
    placed = prefix_sums(ordered.withColumn("all", F.lit(0)), ["all"], ["unnamed", "source"], "one", "before")
    rank = F.coalesce(F.col("before"), F.lit(0)).cast("long")
    return placed.select("source", "words", rank.alias("rank"), (F.pmod(rank, F.lit(3)) + 1).cast("double").alias("weight"))


def targets(sources: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (``source, words, weight``) with ``target``: shares of all words by weight.

    A target stops at ``most_epochs`` times the words of its source; the excess is
    shared again by weight among the others until none is above its limit. Each round
    is one small aggregation; the level can only rise, so sources once full stay full.
    """
    limit = F.col("words") * F.lit(float(most_epochs))
    total = sources.agg(F.sum("words")).first()[0] or 0
    level, full = -1.0, -1
    weight = sources.agg(F.sum("weight")).first()[0]
    level = total / weight if weight else 0.0
    while True:
        above = F.col("weight") * F.lit(level) >= limit
        now = sources.agg(F.sum(F.when(above, 1).otherwise(0)), F.sum(F.when(above, limit).otherwise(0.0)),
                          F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if not now[0] or now[0] == full or not now[2]:
            break
        full, level = now[0], (total - now[1]) / now[2]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), limit))


def mix(docs: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """One row per row of ``docs`` with ``doc_id, row_hash, size, source, source_size, target, taken``.

    ``size`` counts words (null text: 0), ``taken`` the words that the mix takes of the
    document, repeats counted. The sum of ``taken`` over a source is its target
    rounded to a whole word. The order within a source follows the hash of the row,
    so reruns agree; rows that are equal throughout are interchangeable.
    """
    sized = staged(docs.select("doc_id", "source", F.xxhash64(*hashable(docs)).alias("row_hash"),
                               word_count(F.col("text")).alias("size")), "sizes")
    sources = staged(sized.groupBy("source").agg(F.sum("size").alias("words")), "sources")
    aims = staged(targets(staged(ranked_weights(sources), "weights"), most_epochs), "targets")
    rows = (sized.alias("d").join(aims.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
            .select("d.doc_id", "d.row_hash", "d.size", "d.source", "s.rank", F.col("s.words").alias("source_size"), "s.target",
                    hash_share(F.col("d.doc_id"), F.col("d.row_hash"), F.lit("mix")).alias("key")))
    placed = words_before(rows, ["key", "doc_id", "row_hash"])
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.coalesce(F.col("before"), F.lit(0))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "row_hash", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word, white space kept."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank_start = text.rlike(r"^[\x20\x09-\x0D]").cast("int")
    return F.rtrim(F.array_join(F.slice(pieces, F.lit(1), (count + blank_start).cast("int")), ""))


def mixed_documents(docs: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document comes as often as the mix takes it whole; where a budget ends inside a
    document, its last copy ends there too (``n_chars`` follows, if there is one).
    Documents that the mix takes nothing of are left out.
    """
    mark, id_, taken, size, copies, words, copy = fresh(
        docs, "row_hash", "row_id", "taken", "size", "copies", "words", "copy")
    share = (mix(docs, most_epochs).withColumn(id_, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
             .groupBy(id_, F.col("row_hash").alias(mark))
             .agg(F.sum("taken").alias(taken), F.max("size").alias(size)).where(F.col(taken) > 0))
    # Rows that are equal throughout count together and are handed out together.
    keyed = docs.withColumns({mark: F.xxhash64(*hashable(docs)),
                              id_: F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    once = keyed.join(share, [id_, mark]).dropDuplicates([id_, mark])
    whole = F.floor(F.col(taken) / F.col(size)).cast("int")
    rest = F.pmod(F.col(taken), F.col(size))
    numbered = once.withColumn(copies, F.sequence(F.lit(1), whole + F.when(rest > 0, 1).otherwise(0)))
    out = (numbered.withColumn(copy, F.explode(copies))
           .withColumn(words, F.when(F.col(copy) > whole, rest)))
    cut = F.col(words).isNotNull()
    out = out.withColumn("text", F.when(cut, first_words(F.col("text"), F.col(words))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
