"""Quotation linking, by DataFrame operations alone.

Nested quote levels are parsed line by line. Quoted passages, their paragraphs and
their lines are normalised and hashed, and joined to the messages of the same
conversation that first held them. A message answers the original of its outermost
quoted passage; links make threads, and a conversation is put in reply order with
the quotes taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.columns import null_safe_equal
from strandline.operators.joins import attach_group_facts
from strandline.operators.ranking import prefix_sums
from strandline.session import staged

# Fixed patterns of quoted mail: the marks before a line, and the line that introduces a quote.
MARKS = r"^[ \t]*(?:>[ \t]?)+"
INTRODUCTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*a écrit|el\b.*escribió)\s*:\s*$"
KEY = ["conv_id", "turn"]
#: Messages that meet in one task because they quote one passage or answer one thread; more are spread.
ROWS_TOGETHER = 2_000_000


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parse_levels(messages: DataFrame) -> DataFrame:
    """``(message, conv_id, turn, run, level, content)``: runs of lines of one quote level, in order.

    Level 0 is the author's own text. A line that introduces a quote is left out. The
    lines of one message are the largest group.
    """
    lines = messages.select("message", *KEY, F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    marks = F.regexp_extract("line", MARKS, 0)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    order = Window.partitionBy("message").orderBy("pos")
    leveled = lines.select("message", *KEY, "pos", level.alias("level"), F.expr("substr(line, length(regexp_extract(line, '%s', 0)) + 1)" % MARKS.replace("\\", "\\\\")).alias("content"))
    introduces = F.col("content").rlike(INTRODUCTION) & (F.lead("level", 1, 0).over(order) > F.col("level"))
    kept = leveled.withColumn("introduces", introduces).where(~F.col("introduces"))
    changed = F.coalesce((F.col("level") != F.lag("level").over(order)).cast("int"), F.lit(1))
    numbered = kept.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    return numbered.groupBy("message", *KEY, "run", "level").agg(joined.alias("content"))


def units(texts: DataFrame, content: str, *keep: str) -> DataFrame:
    """The hashes of each text as a whole, of its paragraphs and of its lines, after normalising; with their lengths."""
    parts = F.array_distinct(F.concat(
        F.array(normalised(F.col(content))),
        F.transform(F.split(content, r"\n\s*\n"), normalised),
        F.transform(F.split(content, "\n"), normalised)))
    found = texts.select(*keep, F.explode(parts).alias("unit")).where(F.col("unit") != "")
    return found.select(*keep, F.xxhash64("unit").alias("hash"), F.length("unit").alias("length"))


def reply_links(runs: DataFrame, own: DataFrame, rows_together: int = ROWS_TOGETHER) -> DataFrame:
    """``(conv_id, turn, reply_to, n_linked)``: the turn that a quoting message answers.

    A passage comes from the message of the conversation that holds it as its own
    text first, if that is an earlier turn. Of several the outermost level counts, then
    the longest passage, then the latest turn. One row per hash is joined, so a line
    that very many messages share makes no pairs among them; the quotes of such a line
    are spread over tasks by their turn.
    """
    quoted = units(runs.where("level > 0 and turn is not null"), "content", *KEY, "level")
    firsts = (units(own, "own_text", *KEY).where(F.col("turn").isNotNull())
              .groupBy("conv_id", "hash").agg(F.min("turn").alias("said")))
    asked = quoted.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    facts = staged(asked.alias("q").join(firsts.alias("o"), null_safe_equal("q", "o", ["conv_id", "hash"]), "left")
                   .select("q.*", "o.said"), "passages")
    met = attach_group_facts(quoted, facts, ["conv_id", "hash"], ["turn"], "n", rows_together).where("said < turn")
    best = F.min(F.struct("level", (-F.col("length")).alias("size"), (-F.col("said")).alias("said")))
    return met.groupBy(*KEY).agg(best.alias("best"), F.count(F.lit(1)).alias("n_linked")).select(
        "conv_id", "turn", (-F.col("best.said")).alias("reply_to"), "n_linked")


def thread_roots(links: DataFrame, rows_together: int = ROWS_TOGETHER) -> DataFrame:
    """``(conv_id, turn, root, depth)`` for every message that answers another.

    Pointers are doubled until all end at a message that answers none, so the number
    of rounds grows with the logarithm of the longest thread. The messages of a crowded
    thread are spread over tasks by their turn.
    """
    state = staged(links.select(*KEY, F.col("reply_to").alias("root"), F.lit(1).alias("depth")), "pointers")
    while True:
        # Every message pointed at, with those that point at it counted, and where it points itself.
        at = state.groupBy("conv_id", "root").agg(F.count(F.lit(1)).alias("n"))
        on = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.root") == F.col("b.turn"))
        steps = staged(at.alias("a").join(state.alias("b"), on, "left").select(
            "a.*", F.col("b.root").alias("next"), F.col("b.depth").alias("further")), "steps")
        ahead = attach_group_facts(state, steps, ["conv_id", "root"], ["turn"], "n", rows_together)
        moved = staged(ahead.select(
            *KEY, F.coalesce("next", "root").alias("root"),
            (F.col("depth") + F.coalesce("further", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("went")), "pointers")
        if moved.where("went").isEmpty():
            return moved.select(*KEY, "root", "depth")
        state = moved.select(*KEY, "root", "depth")


def threaded(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages`` (``conv_id, turn, role, text``) with the quotes taken out.

    Adds ``reply_to`` (the turn answered; null for the first of a thread), ``root`` and
    ``depth`` (the thread's first turn and the steps to it), ``position`` (from 0, in the
    reply order of the conversation: threads by their root, each by turn, so that an
    answer follows what it answers), ``n_quoted`` (quoted passages), ``n_linked``
    (passages, paragraphs and lines that were found in an original) and ``chat`` (the
    text under its role). ``text`` is the author's own text: white space around it is
    trimmed, null stays null. Null conversations are one conversation; a message
    without a turn answers nothing and comes last. Rows with the same conversation
    and turn share their links; rows equal throughout may come in any order.
    """
    base = staged(messages.select(*KEY, "role", "text").withColumn("message", F.xxhash64(*KEY, "role", "text")), "messages")
    quoting = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    # Parsed once per message; rows without quotes need no parsing.
    runs = staged(parse_levels(base.where(quoting).dropDuplicates(["message"])), "quote-runs")
    if runs.isEmpty():
        marked = base.withColumns({
            "own_text": F.regexp_replace("text", r"^\s+|\s+$", ""), "reply_to": F.lit(None).cast(base.schema["turn"].dataType),
            "root": F.col("turn"), "depth": F.lit(0), "n_quoted": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long")})
    else:
        marked = _linked(base, runs, quoting)
    ordered = marked.withColumns({"rootless": F.col("root").isNull(), "one": F.lit(1)})
    placed = prefix_sums(ordered, ["conv_id"], ["rootless", "root", "turn", "message"], "one", "position")
    role = F.coalesce("role", F.lit("unknown"))
    return placed.select(
        *KEY, "role", F.col("own_text").alias("text"), "reply_to", "root", "depth",
        F.coalesce("position", F.lit(0)).cast("long").alias("position"), "n_quoted", "n_linked",
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce("own_text", F.lit(""))).alias("chat"))


def _linked(base: DataFrame, runs: DataFrame, quoting: Column) -> DataFrame:
    own_runs = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("run", "content"))))
    parsed = runs.groupBy("message").agg(
        F.regexp_replace(F.array_join(F.transform(own_runs, lambda x: x["content"]), "\n"), r"^\s+|\s+$", "").alias("parsed_text"),
        F.sum((F.col("level") > 0).cast("long")).alias("n_quoted"))
    texts = staged(
        base.join(parsed, "message", "left").withColumns({
            "own_text": F.when(quoting, F.coalesce("parsed_text", F.lit(""))).otherwise(
                F.regexp_replace("text", r"^\s+|\s+$", "")),
            "n_quoted": F.coalesce("n_quoted", F.lit(0).cast("long"))}).drop("parsed_text"), "own-texts")
    # Originals are looked for in the conversations that have quotes.
    asking = runs.select("conv_id").distinct()
    own = texts.alias("t").join(asking.alias("a"), null_safe_equal("t", "a", ["conv_id"]), "left_semi")
    links = staged(reply_links(runs, own), "reply-links")
    roots = thread_roots(links)
    facts = links.join(roots.withColumnRenamed("conv_id", "c").withColumnRenamed("turn", "t"),
                       F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))).drop("c", "t")
    found = texts.alias("m").join(facts.alias("f"), null_safe_equal("m", "f", KEY), "left")
    return found.select("m.*", "f.reply_to", F.coalesce("f.root", "m.turn").alias("root"),
                        F.coalesce("f.depth", F.lit(0)).alias("depth"),
                        F.coalesce("f.n_linked", F.lit(0).cast("long")).alias("n_linked"))
