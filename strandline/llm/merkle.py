"""Merkle dataset manifest: a hash tree over the rows of each source, and one over the sources.

Nodes of a level are numbered within their tree. Every node sends its digest to the
computed indices of its siblings (its own index moved by each slot offset inside its
run of ``arity`` nodes, which for two is the exclusive or with one), and an equijoin
on tree and index brings the siblings to each node. Nodes in slot zero then hold a
whole run and emit its parent. Nothing but the number of levels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.joins import attach_group_facts
from strandline.operators.ranking import prefix_sums
from strandline.session import staged

ARITY = 16
#: The columns that a leaf commits to, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<slot:int,siblings:binary>>"


def field(value: Column) -> Column:
    """A value as it is hashed: its length in UTF-8 bytes, a colon and the value; a null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """The SHA-256 of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _parent(digests: Column) -> Column:
    """The digest over concatenated digests, which are hashed as hex text."""
    return F.unhex(F.sha2(hexed(digests), 256))


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``slot`` and ``siblings``: the digests of the other nodes of the run, left to right."""
    slot = F.pmod("idx", F.lit(arity)).cast("int")
    slotted = nodes.withColumn("slot", slot)
    offset = F.explode(F.sequence(F.lit(1), F.lit(arity - 1)))
    sent = (slotted.where("n > 1").select("tree", "idx", "n", "slot", "digest", offset.alias("offset"))
            .select("tree", (F.col("idx") - F.col("slot") + F.pmod(F.col("slot") + F.col("offset"), F.lit(arity))).alias("idx"),
                    "n", F.struct("slot", "digest").alias("sibling")).where("idx < n"))
    met = sent.groupBy("tree", "idx").agg(F.array_sort(F.collect_list("sibling")).alias("met"))
    joined = F.aggregate("met", F.lit(b""), lambda all_, one: F.concat(all_, one["digest"]))
    return (slotted.join(met, ["tree", "idx"], "left")
            .withColumn("siblings", F.coalesce(joined, F.lit(b""))).drop("met"))


def grow(nodes: DataFrame, arity: int = ARITY) -> tuple[list[DataFrame], DataFrame]:
    """The levels above the leaves ``nodes (tree, idx, n, digest, …)`` and the ``(tree, root)`` of every tree.

    ``idx`` runs from 0 within a tree of ``n`` leaves. Each level is written to the
    shared folder with the siblings of its nodes; other columns of ``nodes`` stay in
    the first. A tree of one leaf is its own root. There are as many levels as the
    largest tree needs, the logarithm of its leaves.
    """
    levels, level = [], staged(nodes, "nodes")
    while True:
        here = staged(_with_siblings(level, arity), "level")
        levels.append(here)
        if (here.agg(F.max("n")).first()[0] or 0) <= 1:
            break
        level = here.where((F.col("slot") == 0) & (F.col("n") > 1)).select(
            "tree", F.floor(F.col("idx") / arity).cast("long").alias("idx"),
            F.ceil(F.col("n") / arity).cast("long").alias("n"), _parent(F.concat("digest", "siblings")).alias("digest"))
    tops = [x.where("n = 1").select("tree", F.col("digest").alias("root")) for x in levels]
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionAll(top)
    return levels, roots


def paths(levels: list[DataFrame], above: DataFrame | None = None, arity: int = ARITY) -> DataFrame:
    """The leaves with ``path``: slot and siblings at each level up to the root, lowest first.

    ``above`` gives each tree ``(tree, path, …)``: the path that goes on from its root,
    and facts that its leaves get too. A node's path is looked up by the index of its
    parent, one equijoin a level from the top.
    """
    out, facts = None, [c for c in above.columns if c not in ("tree", "path")] if above is not None else []
    for level in reversed(levels):
        step = F.array(F.struct(F.col("slot"), F.col("siblings"))).cast(_PATH)
        own = level.drop("slot", "siblings")
        ends = own.where("n = 1").alias("l")
        empty = F.array().cast(_PATH)
        if above is None:
            ends = ends.withColumn("path", empty)
        else:
            ends = ends.join(above.alias("a"), "tree").select("l.*", "a.path", *[f"a.{c}" for c in facts])
        if out is None:
            out = ends
            continue
        up = out.select("tree", F.col("idx").alias("__parent"), F.col("path").alias("__above"), *facts)
        inner = (level.where("n > 1").withColumn("__parent", F.floor(F.col("idx") / arity).cast("long"))
                 .join(up, ["tree", "__parent"]).withColumn("path", F.concat(step, "__above"))
                 .drop("slot", "siblings", "__parent", "__above"))
        out = inner.unionByName(ends)
    return out


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf digest (32 bytes) and a path lead to, as 32 bytes."""
    def up(below: Column, step: Column) -> Column:
        left = step["slot"] * 32
        return _parent(F.concat(F.substring(step["siblings"], F.lit(1), left), below,
                                F.substring(step["siblings"], left + 1, F.octet_length(step["siblings"]))))

    return F.aggregate(path, digest, up)


def proof_digest(path: Column) -> Column:
    """The SHA-256, in hex, of all siblings of a path as hex text, lowest level first and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: hexed(step["siblings"])), ""), 256)


def manifest(docs: DataFrame, keep: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS,
             key: str = "doc_id", group: str = "source", arity: int = ARITY) -> DataFrame:
    """One row per row of ``docs``: ``key, group, leaf, subroot, root`` (32 bytes each), ``path`` and what ``keep`` names.

    Leaves of a group ascend by key, a null key first; rows with the same key follow
    the order of their digests, so equal rows are interchangeable. Groups are ordered
    by their UTF-8 bytes, the null group first. Null and empty values differ. Texts
    are read once and hashed whole. No rows give no rows. Other columns, whatever
    their names, play no part; ``keep`` adds expressions over the columns of ``docs``.
    """
    keep = keep or {}
    rows = staged(docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{group}`").alias("__group"),
                              leaf_digest([F.col(f"`{f}`") for f in fields]).alias("digest"),
                              *[c.alias(f"__keep_{i}") for i, c in enumerate(keep.values())], F.lit(1).alias("one")), "leaves")
    number = F.coalesce("before", F.lit(0)).cast("long")
    placed = (prefix_sums(rows, ["__group"], ["__key", "digest"], "one", "before")
              .withColumn("idx", number).drop("before", "one"))
    groups = rows.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).withColumns({"all": F.lit(0), "one": F.lit(1)})
    numbered = staged(prefix_sums(groups, ["all"], ["__group"], "one", "before")
                      .select("__group", "n", number.alias("tree")), "groups")
    levels, subroots = grow(attach_group_facts(placed, numbered, ["__group"], ["__key", "digest"], "n"), arity)
    tops = staged(subroots, "subroots")
    top_levels, roots = grow(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"),
                                         F.lit(tops.count()).alias("n"), F.col("root").alias("digest")), arity)
    root = roots.select("root").first()
    above = staged(paths(top_levels, None, arity).select(
        F.col("idx").alias("tree"), "path", F.col("digest").alias("subroot")), "above")
    return paths(levels, above, arity).select(
        F.col("__key").alias(key), F.col("__group").alias(group), F.col("digest").alias("leaf"), "subroot",
        F.lit(bytes(root[0]) if root else None).cast("binary").alias("root"), "path",
        *[F.col(f"__keep_{i}").alias(name) for i, name in enumerate(keep)])


def tampered_leaf(tampered: Column, fields: tuple[str, ...] = FIELDS, text: str = "text") -> Column:
    """The digest of a row as it is, or with the letters A-Z of its text in lower case where ``tampered`` holds."""
    upper = "".join(map(chr, range(65, 91)))
    changed = F.translate(F.col(text), upper, upper.lower())
    return F.when(tampered, leaf_digest([changed if f == text else F.col(f"`{f}`") for f in fields])).otherwise(
        leaf_digest([F.col(f"`{f}`") for f in fields]))
