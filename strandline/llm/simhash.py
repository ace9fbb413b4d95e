"""SimHash near-duplicates, linked with Burkhard-Keller trees.

Fingerprints within ``radius`` bits of each other agree in some choice of blocks of
their bits, so they meet in the shard of that choice. In each shard a tree holds the
distinct fingerprints, children keyed by their Hamming distance to the parent, and
every fingerprint follows only the edges within the radius. The trees of all shards
in a task are built and searched together, one array operation per level. A shard
passes on a spanning forest of the links it finds, not the links of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import documents, fresh, hashable, python_tasks
from strandline.llm.components import components
from strandline.operators.joins import attach_group_facts
from strandline.session import staged

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Distinct fingerprints in a tree, and queries to it in a task; a larger shard is spread over several of both.
TREE_NODES = 50_000
ROWS_OF_A_SHARD = 2_000_000
_AT_ONCE = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text in UTF-8 as an unsigned number; zero without words."""
    words = raw.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    text = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    if len(words) >= shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), _AT_ONCE):  # bounds the memory that a very long text takes
        spans = zip(starts[at:at + _AT_ONCE].tolist(), ends[at:at + _AT_ONCE].tolist())
        hashes = b"".join([digest(text[s:e], SEED) for s, e in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprint_column(text: str = "text", shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""
    @arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(raw, shingle) for raw in documents(texts)], np.uint64)
        return pa.array(found.view(np.int64))

    return fingerprints(text)


def as_hex(fingerprints: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprints)), 16, "0")


class Forest:
    """One Burkhard-Keller tree per shard. ``shards`` is sorted, values differ within a shard."""

    def __init__(self, shards: np.ndarray, values: np.ndarray):
        self.values = values
        first = np.ones(len(shards), bool)
        first[1:] = shards[1:] != shards[:-1]
        self.shards, self.roots = shards[first], np.flatnonzero(first)
        waiting = np.flatnonzero(~first)
        at = self.roots[np.cumsum(first) - 1][waiting]
        keys, nodes = [], []
        while len(waiting):
            distance = np.bitwise_count(values[waiting] ^ values[at]).astype(np.int64)
            edge = at * 65 + distance
            edges, new = np.unique(edge, return_index=True)
            child = waiting[new]
            keys.append(edges)
            nodes.append(child)
            below = child[np.searchsorted(edges, edge)]
            rest = np.ones(len(waiting), bool)
            rest[new] = False
            waiting, at = waiting[rest], below[rest]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.edges = keys[order]
        self.children = (np.concatenate(nodes) if nodes else np.zeros(0, np.int64))[order]

    def search(self, shards: np.ndarray, values: np.ndarray, radius: int, at_once: int = 1 << 15, most: int = 1 << 20):
        """Pairs (query, node) within the radius, in pieces; every query's shard must have a tree."""
        for lo in range(0, len(values), at_once):
            query = np.arange(lo, min(len(values), lo + at_once))
            todo = [(query, self.roots[np.searchsorted(self.shards, shards[query])])]
            while todo:
                query, node = todo.pop()
                if len(query) > most:
                    half = len(query) // 2
                    todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                distance = np.bitwise_count(values[query] ^ self.values[node]).astype(np.int64)
                near = distance <= radius
                yield query[near], node[near]
                lo_edge = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0), "left")
                hi_edge = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right")
                count = hi_edge - lo_edge
                total = int(count.sum())
                if total:
                    within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
                    todo.append((np.repeat(query, count), self.children[np.repeat(lo_edge, count) + within]))


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest label of each class after a and b have been linked."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def _links_of(shards: np.ndarray, values: np.ndarray, planted: np.ndarray, asks: np.ndarray, radius: int):
    """A spanning forest of the links between the rows that ask and those planted in the tree of their shard."""
    nodes = np.flatnonzero(planted)
    if not len(nodes):
        return values[:0], values[:0]
    forest = Forest(shards[nodes], values[nodes])
    label = np.arange(len(values))
    queries = np.flatnonzero(asks & np.isin(shards, forest.shards))
    for query, node in forest.search(shards[queries], values[queries], radius):
        label = join_labels(label, queries[query], nodes[node])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return values[moved], values[label[moved]]


def block_masks(blocks: int, radius: int) -> list[int]:
    """The bit masks of every choice of ``blocks - radius`` of ``blocks`` bit ranges."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    ranges = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(ranges, blocks - radius)]


def _blocks_for(distinct: int, radius: int) -> int:
    """So many blocks that evenly spread fingerprints leave at most 256 to a shard; any number finds all links."""
    blocks = radius + 1
    while blocks < radius + 4 and distinct > 256 << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def links(fingerprints: DataFrame, radius: int = RADIUS, blocks: int | None = None,
          tree_nodes: int = TREE_NODES, rows_of_a_shard: int = ROWS_OF_A_SHARD) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints (column ``fp``) within the radius of each other.

    Not every pair is returned: in each shard a spanning forest of its links is, so
    classes are whole while a group of near copies gives as many rows as it has members.
    A shard above ``rows_of_a_shard`` learns its number of trees in several tasks.
    """
    blocks = blocks or _blocks_for(fingerprints.count(), radius)
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in block_masks(blocks, radius)])
    placed = fingerprints.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("shard"))
    sizes = placed.groupBy("choice", "shard").agg(F.count(F.lit(1)).alias("n"))
    # Shards of one fingerprint have no links. Crowded ones take several trees and as many lots of queries:
    # a row is planted in its own tree for every lot, and asks every tree with its own lot.
    crowds = staged(sizes.where("n > 1").withColumn("trees", F.ceil(F.col("n") / tree_nodes).cast("int")), "shards")

    def drawn(seed: int) -> Column:
        return F.pmod(F.xxhash64("fp", F.lit(seed)), F.col("trees")).cast("int")

    each = F.explode(F.sequence(F.lit(0), F.col("trees") - 1))
    met = attach_group_facts(placed, crowds, ["choice", "shard"], ["fp"], "n", rows_of_a_shard).where(F.col("trees").isNotNull())
    rows = met.withColumns({"home": drawn(1), "own_lot": drawn(2)})
    columns = ["choice", "shard", "tree", "lot", "fp", "planted", "asks"]
    planted = rows.withColumns({"tree": F.col("home"), "lot": each, "planted": F.lit(True)}).withColumn(
        "asks", F.col("lot") == F.col("own_lot"))
    asking = (rows.where("trees > 1").withColumns({"tree": each, "lot": F.col("own_lot"), "planted": F.lit(False), "asks": F.lit(True)})
              .where(F.col("tree") != F.col("home")))
    meeting = ["choice", "shard", "tree", "lot"]
    rows = (planted.select(columns).unionAll(asking.select(columns))
            .repartition(*meeting).sortWithinPartitions(*meeting, "fp"))

    def search(batches):
        # Rows that meet are searched together as they come; the last ones wait for the rest of theirs.
        waiting, waiting_rows = [], 0
        for batch in batches:
            part = _Rows.of(batch)
            waiting.append(part)
            waiting_rows += len(part.fp)
            if waiting_rows >= 1 << 17:
                done, rest = _Rows.joined(waiting).cut()
                waiting, waiting_rows = [rest], len(rest.fp)
                yield from done.linked(radius)
        if waiting:
            yield from _Rows.joined(waiting).linked(radius)

    return rows.mapInArrow(search, "a long, b long")


class _Rows:
    """Rows of a task in the order of their shards, trees and lots."""

    def __init__(self, keys: np.ndarray, fp: np.ndarray, planted: np.ndarray, asks: np.ndarray):
        self.keys, self.fp, self.planted, self.asks = keys, fp, planted, asks

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        return cls(np.stack([c.astype(np.int64) for c in columns[:4]], axis=1), columns[4].astype(np.int64).view(np.uint64),
                   columns[5].astype(bool), columns[6].astype(bool))

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        return cls(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("keys", "fp", "planted", "asks")])

    def _slice(self, part: slice) -> _Rows:
        return _Rows(self.keys[part], self.fp[part], self.planted[part], self.asks[part])

    def cut(self) -> tuple[_Rows, _Rows]:
        """All but the last group of rows that meet, and the last."""
        last = int(np.flatnonzero((self.keys == self.keys[-1]).all(axis=1))[0]) if len(self.fp) else 0
        return self._slice(slice(0, last)), self._slice(slice(last, None))

    def linked(self, radius: int):
        if not len(self.fp):
            return
        new = np.ones(len(self.fp), bool)
        new[1:] = (self.keys[1:] != self.keys[:-1]).any(axis=1)
        a, b = _links_of(np.cumsum(new), self.fp, self.planted, self.asks, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def group_by_fingerprint(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root)`` for each distinct value of ``fp``; equal roots are one class."""
    distinct = staged(fingerprints.select("fp").distinct(), "fingerprints")
    linked = components(links(distinct, radius))
    return (distinct.join(linked, distinct["fp"] == linked["node"], "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links; null only where
    all documents of the class lack an id. Null and empty texts have fingerprint
    zero and are linked like any other. Repeated rows are each returned.
    """
    python_tasks(docs.sparkSession)
    marked = staged(docs.select("doc_id", fingerprint_column("text", shingle).alias("fp")), "simhash")
    counted = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    members = staged(counted.join(group_by_fingerprint(counted, radius), "fp"), "members")
    classes = members.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = staged(members.join(classes, "root").select("fp", "n", "component_id"), "classes")
    found = attach_group_facts(marked, facts, ["fp"], ["doc_id"], "n")
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each class, with the columns of ``docs``: that with the smallest ``doc_id``.

    Rows without an id stay only where no document of the class has one. Of several
    rows with the smallest id the one with the smallest hash of all columns stays.
    """
    python_tasks(docs.sparkSession)
    mark, id_, = fresh(docs, "row_hash", "row_id")
    keyed = docs.withColumns({mark: F.xxhash64(*hashable(docs)), id_: F.col("doc_id").cast("string")})
    marked = staged(keyed.select(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col(id_).alias("id"),
                                 F.col(mark).alias("mark"), fingerprint_column("text", shingle).alias("fp")), "simhash")
    best = F.min(F.struct("nameless", "doc_id", "mark", "id"))
    counted = marked.groupBy("fp").agg(best.alias("best"))
    classes = counted.join(group_by_fingerprint(counted, radius), "fp").groupBy("root").agg(F.min("best").alias("best"))
    chosen = classes.select(F.coalesce("best.id", F.lit("")).alias(id_), F.col("best.mark").alias(mark))
    kept = keyed.withColumn(id_, F.coalesce(id_, F.lit(""))).join(chosen, [id_, mark])
    return kept.dropDuplicates([id_, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
