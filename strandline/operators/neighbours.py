"""Exact nearest neighbours within one table, block against block.

The points are divided among pivots (a Voronoi partition). A first search looks in
a point's own cell; the largest distance of a k-th hit in a cell then rules out, by
the triangle inequality, the cells and the points that cannot be nearer to any point
of it, and a second search visits the rest. This is the scheme of Lu, Shen, Chen and
Ooi, "Efficient Processing of k Nearest Neighbor Joins using MapReduce" (VLDB 2012).

Copies of a point are folded into one before the search. Near cells are searched
together in blocks of bounded size, and a point is sent once to each block of visitors
that it may matter to, not to each visitor or cell; inside a block each cell only looks
at the points that it may need. Where nothing can be ruled out, as in very many
dimensions, what is sent is the points times some blocks, as many as keep all cores
busy, so it grows with the points; beyond what a block's memory holds it grows with
their square over the block size. Blocks are Arrow tables and read as flat arrays, with
no copy for each cell, so they may hold many points. What is written stays linear.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.joins import attach_group_facts
from strandline.session import staged

POINTS_PER_CELL = 500
MAX_CELLS = 1_024  # pivots and pairs of cells are known to the driver; beyond it cells take more blocks
VISITOR_ROWS, POINT_ROWS = 4_000, 16_000  # rows of the two sides of a block, at least as the most that it may hold
BLOCK_BYTES = 96 << 20  # coordinates of one side of a block, at most
SPARE = 0.1  # a block may hold so much more, rather than be divided
BLOCKS_PER_CORE = 3
ASKING, ASKED = 256, 4_096  # rows of a matrix of rough distances, which fits a core's cache
SLACK = 1e-9  # rounding must not rule out a point


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, summed column by column."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float)


def _coordinates(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _in_cells(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The nearest pivot of each point and the distance to it."""
    def assign(batches):
        for batch in batches:
            for start in range(0, len(batch), 1_000):
                some = batch.iloc[start:start + 1_000]
                d2 = _distances(_matrix(some["vector"]), pivots)
                cell = d2.argmin(axis=1)
                yield some.assign(cell=cell.astype("int32"), radius=np.sqrt(d2[np.arange(len(cell)), cell]))

    return reps.mapInPandas(
        assign, f"rep {dict(reps.dtypes)['rep']}, vector array<double>, cell int, radius double")


def _rough_hits(asking: np.ndarray, reach2: np.ndarray, right: np.ndarray, farthest2: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asking row, point) that may be among the k + 1 nearest points of the row and within its reach.

    ``right`` has the points and their squares, none above ``farthest2``. Distances are
    rough, as products of matrices of its kind; what their rounding leaves open stays in.
    Points come in chunks, and each chunk is held against the best so far.
    """
    kind, mine = right.dtype.type, (asking**2).sum(axis=1)
    # Without the size of the asking row, which moves all its distances alike.
    left = np.hstack([-2 * asking, np.ones((len(asking), 1))]).astype(kind)
    error = 4 * (right.shape[1] + 15) * np.finfo(kind).eps * (mine + farthest2)
    limit, best = reach2 - mine + error, np.full((len(asking), k + 1), np.inf)

    def most() -> np.ndarray:
        return np.nextafter(np.minimum(limit, best.max(axis=1) + 2 * error).astype(kind), kind(np.inf))

    rows, hits, at = [], [], []
    for start in range(0, len(right), ASKED):
        rough = left @ right[start:start + ASKED].T
        if start == 0:
            width = min(k + 1, rough.shape[1])
            best[:, :width] = np.partition(rough, width - 1, axis=1)[:, :width]
        found = np.flatnonzero(rough <= most()[:, None])  # of a flat array: several times as fast
        (r, h), value = np.divmod(found, rough.shape[1]), rough.ravel()[found]
        if start and len(r):
            order = np.lexsort((value, r))
            place = np.arange(len(r)) - np.searchsorted(r, r)
            new, first = np.full_like(best, np.inf), place <= k
            new[r[first], place[first]] = value[order][first]
            best = np.partition(np.hstack([best, new]), k, axis=1)[:, :k + 1]
        rows.append(r)
        hits.append(h + start)
        at.append(value)
    r, h = np.concatenate(rows), np.concatenate(hits)
    stays = np.concatenate(at) <= most()[r]
    return r[stays], h[stays]


def nearest_rows(own: np.ndarray, asking: np.ndarray, reach: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int,
                 counts: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pd.DataFrame:
    """The k nearest points of each asking row, none beyond its reach nor itself; ``ids`` ascend.

    ``counts`` says of pairs (asking row, point) whether they are hits; those that are
    not still rule out what is farther away.
    """
    out = []
    fit = np.isfinite(vectors).all() and np.isfinite(asking).all()
    centre = vectors.mean(axis=0) if fit else 0.0
    centred = vectors - centre
    small = fit and max(np.abs(centred).max(initial=0.0), np.abs(asking - centre).max(initial=0.0)) < 1e12
    theirs = np.einsum("ij,ij->i", centred, centred)
    del centred
    sides: dict[type, np.ndarray] = {}

    def side(kind: type) -> np.ndarray:
        if kind not in sides:
            sides[kind] = np.empty((len(vectors), vectors.shape[1] + 1), kind)
            np.subtract(vectors, centre, out=sides[kind][:, :-1], casting="same_kind")
            sides[kind][:, -1] = theirs
        return sides[kind]

    for start in range(0, len(own), ASKING):
        mine, points = own[start:start + ASKING], asking[start:start + ASKING]
        near = (reach[start:start + ASKING] * (1 + SLACK) + SLACK) ** 2
        # Single precision rules out most points at half the cost, unless distances are small against the coordinates.
        kinds = [np.float32, np.float64] if small else [np.float64]
        for kind in kinds:
            rows, hits = _rough_hits(points - centre, near, side(kind), theirs.max(), k)
            if len(rows) <= 32 * (k + 1) * len(points):
                break
        at = np.searchsorted(ids, mine).clip(max=len(ids) - 1)
        other = (hits != at[rows]) | (ids[at] != mine)[rows]
        if counts is not None:
            other &= counts(start + rows, hits)
        rows, hits = rows[other], hits[other]
        # Those that may count are summed exactly.
        d2 = np.zeros(len(rows))
        for j in range(points.shape[1]):
            d2 += (points[rows, j] - vectors[hits, j]) ** 2
        within = (d2 <= near[rows]) & np.isfinite(d2)
        rows, hits, d2 = rows[within], hits[within], d2[within]
        order = np.lexsort((hits, d2, rows))
        rows, hits, d2 = rows[order], hits[order], d2[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        first = place < k
        out.append(pd.DataFrame({"rep": mine[rows[first]], "other": ids[hits[first]], "distance2": d2[first]}))
    return pd.concat(out, ignore_index=True)


def _block_rows(spark: SparkSession, rows: int, width: int) -> tuple[int, int]:
    """Rows of the two sides of a block: what memory allows, or fewer so that there are blocks for all cores."""
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))
    sides = math.ceil(math.sqrt(BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism))
    return tuple(max(least, min(most, math.ceil(rows / sides))) for least in (VISITOR_ROWS, POINT_ROWS))


def _parts(rows: int, most: int) -> int:
    """The blocks that so many rows take, of ``most`` rows and little more."""
    return max(int(rows > 0), math.ceil(rows / most - SPARE))


def _near_cells(pivots: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """A group for each cell: near cells together, in as few groups as hold about ``rows`` points each.

    Groups are cut between cells, so one may hold some part of a cell more. Halving
    until all fit would leave most groups half empty, and points are sent to each group.
    """
    group, waiting, made = np.zeros(len(sizes), dtype=int), [(np.arange(len(sizes)), _parts(int(sizes.sum()), rows))], 0
    while waiting:
        cells, parts = waiting.pop()
        if len(cells) == 1 or parts <= 1:
            group[cells] = made
            made += 1
            continue
        widest = np.ptp(pivots[cells], axis=0).argmax()
        cells = cells[np.argsort(pivots[cells, widest], kind="stable")]
        upto = sizes[cells].cumsum()
        first = np.abs(upto[:-1] - upto[-1] * (parts // 2) / parts).argmin() + 1
        for side in (cells[first:], cells[:first]):
            waiting.append((side, _parts(int(sizes[side].sum()), rows)))
    return group


def _search(visitors: DataFrame, sizes: dict[int, int], points: DataFrame, lows: np.ndarray, used: np.ndarray,
            group_of: np.ndarray, shape: tuple[int, int], k: int) -> DataFrame:
    """The k nearest points of each visitor (``rep, vector, reach, cell``) along the routes.

    ``lows`` has a row for each cell of ``used`` and a column for each cell that asks:
    it needs the points that are at least so far from their pivot, none if it is
    infinite. Cells of one group of ``group_of`` ask together. There are at most the
    square of ``MAX_CELLS`` bounds of 8 bytes, 8 MB, whatever the number of points.
    """
    spark = points.sparkSession
    groups = int(group_of.max()) + 1
    # What a group is sent of a cell: whatever any of its cells needs.
    routes = np.stack([lows[:, group_of == g].min(axis=1) for g in range(groups)], axis=1)
    at, to = np.nonzero(routes < np.inf)  # a bound of minus infinity sends all
    plan = F.broadcast(spark.createDataFrame(pa.table({
        "cell": pa.array(used[at], pa.int32()), "to": pa.array(to, pa.int32()), "low": pa.array(routes[at, to], pa.float64())})))
    home = F.broadcast(spark.createDataFrame(pa.table({
        "cell": pa.array(used, pa.int32()), "to": pa.array(group_of, pa.int32())})))
    sent = points.join(plan, "cell").where(F.col("radius") >= F.col("low"))
    load = {r["to"]: r["n"] for r in sent.groupBy("to").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = {g: sum(sizes[c] for c in used[group_of == g]) for g in range(groups)}
    blocks = F.broadcast(spark.createDataFrame(
        [(g, _parts(n, shape[0]), _parts(load.get(g, 0), shape[1])) for g, n in asks.items()], "to int, groups int, parts int"))
    block, kind = ["to", "group", "part"], dict(points.dtypes)["rep"]

    def one(count):
        return F.pmod(F.xxhash64("rep", F.lit(count)), F.col(count)).cast("int")

    def each(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    asking = (visitors.join(home, "cell").join(blocks, "to").where("parts > 0")
              .withColumn("group", one("groups")).withColumn("part", each("parts"))
              .select("rep", "vector", "reach", "cell", *block))
    asked = (sent.join(blocks, "to").withColumn("part", one("parts")).withColumn("group", each("groups"))
             .select(F.col("rep").alias("other"), F.col("vector").alias("other_vector"),
                     F.col("cell").alias("other_cell"), "radius", *block))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["other"]
        shown = pa.schema({"rep": ids.type, "other": ids.type, "distance2": pa.float64()})
        if not (left.num_rows and right.num_rows):
            return shown.empty_table()
        order = pc.sort_indices(ids).to_numpy()  # ids are unique; equal distances: the lowest id first
        ids, vectors = ids.to_numpy()[order], _coordinates(right["other_vector"])[order]
        radius, place = right["radius"].to_numpy()[order], np.searchsorted(used, right["other_cell"].to_numpy()[order])
        own, asking, reach = left["rep"].to_numpy(), _coordinates(left["vector"]), left["reach"].to_numpy()
        column = np.searchsorted(used, left["cell"].to_numpy())
        del left, right
        found, together = [], np.zeros(len(own), dtype=bool)
        for c in np.unique(column):
            needed, some = radius >= lows[place, c], column == c
            if 2 * np.count_nonzero(needed) >= len(needed):
                together |= some  # cells that need most points look at all of them, without a copy for each cell
            elif needed.any():
                found.append(nearest_rows(own[some], asking[some], reach[some], ids[needed], vectors[needed], k))
        if together.any():
            column = column[together]
            found.append(nearest_rows(own[together], asking[together], reach[together], ids, vectors, k,
                                      lambda rows, hits: radius[hits] >= lows[place[hits], column[rows]]))
        return pa.Table.from_pandas(pd.concat(found), shown, preserve_index=False) if found else shown.empty_table()

    return (asking.groupBy(*block).cogroup(asked.groupBy(*block))
            .applyInArrow(nearest, f"rep {kind}, other {kind}, distance2 double"))


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rep").orderBy("distance2", "other")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def distinct_points(df: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows ``(id, vector)``, and written the distinct points: ``vector, rep`` (lowest id), its first ``ids``, ``copies``."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    unfit = F.col("vector").isNull() | F.exists("vector", lambda c: c.isNull() | F.isnan(c))
    if not rows.where(unfit).isEmpty():
        raise ValueError(f"{vector!r} holds a null or NaN coordinate")

    # Copies of a point: k + 1 ids are enough, since nobody needs more than k besides itself.
    lowest = Window.partitionBy("vector").orderBy("id")
    ids = (rows.withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= k + 1)
           .groupBy("vector").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")))
    counts = rows.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"))
    reps = staged(ids.join(counts, "vector"), "neighbour-points")
    return rows, reps


def nearest_neighbours(df: DataFrame, key: str, vector: str, k: int, pairs: DataFrame | None = None) -> DataFrame:
    """The k nearest other rows of each row: (key, rank, neighbour, distance2, neighbour_vector).

    With ``pairs`` (``key``, ``rank`` and other columns) only these neighbours, next to
    the other columns and the ``vector`` of the row itself.

    Equal distances go to the lower key. Keys are unique numbers or texts, vectors are
    arrays of equal length; a null or NaN coordinate is refused. With k or fewer
    rows, all other rows are neighbours; no rows give no rows.
    """
    rows, reps = distinct_points(df, key, vector, k)
    n_cells = min(MAX_CELLS, math.ceil(reps.count() / POINTS_PER_CELL))
    chosen = reps.select("vector", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(max(1, n_cells)).collect()
    if not chosen:
        return _expand(rows, reps, None, k, pairs)
    pivots = np.array([r["vector"] for r in chosen], dtype=float)
    points = staged(_in_cells(reps.select("rep", "vector"), pivots), "neighbour-cells")
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("r")).collect()
    sizes, radii = {c["cell"]: c["n"] for c in cells}, {c["cell"]: c["r"] for c in cells}

    unbounded = points.select("rep", "vector", "cell", F.lit(float("inf")).alias("reach"))
    used = np.array(sorted(sizes))
    counts = np.array([sizes[c] for c in used])
    shape = _block_rows(points.sparkSession, int(counts.sum()), pivots.shape[1])
    own = np.where(np.eye(len(used), dtype=bool), 0.0, np.inf)
    hits = _best(_search(unbounded, sizes, points, own, used, np.arange(len(used)), shape, k), k)
    if len(cells) > 1:
        hits = staged(hits, "neighbour-hits")
        known = staged(hits.groupBy("rep").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("distance2"))).alias("reach")), "neighbour-reach")
        bounded = points.join(known, "rep", "left").select("rep", "vector", "cell", F.coalesce(
            "reach", F.lit(float("inf"))).alias("reach"))
        reach = {r["cell"]: r["reach"] for r in bounded.groupBy("cell").agg(F.max("reach").alias("reach")).collect()}
        far = np.sqrt(_distances(pivots[used], pivots[used]))
        # No point of a cell is nearer to a visitor than the pivots' distance less both radii.
        outer = np.array([radii[c] + reach[c] for c in used])
        lows = far - outer[None, :] * (1 + SLACK) - SLACK
        matters = lows <= np.array([radii[c] for c in used])[:, None]
        np.fill_diagonal(matters, False)
        if matters.any():
            needed, near = np.where(matters, lows, np.inf), _near_cells(pivots[used], counts, shape[0])
            hits = _best(hits.unionAll(_search(bounded, sizes, points, needed, used, near, shape, k)), k)
    return _expand(rows, reps, hits, k, pairs)


def _expand(rows: DataFrame, reps: DataFrame, hits: DataFrame | None, k: int, pairs: DataFrame | None = None) -> DataFrame:
    """From distinct points back to rows: a point's own copies come first, then its neighbours' ids.

    Neighbours are ranked by ids and the numbers of their points; coordinates are joined
    to what is returned only, so ``pairs`` costs a vector or two for each pair and not k for each row.
    """
    own = reps.select("rep", F.explode("ids").alias("neighbour"), F.lit(0.0).alias("distance2"), F.col("rep").alias("point"))
    if hits is not None:
        others = hits.join(reps.select(F.col("rep").alias("other"), "ids"), "other")
        own = own.unionAll(others.select("rep", F.explode("ids").alias("neighbour"), "distance2", F.col("other").alias("point")))
    # k + 1 candidates per point serve all its copies: each copy skips itself.
    order = Window.partitionBy("rep").orderBy("distance2", "neighbour")
    candidates = (own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
                  .groupBy("rep").agg(F.array_sort(F.collect_list(
                      F.struct("distance2", "neighbour", "point"))).alias("candidates")))
    found = reps.select("rep", "vector", "copies").join(candidates, "rep").select("vector", "copies", "candidates")
    others = F.slice(F.filter("candidates", lambda c: c["neighbour"] != F.col("id")), 1, k)
    near = attach_group_facts(rows, staged(found, "neighbour-found"), ["vector"], ["id"], "copies")
    if pairs is None:
        near = near.select(F.col("id").alias("key"), F.posexplode(others).alias("rank", "c")).withColumn("rank", F.col("rank") + 1)
    else:
        near = (near.select(F.col("id").alias("key"), "vector", others.alias("others")).join(pairs, "key")
                .withColumn("c", F.get("others", F.col("rank") - 1)).where(F.col("c").isNotNull()).drop("others"))
    points = reps.select(F.col("rep").alias("point"), F.col("vector").alias("neighbour_vector"), F.col("copies").alias("__copies"))
    # Copies of a point are near to each other, so a crowded point is asked for as often.
    return attach_group_facts(near.select(*[c for c in near.columns if c != "c"], "c.neighbour", "c.distance2", "c.point"),
                              points, ["point"], ["key"], "__copies").drop("point", "__copies")
