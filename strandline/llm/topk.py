"""Exact top-k inner-product search as a Voronoi kNN join.

With one more coordinate, sqrt(M^2 - |x|^2) for data and 0 for queries, the largest
inner products are the smallest distances. Queries and data are grouped by their
nearest pivot. Summaries of the data groups (count, span and the smallest distances
to the pivot) bound the k-th distance of each query group; a row goes to a query
group only if its distance to its pivot leaves it within that bound. What a group
receives is cut into blocks, each solved by a task of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import hash_share, python_tasks
from strandline.operators.joins import attach_group_facts
from strandline.session import staged

SCALE, TOP = 64, 20
#: Pivots, which are collected.
PIVOTS = 64
#: Rows of a block of queries or data, at most, and the bytes of their numbers: long vectors make smaller blocks.
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
_AT_ONCE = 256
#: Distances of each pivot that are collected beyond k, at most, where ids are shared.
MOST_OWN = 1000


def quantised(vectors: DataFrame, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` with ``v = floor(scale * x)`` as longs.

    Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part. Empty vectors do. Trailing zeros change nothing, so
    vectors of different lengths are compared as if the shorter ended in zeros.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & usable).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _lifted(rows: np.ndarray, most: float, is_data: bool) -> np.ndarray:
    """The coordinates in which inner products are distances."""
    x = rows.astype(float)
    last = np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0)) if is_data else np.zeros(len(x))
    return np.concatenate([x, last[:, None]], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _nearest(pivots: np.ndarray, most: float, width: int, is_data: bool) -> Column:
    """``struct<cell, distance>``: the nearest pivot of a vector and how far it is."""
    @arrow_udf("cell int, distance double")
    def nearest(vectors: pa.Array) -> pa.Array:
        far = _distances(_lifted(_matrix(vectors, width), most, is_data), pivots)
        cell = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(far[np.arange(len(far)), cell])], ["cell", "distance"])

    return nearest("v")


def _bounds(between: np.ndarray, reach: dict[int, float], near: dict[int, list[float]], k: dict[int, int]) -> dict[int, float]:
    """An upper bound of the k-th smallest distance of any query in each query cell, which has a k of its own.

    A row at distance d from its pivot is no farther from a query than the reach of
    the query's cell, plus the distance between the two pivots, plus d.
    """
    out = {}
    for i, far in reach.items():
        ways = np.sort(np.concatenate([far + between[i, j] + np.array(d) for j, d in near.items()]))
        out[i] = float(ways[k[i] - 1]) if len(ways) >= k[i] else float("inf")
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores; among equal ones the first, as ``ids`` ascend."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([above, equal[:k - len(above)]])


def _solve(queries: pa.Table, data: pa.Table, k: int, width: int) -> pa.Table:
    """The k best data rows of each query in one block: by score, then by smaller id."""
    names = ["query_id", "vec_id", "score"]
    data = data.sort_by("vec_id")
    q, x = _matrix(queries["v"], width), _matrix(data["v"], width)
    ids, own = data["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    out = [np.zeros((0, 3), np.int64)]
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1) < 2.0**53
    for lo in range(0, len(q) if len(x) else 0, _AT_ONCE):
        part = q[lo:lo + _AT_ONCE]
        # Whole numbers below 2^53 are exact as doubles, for which there are fast routines.
        scores = part.astype(float) @ x.T.astype(float) if exact else part @ x.T
        for row, me in zip(scores, own[lo:lo + _AT_ONCE].tolist()):
            others = np.flatnonzero(ids != me)
            pick = others[_best(row[others], ids[others], k)]
            out.append(np.stack([np.full(len(pick), me), ids[pick], row[pick].astype(np.int64)], axis=1))
    rows = np.concatenate(out)
    return pa.table([pa.array(rows[:, i]) for i in range(3)], names=names)


def block_rows(width: int) -> int:
    """Rows of a block of vectors of this width.

    Every row is sent once to each block of the other side, so blocks of both sides are
    as large as a task can hold: what is sent is queries times data times two over this.
    """
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1))))


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE, pivots: int = PIVOTS,
          query_block: int | None = None, data_block: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each query.

    Candidates are all rows but those that bear the query's own id. Ties go to the
    smaller id. Query rows that share an id all ask, equal ones once, and the k largest
    of their answers together are the id's; as candidates all rows count. Fewer
    candidates than k give fewer rows, none give none. Every number that prunes is widened by a share of the longest vector, so
    rounding never loses a row. Blocks have ``block_rows`` rows unless told otherwise.
    """
    spark = vectors.sparkSession
    python_tasks(spark)
    rows = staged(quantised(vectors, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda t, c: t + c.cast("double") * c)
    most, width = rows.agg(F.max(square), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if most is None:
        return spark.createDataFrame([], schema)
    query_block, data_block = query_block or block_rows(width), data_block or block_rows(width)
    slack = 1e-6 * (1.0 + float(np.sqrt(most)))
    drawn = (rows.where(hash_share(F.col("vec_id"), F.lit("pivot")) < 4.0 * pivots / rows.count())
             .orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(pivots).collect()) or rows.limit(1).collect()
    drawn = _matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.int64())), width)

    asked = rows.where(is_query).dropDuplicates(["vec_id", "v"])
    # Rows that share a query's id are not its candidates.
    own = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"), F.max(is_query).alias("asks"))
    own = staged(own.where("asks").select("vec_id", "own"), "own")
    most_own = own.agg(F.max("own")).first()[0] or 1
    asked = staged(asked.withColumn("own", F.lit(1).cast("long")) if most_own == 1 else
                   attach_group_facts(asked, own, ["vec_id"], ["v"], "own"), "asked")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    # No more query cells than blocks of queries: each cell is sent what it needs of the data.
    centres = _lifted(drawn, most, True)
    askers = _lifted(drawn[:-(-n_asked // query_block)], most, False)
    between = _distances(askers, centres)
    queries = staged(asked.withColumn("at", _nearest(askers, most, width, False)).select("vec_id", "v", "own", "at.*"), "queries")
    # Copies of a row are told apart by a number, so that they are divided among blocks like other rows.
    data = staged(rows.withColumn("at", _nearest(centres, most, width, True))
                  .select("vec_id", "v", "at.*", F.monotonically_increasing_id().alias("row")), "data")

    # Summaries, as many rows as pivots. More distances than k, as a query never meets rows of its own id.
    in_cell = Window.partitionBy("cell").orderBy("distance")
    near = {r["cell"]: r["near"] for r in data.select("cell", "distance").withColumn("n", F.row_number().over(in_cell))
            .where(F.col("n") <= k + min(most_own, MOST_OWN)).groupBy("cell").agg(F.collect_list("distance").alias("near")).collect()}
    cells = {r["cell"]: r for r in queries.groupBy("cell").agg(
        F.max("distance").alias("reach"), F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).collect()}
    reach = {i: r["reach"] for i, r in cells.items()}
    bound = _bounds(between, reach, near, {i: k + r["own"] for i, r in cells.items()})
    # Per pair of cells the distances to the data pivot at which a row can matter.
    routes = [(i, j, float(between[i, j] - reach[i] - bound[i] - slack), float(between[i, j] + reach[i] + bound[i] + slack))
              for i in reach for j in range(len(centres))]
    plan = F.broadcast(spark.createDataFrame(routes, "query_cell int, cell int, low double, high double"))
    sent = data.join(plan, "cell").where((F.col("distance") >= F.col("low")) & (F.col("distance") <= F.col("high")))
    load = {r["query_cell"]: r["n"] for r in sent.groupBy("query_cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = [(i, -(-r["n"] // query_block), max(1, -(-load.get(i, 0) // data_block))) for i, r in cells.items()]
    blocks = F.broadcast(spark.createDataFrame(shape, "query_cell int, query_blocks int, data_blocks int"))

    def one(count: str, *row: str) -> Column:
        return F.pmod(F.xxhash64(*row, F.lit(count)), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    at = ["query_cell", "query_part", "data_part"]
    left = (queries.withColumnRenamed("cell", "query_cell").join(blocks, "query_cell")
            .withColumn("query_part", one("query_blocks", "vec_id", "v")).withColumn("data_part", every("data_blocks"))
            .select(*at, "vec_id", "v"))
    right = (sent.join(blocks, "query_cell").withColumn("data_part", one("data_blocks", "row"))
             .withColumn("query_part", every("query_blocks")).select(*at, "vec_id", "v"))

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        return _solve(queries, data, k, width)

    found = left.groupBy(at).cogroup(right.groupBy(at)).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
