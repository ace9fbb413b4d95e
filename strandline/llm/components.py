"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.joins import attach_group_facts
from strandline.session import release, staged

#: Links of a node that meet in one task; those of a hub are spread over several.
LINKS_OF_A_NODE = 2_000_000


def _star(links: DataFrame, both_ways: bool, links_of_a_node: int) -> DataFrame:
    """Hang the neighbours of every node below the smallest of them; links run from ``high`` to ``low``.

    The smallest neighbours are written and joined back to the links.
    """
    near = links.select(F.col("high").alias("node"), F.col("low").alias("near"))
    if both_ways:
        near = near.unionAll(links.select(F.col("low").alias("node"), F.col("high").alias("near")))
    # The smallest neighbour is found map-side; a node with very many links sends one row per task.
    found = near.groupBy("node").agg(F.min("near").alias("least"), F.count(F.lit(1)).alias("n"))
    least = staged(found.select("node", F.least("node", "least").alias("least"), "n"), "least")
    hung = attach_group_facts(near, least, ["node"], ["near"], "n", links_of_a_node)
    if both_ways:
        moved = hung.where(F.col("near") > F.col("node")).select(F.col("near").alias("high"), F.col("least").alias("low"))
    else:
        moved = (hung.select(F.col("near").alias("high"), F.col("least").alias("low"))
                 .unionAll(least.select(F.col("node").alias("high"), F.col("least").alias("low"))))
    after = staged(moved.where(F.col("high") != F.col("low")).distinct(), "stars")
    release(least)
    return after


def components(links: DataFrame, left: str = "a", right: str = "b",
               links_of_a_node: int = LINKS_OF_A_NODE) -> DataFrame:
    """``(node, root)`` for every node that has a link to another; the root is the smallest node reachable.

    Each round is written to the shared folder, which cuts the lineage. Links become
    stars in a number of rounds that grows with the logarithm of the longest chain.
    A task gathers some ``links_of_a_node`` links of a node at most; a hub with more is spread.
    Rows with a null end are left out. No links give no rows.
    """
    ends = [F.col(left), F.col(right)]
    state = staged(links.where(ends[0] != ends[1])
                   .select(F.greatest(*ends).alias("high"), F.least(*ends).alias("low")).distinct(), "links")
    before = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return state.select(F.col("high").alias("node"), F.col("low").alias("root")).unionAll(
                state.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
        before = now
        large = _star(state, True, links_of_a_node)
        after = _star(large, False, links_of_a_node)
        release(state, large)
        state = after
