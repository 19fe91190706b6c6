"""Connected components of a link table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the least of them: the greater ones (large) or the others.

    The least neighbour is a partial aggregate and comes back by a join whose right side has one
    row per node, so a hub with very many neighbours is split between tasks.
    """
    around = _both_ways(edges)
    if not large:
        around = around.where("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
    linked = around.join(least, "u")
    if large:
        linked = linked.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        linked = linked.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return linked.where("a < b").distinct()


def _trace(edges: DataFrame):
    return edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))
    ).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node that has links; ``root`` is the least node of its component.

    ``edges`` has columns ``a`` and ``b`` of whole numbers, in any order and with repeats. Each
    round is written to the shared folder; the number of rounds grows with the logarithm of the
    longest chain. Loops are left out: a node linked with itself only is not returned.
    """
    now = written(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(),
        "links",
    )
    before = _trace(now)
    while before[0]:
        now = written(_star(_star(now, large=True), large=False), "links")
        after = _trace(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
