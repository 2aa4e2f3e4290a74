"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` has columns ``a`` and ``b``, of one type; return ``node, root``
    with one row for every node of an edge, where nodes of a component, and no
    others, share a root (some node of it, not always the least).

    Each round lets every node point to the least of itself and its neighbours
    in the order of a hash, then contracts the edges along the pointers. A hash
    order, unlike the order of ids, makes long chains shrink by a constant
    factor a round. All rounds are joins and partial aggregates on tables that
    were written to the shared checkpoint folder, so no node's neighbours are
    ever gathered in one place. Null nodes and loops are left out; no edges
    give no rows.
    """
    edges = cut_lineage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    nodes = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a")))
        order = F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(order).alias("m"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("to"))
        pointer = cut_lineage(
            least.select("node", F.least(own, F.col("m"))["to"].alias("to"))
        )
        if nodes is None:
            nodes = pointer.select("node", F.col("to").alias("root"))
        else:
            nodes = nodes.join(
                pointer.select(F.col("node").alias("root"), "to"), "root", "left"
            ).select("node", F.coalesce("to", "root").alias("root"))
        nodes = cut_lineage(nodes)
        ends = edges.join(pointer.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        ends = ends.join(pointer.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = cut_lineage(
            ends.where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    if nodes is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes
