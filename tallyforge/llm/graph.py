"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

#: Edges of a node from which it is a hub: what belongs to hubs is broadcast, so their edges stay where they are.
HUB = 10_000


def _with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """edges (u, v) with m, the least of u's neighbourhood from least (u, m, n), without dealing a hub's edges by u."""
    hubs = least.where(F.col("n") > hub).select("u", "m") if hub else None
    if hubs is None or not 0 < hubs.count() <= BROADCAST_ROWS:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(hubs)
    return edges.join(hubs, "u").union(edges.join(hubs, "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u"))


def connected_components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """edges (u, v) of one orderable type -> (node, root): root is the least node of node's component.

    Null ends and loops give no edge. A node without an edge has no row. Each
    half round is a partial aggregate and a join. Edges of nodes with more than
    `hub` of them are not dealt by that node: their nodes' part is broadcast
    (should there be more than BROADCAST_ROWS such nodes, they are joined like
    the others, where AQE splits what is skewed). As long as there are no more
    than 100 * hub edges in all, one task could hold a hub's, and hubs are not
    looked for. Each round is written to the shared folder.
    """
    e = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "edges")
    before, many = None, e.count()
    while many:
        big = many > 100 * hub
        kept = (lambda df, name: stored(df, name)) if big else (lambda df, name: df)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = _with_least(both, least, hub if big else None).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.union(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), "large")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = _with_least(large, least, hub if big else None).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, many = now, now[0]
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
