"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_counted, stage, unstage


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of comparable ids -> ``(node, root)``, root the smallest id of the node's component.

    Nodes are those that occur in an edge (u = v is allowed). Neighbour minima are plain aggregates, so a hub of
    any degree is combined before the shuffle, and edges meet the minima by :func:`join_counted`, so a hub's edges are
    not all sent to one task; no neighbour list is ever gathered. Every round is written to the shared folder, and the
    round before it deleted. Rows with a null end are ignored; an empty table gives an empty result.
    """
    e = edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e, total, seen = stage(e.distinct(), "cc"), None, None

    def nearest(table: DataFrame, n: int) -> DataFrame:
        """Rows of ``table(u, v)``, ``n`` in all, with the smallest neighbour ``m`` of u."""
        low = table.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return join_counted(table, low, "u", "n", n)

    for _ in range(max_rounds):
        total = e.count() if total is None else total
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = nearest(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = stage(large.unionByName(e.where("u = v")).distinct(), "cc")
        unstage(e)
        small = nearest(large, large.count()).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = stage(small.distinct(), "cc")
        unstage(large)
        state = e.agg(F.count("*").alias("rows"), F.count_if(F.col("u") != F.col("v")).alias("n"), F.sum(F.when(F.col("u") != F.col("v"), F.xxhash64("u", "v")).cast("decimal(38,0)")).alias("h")).first()
        total = state["rows"]
        if seen == (state["n"], state["h"]):
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = (state["n"], state["h"])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
