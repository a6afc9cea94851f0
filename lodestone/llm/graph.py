"""Connected components over a table of edges, in a number of rounds that grows with the logarithm of the longest path.

Alternates large-star and small-star steps (each node's neighbours are attached to its least neighbour) until the edges no
longer change. Each round is a written table: nothing is collected, a lost executor costs a reread. The least neighbour is
found by an aggregation, and joined back by a join that can be split, so a hub may have any number of edges.

Null ends are dropped, repeated edges count once, an edge from a node to itself has no effect, no edges give no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. edges: (u, v) with u > v. large: over all neighbours, the larger ones move; small: over the smaller ones."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v") if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    # Written, so that the join has an exchange of its own on either side, and a hub's edges can be split.
    least = materialize(least.select("u", F.least("u", "m").alias("m")), "least")
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node that can be reached. edges: two columns of one orderable type."""
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = materialize(now, "edges")
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = materialize(_star(materialize(_star(now, True), "edges"), False), "edges")
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
