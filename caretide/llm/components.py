"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a grouping and a join of the remaining edges; node sets and components are never gathered. The join is
on a node that may have very many neighbours: its minimum is pre-aggregated, and the adaptive planner splits the rest.
"""

from pyspark.sql import DataFrame, functions as F

from caretide.llm.common import drop_stored, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v) with u > v in and out. Large: larger neighbours of u go to its least neighbour; small: its smaller
    ones do."""
    if small:
        near = edges
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if small:
        out = joined.select(F.explode(F.array("u", "v")).alias("a"), "m")
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), "m")
    return out.filter(F.col("a") != F.col("m")).select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (its least node) for every node of an edge, the least nodes themselves left out.

    Self-loops, repeated and reversed edges change nothing; edges with a null end are left out.
    """
    e = edges.filter(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e = stored(e, "edges")
    while True:
        after = stored(_star(_star(e, small=False), small=True), "edges")
        # done when the edges are disjoint stars: every node points once, to a node that points nowhere
        centers = after.select(F.col("v").alias("u")).distinct()
        done = after.groupBy("u").count().filter("count > 1").isEmpty() and after.join(centers, "u", "left_semi").isEmpty()
        drop_stored(e)
        e = after
        if done:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
