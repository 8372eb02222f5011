"""Connected components as rounds of grouped minima and joins (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlife.llm.storage import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the least node near it; minima are combined before they move."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    linked = near.join(least, "a")
    if large:
        return linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(space: Workspace, edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component: the least node it hangs together with.

    Edges with a null end and loops say nothing and are left out; repeats do no harm. Each round
    is written to the shared folder, which cuts the lineage. Rounds end when a round changes nothing.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    now = space.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    mark = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    state, step = mark(now), 0
    while True:
        step += 1
        wide = space.save(_star(now, True), f"{tag}-{step}-large")
        after = space.save(_star(wide, False), f"{tag}-{step}")
        fresh = mark(after)
        space.drop(f"{tag}-{step}-large")
        space.drop(f"{tag}-{step - 1}")
        if fresh == state:
            break
        now, state = after, fresh
    children = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = after.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return children.union(roots)
