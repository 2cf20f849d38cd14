"""Connected components over an edge table: each vertex hooks to its least neighbour, the trees that this makes are flattened by pointer jumping, and what is left between them is contracted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``v`` and ``root`` (the least vertex of its component) for every vertex of ``edges`` (a, b), of any ordered type.

    Every step is written, so lineage stays short. Each round at least halves the vertices of a component, and a tree of
    depth d takes log d jumps, so long chains end as well.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps = []
    while True:
        both = edges.select(F.col("a").alias("v"), F.col("a").alias("m")).union(edges.select("b", "a"))
        steps.append(flat(stored(both.groupBy("v").agg(F.min("m").alias("to")), "labels")))
        a, b = (steps[-1].select(F.col("v").alias(x), F.col("to").alias(f"{x}2")) for x in "ab")
        moved = edges.join(a, "a").join(b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = stored(moved, "edges")
        if edges.isEmpty():
            break
    found = steps.pop()
    while steps:  # a vertex of an earlier round goes where its root went
        last = found.select(F.col("v").alias("to"), F.col("to").alias("end"))
        found = stored(steps.pop().join(last, "to", "left").select("v", F.coalesce("end", "to").alias("to")), "labels")
    return found.withColumnRenamed("to", "root")


def flat(labels: DataFrame) -> DataFrame:
    """Every vertex's root in the forest of (v, to)."""
    while True:
        # Where a root is the target there is nothing to follow, so a star's leaves never meet in a task.
        up = labels.where("v <> to").select(F.col("v").alias("to"), F.col("to").alias("up"))
        if labels.where("v <> to").join(up, "to", "left_semi").isEmpty():
            return labels
        labels = stored(labels.join(up, "to", "left").select("v", F.coalesce("up", "to").alias("to")), "labels")
