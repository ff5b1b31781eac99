"""Connected components of a stored edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landflux.llm.store import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being its smallest node.

    Each round hooks every node to its smallest smaller neighbour, follows those
    hooks to their ends by pointer doubling, and replaces the ends of every edge
    by them. A node that is not the smallest of its neighbourhood vanishes from
    the edges, so they shrink by half a round at least; edges within one
    contracted node and repeats are dropped. All state is in stored tables; no
    group is gathered, as each step is a minimum or a join with one side unique.
    """
    live = store.keep(_ordered(edges))
    hooks = []
    while not live.isEmpty():
        parent = store.keep(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent")))
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            doubled = store.keep(
                parent.join(up, "parent", "left").select(
                    "node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
                )
            )
            moved = not doubled.filter("moved").isEmpty()
            store.drop(parent)
            parent = doubled
            if not moved:
                break
        hooks.append(parent.select("node", "parent"))
        ends = hooks[-1]
        renamed = live.join(ends.select(F.col("node").alias("hi"), F.col("parent").alias("h")), "hi", "left").join(
            ends.select(F.col("node").alias("lo"), F.col("parent").alias("l")), "lo", "left"
        )
        contracted = store.keep(
            _ordered(renamed.select(F.coalesce("h", "hi").alias("a"), F.coalesce("l", "lo").alias("b")))
        )
        store.drop(live)
        live = contracted
    if not hooks:
        return live.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    label = hooks.pop()
    while hooks:
        above = label.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        below = hooks.pop()
        label = store.keep(
            below.join(above, "parent", "left")
            .select("node", F.coalesce("above", "parent").alias("parent"))
            .unionByName(label)
        )
    roots = label.select(F.col("parent").alias("node")).distinct().withColumn("component", F.col("node"))
    return label.withColumnRenamed("parent", "component").unionByName(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct (hi, lo) of the edges that join two nodes."""
    return (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
