"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.scratch import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """Links (a long, b long) -> (node, component) for each node of a link between two nodes; component is its smallest node.

    Each round hangs every node below the smallest of itself and its neighbours, lets each node jump to its parent's parent
    until all hang below a root, and draws the links between roots that are left.  A component's smallest node is a root in
    all rounds.  The nodes that have a smaller neighbour are gone after a round, and those that were linked to one of these
    after the next, so that two rounds halve the nodes with links at least; jumps double the way each time.  Links with a
    null end, to itself or given again add nothing.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = None
    while not edges.isEmpty():
        root = _hung(edges)
        a, b = root.toDF("a", "to_a"), root.toDF("b", "to_b")
        moved = edges.join(a, "a").join(b, "b").where("to_a <> to_b")
        left = stored(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        dropped(edges)
        edges = left
        if out is None:
            out = root
        else:
            further = root.toDF("to", "next")
            whole = stored(out.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "roots")
            dropped(out, root)
            out = whole
    dropped(edges)
    return out.toDF("node", "component")


def _hung(edges: DataFrame) -> DataFrame:
    """(node, to): the root of the tree in which each node has the smallest of itself and its neighbours as its parent."""
    ends = edges.union(edges.select("b", "a"))
    root = stored(ends.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to")), "roots")
    while True:
        further = root.where("node <> to").toDF("to", "next")  # of the nodes that are no roots themselves
        jumps = root.join(further, "to")
        if jumps.isEmpty():
            return root
        jumped = stored(root.join(further, "to", "left").select("node", F.coalesce("next", "to").alias("to")), "roots")
        dropped(root)
        root = jumped
