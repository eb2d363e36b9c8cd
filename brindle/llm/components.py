"""Connected components of an edge table, by contraction.

Each round every node points to the smallest of itself and its neighbours,
pointers are followed to their ends (each step goes three times as far), and
the edges are rewritten between those ends; edges inside a group vanish.  All
state is in tables of the shared folder.  The smallest node of a component
always points to itself, so what is left of a component is its smallest node.

Rounds grow with the logarithm of the number of nodes.  A node that points to
itself is smaller than its neighbours; either all of those point to it, or one
of them leads to a smaller end, which becomes its neighbour, and it points
there in the next round.  So after two rounds every end has taken in another
node, and at most half are left.  A sorted chain takes a single round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _ends(step: DataFrame) -> DataFrame:
    """(u, p) with every pointer p followed to its end."""
    while True:
        hop = step.select(F.col("u").alias("p"), F.col("p").alias("q"))
        jump = step.join(hop, "p").join(hop.select(F.col("p").alias("q"), F.col("q").alias("r")), "q")
        # A pointer is at its end where the last hop led nowhere else.
        step = common.materialize(jump.select("u", F.col("r").alias("p"), (F.col("q") == F.col("r")).alias("ended")), "cc-jump")
        if step.filter("not ended").isEmpty():
            return step.drop("ended")
        step = step.drop("ended")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the
    smallest node reachable.  Nulls and loops are ignored; an empty table gives
    an empty result."""
    e = edges.select("a", "b").filter("a <> b")
    e = common.materialize(e.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*").distinct(), "cc-edges")
    labels = None
    while True:
        step = common.materialize(e.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), "cc-step")
        jump = _ends(step)
        if labels is None:
            labels = jump.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            moved = jump.select(F.col("u").alias("component"), F.col("p").alias("to"))
            labels = common.materialize(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "cc-labels")
        left, right = jump.select("u", F.col("p").alias("pu")), jump.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        e = common.materialize(e.join(left, "u").join(right, "v").filter("pu <> pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "cc-edges")
        if e.isEmpty():
            return labels
