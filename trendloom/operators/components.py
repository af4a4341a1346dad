"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.plans.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(u, v) edges of any orderable type -> (node, component), component the smallest node reachable.

    Each round points every node at its smallest neighbour (or itself), shortens those
    pointers once, and replaces the edges' ends by what they point at; edges whose ends meet
    vanish. The rounds' pointer tables, followed one after the other, give the component.
    Minima are taken by aggregates with map-side partials, so a node with many edges is no
    hot spot, and no neighbour list is ever built. Nodes without edges don't appear; edges
    with a null end and loops are ignored; no edges give an empty table.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    left = scratch.save(edges.select("u", "v").where("u < v or v < u").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("u").alias("node"), F.col("v").alias("other")).union(left.select(F.col("v"), F.col("u")))
        point = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("to"))
        point = scratch.save(point, "point")
        up = point.select(F.col("node").alias("to"), F.col("to").alias("top"))
        point2 = scratch.save(point.join(up, "to").select("node", F.col("top").alias("to")), "jump")
        scratch.drop(point)
        a = point2.select(F.col("node").alias("u"), F.col("to").alias("pu"))
        b = point2.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        met = left.join(a, "u").join(b, "v").where("pu <> pv")
        nxt = scratch.save(met.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        scratch.drop(left)
        left = nxt
        rounds.append(point2)
    if not rounds:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = rounds[-1].select("node", F.col("to").alias("component"))
    for earlier in reversed(rounds[:-1]):
        later = out.select(F.col("node").alias("to"), "component")
        out = earlier.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    return out
