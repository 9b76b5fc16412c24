"""Cleaning of the string graph before paths: chimeric nodes and edges that a resolved repeat leaves over.

``live`` are the edges left, ``whole`` those of the whole graph, removed ones too; both hold every edge's reverse.
Sets of nodes are rows, compared by joins; none is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import with_reverses


def _many(es: DataFrame, by: str, other: str) -> DataFrame:
    """Ends ``other`` of edges whose ``by`` has more than one of them."""
    ends = es.select(by, other).distinct()
    more = ends.groupBy(by).agg(F.count("*").alias("n")).where("n > 1").select(by)
    return ends.join(more, by, "left_semi").select(F.col(other).alias("node")).distinct()


def chimeras(live: DataFrame, whole: DataFrame, hops: int, keep) -> DataFrame:
    """Nodes between unrelated parts of the graph.

    Such a node is one of several next to a node before it and one of several before a node after it. What follows it
    and what else follows the nodes before it have nothing in common, themselves and all that up to ``hops`` - 1 edges
    lead to without the node. A node without an edge left ends such a way, unless the way starts there.
    """
    all_ = whole.select("src", "dst").distinct()
    suspects = keep(_many(live, "src", "dst").join(_many(live, "dst", "src"), "node", "left_semi"), "suspects")
    after = suspects.join(all_.withColumnRenamed("src", "node"), "node").select("node", F.col("dst").alias("at"), F.lit(1).alias("side"))
    beside = suspects.join(all_.withColumnRenamed("dst", "node"), "node").join(all_.withColumnRenamed("dst", "at"), "src").where("at <> node").select("node", "at", F.lit(2).alias("side"))
    reached = step = keep(after.union(beside).distinct(), "reach0")
    goes_on = live.select(F.col("src").alias("at")).distinct()
    for hop in range(1, hops):
        ways = step if hop == 1 else step.join(goes_on, "at", "left_semi")
        new = ways.join(all_.withColumnRenamed("src", "at"), "at").where("dst <> node").select("node", F.col("dst").alias("at"), "side").distinct()
        step = keep(new.join(reached, ["node", "at", "side"], "left_anti"), f"step{hop}")
        reached = reached.union(step)
    reached = keep(reached, "reach")
    met = reached.groupBy("node", "at").agg(F.count("*").alias("sides")).where("sides > 1").select("node").distinct()
    return suspects.join(met, "node", "left_anti")


def edges_at(live: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) left at ``nodes``, with their reverses."""
    out = live.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")
    return with_reverses(out.union(live.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")))


def _degree(es: DataFrame, by: str, name: str) -> DataFrame:
    return es.groupBy(by).agg(F.count("*").alias(name))


def repeat_edges(live: DataFrame, whole: DataFrame) -> DataFrame:
    """Edges (src, dst) beside a node through which one way leads, with their reverses.

    The node has one edge in, from u, and one out, to w. Another edge of u goes if its end has further edges in and
    nothing in the whole graph follows both that end and the node; another edge into w goes likewise, seen backwards.
    As the graph holds all reverses, the second is the first of the reverse nodes.
    """
    through = _degree(live, "dst", "n").where("n = 1").select(F.col("dst").alias("node")).join(_degree(live, "src", "n").where("n = 1").select(F.col("src").alias("node")), "node", "left_semi")
    into = live.select("src", F.col("dst").alias("node")).join(through, "node", "left_semi")
    entered = _degree(live, "dst", "n").where("n > 1").select("dst")
    beside = into.join(live.select("src", "dst"), "src").where("dst <> node").join(entered, "dst", "left_semi").select("node", "src", "dst")
    all_ = whole.select("src", "dst").distinct()
    # Counted over all of a pair's ways: a pair with one in common stays.
    shared = beside.select("node", "dst").distinct().join(all_.select(F.col("src").alias("node"), F.col("dst").alias("x")), "node").join(all_.select(F.col("src").alias("dst"), F.col("dst").alias("x")), ["dst", "x"]).select("node", "dst").distinct()
    return with_reverses(beside.join(shared, ["node", "dst"], "left_anti").select("src", "dst"))
