"""Chains of items that each point to the next one: names and places by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chains(items: DataFrame, links: DataFrame, keep) -> DataFrame:
    """(chain, pos, e): every item's chain, named by its first item, and its place in it from 0.

    items: e. links: e, next; no item has two next ones or two before it. Each item points to the one before, and
    pointers are doubled, so the rounds grow with the logarithm of the longest chain; what an item has reached is one
    row. A ring is cut before its smallest item. ``keep`` writes a table and reads it back.
    """
    before = links.select(F.col("next").alias("e"), F.col("e").alias("prev"))
    rows = keep(items.join(before, "e", "left"), "items")
    state = keep(rows.select("e", F.coalesce("prev", "e").alias("at"), F.col("prev").isNotNull().cast("int").alias("hops"), F.col("prev").isNull().alias("done"), F.least("e", F.coalesce("prev", "e")).alias("low")), "chain0")
    total, step = rows.count(), 0
    while (1 << step) <= 2 * total and state.where("not done").limit(1).count():
        step += 1
        further = state.select(F.col("e").alias("at"), F.col("at").alias("at2"), F.col("hops").alias("hops2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        open_ = state.where("not done").join(further, "at").select("e", F.col("at2").alias("at"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"))
        # What is done does not change and is not written again.
        state = state.where("done").unionByName(keep(open_, f"chain{step}"))
    found = state.where("done").select(F.col("at").alias("chain"), F.col("hops").alias("pos"), "e")
    rings = state.where("not done").select("e", F.col("low").alias("first"))
    if rings.limit(1).count():
        # Who has passed every chain's length is on a ring, and has seen its smallest item.
        cut = rings.join(rows, "e").where("e <> first").select("e", F.col("prev").alias("before"))
        again = chains(rings.select("e"), cut.select(F.col("before").alias("e"), F.col("e").alias("next")), keep)
        found = found.unionByName(again)
    return found
