"""Shortest ways from many starts at once, bucket by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shortest(edges: DataFrame, starts: DataFrame, delta: int, keep, limit: int | None = None) -> DataFrame:
    """(start, node, dist, before): the length of a shortest way from each start to each node it reaches, and the node
    before on one (of several, the smallest). A start reaches itself at 0, with no node before.

    edges: src, dst, len of 0 and more. starts: start. Ways longer than ``limit`` are left out. Distances are settled in
    buckets of ``delta``: edges up to ``delta`` are followed until the bucket does not change, longer ones once, when it
    is settled. A round is a join of the nodes just reached with their edges and one minimum for each (start, node); its
    rows are written. There are about limit / delta buckets, and in each as many rounds as short edges follow one
    another in it.
    """
    short, long = edges.where(F.col("len") <= delta).select("src", "dst", "len"), edges.where(F.col("len") > delta).select("src", "dst", "len")
    within = (lambda df: df) if limit is None else (lambda df: df.where(F.col("dist") <= limit))

    def relaxed(nodes: DataFrame, by: DataFrame) -> DataFrame:
        ways = nodes.withColumnRenamed("node", "src").join(by, "src").select("start", F.col("dst").alias("node"), (F.col("dist") + F.col("len")).alias("dist"))
        return within(ways).groupBy("start", "node").agg(F.min("dist").alias("dist"))

    def better(known: DataFrame, found: DataFrame) -> DataFrame:
        return known.unionByName(found).groupBy("start", "node").agg(F.min("dist").alias("dist"))

    # open: reached, not settled. Each round of a bucket follows only what it has just improved.
    open_ = keep(starts.select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("dist")).distinct(), "open")
    done = None
    while (low := open_.agg(F.min("dist")).first()[0]) is not None:
        end = (low // delta + 1) * delta
        bucket = fresh = keep(open_.where(F.col("dist") < end), "bucket")
        later = open_.where(F.col("dist") >= end)
        pushed: list[DataFrame] = []
        while fresh.limit(1).count():
            found = keep(relaxed(fresh, short), "relaxed")
            pushed.append(found.where(F.col("dist") >= end))
            near = found.where(F.col("dist") < end)
            if done is not None:  # what was settled before is nearer
                near = near.join(done.select("start", "node"), ["start", "node"], "left_anti")
            near = near.join(bucket.withColumnRenamed("dist", "had"), ["start", "node"], "left").where("had is null or dist < had").drop("had")
            fresh = keep(near, "fresh")
            bucket = keep(better(bucket, fresh), "bucket")
        done = bucket if done is None else keep(done.unionByName(bucket), "done")
        for found in (*pushed, relaxed(bucket, long)):
            later = later.unionByName(found)
        open_ = keep(later.groupBy("start", "node").agg(F.min("dist").alias("dist")).join(done.select("start", "node"), ["start", "node"], "left_anti"), "open")
    if done is None:
        return open_.withColumn("before", F.lit(None).cast("int"))
    out = done
    from_ = out.select("start", F.col("node").alias("src"), F.col("dist").alias("dist0")).join(edges.select("src", "dst", "len"), "src")
    step = from_.select("start", F.col("dst").alias("node"), (F.col("dist0") + F.col("len")).alias("dist"), F.col("src").alias("before"))
    return out.join(step, ["start", "node", "dist"], "left").groupBy("start", "node", "dist").agg(F.min(F.when(F.col("start") != F.col("node"), F.col("before"))).alias("before"))
