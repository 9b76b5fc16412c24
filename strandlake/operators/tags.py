"""Tags of sequences by how they lie to others: perfect copies, repeats, contained and clean ones; reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("perfect", "repeat", "circular", "rcdup", "unperfect", "normal")


def sequence_tags(df: DataFrame, tolerance: int = 200, margin: float = 8.0) -> DataFrame:
    """(read, size, tag): the first that holds of perfect, repeat, circular, rcdup, unperfect, normal.

    perfect: lies whole (up to ``tolerance``) on another read; repeat: whole on several, with identities within
    ``margin``; circular: its ends overlap each other through a read of the other strand's direction; rcdup: overlaps
    a read on both strands; unperfect: overlaps reach neither whole read nor its ends; normal: the rest.
    """
    rows = df.select("qid", "sid", "ident", "qsize", ((F.col("qoff") <= tolerance) & (F.col("qsize") - F.col("qend") <= tolerance)).alias("whole"), (F.col("qoff") <= tolerance).alias("at_begin"), (F.col("qsize") - F.col("qend") <= tolerance).alias("at_end"), (F.col("qdir") != F.col("sdir")).alias("turned"))
    pair = rows.groupBy("qid", "sid").agg(F.max("qsize").alias("qsize"), F.max("whole").alias("whole"), F.max(F.when(F.col("whole"), F.col("ident"))).alias("ident"), F.max(F.col("at_begin") & ~F.col("whole")).alias("b"), F.max(F.col("at_end") & ~F.col("whole")).alias("e"), F.max("turned").alias("rev"), F.max(~F.col("turned")).alias("fwd"))
    one = pair.groupBy("qid").agg(F.max("qsize").alias("size"), F.count_if("whole").alias("n_whole"), F.max("ident").alias("hi"), F.min("ident").alias("lo"), F.max(F.col("b") & F.col("e") & ~F.col("rev")).alias("circular"), F.max(F.col("rev") & F.col("fwd")).alias("rcdup"), F.max(F.col("b") | F.col("e")).alias("ends"))
    tag = F.when((F.col("n_whole") > 1) & (F.col("hi") - F.col("lo") <= margin), "repeat").when(F.col("n_whole") > 0, "perfect").when(F.col("circular"), "circular").when(F.col("rcdup"), "rcdup").when(~F.col("ends"), "unperfect").otherwise("normal")
    return one.select(F.col("qid").alias("read"), "size", tag.alias("tag"))


def tag_report(tags: DataFrame) -> DataFrame:
    """Sequences, residues and per cent of residues by tag, and of all."""
    rows = tags.rollup("tag").agg(F.count("*").alias("sequences"), F.sum(F.col("size").cast("long")).alias("residues"))
    total = tags.agg(F.sum(F.col("size").cast("long")).alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(F.coalesce("tag", F.lit("total")).alias("tag"), "sequences", "residues", F.round(F.col("residues") * 100 / F.col("total"), 4).alias("percent"))
