"""Reads by where they lie on references: one best placing each, which references they belong to, and which pairs of
placed reads can overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bases that ends may miss in tags.
REACH = 200


def placed_tags(hits: DataFrame, reach: int = REACH) -> DataFrame:
    """(read, tag, sid, qoff, qend, qsize, soff, send): each read's longest hit (ties: more identical, smaller subject
    and offsets), perfect if it holds the whole read up to ``reach`` bases, else unperfect."""
    rank = F.struct((F.col("qend") - F.col("qoff")).alias("a"), F.col("ident").alias("b"), (-F.col("sid")).alias("c"), (-F.col("qoff")).alias("d"), (-F.col("soff")).alias("e"))
    one = hits.groupBy(F.col("qid").alias("read")).agg(F.max_by(F.struct("sid", "qoff", "qend", "qsize", "soff", "send"), rank).alias("b")).select("read", "b.*")
    whole = (F.col("qoff") <= reach) & (F.col("qsize") - F.col("qend") <= reach)
    return one.select("read", F.when(whole, "perfect").otherwise("unperfect").alias("tag"), "sid", "qoff", "qend", "qsize", "soff", "send")


def valid_pairs(pairs: DataFrame, tags: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs (qid, sid) of tagged reads with ``valid``: whether their placings let the query vote for the subject.

    Two perfect reads have to meet on one reference: their parts of it share a base, or one holds the other up to
    ``reach``. A perfect and a circular one have to meet near where the circular one's parts lie: the perfect one ends
    in what the circular one's tail covers or reaches its part. Circular reads vote for each other; an unperfect read
    votes for any but a circular one, and every read for an unperfect one. Pairs with an untagged read have no row.
    """
    side = lambda p, key: tags.select(F.col("read").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("tag", "sid", "qend", "qsize", "soff", "send")]).hint("merge")
    # A row a read, however small its file: tags are never broadcast.
    rows = pairs.select("qid", "sid").join(side("q", "qid"), "qid").join(side("s", "sid"), "sid")
    c = F.col
    share = F.greatest("q_soff", "s_soff") <= F.least("q_send", "s_send")
    inside = lambda a, b: (c(f"{a}_soff") + reach >= c(f"{b}_soff")) & (c(f"{a}_send") <= c(f"{b}_send") + reach)
    together = (c("q_sid") == c("s_sid")) & (share | inside("q", "s") | inside("s", "q"))
    ring = lambda flat, round_: (c(f"{flat}_send") <= c(f"{round_}_qsize") - c(f"{round_}_qend") + reach) | (c(f"{flat}_send") + reach >= c(f"{round_}_soff"))
    q, s = c("q_tag"), c("s_tag")
    valid = (
        F.when(s == "unperfect", True).when(q == "unperfect", s != "circular").when((q == "circular") & (s == "circular"), True)
        .when(s == "circular", ring("q", "s")).when(q == "circular", ring("s", "q")).otherwise(together)
    )
    return rows.select("qid", "sid", "q_tag", "s_tag", valid.alias("valid"))


def places(hits: DataFrame, least_size: int = 1000, reach: int = 50, share: float = 0.6, least_identity: float = 80.0) -> DataFrame:
    """(read, kind, sid): the references that each read of ``least_size`` bases belongs to.

    A hit is an end hit if it takes up the whole read or the whole reference up to ``reach``, a crossing one if it leaves
    over an end of each and is ``share`` of either. A read's only end hit decides (kind end), or without any its only
    crossing one (crossing), if identical enough; of reads with several such hits none does. A read with neither belongs
    wherever identical enough hits are ``share`` of either (part).
    """
    c = F.col
    begins, ends, starts, stops = c("qoff") <= reach, c("qsize") - c("qend") <= reach, c("soff") <= reach, c("ssize") - c("send") <= reach
    large = (c("qend") - c("qoff") >= c("qsize") * share) | (c("send") - c("soff") >= c("ssize") * share)
    rows = hits.where(c("qsize") >= least_size).select(c("qid").alias("read"), "sid", (c("ident") >= least_identity).alias("fine"), ((begins & ends) | (starts & stops)).alias("whole"), (((starts & ends) | (begins & stops)) & large).alias("cross"), large.alias("large"))
    seen = rows.groupBy("read").agg(F.count_if("whole").alias("n_whole"), F.count_if("cross").alias("n_cross"))
    at = rows.where("fine").join(seen, "read")
    kind = F.when((c("n_whole") == 1) & c("whole"), "end").when((c("n_whole") == 0) & (c("n_cross") == 1) & c("cross"), "crossing").when((c("n_whole") == 0) & (c("n_cross") == 0) & c("large"), "part")
    return at.select("read", kind.alias("kind"), "sid").where("kind is not null").distinct()
