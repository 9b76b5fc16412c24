"""The overlap filter: thresholds chosen from robust statistics, then load, duplicate, coverage, support, containment
and best-n steps, each a DataFrame to DataFrame step that tags what it drops with a reason."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import Stages
from .overlap import aligned_length, best_of_pair, by_read, common_counts, load_filter, location, longest_first, overhangs, read_statistics
from .quantiles import first_trough, percentile, weighted_median_mad

MAD = 1.4826


def _normal_statistics(df: DataFrame) -> DataFrame:
    """Statistics of reads over roughly normal overlaps, written because every narrowing step reads them."""
    return Stages(df.sparkSession, "statistics").keep(read_statistics(df.where((F.col("ident") > 70) & (location(1000) != "Abnormal"))), "reads")


def auto_identity(df: DataFrame, sigmas: float = 6.0) -> float | None:
    """Lower limit of identity: weighted median of reads' mean identity less ``sigmas`` deviations; weight length // 1000."""
    stats = _normal_statistics(df)
    median, mad = weighted_median_mad(stats, F.col("mean_ident"), F.floor(F.col("len") / 1000))
    return None if median is None else round(median - sigmas * MAD * mad, 6)


def auto_overhang(df: DataFrame, sigmas: float = 6.0) -> int | None:
    """Upper limit of overhangs: weighted median of reads' largest plus ``sigmas`` deviations; weight length // 100."""
    stats = _normal_statistics(df)
    median, mad = weighted_median_mad(stats, F.col("max_overhang"), F.floor(F.col("len") / 100))
    return None if median is None else math.floor(median + sigmas * MAD * mad)


def local_statistics(df: DataFrame) -> DataFrame:
    """Per read the weighted median and deviation of its overlaps' identities (by identity and aligned length) and of its
    overhangs (by aligned length; null where the read has none), exact and for all reads at once: (read, ident,
    ident_mad, overhang, overhang_mad).

    Identities count in hundredths, so that all weights are whole. A read has at most 10,001 of them and as many
    overhangs as it has bases, so equal values are added up and one exchange by read brings each read's values together;
    medians and deviations follow there. Nothing is written.
    """
    q, s = overhangs()
    rows = df.select("qid", "sid", F.round(F.col("ident") * 100).cast("int").alias("hundredths"), aligned_length().alias("alen"), q.alias("oh_q"), s.alias("oh_s"))
    # An identity at its hundredths, an overhang at -1 and less; one array of both reads' values, worked out once a row.
    one = lambda read, at: F.struct(F.col(read).alias("read"), at.alias("at"), F.col("alen"))
    hang = lambda oh: F.when(F.col(oh) >= 0, -1 - F.col(oh))
    values = F.array(*[one(read, at) for read, oh in (("qid", "oh_q"), ("sid", "oh_s")) for at in (F.col("hundredths"), hang(oh))])
    both = rows.select(F.inline(values)).where("at <> 0 and alen > 0").groupBy("read", "at").agg(F.sum(F.col("alen").cast("long")).alias("alen"))
    own = F.col("at") > 0
    dealt = both.repartition("read").select("read", own.cast("int").alias("of"), F.when(own, F.col("at") / 100).otherwise((-1 - F.col("at")).cast("double")).alias("v"), F.when(own, F.col("at") * F.col("alen")).otherwise(F.col("alen")).alias("w"))
    all_ = Window.partitionBy("read", "of")

    def median(df: DataFrame, v: str, name: str) -> DataFrame:
        upto = df.withColumn("_u", F.sum("w").over(all_.orderBy(v)))
        return upto.withColumn(name, F.min(F.when(2 * F.col("_u") >= F.col("_a"), F.col(v))).over(all_))

    found = median(dealt.withColumn("_a", F.sum("w").over(all_)), "v", "median")
    found = median(found.withColumn("d", F.abs(F.col("v") - F.col("median"))), "d", "mad")
    pick = lambda of, c: F.max(F.when(F.col("of") == of, F.col(c)))
    named = found.groupBy("read").agg(pick(1, "median").alias("ident"), pick(1, "mad").alias("ident_mad"), pick(0, "median").alias("overhang"), pick(0, "mad").alias("overhang_mad"))
    return named.where("ident is not null")


def local_limits(df: DataFrame, least_identity: float, most_overhang: float, sigmas: float = 6.0) -> DataFrame:
    """(read, min_ident, max_overhang): what a read's own overlaps ask for, never stricter than the two given values."""
    low = F.least(F.round(F.col("ident") - sigmas * MAD * F.col("ident_mad"), 6), F.lit(float(least_identity)))
    high = F.when(F.col("overhang").isNotNull(), F.greatest(F.round(F.col("overhang") + sigmas * MAD * F.col("overhang_mad"), 6), F.lit(float(most_overhang))))
    return local_statistics(df).select("read", low.alias("min_ident"), high.alias("max_overhang"))


def local_dropped(df: DataFrame, limits: DataFrame, least_identity: float = math.inf, most_overhang: float = -1.0) -> DataFrame:
    """Overlaps (qid, sid) that one of their reads' own limits drops: too little identity or too long an overhang of it.

    No limit is stricter than ``least_identity`` and ``most_overhang``, so only overlaps beyond these meet the limits.
    """
    q, s = overhangs()
    rows = df.select("qid", "sid", "ident", q.alias("oh_q"), s.alias("oh_s"))
    rows = rows.where((F.col("ident") < float(least_identity)) | (F.col("oh_q") > float(most_overhang)) | (F.col("oh_s") > float(most_overhang)))
    for side, oh in (("qid", "oh_q"), ("sid", "oh_s")):
        own = limits.select(F.col("read").alias(side), F.col("min_ident").alias(f"low_{side}"), F.col("max_overhang").alias(f"high_{side}"))
        rows = rows.join(own, side, "left")
    out = [(F.col("ident") < F.col(f"low_{side}")) | ((F.col(oh) >= 0) & (F.col(oh) > F.col(f"high_{side}"))) for side, oh in (("qid", "oh_q"), ("sid", "oh_s"))]
    return rows.where(F.coalesce(out[0], F.lit(False)) | F.coalesce(out[1], F.lit(False))).select("qid", "sid").distinct()


def coverage(df: DataFrame) -> DataFrame:
    """Least and most overlaps over the positions of each read: read, len, cov_min, cov_max.

    Starts and ends are added up per position first; the ends of the read count as positions without change. A read's
    length goes along at its position 0 alone, and of ``df`` only ids, offsets and lengths are read.
    """
    at = lambda read, pos, d, size: F.struct(F.col(read).alias("read"), pos.alias("pos"), F.lit(d).alias("d"), size.alias("len"))
    none, sides = F.lit(None), (("qid", "qoff", "qend", "qsize"), ("sid", "soff", "send", "ssize"))
    ends = [e for read, a, z, size in sides for e in (at(read, F.col(a), 1, none), at(read, F.col(z), -1, none), at(read, F.lit(0), 0, F.col(size)))]
    steps = df.select(F.inline(F.array(*ends))).groupBy("read", "pos").agg(F.sum("d").alias("d"), F.max("len").alias("len"))
    own = Window.partitionBy("read")
    inside = steps.withColumns({"depth": F.sum("d").over(own.orderBy("pos")), "len": F.max("len").over(own)}).where("pos < len")
    return inside.groupBy("read").agg(F.max("len").alias("len"), F.min("depth").alias("cov_min"), F.max("depth").alias("cov_max"))


def coverage_limits(cov: DataFrame, discard: float = 0.01) -> tuple[int, int, int]:
    """Least minimum (first trough of minima), most maximum and most difference (upper percentiles)."""
    low = first_trough(cov, F.col("cov_min")).first()[0]
    if low is None:
        return 0, 0, 0
    difference = F.col("cov_max") - F.col("cov_min")
    return low, int(percentile(cov, F.col("cov_max"), 100 - discard)), int(percentile(cov, difference, 100 - discard))


def coverage_dropped(cov: DataFrame, limits: tuple[int, int, int]) -> DataFrame:
    """Reads outside the limits."""
    return cov.where((F.col("cov_min") < limits[0]) | (F.col("cov_max") > limits[1]) | (F.col("cov_max") - F.col("cov_min") > limits[2]))


def contained_reads(df: DataFrame) -> DataFrame:
    """Reads that an overlap shows inside another: read, container (smallest). Of equal reads the larger id goes."""
    loc = location(0)
    q, s = F.col("qid"), F.col("sid")
    inner = F.when(loc == "Contained", q).when(loc == "Containing", s).when(loc == "Equal", F.greatest(q, s))
    outer = F.when(loc == "Contained", s).when(loc == "Containing", q).when(loc == "Equal", F.least(q, s))
    return df.select(inner.alias("read"), outer.alias("container")).where("read is not null").groupBy("read").agg(F.min("container").alias("container"))


def without_reads(df: DataFrame, reads: DataFrame) -> DataFrame:
    """Overlaps of which neither read is in ``reads``."""
    for side in ("qid", "sid"):
        df = df.join(reads.select(F.col("read").alias(side)), side, "left_anti")
    return df


def neighbours(df: DataFrame, reach: int) -> DataFrame:
    """Adjacency (read, other, at0, at1): whether the overlap touches the read's begin and end, up to ``reach`` bases."""
    return by_read(df).select("read", "other", (F.col("start") <= reach).alias("at0"), (F.col("len") - F.col("end") <= reach).alias("at1"))


def supported(df: DataFrame, count: int, reach: int) -> DataFrame:
    """Overlaps of unordered pairs with, at every end they reach past, at least ``count`` common neighbours.

    df: one overlap a pair. Neighbours common to both reads are counted by words of 64 read ids, per pair and end.
    """
    found = common_counts(df, neighbours(df, reach), "at0", "at1")
    counts = found.select("qid", "sid", *[F.col(f"{c[0]}_at{c[1]}").alias(f"n_{c}") for c in ("q0", "q1", "s0", "s1")])
    loc, same = location(0), F.col("qdir") == F.col("sdir")
    n = lambda c: F.coalesce(F.col(f"n_{c}"), F.lit(0)) >= max(count, 1)
    q_whole, s_whole = n("q0") & n("q1"), n("s0") & n("s1")
    ok = (
        F.when((loc == "Left") & same, n("q1") & n("s0")).when((loc == "Right") & same, n("q0") & n("s1"))
        .when(loc == "Left", n("q0") & n("s0")).when(loc == "Right", n("q1") & n("s1"))
        .when(loc == "Containing", s_whole).when(loc == "Contained", q_whole).when(loc == "Equal", q_whole & s_whole).otherwise(False)
    )
    return df.join(counts, ["qid", "sid"], "left").where(ok).select(df.columns)


def best_n(df: DataFrame, n: int = 10) -> DataFrame:
    """Overlaps among the ``n`` longest aligned at an end of either of their reads (proper overlaps only)."""
    rows = df.withColumns({"alen": aligned_length(), "loc": location(0)}).where("loc in ('Left', 'Right')")
    sides = by_read(rows)
    own = F.when(F.col("read") == F.col("qid"), F.col("loc")).otherwise(F.when((F.col("qdir") == F.col("sdir")) & (F.col("loc") == "Left"), "Right").when((F.col("qdir") == F.col("sdir")) & (F.col("loc") == "Right"), "Left").otherwise(F.col("loc")))
    ranked = sides.withColumn("side", own).withColumn("rank", F.row_number().over(longest_first("read", "side"))).where(F.col("rank") <= n)
    return ranked.select(df.columns).distinct()


def tagged(df: DataFrame, kept: DataFrame, reason: str) -> DataFrame:
    """``df`` with a reason where a row (one a pair) is not among the kept ones and has none yet."""
    marks = kept.select("qid", "sid", F.lit(True).alias("_kept"))
    return df.join(marks, ["qid", "sid"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_kept").isNull(), reason))).drop("_kept")


def report(tagged_rows: DataFrame) -> DataFrame:
    """Overlaps by reason, and all of them."""
    return tagged_rows.rollup(F.coalesce("reason", F.lit("kept")).alias("why")).agg(F.count("*").alias("overlaps")).select(F.coalesce("why", F.lit("total")).alias("reason"), "overlaps")


def limits(df: DataFrame, min_length: int = 2500, min_aligned: int = 2000) -> dict[str, float]:
    """All automatic thresholds."""
    return {"min_identity": auto_identity(df) or 0.0, "max_overhang": auto_overhang(df) or 0, "min_length": min_length, "min_aligned": min_aligned, "max_length": 2**31 - 1}


def run(df: DataFrame, min_identity: float, max_overhang: int, min_length: int = 2500, min_aligned: int = 2000, n: int = 10, discard: float = 0.01, keep=lambda x, name: x) -> DataFrame:
    """All steps in order; the rows of the load step with a nullable reason. ``keep`` writes a table between steps."""
    from .overlap import snap_ends

    loaded = keep(best_of_pair(snap_ends(load_filter(df, min_identity, min_length, 2**31 - 1, min_aligned, max_overhang), max_overhang)), "loaded")
    out = loaded.withColumn("reason", F.lit(None).cast("string"))
    cov = keep(coverage(loaded), "coverage")
    cuts = coverage_limits(cov, discard)
    rest = keep(without_reads(loaded, coverage_dropped(cov, cuts)), "covered")
    out = tagged(out, rest, "Coverage")
    rest = keep(supported(rest, max(0, cuts[0] - 1), max_overhang), "supported")
    out = tagged(out, rest, "LackOfSupport")
    rest = keep(without_reads(rest, contained_reads(rest)), "proper")
    out = tagged(out, rest, "Contained")
    return tagged(out, best_n(rest, n), "BestN")
