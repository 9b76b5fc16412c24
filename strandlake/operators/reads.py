"""Length statistics, longest-reads selection, volumes and k-mer spectra of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import kmer_number
from ..plans.stages import Stages
from .ids import dense_ids, running_starts

#: Bases of the pieces that k-mers are cut from.
PIECE = 256


def length_histogram(reads: DataFrame) -> DataFrame:
    """len, n and the running sums from the longest down: n_upto, mass_upto. As many rows as there are lengths."""
    counts = reads.groupBy("len").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("len"))
    return counts.withColumn("mass", F.col("len").cast("long") * F.col("n")).withColumns({"n_upto": F.sum("n").over(down), "mass_upto": F.sum("mass").over(down)})


def n_statistics(reads: DataFrame, percents: tuple[int, ...] = tuple(range(10, 100, 10)), strict: bool = False) -> DataFrame:
    """Nx and Lx: the length at which the running sum from the longest reaches (strict: passes) x percent of all bases."""
    hist = length_histogram(reads)
    total = hist.agg(F.sum("mass").alias("total"))
    marks = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    rows = hist.crossJoin(F.broadcast(total)).select("*", marks)  # one row against one, then a few marks
    need = F.col("total") * F.col("percent")
    before = (F.col("mass_upto") - F.col("mass")) * 100
    reached = (F.col("mass_upto") * 100 > need) if strict else (F.col("mass_upto") * 100 >= need)
    missed = (before <= need) if strict else (before < need)
    per = F.col("len").cast("long") * 100
    more = (F.floor((need - before) / per) + 1) if strict else F.ceil((need - before) / per)
    l_value = F.col("n_upto") - F.col("n") + F.greatest(more, F.lit(1))
    return rows.where(reached & missed).groupBy("percent").agg(F.max(F.struct("len", l_value.cast("long").alias("l"))).alias("b")).select("percent", F.col("b.len").alias("n_length"), F.col("b.l").alias("l_count"))


def length_summary(reads: DataFrame) -> DataFrame:
    """Number, bases, mean, extremes and the element at place n // 2 from the longest."""
    hist = length_histogram(reads)
    totals = hist.agg(F.sum("n").alias("reads"), F.sum("mass").alias("bases"), F.max("len").alias("longest"), F.min("len").alias("shortest"))
    middle = hist.crossJoin(F.broadcast(totals.select("reads"))).where((F.col("n_upto") > F.floor(F.col("reads") / 2)) & (F.col("n_upto") - F.col("n") <= F.floor(F.col("reads") / 2))).select(F.col("len").alias("median"))
    return totals.crossJoin(F.broadcast(middle)).withColumn("mean", F.floor(F.col("bases") / F.col("reads")).cast("long"))


def longest_cutoff(reads: DataFrame, goal: int) -> DataFrame:
    """Length at which the longest reads add up to ``goal`` bases (0 if never), and what keeping all at least as long gives."""
    hist = length_histogram(reads)
    cut = hist.agg(F.coalesce(F.max(F.when(F.col("mass_upto") >= goal, F.col("len"))), F.lit(0)).alias("cutoff"))
    return hist.join(F.broadcast(cut), F.col("len") >= F.col("cutoff")).groupBy("cutoff").agg(F.sum("n").alias("reads"), F.sum("mass").alias("bases"))


def longest_prefix(reads: DataFrame, goal: int) -> DataFrame:
    """The fewest longest reads (ties: smaller read_id) that reach ``goal`` bases."""
    hist = length_histogram(reads)
    need = F.greatest(F.lit(0), F.ceil((F.lit(goal) - (F.col("mass_upto") - F.col("mass"))) / F.col("len")))
    taken = hist.select("len", F.least("n", need).cast("long").alias("take"), "n").where("take > 0")
    whole = reads.join(F.broadcast(taken.where("take = n").select("len")), "len", "left_semi").select("read_id", "len")
    # Only the last length is cut; its first ids are few rows of one known length.
    last = reads.join(F.broadcast(taken.where("take < n").select("len", "take")), "len")
    rank = F.row_number().over(Window.partitionBy("len").orderBy("read_id"))
    return whole.union(last.withColumn("r", rank).where("r <= take").select("read_id", "len"))


def _volume_starts(spark: SparkSession, reads: DataFrame, most_bases: int, most_reads: int) -> tuple[DataFrame, DataFrame]:
    """All reads (place, read_id, before, upto) in order, and the places where a volume starts, both written.

    No task walks over all reads. Every read gets its place and the bases before it from range partitions; where a
    volume that starts with it would end is the first place with ``most_bases`` more before it, looked up in one sorted
    exchange, or ``most_reads`` further on. From the first read on, these pointers lead from volume to volume; they are
    doubled, so the rounds grow with the logarithm of the number of volumes.
    """
    st = Stages(spark, "volumes")
    placed = dense_ids(reads.select("read_id", "len"), "read_id", "place")
    rows = st.keep(running_starts(placed, "place", "len", "before").select("place", "read_id", "before", (F.col("before") + F.col("len")).alias("upto")), "reads")
    n = rows.count()
    # An end is the place behind a read, at the bases up to it; an asker looks for the first end at its bases or more.
    ends = rows.select(F.col("upto").alias("at"), (F.col("place") + 1).alias("end"), F.lit(None).cast("long").alias("asker"))
    askers = rows.select((F.col("before") + most_bases).alias("at"), F.lit(None).cast("long").alias("end"), F.col("place").alias("asker"))
    sorted_ = st.keep(ends.union(askers).repartitionByRange("at").withColumn("part", F.spark_partition_id()), "sorted")
    down = Window.partitionBy("part").orderBy(F.desc("at"), F.col("asker").isNotNull(), F.desc("end"), "asker")
    inside = F.last("end", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    # The first end of each range, and of the ranges behind it: one row a range.
    firsts = sorted_.groupBy("part").agg(F.min("end").alias("first"))
    behind = firsts.select("part", F.min("first").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)).alias("behind"))
    found = sorted_.withColumn("inside", inside).where("asker is not null").join(F.broadcast(behind), "part")
    jump = found.select(F.col("asker").alias("place"), F.least(F.coalesce("inside", "behind", F.lit(n).cast("long")), F.col("asker") + most_reads, F.lit(n).cast("long")).alias("to"))
    jump = st.keep(jump, "jumps")
    starts = st.keep(rows.where("place = 0").select("place"), "starts")
    while True:
        more = starts.join(jump, "place").where(F.col("to") < n).select(F.col("to").alias("place"))
        grown = st.keep(starts.union(more).distinct(), "starts")
        if grown.count() == starts.count():
            break
        starts = grown
        jump = st.keep(jump.join(jump.select(F.col("place").alias("to"), F.col("to").alias("to2")), "to").select("place", F.col("to2").alias("to")), "jumps")
    return rows, starts


def volumes(spark: SparkSession, reads: DataFrame, most_bases: int, most_reads: int) -> DataFrame:
    """Volumes of consecutive reads: one closes when it has reached either limit; volume 0 is the whole."""
    rows, starts = _volume_starts(spark, reads, most_bases, most_reads)
    whole = rows.agg(F.min("read_id").alias("first_read"), F.count("*").alias("reads"), F.coalesce(F.max("upto"), F.lit(0).cast("long")).alias("bases"))
    first = rows.join(starts, "place").select("place", "read_id", "before")
    up = Window.orderBy("place")  # a row a volume
    parts = first.crossJoin(F.broadcast(whole.select("reads", "bases"))).select(
        F.row_number().over(up).alias("volume"), F.col("read_id").alias("first_read"), (F.coalesce(F.lead("place").over(up), F.col("reads")) - F.col("place")).alias("reads"), (F.coalesce(F.lead("before").over(up), F.col("bases")) - F.col("before")).alias("bases"),
    )
    return whole.select(F.lit(0).alias("volume"), "first_read", "reads", "bases").union(parts.where("bases > 0"))


def volume_of_reads(spark: SparkSession, reads: DataFrame, most_bases: int, most_reads: int) -> DataFrame:
    """(place, read_id, volume): every read's place from 0 in the order of read_id, and its volume from 1."""
    rows, starts = _volume_starts(spark, reads, most_bases, most_reads)
    marked = rows.select("place", "read_id").join(starts.withColumn("begins", F.lit(1)), "place", "left").na.fill(0, ["begins"])
    return running_starts(marked, "place", "begins", "volumes").select("place", "read_id", (F.col("volumes") + F.col("begins")).cast("int").alias("volume"))


def kmers(reads: DataFrame, k: int, step: int = 1) -> DataFrame:
    """read_id, len, pos, kmer: k-mers of A, C, G and T every ``step`` bases, as numbers (see ``kmer_number``), k up to 18.

    Reads are first cut into pieces of about PIECE bases that overlap by k - 1, in one pass, and k-mers are cut from
    pieces: time grows in proportion to a read's length, and no row carries a whole read. K-mers are numbers from the
    start, so joins and aggregations move 8 bytes for each. Reads are dealt out before: that moves each base once, and
    files of few row groups or a stretch of long reads keep no task behind.
    """
    reads = reads.select("read_id", "len", "seq").repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "read_id")
    size = step * max(1, PIECE // step)
    pieces = F.regexp_extract_all(F.translate("seq", "ACGT", "1234"), F.lit(f"(?=(.{{1,{size + k - 1}}})).{{1,{size}}}"), F.lit(1))
    rows = reads.select("read_id", "len", F.posexplode(pieces).alias("_nth", "_piece")).where(F.length("_piece") >= k)
    starts = F.sequence(F.lit(0), F.least(F.lit(size - 1), F.length("_piece") - k), F.lit(step))
    each = rows.select("read_id", "len", "_nth", "_piece", F.explode(starts).alias("_at"))
    return each.select("read_id", "len", (F.col("_nth") * size + F.col("_at")).alias("pos"), kmer_number(F.col("_piece"), F.col("_at"), k).alias("kmer")).where("kmer is not null")


def kmer_spectrum(reads: DataFrame, k: int) -> DataFrame:
    """How many distinct k-mers occur so often."""
    return kmers(reads, k).groupBy("kmer").agg(F.count("*").alias("occ")).groupBy("occ").agg(F.count("*").alias("kmers"))
