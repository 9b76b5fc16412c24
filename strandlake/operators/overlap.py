"""Overlap algebra as column expressions: where two reads lie to each other, overhangs, end snapping, role changes.

Overlaps have the columns qid, sid, ident, qdir, qoff, qend, qsize, sdir, soff, send, ssize; offsets are half-open and
on the forward strand of each read. The query is the first read (a), the subject the second (b).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

A = ("qid", "qdir", "qoff", "qend", "qsize")
B = ("sid", "sdir", "soff", "send", "ssize")
COLUMNS = ("qid", "sid", "ident", "qdir", "qoff", "qend", "qsize", "sdir", "soff", "send", "ssize")


def same_direction() -> Column:
    return F.col("qdir") == F.col("sdir")


def aligned_length() -> Column:
    """Mean of the two aligned lengths, rounded down."""
    return F.expr("((qend - qoff) + (send - soff)) div 2").cast("int")


def near(x: Column, err: int) -> Column:
    """-1, 0 or 1 as x is under, within ``err`` of, or over 0."""
    return F.when(x < -err, -1).when(x > err, 1).otherwise(0)


def _location(same: bool, qb: int, qe: int, sb: int, se: int) -> str:
    """Location by how the query's begin and end and the subject's lie to their reads' (-1 before, 0 at, 1 after)."""
    if same and (qb, qe, sb, se) == (1, 0, 0, -1) or not same and (qb, qe, sb, se) == (0, -1, 0, -1):
        return "Left"
    if same and (qb, qe, sb, se) == (0, -1, 1, 0) or not same and (qb, qe, sb, se) == (1, 0, 1, 0):
        return "Right"
    if sb == se == 0 and qb >= 0 >= qe:
        return "Equal" if qb == qe == 0 else "Containing"
    return "Contained" if qb == qe == 0 and sb >= 0 >= se else "Abnormal"


#: All cases, the last of the four ends changing fastest.
_LOCATIONS = [_location(same, *ends) for same in (False, True) for ends in product((-1, 0, 1), repeat=4)]


def location(err: int) -> Column:
    """Left, Right, Equal, Containing, Contained or Abnormal: how the query lies to the subject, up to ``err`` bases.

    The four ends make one number, worked out once, that is looked up.
    """
    ends = (F.col("qoff"), F.col("qend") - F.col("qsize"), F.col("soff"), F.col("send") - F.col("ssize"))
    number = same_direction().cast("int")
    for end in ends:
        number = number * 3 + (near(end, err) + 1)
    return F.get(F.array(*[F.lit(x) for x in _LOCATIONS]), number)


def other_view(loc: Column) -> Column:
    """The same overlap's location seen from the subject."""
    return (
        F.when((loc == "Left") & same_direction(), "Right").when((loc == "Right") & same_direction(), "Left")
        .when(loc == "Containing", "Contained").when(loc == "Contained", "Containing").otherwise(loc)
    )


def overhangs() -> tuple[Column, Column]:
    """Query's and subject's unaligned bases at the ends that should align; -1 where a read has no such end.

    Of four layouts (query's start with subject's end or start, the other two ends, query inside, subject inside) the
    first with the smallest larger overhang counts.
    """
    a0, a1 = F.col("qoff"), F.col("qsize") - F.col("qend")
    b0, b1 = F.col("soff"), F.col("ssize") - F.col("send")
    at_start, at_end = F.when(same_direction(), b1).otherwise(b0), F.when(same_direction(), b0).otherwise(b1)
    sizes = [F.greatest(a0, at_start), F.greatest(a1, at_end), F.greatest(a0, a1), F.greatest(b0, b1)]
    least = F.least(*sizes)
    q = F.when(sizes[0] == least, a0).when(sizes[1] == least, a1).when(sizes[2] == least, sizes[2]).otherwise(-1)
    s = F.when(sizes[0] == least, at_start).when(sizes[1] == least, at_end).when(sizes[2] == least, -1).otherwise(sizes[3])
    return q.cast("int"), s.cast("int")


def load_filter(df: DataFrame, min_identity: float, min_length: int, max_length: int, min_aligned: int, max_overhang: int) -> DataFrame:
    """Overlaps of two different reads that are long, identical and aligned enough and have a normal location."""
    sizes = F.col("qsize").between(min_length, max_length) & F.col("ssize").between(min_length, max_length)
    return df.where((F.col("ident") >= min_identity) & (F.col("qid") != F.col("sid")) & sizes & (aligned_length() >= min_aligned) & (location(max_overhang) != "Abnormal"))


def snap_ends(df: DataFrame, reach: int) -> DataFrame:
    """Ends within ``reach`` of their read's end are moved there and the other read's end along; exact ones stay.

    Only overlaps that are abnormal as they are, but normal up to ``reach``, change.
    """
    todo = (location(0) == "Abnormal") & (location(reach) != "Abnormal")
    same = same_direction()
    flat = ("qoff", "qend", "soff", "send")

    def end(df: DataFrame, which: Column, x: str, x_hang: Column, x_to: Column, y: str, y_hang: Column, y_to: Column, x_sign: int, y_sign: int) -> DataFrame:
        """Moves end ``x`` to ``x_to`` and ``y`` to ``y_to``: both if both are near, else the near one with the other along."""
        nx, ny = x_hang <= reach, y_hang <= reach
        new_x = F.when(nx, x_to).when(ny, F.col(x) + x_sign * y_hang).otherwise(F.col(x))
        new_y = F.when(ny & nx, y_to).when(nx, F.col(y) + y_sign * x_hang).when(ny, y_to).otherwise(F.col(y))
        return df.withColumns({x: F.when(which, new_x).otherwise(F.col(x)), y: F.when(which, new_y).otherwise(F.col(y))})

    out = df.withColumn("_todo", todo)
    go, zero = F.col("_todo"), F.lit(0)
    qs, ss = F.col("qsize"), F.col("ssize")
    out = end(out, go & same, "qoff", F.col("qoff"), zero, "soff", F.col("soff"), zero, -1, -1)
    out = end(out, go & same, "qend", qs - F.col("qend"), qs, "send", ss - F.col("send"), ss, 1, 1)
    out = end(out, go & ~same, "qoff", F.col("qoff"), zero, "send", ss - F.col("send"), ss, -1, 1)
    # The subject's start goes first here, the query's end along with it.
    out = end(out, go & ~same, "soff", F.col("soff"), zero, "qend", qs - F.col("qend"), qs, -1, 1)
    return out.withColumns({c: F.col(c).cast("int") for c in flat}).drop("_todo")


def between(p: Column, from_lo: Column, from_hi: Column, to_lo: Column, to_hi: Column, same: Column) -> Column:
    """Where a position of one read lies on the other: in proportion inside the alignment, base by base outside."""
    scaled = lambda d: (d.cast("long") * (to_hi - to_lo)) / (from_hi - from_lo)
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    direct = F.when(p < from_lo, to_lo + (p - from_lo)).when(p < from_hi, to_lo + whole(scaled(p - from_lo))).otherwise(to_hi + (p - from_hi))
    flipped = F.when(p > from_hi, to_lo - (p - from_hi)).when(p > from_lo, to_lo - whole(scaled(p - from_hi))).otherwise(to_hi - (p - from_lo))
    return F.when(same, direct).otherwise(flipped).cast("long")


def map_position(position: Column) -> Column:
    """Where a subject position lies on the query."""
    return between(position, *(F.col(c) for c in ("soff", "send", "qoff", "qend")), same_direction())


def swapped(df: DataFrame) -> DataFrame:
    """Query and subject exchanged."""
    pairs = dict(zip((*A, *B), (*B, *A), strict=True))
    return df.select(*[F.col(pairs.get(c, c)).alias(c) for c in df.columns])


def subject_forward(df: DataFrame) -> DataFrame:
    """Strands turned so that the subject is forward; offsets stay on forward strands."""
    flip = F.col("sdir") == 1
    return df.withColumns({"qdir": F.when(flip, 1 - F.col("qdir")).otherwise(F.col("qdir")), "sdir": F.lit(0)})


def symmetrize(df: DataFrame) -> DataFrame:
    """Every overlap in both roles, the subject forward."""
    return subject_forward(df.unionByName(swapped(df)))


def by_read(df: DataFrame) -> DataFrame:
    """One row per overlap and read in it: read, other, start, end, len, other_* and the overlap's columns."""
    side = lambda own, other: F.struct(*[F.col(c).alias(n) for c, n in zip((*own, *other), ("read", "dir", "start", "end", "len", "other", "other_dir", "other_start", "other_end", "other_len"), strict=True)])
    return df.select("*", F.explode(F.array(side(A, B), side(B, A))).alias("v")).select(*df.columns, "v.*")


def neighbour_words(adj: DataFrame, *flags: str) -> DataFrame:
    """Neighbours of each read as bits: (read, word, bits, a column of bits for each of ``flags``), 64 ids a word.

    adj: read, other and the flags. Reads that lie close have neighbours with ids close to each other or, with many
    neighbours, all ids; then a word stands for many rows, and never for less than one.
    """
    bit = F.expr("shiftleft(1L, cast(pmod(other, 64) as int))")
    some = [F.bit_or(F.when(F.col(c), F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(c) for c in flags]
    rows = adj.select("read", F.shiftright("other", 6).alias("word"), bit.alias("_bit"), *flags)
    return rows.groupBy("read", "word").agg(F.bit_or("_bit").alias("bits"), *some)


def common_counts(pairs: DataFrame, adj: DataFrame, *flags: str) -> DataFrame:
    """(qid, sid, common, and for each flag q_ and s_): how many neighbours both reads of a pair have, and of these how
    many have the flag at the query and at the subject; pairs without any are left out.

    A pair meets the words of its reads' neighbours, not the neighbours: 64 are counted at once. Pairs are dealt out
    for that and not broadcast, however small they are: each grows to many rows.
    """
    pairs = pairs.select("qid", "sid").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid")
    side = lambda df, key, p: neighbour_words(df, *flags).select(F.col("read").alias(key), "word", *[F.col(c).alias(f"{p}_{c}") for c in ("bits", *flags)]).hint("merge")
    met = pairs.join(side(adj, "qid", "q"), "qid").join(side(adj.where("read <> other"), "sid", "s"), ["sid", "word"])
    both = lambda a, b: F.sum(F.bit_count(F.col(a).bitwiseAND(F.col(b))).cast("long"))
    counts = [x for c in flags for x in (both(f"q_{c}", "s_bits").alias(f"q_{c}"), both("q_bits", f"s_{c}").alias(f"s_{c}"))]
    return met.where(F.col("q_bits").bitwiseAND(F.col("s_bits")) != 0).groupBy("qid", "sid").agg(both("q_bits", "s_bits").alias("common"), *counts)


def best_of_pair(df: DataFrame) -> DataFrame:
    """Of all overlaps of two reads the longest aligned (ties: more identical, then smaller ids and offsets).

    One map-side combined aggregation on the unordered pair. A value is moved once: what the order asks for is also what
    the row is made of again, and of the ids only which one comes first.
    """
    kinds = dict(df.dtypes)
    ordered = [c for c in ("qoff", "soff", "qend", "send", "sdir", "qdir") if c in kinds]
    rest = [c for c in df.columns if c not in ("qid", "sid", "ident", *ordered)]
    rank = F.struct(aligned_length().alias("alen"), F.col("ident").alias("ident"), (F.col("qid") <= F.col("sid")).alias("low_first"), *[(-F.col(c)).alias(c) for c in ordered], *[F.struct(*rest).alias("rest")][: len(rest)])
    low, high = F.least("qid", "sid").alias("_low"), F.greatest("qid", "sid").alias("_high")
    best = df.groupBy(low, high).agg(F.max(rank).alias("b"))
    own = lambda one, other: F.when(F.col("b.low_first"), F.col(one)).otherwise(F.col(other))
    made = {"qid": own("_low", "_high"), "sid": own("_high", "_low"), "ident": F.col("b.ident")} | {c: (-F.col(f"b.{c}")).cast(kinds[c]) for c in ordered} | {c: F.col(f"b.rest.{c}") for c in rest}
    return best.select(*[made[c].alias(c) for c in df.columns])


def longest_first(*partition: str) -> Window:
    """Window of overlaps in their total order."""
    return Window.partitionBy(*partition).orderBy(F.desc("alen"), F.desc("ident"), "qid", "sid", "qoff", "soff", "qend", "send", "sdir")


def read_statistics(df: DataFrame) -> DataFrame:
    """Per read: overlaps, mean and best identity, largest overhang, aligned bases. Map-side combined."""
    q, s = overhangs()
    rows = by_read(df.withColumns({"alen": aligned_length(), "oh": F.greatest(q, s)}))
    return rows.groupBy("read").agg(
        F.max("len").alias("len"), F.count("*").alias("overlaps"), F.round(F.sum(F.round(F.col("ident") * 100).cast("long")) / F.count("*") / 100, 6).alias("mean_ident"),
        F.max(F.struct("alen", "ident")).getField("ident").alias("best_ident"), F.max("oh").alias("max_overhang"), F.sum(F.col("alen").cast("long")).alias("aligned"),
    )


def compare_sets(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Two overlap sets by unordered pair: missing on either side, similar or not similar (ends within ``tolerance``)."""

    def ends(df: DataFrame, name: str) -> DataFrame:
        low = F.col("qid") < F.col("sid")
        cols = {"a": ("qoff", "soff"), "b": ("qend", "send"), "c": ("soff", "qoff"), "d": ("send", "qend")}
        picked = [F.when(low, F.col(x)).otherwise(F.col(y)).alias(n) for n, (x, y) in cols.items()]
        return best_of_pair(df).select(F.least("qid", "sid").alias("low"), F.greatest("qid", "sid").alias("high"), F.struct(*picked).alias(name))

    both = ends(left, "l").join(ends(right, "r"), ["low", "high"], "full_outer")
    close = F.lit(True)
    for c in "abcd":
        close = close & (F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= tolerance)
    kind = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(close, "similar").otherwise("not_similar")
    return both.select("low", "high", kind.alias("kind"))
