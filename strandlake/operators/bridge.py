"""Contig bridging: contigs that share reads, links sorted into sessions, and which links hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import end_id, reverse_complement
from .overlap import between, location, other_view


def contig_pairs(hits: DataFrame, least: int = 1) -> DataFrame:
    """(c0, c1, reads): pairs of contigs that share reads, c0 < c1. hits: contig, read.

    A read's contigs are few; the hits are made distinct before they meet.
    """
    one = hits.select("contig", "read").distinct()
    pairs = one.select("read", F.col("contig").alias("c0")).join(one.select("read", F.col("contig").alias("c1")), "read").where("c0 < c1")
    return pairs.groupBy("c0", "c1").agg(F.count("*").alias("reads")).where(F.col("reads") >= least)


def sessions(links: DataFrame, gap: int, *group: str) -> DataFrame:
    """Links with a session number in each group: a new one where the position jumps by more than ``gap``.

    Equal positions are counted first, so a group's window sees a row a position.
    """
    counted = links.groupBy(*group, "pos").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy("pos")
    fresh = F.coalesce(F.col("pos") - F.lag("pos").over(w) > gap, F.lit(True)).cast("int")
    return counted.withColumn("session", F.sum(fresh).over(w))


def session_summary(rows: DataFrame, *group: str) -> DataFrame:
    """Links, first and last position of each session."""
    return rows.groupBy(*group, "session").agg(F.sum("n").alias("links"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def within_three_sigma(rows: DataFrame, *group: str) -> DataFrame:
    """Positions within three deviations of their session's mean, both rounded down."""
    n, x = F.col("n"), F.col("pos").cast("long")
    key = [*group, "session"]
    sums = rows.groupBy(*key).agg(F.sum("n").alias("total"), F.sum(n * x).alias("s1"), F.sum((n * x * x).cast("decimal(38,0)")).alias("s2"))
    mean = F.floor(F.col("s1") / F.col("total"))
    # Sum of squared distances to the floored mean, from the power sums.
    square = F.col("s2") - 2 * mean * F.col("s1") + mean * mean * F.col("total")
    stats = sums.select(*key, mean.alias("mean"), F.floor(F.sqrt(square.cast("double") / F.col("total"))).alias("sd"))
    return rows.join(stats, key).where(F.abs(F.col("pos") - F.col("mean")) <= 3 * F.col("sd")).select(*group, "pos", "n", "session", "mean", "sd")


def best_links(summary: DataFrame, *group: str) -> DataFrame:
    """The session with the most links of each group (ties: the first)."""
    best = F.max(F.struct("links", (-F.col("session")).alias("k"), "first", "last")).alias("b")
    return summary.groupBy(*group).agg(best).select(*group, (-F.col("b.k")).alias("session"), "b.links", "b.first", "b.last")


def unbridged(contigs: DataFrame, pairs: DataFrame, contained: DataFrame) -> DataFrame:
    """Contigs in no pair and not contained in another."""
    joined = pairs.select(F.explode(F.array("c0", "c1")).alias("contig")).distinct()
    return contigs.join(joined, "contig", "left_anti").join(contained.select("contig"), "contig", "left_anti")


def link_location(err: int) -> Column:
    """How a link's source contig lies to its target, by where the source's ends fall on it (lo, hi; len1)."""
    sign = lambda x: F.when(x < -err, -1).when(x > err, 1).otherwise(0)
    a, z = sign(F.col("lo")), sign(F.col("hi") - F.col("len1"))
    return (
        F.when((a < 0) & (z < 0), "Left").when((a > 0) & (z > 0), "Right").when((a == 0) & (z == 0), "Equal")
        .when((a <= 0) & (z >= 0), "Containing").when((a >= 0) & (z <= 0), "Contained").otherwise("Abnormal")
    )


def _ends_on_target(rows: DataFrame) -> DataFrame:
    """Of links with pos0 to pos3 (the source's begin, aligned begin and end, and end on the target): the source's ends
    (lo, hi), the part of the target it should cover (expect_lo, expect_hi) and the part aligned (real_lo, real_hi)."""
    lo, hi = F.least("pos0", "pos3"), F.greatest("pos0", "pos3")
    first, last = F.least("pos1", "pos2"), F.greatest("pos1", "pos2")
    zero = F.lit(0).cast("long")
    return rows.withColumns({
        "lo": lo, "hi": hi, "expect_lo": F.greatest(lo, zero), "expect_hi": F.least(hi, F.col("len1").cast("long")), "real_lo": F.greatest(first, F.col("start1").cast("long")), "real_hi": F.least(last, F.col("end1").cast("long")),
    })


LINK = ("c0", "c1", "read", "same", "len0", "len1", "pos0", "lo", "hi", "expect_lo", "expect_hi", "real_lo", "real_hi")


def read_links(hits: DataFrame, err: int) -> DataFrame:
    """Links (LINK, loc) of two contigs by a read that lies on both.

    hits: overlaps whose query is a read and whose subject a contig. A read links contigs c0 < c1 if it runs over the end
    of one and the begin of the other, or lies within one of them, up to ``err`` bases. c0's positions are mapped to the
    read and from there to c1. The two hits meet on the read, whose contigs are few.
    """
    seen = other_view(F.col("loc"))  # of the contig to the read
    placed = hits.withColumn("loc", location(err)).where("loc <> 'Abnormal'").withColumn("view", seen)
    side = lambda n: placed.select(F.col("qid").alias("read"), *[F.col(c).alias(f"{c}{n}") for c in ("sid", "qdir", "qoff", "qend", "sdir", "soff", "send", "ssize", "view")])
    both = side(0).join(side(1), "read").where("sid0 < sid1")
    v0, v1 = F.col("view0"), F.col("view1")
    fits = ((v0 == "Left") & (v1 == "Right")) | ((v0 == "Right") & (v1 == "Left")) | v0.isin("Equal", "Contained") | v1.isin("Equal", "Contained")
    same0, same1 = F.col("qdir0") == F.col("sdir0"), F.col("qdir1") == F.col("sdir1")
    c = F.col

    # Positions on the read, then on the target, as columns of their own: each is used many times in the next step.
    ends = (F.lit(0), c("soff0"), c("send0"), c("ssize0"))
    on_read = both.where(fits).withColumns({f"on_read{i}": between(p, c("soff0"), c("send0"), c("qoff0"), c("qend0"), same0) for i, p in enumerate(ends)})
    at = [between(c(f"on_read{i}"), c("qoff1"), c("qend1"), c("soff1"), c("send1"), same1).alias(f"pos{i}") for i in range(4)]
    rows = on_read.select(c("sid0").alias("c0"), c("sid1").alias("c1"), "read", (same0 == same1).alias("same"), c("ssize0").alias("len0"), c("ssize1").alias("len1"), c("soff1").alias("start1"), c("send1").alias("end1"), *at)
    return _ends_on_target(rows).select(*LINK).withColumn("loc", link_location(err))


def bridges(found: DataFrame, hits: DataFrame, direct: DataFrame, bunches: DataFrame) -> DataFrame:
    """(c0, c1, gap, read, from_, to, turned) of each chosen link (``best_bunches``) to the left or right.

    gap: bases from the end of c0 that lies nearer c1 to the end of c1 that lies nearer c0, below 0 where they overlap.
    A link by reads has it from its session's first read (of several hits the smallest gap), with the part of the read
    between the two ends, turned if the read runs from c1 to c0. A direct one overlaps as its longest agreeing link does,
    and has no read.
    """
    c = F.col
    rank = F.struct("links", c("same").alias("r1"), (-c("session")).alias("r2"))
    first = found.groupBy("c0", "c1").agg(F.max_by(F.struct("same", "read"), rank).alias("b")).select("c0", "c1", "b.*")
    chosen = bunches.where("kind = 'reads' and loc in ('Left', 'Right')").select("c0", "c1", "same", "loc").join(first, ["c0", "c1", "same"])
    left = c("loc") == "Left"

    def end_on_read(df: DataFrame, contig: str, at_end: Column, name: str) -> DataFrame:
        """Where a contig's end (or, where not ``at_end``, its begin) lies on the read."""
        own = hits.select(c("qid").alias("read"), c("sid").alias(contig), (c("qdir") == c("sdir")).alias(f"{name}_same"), "qoff", "qend", "soff", "send", "ssize")
        place = between(F.when(at_end, c("ssize")).otherwise(F.lit(0)), c("soff"), c("send"), c("qoff"), c("qend"), c(f"{name}_same"))
        return df.join(own, ["read", contig]).withColumn(name, place).drop("qoff", "qend", "soff", "send", "ssize")

    ends = end_on_read(end_on_read(chosen, "c0", left == c("same"), "near0"), "c1", ~left, "near1")
    up = left == c("near1_same")
    spans = ends.select("c0", "c1", "read", F.when(up, c("near1") - c("near0")).otherwise(c("near0") - c("near1")).alias("gap"), F.least("near0", "near1").alias("from_"), F.greatest("near0", "near1").alias("to"), (~up).alias("turned"))
    read = spans.groupBy("c0", "c1", "read").agg(F.min(F.struct("gap", "from_", "to", "turned")).alias("g")).select("c0", "c1", "g.gap", "read", "g.from_", "g.to", "g.turned")
    over = F.when(F.col("loc") == "Left", -F.col("hi")).otherwise(F.col("lo") - F.col("len1")).alias("gap")
    longest = F.max_by("gap", F.struct("aligned", (-F.col("pos0")).alias("k"))).alias("gap")
    pairs = bunches.where("kind = 'direct' and loc in ('Left', 'Right')").select("c0", "c1", "same", "loc")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("read", "int"), ("from_", "long"), ("to", "long"), ("turned", "boolean"))]
    meet = direct.join(pairs, ["c0", "c1", "same", "loc"]).select("c0", "c1", "aligned", "pos0", over).groupBy("c0", "c1").agg(longest).select("c0", "c1", "gap", *none)
    return read.unionByName(meet)


def layout(paths: DataFrame, edges: DataFrame, joints: DataFrame, contigs: DataFrame, contained: DataFrame) -> DataFrame:
    """(path, nth, kind, id, start, end, turned): what every bridged contig is made of, in order.

    A path of the contig graph begins with its first contig; each edge adds the read between the two contigs where they
    leave a gap, and the next contig, without what it shares with the one before. Of a path and its reverse one is laid
    out. Contigs (contig, len) in no path, and not ``contained``, stand alone.
    """
    steps = paths.where("forward").join(edges.select("eid", "src", "dst"), "eid")
    here, there = F.abs("src") - 1, F.abs("dst") - 1
    steps = steps.withColumns({"c0": F.least(here, there), "c1": F.greatest(here, there), "back": here > there, "next": there}).join(joints, ["c0", "c1"])
    sized = steps.join(contigs.withColumnRenamed("contig", "next"), "next")
    cut = F.least(F.greatest(-F.col("gap"), F.lit(0)), F.col("len"))
    zero = F.lit(0).cast("long")
    piece = lambda nth, kind, id_, start, end, turned: F.struct(nth.cast("long").alias("nth"), F.lit(kind).alias("kind"), id_.cast("long").alias("id"), start.cast("long").alias("start"), end.cast("long").alias("end"), turned.alias("turned"))
    fill = F.when(F.col("gap") > 0, F.array(piece(F.col("pos") * 2 + 1, "read", F.col("read"), F.col("from_"), F.col("to"), F.col("turned") != F.col("back")))).otherwise(F.array())
    grown = piece(F.col("pos") * 2 + 2, "contig", F.col("next"), F.when(F.col("dst") < 0, cut).otherwise(zero), F.when(F.col("dst") < 0, F.col("len")).otherwise(F.col("len") - cut), F.col("dst") > 0)
    tail = sized.select("path", F.explode(F.concat(fill, F.array(grown))).alias("p")).select("path", "p.*")
    heads = steps.where("pos = 0").select("path", "src", (F.abs("src") - 1).alias("contig")).join(contigs, "contig")
    head = heads.select("path", piece(zero, "contig", F.col("contig"), zero, F.col("len"), F.col("src") > 0).alias("p")).select("path", "p.*")
    used = edges.select((F.abs("src") - 1).alias("contig")).union(edges.select(F.abs("dst") - 1)).distinct()
    alone = contigs.join(used, "contig", "left_anti").join(contained, "contig", "left_anti")
    single = alone.select(F.col("contig").cast("string").alias("path"), piece(zero, "contig", F.col("contig"), zero, F.col("len"), F.lit(False)).alias("p")).select("path", "p.*")
    return head.unionByName(tail).unionByName(single)


def spelled(pieces: DataFrame, contigs: DataFrame, reads: DataFrame, least: int = 500) -> DataFrame:
    """(path, len, seq) of each laid out contig of ``least`` bases. contigs, reads: id, seq. Pieces are cut out of their
    sequences before they meet."""
    of = contigs.select(F.lit("contig").alias("kind"), "id", "seq").unionByName(reads.select(F.lit("read").alias("kind"), "id", "seq"))
    part = F.substring("seq", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    cut = pieces.join(of, ["kind", "id"]).select("path", "nth", F.when(F.col("turned"), reverse_complement(part)).otherwise(part).alias("piece"))
    whole = cut.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("nth", "piece"))).alias("p"))
    return whole.select("path", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq")).select("path", F.length("seq").alias("len"), "seq").where(F.col("len") >= least)


def direct_links(hits: DataFrame, err: int) -> DataFrame:
    """Links (LINK without a read, loc, aligned) of contigs that overlap each other: hits of contigs on contigs."""
    c = F.col
    turned = hits.where("qid <> sid").withColumn("swap", c("qid") > c("sid"))
    pick = lambda a, b: F.when(c("swap"), c(b)).otherwise(c(a))
    one = turned.where(location(err) != "Abnormal").select(
        pick("qid", "sid").alias("c0"), pick("sid", "qid").alias("c1"), (c("qdir") == c("sdir")).alias("same"), pick("qsize", "ssize").alias("len0"), pick("ssize", "qsize").alias("len1"),
        pick("qoff", "soff").alias("s0"), pick("qend", "send").alias("e0"), pick("soff", "qoff").alias("start1"), pick("send", "qend").alias("end1"),
    )
    at = {f"pos{i}": between(p, c("s0"), c("e0"), c("start1"), c("end1"), c("same")) for i, p in enumerate((F.lit(0), c("s0"), c("e0"), c("len0")))}
    rows = _ends_on_target(one.select("*", *[v.alias(k) for k, v in at.items()]))
    return rows.select(*[x for x in LINK if x != "read"], ((c("e0") - c("s0") + c("end1") - c("start1")) / 2).cast("long").alias("aligned")).withColumn("loc", link_location(err))


def supported_sessions(links: DataFrame, gap: int, err: int, least: int) -> DataFrame:
    """Sessions of read links whose reads cover the part of the target the source should: (c0, c1, same, session, links,
    first, last, read, loc, pos0, depth).

    Normal links of a pair and strand are sessions by where the source begins on the target, a new one after a jump of
    more than ``gap``. The means of the links' expected parts, rounded down, bound the part; away from its ends by
    ``err`` more than ``least`` links have to be aligned at every base of it (a part of at most 2 * ``err`` bases is not
    tested). Starts and ends are added up a position before the depths are summed. read, loc and pos0 are of the
    session's first link.
    """
    key = ["c0", "c1", "same"]
    normal = links.where("loc <> 'Abnormal'")
    numbered = sessions(normal.withColumn("pos", F.col("pos0")), gap, *key).select(*key, "pos", "session")
    rows = normal.join(numbered.withColumnRenamed("pos", "pos0"), [*key, "pos0"])
    key = [*key, "session"]
    mean = lambda x: F.floor(F.sum(x) / F.count("*"))
    summary = rows.groupBy(*key).agg(F.count("*").alias("links"), F.min("pos0").alias("first"), F.max("pos0").alias("last"), F.min(F.struct("pos0", "read", "loc")).alias("b"), mean("expect_lo").alias("lo"), mean("expect_hi").alias("hi"))
    inner = rows.select(*key, "real_lo", "real_hi").join(summary.select(*key, "lo", "hi"), key)
    inner = inner.withColumns({"a": F.greatest("real_lo", F.col("lo")), "z": F.least("real_hi", F.col("hi"))})
    point = lambda at, d: F.struct(at.alias("at"), F.lit(d).alias("d"))
    events = inner.select(*key, "lo", "hi", F.explode(F.concat(F.when(F.col("z") > F.col("a"), F.array(point(F.col("a"), 1), point(F.col("z"), -1))).otherwise(F.array().cast("array<struct<at:bigint,d:int>>")), F.array(point(F.col("lo") + err, 0)))).alias("e"))
    steps = events.groupBy(*key, "lo", "hi", "e.at").agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*key).orderBy("at")
    depths = steps.withColumns({"depth": F.sum("d").over(w), "to": F.coalesce(F.lead("at").over(w), F.col("hi"))})
    # A stretch counts if part of it lies err bases within; the last base of the part does not.
    least_depth = depths.where((F.col("to") > F.col("lo") + err) & (F.col("at") < F.col("hi") - err) & (F.col("to") > F.col("at"))).groupBy(*key).agg(F.min("depth").alias("depth"))
    tested = summary.join(least_depth, key, "left").where((F.col("hi") - F.col("lo") <= 2 * err) | (F.coalesce("depth", F.lit(0)) > least))
    return tested.select(*key, "links", "first", "last", "b.read", "b.loc", "b.pos0", "depth")


def best_bunches(found: DataFrame, direct: DataFrame, reach: int) -> DataFrame:
    """One link a pair of contigs: (c0, c1, same, loc, support, kind).

    Of a pair without direct links the session with the most links (ties: the same strand, then the first). Of a pair
    with some, the first such session that agrees with one (strand, and begins within ``reach`` of it) gives the support
    and the longest agreeing direct link strand and place; where none agrees, the pair has no link.
    """
    rank = F.struct("links", F.col("same").alias("r1"), (-F.col("session")).alias("r2"))
    pairs = direct.select("c0", "c1").distinct()
    alone = found.join(pairs, ["c0", "c1"], "left_anti").groupBy("c0", "c1").agg(F.max_by(F.struct("same", "loc", F.col("links").alias("support")), rank).alias("b"))
    one = direct.select("c0", "c1", "same", F.col("pos0").alias("at"), F.col("loc").alias("direct_loc"), "aligned")
    agree = found.join(one, ["c0", "c1", "same"]).where(F.abs(F.col("pos0") - F.col("at")) < reach)
    both = agree.groupBy("c0", "c1").agg(F.max_by(F.struct("same", F.col("direct_loc").alias("loc"), F.col("links").alias("support")), F.struct("links", F.col("same").alias("r1"), (-F.col("session")).alias("r2"), "aligned", (-F.col("at")).alias("r3"))).alias("b"))
    return alone.select("c0", "c1", "b.*", F.lit("reads").alias("kind")).unionByName(both.select("c0", "c1", "b.*", F.lit("direct").alias("kind")))


def contained_contigs(bunches: DataFrame) -> DataFrame:
    """Contigs that lie in another one. Of equal contigs the larger id does."""
    loc = F.col("loc")
    inner = F.when(loc == "Containing", F.col("c1")).when(loc == "Contained", F.col("c0")).when(loc == "Equal", F.greatest("c0", "c1"))
    return bunches.select(inner.alias("contig")).where("contig is not null").distinct()


def contig_graph(bunches: DataFrame) -> DataFrame:
    """Edges (eid, rid, src, dst, score) between contig ends: two, each the other's reverse, for every link between
    contigs that lie in no other. Of equal contigs the larger id goes."""
    loc = F.col("loc")
    gone = contained_contigs(bunches)
    rows = bunches.where("loc in ('Left', 'Right')")
    for side in ("c0", "c1"):
        rows = rows.join(gone.select(F.col("contig").alias(side)), side, "left_anti")
    s_b, s_e, t_b, t_e = end_id(F.col("c0"), 0), end_id(F.col("c0"), 1), end_id(F.col("c1"), 0), end_id(F.col("c1"), 1)
    left, same = loc == "Left", F.col("same")
    src = F.when(same & left, t_b).when(same, s_b).when(left, t_b).otherwise(s_e)
    dst = F.when(same & left, s_b).when(same, t_b).when(left, s_e).otherwise(t_b)
    one = rows.select(src.cast("int").alias("src"), dst.cast("int").alias("dst"), F.col("support").cast("long").alias("score"))
    name = lambda a, b: F.concat_ws("~", a.cast("string"), b.cast("string"))
    both = one.union(one.select(-F.col("dst"), -F.col("src"), "score"))
    return both.select(name(F.col("src"), F.col("dst")).alias("eid"), name(-F.col("dst"), -F.col("src")).alias("rid"), "src", "dst", "score")
