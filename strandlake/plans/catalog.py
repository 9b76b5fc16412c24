"""The queries: each runs one operator over the whole of its projected table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filterexpr
from ..functions import sequence as sq
from ..operators import bridge, consensus, graph, ids, olfilter, quantiles, seedgrid, seeds, tags, trim
from ..operators import intervals as iv
from ..operators import overlap as ov
from ..operators import reads as rd
from ..sources import formats
from ..sources import projections as pr
from . import pipeline
from .stages import Stages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _doubles(spark: SparkSession, **values) -> DataFrame:
    """One row of values found by steps that each collect a bounded number of rows."""
    return spark.createDataFrame([tuple(None if v is None else float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


K = 13
#: Thresholds of the overlap queries.
IDENTITY, OVERHANG, LENGTH, ALIGNED = 92.0, 10, 2500, 2000


@query
def reads_projection(s, d):
    return pr.reads(s, d).select("read_id", "len", F.md5("seq").alias("sum"))


@query
def read_length_nstats(s, d):
    return rd.n_statistics(pr.reads(s, d))


@query
def read_length_summary(s, d):
    return rd.length_summary(pr.reads(s, d))


@query
def n50_strict(s, d):
    return rd.n_statistics(pr.reads(s, d), (25, 50, 75), strict=True)


@query
def ambig_runs(s, d):
    seq = F.col("seq")
    return pr.reads(s, d, to=pr.BASES[:25] + "N").select("read_id", sq.ambiguous_runs(seq).alias("runs"), sq.ambiguous_residues(seq).alias("residues"), sq.valid_residues(seq).alias("valid"))


@query
def longest_x_cutoff(s, d):
    return rd.longest_cutoff(pr.reads(s, d), 300_000)


@query
def longest_x_prefix(s, d):
    return rd.longest_prefix(pr.reads(s, d), 300_000)


@query
def volume_split(s, d):
    return rd.volumes(s, pr.reads(s, d), 100_000, 40)


@query
def revcomp(s, d):
    return pr.reads(s, d).select("read_id", F.md5(sq.reverse_complement(F.col("seq"))).alias("sum"))


@query
def kmer_spectrum(s, d):
    return rd.kmer_spectrum(pr.reads(s, d), K)


@query
def kmer_capped_index(s, d):
    found = seeds.capped_index(pr.reads(s, d), K).groupBy("kmer").agg(F.count("*").alias("places"), F.min("sid").alias("first_read"))
    return found.withColumn("kmer", sq.kmer_text(F.col("kmer"))).withColumn("code", sq.kmer_code(F.col("kmer")))


@query
def seed_join(s, d):
    return seedgrid.pair_seeds(pr.reads(s, d), K)


@query
def seed_blocks(s, d):
    return seedgrid.pair_blocks(pr.reads(s, d), K)


@query
def top_subjects(s, d):
    return seedgrid.best_subjects(pr.reads(s, d), K, 3)


@query
def subject_window(s, d):
    o = pr.overlaps(s, d)
    start, end = seeds.subject_window(F.expr("(soff + send) div 2"), F.col("ssize"), F.expr("(qoff + qend) div 2"), F.col("qsize"))
    return o.select("qid", "sid", "qoff", "soff", "qsize", "ssize", start.alias("sfrom"), end.alias("sto"))


_PLACE = ("qid", "sid", "qoff", "qend", "soff", "send")


@query
def overlap_location(s, d):
    return pr.overlaps(s, d).select(*_PLACE, ov.location(0).alias("exact"), ov.location(10).alias("near"))


@query
def overlap_location_other(s, d):
    loc = ov.location(11)
    return pr.overlaps(s, d).select(*_PLACE, ov.other_view(loc).alias("other"), loc.isin("Containing", "Equal").alias("containing"), loc.isin("Contained", "Equal").alias("contained"), loc.isin("Left", "Right").alias("proper"))


@query
def overlap_overhang(s, d):
    q, t = ov.overhangs()
    return pr.overlaps(s, d).select(*_PLACE, q.alias("q_hang"), t.alias("s_hang"), ov.aligned_length().alias("alen"))


@query
def overlap_load_filter(s, d):
    return ov.load_filter(pr.overlaps(s, d), IDENTITY, LENGTH, 12_000, ALIGNED, OVERHANG)


@query
def end_snap(s, d):
    return ov.snap_ends(pr.overlaps(s, d), 11)


@query
def coord_map(s, d):
    return pr.overlaps(s, d).select(*_PLACE, *[ov.map_position(F.lit(p)).alias(f"p{p}") for p in (0, 2600, 9000)])


@query
def symmetrize(s, d):
    return ov.symmetrize(pr.overlaps(s, d))


@query
def partition_counts(s, d):
    part = F.floor(F.col("sid") / 100)
    return ov.symmetrize(pr.overlaps(s, d)).groupBy(part.alias("part")).agg(F.count("*").alias("records"))


@query
def overlap_dedup(s, d):
    return ov.best_of_pair(pr.overlaps(s, d))


@query
def overlap_coverage_test(s, d):
    return trim.covered_enough(pr.overlaps(s, d)).select(*_PLACE)


@query
def read_stats(s, d):
    return ov.read_statistics(pr.overlaps(s, d))


@query
def weighted_median_mad(s, d):
    o = pr.table(s, d, "orders")
    return _doubles(s, **dict(zip(("median", "mad"), quantiles.weighted_median_mad(o, F.col("o_totalprice"), F.col("o_custkey")), strict=True)))


@query
def median_mad(s, d):
    o = pr.table(s, d, "orders")
    return _doubles(s, **dict(zip(("median", "mad"), quantiles.upper_median_mad(o, F.col("o_totalprice")), strict=True)))


@query
def mean_deviation(s, d):
    o = pr.table(s, d, "orders").select(F.round(F.col("o_totalprice")).cast("decimal(20,0)").alias("v"), F.col("o_custkey").cast("decimal(10,0)").alias("w"))
    mean = o.agg(F.floor(F.sum(F.col("v") * F.col("w")) / F.sum("w")).cast("decimal(20,0)").alias("m"))
    return o.crossJoin(F.broadcast(mean)).agg(F.max("m").cast("long").alias("mean"), F.round((F.sum(F.abs(F.col("v") - F.col("m")) * F.col("w")) / F.sum("w")).cast("double"), 2).alias("deviation"))


@query
def auto_identity(s, d):
    return _doubles(s, min_identity=olfilter.auto_identity(pr.overlaps(s, d)))


@query
def auto_overhang(s, d):
    return _doubles(s, max_overhang=olfilter.auto_overhang(pr.overlaps(s, d)))


@query
def coverage_minmax(s, d):
    return olfilter.coverage(pr.overlaps(s, d))


@query
def coverage_percentile(s, d):
    q = F.col("l_quantity").cast("int")
    li = pr.table(s, d, "lineitem")
    return _doubles(s, **{f"p{p}": quantiles.percentile(li, q, p) for p in (1, 25, 50, 99)})


@query
def coverage_filter(s, d):
    return olfilter.coverage_dropped(olfilter.coverage(pr.overlaps(s, d)), (4, 60, 50)).select("read", "cov_min", "cov_max")


@query
def support_filter(s, d):
    return olfilter.supported(Stages(s, "support").keep(_proper(s, d), "pairs"), 2, 11).select("qid", "sid")


@query
def containment(s, d):
    return olfilter.contained_reads(pr.overlaps(s, d))


@query
def bestn(s, d):
    return olfilter.best_n(_proper(s, d)).select("qid", "sid")


@query
def filter_report(s, d):
    o = pr.overlaps(s, d)
    alen, loc = ov.aligned_length(), ov.location(OVERHANG)
    reason = F.when(F.col("ident") < IDENTITY, "identity").when(F.least("qsize", "ssize") < LENGTH, "length").when(alen < ALIGNED + 500, "aligned").when(loc == "Abnormal", "location")
    return olfilter.report(o.withColumn("reason", reason))


@query
def interval_merge(s, d):
    return iv.merge(pr.intervals(s, d), "grp")


@query
def interval_depth(s, d):
    return iv.depth(pr.intervals(s, d), "grp")


@query
def interval_invert(s, d):
    return iv.invert(iv.merge(pr.intervals(s, d), "grp"), "grp", 500, 4500)


@query
def interval_intersect(s, d):
    i = pr.intervals(s, d)
    return iv.intersect(iv.merge(i.where("lo % 2 = 0"), "grp"), iv.merge(i.where("lo % 2 = 1"), "grp"), "grp")


@query
def cover_range(s, d):
    return trim.cover_range(ov.by_read(pr.overlaps(s, d)), 2, 0, 1000)


@query
def clip_adjust(s, d):
    o = pr.overlaps(s, d)
    ranges = o.select("qid").union(o.select("sid")).distinct().select(F.col("qid").alias("read"), (F.col("qid") % 40).cast("int").alias("left"), (3100 + (F.col("qid") * 7919) % 9000 - F.col("qid") % 60).cast("int").alias("right"))
    return trim.clip(o, ranges)


def _top_summary(rows):
    return rows.groupBy("read").agg(F.count("*").alias("kept"), F.min("ident").alias("worst"), F.sum(F.col("alen").cast("long")).alias("aligned"))


@query
def top300(s, d):
    return _top_summary(trim.top_overlaps(pr.overlaps(s, d)))


def _candidates(s, d):
    return pr.overlaps(s, d).select("qid", "sid", F.expr("(qoff + qend) div 2").cast("int").alias("qoff"), F.expr("(soff + send) div 2").cast("int").alias("soff"), F.floor(ov.aligned_length() / 100).cast("int").alias("score"), (1 - F.col("sdir")).alias("strand"))


def _candidate_summary(rows):
    return rows.groupBy("sid").agg(F.count("*").alias("kept"), F.min("score").alias("worst"), F.sum(F.col("qid").cast("long")).alias("sum_qid"))


@query
def cns_candidates60(s, d):
    return _candidate_summary(seeds.consensus_candidates(_candidates(s, d)))


@query
def coverage_runs(s, d):
    i = pr.intervals(s, d)
    return iv.longest(iv.runs_at_least(i, "grp", 3), "grp").where("size >= 50")


def _proper(s, d):
    """Snapped overlaps without the containing shape, one a pair."""
    return ov.best_of_pair(ov.snap_ends(pr.overlaps(s, d, (0, 1, 3)), 11))


def _edges(s, d):
    """Edges in a written table: graph steps read them several times."""
    return Stages(s, "edges").keep(graph.edges(graph.admit(Stages(s, "pairs").keep(_proper(s, d), "pairs"), LENGTH, ALIGNED, IDENTITY)), "edges")


@query
def edge_admission(s, d):
    return graph.admit(_proper(s, d), LENGTH, ALIGNED, IDENTITY).select("qid", "sid", "qoff", "qend", "soff", "send")


@query
def graph_edges(s, d):
    return _edges(s, d).withColumns({"src_name": sq.end_name(F.col("src")), "dst_name": sq.end_name(F.col("dst"))})


@query
def transitive_reduce(s, d):
    return graph.transitive(_edges(s, d))


@query
def best_edges(s, d):
    return graph.best_edges(_edges(s, d)).select("src", "dst", "len", "score")


@query
def simple_paths(s, d):
    st = Stages(s, "paths")
    es = st.keep(graph.best_edges(_edges(s, d)), "edges")
    return graph.path_summary(graph.simple_paths(s, es, st.keep))


@query
def repeat_bridge(s, d):
    return graph.repeat_bridges(graph.best_edges(_edges(s, d))).select("src", "dst", "len")


@query
def contig_spell(s, d):
    st = Stages(s, "contigs")
    es = st.keep(graph.best_edges(_edges(s, d)), "edges")
    paths = st.keep(graph.simple_paths(s, es, st.keep), "paths")
    made = s.range(2000).select(F.col("id").cast("int").alias("read_id")).select("read_id", F.expr("substring(repeat(translate(md5(cast(read_id as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 400), 1, cast(3100 + (read_id * 7919) % 9000 as int))").alias("seq"))
    return graph.spell(paths, es, made).select("path", F.length("seq").alias("len"), F.md5("seq").alias("sum"))


@query
def ctg_pairs(s, d):
    hits = pr.overlaps(s, d).select((F.col("sid") % 20).alias("contig"), F.col("qid").alias("read"))
    return bridge.contig_pairs(hits, 3)


def _sessions(s, d):
    rows = pr.table(s, d, "lineitem").select((F.col("l_partkey") % 50).alias("c0"), (F.col("l_suppkey") % 10).alias("c1"), (F.col("l_orderkey") % 50000).alias("pos"))
    return bridge.sessions(rows, 200, "c0", "c1")


@query
def link_sessions(s, d):
    return bridge.session_summary(_sessions(s, d), "c0", "c1")


@query
def best_link(s, d):
    return bridge.best_links(bridge.session_summary(_sessions(s, d), "c0", "c1"), "c0", "c1")


@query
def session_3sigma(s, d):
    return bridge.within_three_sigma(_sessions(s, d), "c0", "c1").groupBy("c0", "c1", "session").agg(F.sum("n").alias("links"), F.max("mean").alias("mean"), F.max("sd").alias("sd"))


@query
def overlap_compare(s, d):
    o = pr.overlaps(s, d)
    return ov.compare_sets(o.where("qoff % 5 <> 0"), o.where("ident >= 94"), 250)


@query
def seq_tags(s, d):
    return tags.sequence_tags(pr.overlaps(s, d))


@query
def tag_report(s, d):
    return tags.tag_report(tags.sequence_tags(pr.overlaps(s, d)))


@query
def subread_filter(s, d):
    return pr.subreads(s, d).where(filterexpr.parse(filterexpr.DEFAULT + " && (np>3 || bc1==2)"))


@query
def subread_regions(s, d):
    rows = pr.subreads(s, d).select(F.col("zm").alias("hole"), F.col("qs").alias("lo"), (F.col("qs") + F.col("ln")).alias("hi"))
    good = rows.select("hole").distinct().select("hole", F.lit(300).alias("lo"), (400 + F.col("hole") % 300).cast("int").alias("hi"))
    return iv.intersect(rows, good, "hole")


@query
def name_ids(s, d):
    return ids.name_dictionary(pr.table(s, d, "documents").select(F.concat_ws("/", "source", "lang").alias("name")))


@query
def trim_reads(s, d):
    reads = pr.reads(s, d)
    ranges = reads.select(F.col("read_id").alias("read"), (F.col("read_id") % 7).cast("long").alias("left"), (F.col("len") - F.col("read_id") % 5).cast("long").alias("right")).where("left < right")
    return trim.trimmed(reads, ranges).select("read_id", "old_id", F.md5("seq").alias("sum"))


@query
def common_neighbours(s, d):
    """How many reads overlap both reads of a pair, for every pair."""
    o = pr.overlaps(s, d)
    return ov.common_counts(ov.best_of_pair(o), ov.by_read(o).select("read", "other"))


@query
def concat_subjects(s, d):
    """All reads in read_id order as one text, by its length and sum: pieces are hashed in order, never in one task."""
    rows = pr.reads(s, d).withColumn("bucket", F.floor(F.col("read_id") / 100))
    sums = rows.groupBy("bucket").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("read_id", "seq"))), lambda x: x["seq"]), "")).alias("sum"), F.sum(F.col("len").cast("long")).alias("bases"))
    return ids.running_starts(sums, "bucket", "bases", "offset")


@query
def partial_scan(s, d):
    """Reads that a batch of overlaps needs, and no others."""
    wanted = pr.overlaps(s, d).where("ident >= 99").select(F.col("qid").cast("long").alias("read_id")).distinct()
    return pr.reads(s, d).join(wanted, "read_id", "left_semi").select("read_id", "len")


@query
def residue_counts(s, d):
    """How often each base occurs, counted per read before anything moves."""
    counts = F.array(*[F.struct(F.lit(b).alias("base"), F.regexp_count("seq", F.lit(b)).cast("long").alias("n")) for b in "ACGT"])
    return pr.reads(s, d).select(F.explode(counts).alias("c")).groupBy("c.base").agg(F.sum("c.n").alias("n"))


@query
def evalues(s, d):
    """Expected chance hits of each overlap's score, in units of 1e-6 of a search of all reads, by the closed formula."""
    bits = (F.lit(0.267) * (F.col("alen") / 100) - F.log(F.lit(0.041))) / F.log(F.lit(2.0))
    return pr.overlaps(s, d).select(*_PLACE, "qsize", "ssize", ov.aligned_length().alias("alen")).select(*_PLACE, F.round(bits, 4).alias("bits"), F.round(F.col("qsize").cast("long") * F.col("ssize") * F.pow(F.lit(2.0), -bits), 4).alias("evalue"))


@query
def two_hop(s, d):
    """Nodes that each node reaches in one or two best edges."""
    es = graph.best_edges(_edges(s, d)).select("src", "dst")
    return graph.reach(es, 2).groupBy("src").agg(F.count("*").alias("reached"))


@query
def m4_roundtrip(s, d):
    """Overlaps written as M4 lines and parsed again."""
    rows = pr.overlaps(s, d).withColumn("score", -ov.aligned_length())
    return formats.parse_m4(formats.m4_lines(rows)).select(*ov.COLUMNS)


@query
def paf_parse(s, d):
    """Overlaps written as PAF lines and parsed again: identity from matches and block length."""
    return formats.parse_paf(formats.paf_lines(pr.overlaps(s, d)))


@query
def chain_candidates(s, d):
    return pipeline.candidates(pr.reads(s, d), K).select(F.floor(F.col("qid") / 2).alias("qid"), "sid", (F.col("qid") % 2).cast("int").alias("qdir"), "score", "seeds", "qoff", "soff")


def _alignments(s, d):
    """All chained candidates of both strands extended, each pair of reads and strand once."""
    st, reads = Stages(s, "alignments"), pr.reads(s, d)
    return st.keep(pipeline.align_candidates(st.keep(pipeline.candidates(reads, K), "chains"), reads), "alignments")


def _subject_alignments(s, d, cut=lambda chains: chains):
    """Alignments to every read as subject; ``cut`` chooses among the candidates in both roles."""
    st, reads = Stages(s, "subjects"), pr.reads(s, d)
    chains = st.keep(pipeline.both_roles(st.keep(pipeline.candidates(reads, K), "chains"), reads, K), "roles")
    return st.keep(pipeline.align_candidates(cut(chains), reads), "alignments")


@query
def align_pairs(s, d):
    return pipeline.forward_offsets(_alignments(s, d)).select("qid", "sid", "qdir", "qoff", "qend", "soff", "send", "ident", "score")


@query
def cigar(s, d):
    rows = _alignments(s, d).withColumn("qid", F.col("qid") * 2 + F.col("qdir")).mapInArrow(formats.cigars, "qid long, sid long, cigar string, md string")
    return rows.select(F.floor(F.col("qid") / 2).alias("qid"), "sid", (F.col("qid") % 2).cast("int").alias("qdir"), "cigar", "md")


@query
def align_tags(s, d):
    return consensus.align_tags(_subject_alignments(s, d))


@query
def read_consensus(s, d):
    return consensus.consensus(consensus.align_tags(_subject_alignments(s, d, seeds.consensus_candidates))).select("sid", F.length("seq").alias("len"), F.md5("seq").alias("sum"))


@query
def find_overlaps(s, d):
    return pipeline.find_overlaps(s, pr.reads(s, d), K)


@query
def overlap_filter(s, d):
    """Overlaps with the reason of the filter's step that drops them, by its automatic limits."""
    o = pr.overlaps(s, d)
    chosen = olfilter.limits(o)
    return olfilter.run(o, chosen["min_identity"], chosen["max_overhang"], keep=Stages(s, "filter").keep).select("qid", "sid", "reason")


@query
def pipeline_assemble(s, d):
    """Load filter with limits from the overlaps, graph, paths and contigs, with sequences made from read ids."""
    reads = s.range(2000).select(F.col("id").cast("int").alias("read_id")).select("read_id", F.expr("substring(repeat(translate(md5(cast(read_id as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 400), 1, cast(3100 + (read_id * 7919) % 9000 as int))").alias("seq"))
    return pipeline.assemble(s, reads, pr.overlaps(s, d)).select("name", "len", F.md5("seq").alias("sum"))
