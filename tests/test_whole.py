"""Small cases that show queries doing all of their job."""

import hashlib
import random

from strandlake.operators import graph, olfilter
from strandlake.plans import catalog, trimming
from strandlake.plans.catalog import QUERIES
from strandlake.plans.graphs import QUERIES as GRAPHS
from strandlake.sources import projections

TURN = str.maketrans("ACGT", "TGCA")


def test_alignments_of_all_subjects_and_strands(spark, tmp_path):
    rng = random.Random(5)
    text = "".join(rng.choice("abcd") for _ in range(900))
    turned = text[::-1].translate(str.maketrans("abcd", "dcba"))
    spark.createDataFrame([(i, turned if i == 4 else text) for i in range(5)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["qid"], r["sid"], r["qdir"]): r for r in QUERIES["align_pairs"](spark, str(tmp_path)).collect()}
    assert set(got) == {(q, s, int(q == 4)) for q in range(5) for s in range(q)}
    assert all((r["qoff"], r["qend"], r["soff"], r["send"], r["ident"]) == (0, 900, 0, 900, 100.0) for r in got.values())
    assert {tuple(r) for r in QUERIES["cigar"](spark, str(tmp_path)).select("qid", "sid", "qdir", "cigar").collect()} == {(*k, "900M") for k in got}
    assert {r["n"] for r in QUERIES["align_tags"](spark, str(tmp_path)).collect()} == {4}
    bases = text.upper().translate(str.maketrans("ABCD", "ACGT"))
    want = {i: hashlib.md5((bases[::-1].translate(TURN) if i == 4 else bases).encode()).hexdigest() for i in range(5)}
    assert {r["sid"]: r["sum"] for r in QUERIES["read_consensus"](spark, str(tmp_path)).collect()} == want


def _size(read):
    return 3100 + read * 7919 % 9000


def _lineitem(spark, folder, rows):
    """rows: (query, subject, line number, discount); lines 4 and 1 lie at the query's end and begin, 2 across the shorter."""
    cols = "l_orderkey long, l_partkey long, l_linenumber int, l_discount double, l_suppkey long, l_quantity double"
    spark.createDataFrame([(*r, 0, 0.0) for r in rows], cols).write.parquet(f"{folder}/lineitem.parquet")


def test_gaps_of_same_strand_odd_reads_need_witnesses_and_no_spans(spark, tmp_path):
    shown, few, spanned = [r for r in range(1, 2000, 2) if 5500 < _size(r) < 7500][:3]
    short = [r for r in range(0, 2000, 2) if _size(r) < 3600][:3]
    long = [r for r in range(0, 2000, 2) if _size(r) > 9000][:10]
    pairs = [(shown, s) for s in short] + [(few, s) for s in short[:2]] + [(spanned, s) for s in short]
    _lineitem(spark, tmp_path, [(q, s, n, 0.0) for q, s in pairs for n in (4, 1)] + [(spanned, s, 2, 0.0) for s in long])
    overlaps = projections.overlaps(spark, str(tmp_path))
    assert [(r["read"], r["ct"]) for r in trimming.gaps_of(overlaps).collect()] == [(shown, 3)]
    cut = {r["read"]: r["size"] for r in trimming.clear_of(overlaps).collect()}
    assert cut[shown] < _size(shown) - 500 and (cut[few], cut[spanned]) == (_size(few), _size(spanned))


def test_spurs_count_every_edge(spark):
    rows = [(-1, -2, 10), (-2, -3, 10), (-3, -4, 10), (-2, -9, 10), (-9, -10, 9)]
    es = spark.createDataFrame([(*e, 1, 99.0, 0, 0, 1) for a, b, n in rows for e in ((a, b, n), (-b, -a, n))], "src int, dst int, len int, score int, ident double, read int, start int, end int")
    best = graph.best_edges(es)
    part, whole = ({tuple(r) for r in graph.spurs(best, edges).collect()} for edges in (es.where("len % 3 <> 0"), es))
    assert (-2, -9) in part and (-2, -9) not in whole


def test_counts_kept_are_the_survey_s(spark, tmp_path):
    long = [r for r in range(2000) if _size(r) > 6000][:331]
    _lineitem(spark, tmp_path, [(s, long[0], 1, i % 10 / 100) for i, s in enumerate(long[1:])])
    kept = {r["read"]: r["kept"] for r in QUERIES["top300"](spark, str(tmp_path)).collect()}
    assert (kept[long[0]], kept[long[1]]) == (300, 1)
    assert [(r["sid"], r["kept"]) for r in QUERIES["cns_candidates60"](spark, str(tmp_path)).collect()] == [(long[0], 60)]


def test_best_ten_an_end(spark, tmp_path):
    hub, *rest = [r for r in range(2000) if _size(r) > 6000][:25]
    subjects = [(s, h) for s in rest[:12] for h in rest[12:24]]
    _lineitem(spark, tmp_path, [(hub, s, 1, i / 100) for i, s in enumerate(rest[:12])] + [(s, h, 4, 0.0) for s, h in subjects])
    five = {tuple(r) for r in olfilter.best_n(catalog._proper(spark, str(tmp_path)), 5).select("qid", "sid").collect()}
    assert five < {tuple(r) for r in QUERIES["bestn"](spark, str(tmp_path)).collect()}


def test_contained_reads_do_not_reach_contigs(spark, tmp_path):
    inner, other = [r for r in range(2000) if 4000 < _size(r) < 5000][:2]
    outer, beside = [r for r in range(2000) if _size(r) > 9000][:2]
    _lineitem(spark, tmp_path, [(outer, beside, 1, 0.0), (inner, outer, 2, 0.0), (inner, other, 1, 0.0)])
    names = [r["name"] for r in QUERIES["pipeline_assemble"](spark, str(tmp_path)).collect()]
    assert {abs(int(n)) - 1 for name in names for n in name.removeprefix("ctg_").split("~")} == {outer, beside}
    assert {(r["qid"], r["sid"]) for r in QUERIES["overlap_filter"](spark, str(tmp_path)).collect()} == {(outer, beside), (inner, outer), (inner, other)}


def test_spurs_of_overlaps_and_of_stretches(spark, tmp_path):
    a, b, c, d = [r for r in range(2000) if _size(r) > 6000][:4]
    _lineitem(spark, tmp_path, [(a, b, 4, 0.0), (a, c, 4, 0.0), (b, d, 4, 0.0)])
    found = {tuple(r) for r in GRAPHS["spur"](spark, str(tmp_path)).where("graph = 'overlaps'").select("src", "dst").collect()}
    assert {frozenset(map(abs, e)) for e in found} == {frozenset((a + 1, c + 1))} and len(found) == 2
