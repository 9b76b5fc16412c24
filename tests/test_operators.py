"""Small cases of formats, intervals, graph steps and the way from reads to a genome."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions.sequence import kmer_text
from strandlake.operators import graph
from strandlake.operators import intervals as iv
from strandlake.operators import overlap as ov
from strandlake.operators import reads as rd
from strandlake.plans import pipeline
from strandlake.plans.stages import Stages
from strandlake.sources import formats as fm
from strandlake.streaming.ingest import index_stream

TURN = str.maketrans("ACGT", "TGCA")


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 first read\nACGT\nAC GT;note\n>r2\nacgn\n>r1 again\nA\n>bad\nAC*T\n>none\n")
    rows = {r["seq"]: r for r in fm.read_sequences(spark, str(tmp_path / "a.fasta")).collect()}
    assert rows["ACGTACGT"]["comment"] == "first read" and rows["ACGTACGT"]["fault"] is None
    assert (rows["ACGN"]["name"], rows["A"]["fault"], rows["AC*T"]["fault"], rows[""]["fault"]) == ("r2", "name again", "residue", "no sequence")
    (tmp_path / "b.fastq").write_text("@q1 x y\nACGT\n+\n@@@@\n@q2\nAC\n+\n!\n")
    rows = {r["name"]: r for r in fm.read_sequences(spark, str(tmp_path / "b.fastq")).collect()}
    assert (rows["q1"]["qual"], rows["q1"]["fault"], rows["q2"]["fault"]) == ("@@@@", None, "quality length")
    (tmp_path / "all.txt").write_text(f"# both\n{tmp_path}/a.fasta\n\n{tmp_path}/b.fastq\n")
    assert fm.read_sequences(spark, str(tmp_path / "all.txt")).count() == 7
    (tmp_path / "empty").write_text("\n;\n")
    assert fm.sniff(spark, str(tmp_path / "empty")) == "empty"


def test_overlap_formats(spark, tmp_path):
    (tmp_path / "x.paf").write_text("a\t100\t0\t90\t-\tb\t120\t30\t120\t81\t90\t60\n")
    row = fm.read_overlaps(spark, str(tmp_path / "x.paf")).first()
    assert (row["ident"], row["score"], row["qdir"], row["sdir"], row["ssize"]) == (90.0, -90, 0, 1, 120)
    (tmp_path / "x.ovl").write_text("1 2 -50 91.5 0 0 10 20 1 5 15 30\n")
    row = fm.read_overlaps(spark, str(tmp_path / "x.ovl")).first()
    assert (row["ident"], row["score"], row["sdir"], row["send"]) == (91.5, -50, 1, 15)
    with pytest.raises(ValueError):
        fm.read_overlaps(spark, str(tmp_path / "x.bin"))
    assert fm.read_config("PROJECT='p'\nGENOME_SIZE=5\nRAWREADS=\"x\"\n# k=v\n")["PROJECT"] == "p"
    with pytest.raises(ValueError):
        fm.read_config("PROJECT=p\n")


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 5, 15), (1, 20, 30)], "g int, lo long, hi long")
    got = lambda x: sorted(tuple(r) for r in x.collect())
    assert got(iv.merge(df, "g")) == [(1, 0, 15, 2), (1, 20, 30, 1)]
    assert got(iv.depth(df, "g")) == [(1, 0, 5, 1), (1, 5, 10, 2), (1, 10, 15, 1), (1, 20, 30, 1)]
    assert got(iv.invert(iv.merge(df, "g"), "g", 0, 40)) == [(1, 15, 20), (1, 30, 40)]
    assert got(iv.merge_overlapping(df, "g", 6).select("g", "lo", "hi", "ct")) == [(1, 0, 10, 1), (1, 5, 15, 1), (1, 20, 30, 1)]
    assert got(iv.merge_overlapping(df, "g", 5).select("g", "lo", "hi", "ct")) == [(1, 0, 15, 2), (1, 20, 30, 1)]
    assert iv.merge(df.limit(0), "g").count() == 0


@pytest.mark.parametrize(
    "row, want",
    [
        ((0, 50, 100, 0, 0, 50, 120), "Left"), ((0, 0, 50, 0, 70, 120, 120), "Right"), ((0, 0, 100, 0, 0, 120, 120), "Equal"),
        ((0, 20, 80, 0, 0, 120, 120), "Containing"), ((0, 0, 100, 0, 20, 110, 120), "Contained"), ((0, 20, 80, 0, 20, 80, 120), "Abnormal"),
        ((0, 0, 50, 1, 0, 50, 120), "Left"), ((0, 50, 100, 1, 70, 120, 120), "Right"), ((0, 0, 50, 1, 70, 120, 120), "Abnormal"),
    ],
)
def test_locations(spark, row, want):
    df = spark.createDataFrame([(row[0], row[1], row[2], 100, row[3], row[4], row[5], row[6])], "qdir int, qoff int, qend int, qsize int, sdir int, soff int, send int, ssize int")
    assert df.select(ov.location(0)).first()[0] == want


def test_longest_reads_keep_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 3)], "read_id long, len int")
    assert tuple(rd.longest_cutoff(df, 10).first()) == (5, 3, 15)
    assert sorted(r["read_id"] for r in rd.longest_prefix(df, 10).collect()) == [1, 2]
    assert rd.longest_cutoff(df, 1000).first()["cutoff"] == 0


def _edge(src, dst, length, score=1):
    return (src, dst, length, score, 99.0, 0, 0, length)


EDGE = "src int, dst int, len int, score int, ident double, read int, start int, end int"


def test_transitive_and_spurs(spark):
    rows = [(-1, -2, 100), (-2, -3, 100), (-1, -3, 200)]
    es = spark.createDataFrame([_edge(*r) for r in rows] + [_edge(-b, -a, n) for a, b, n in rows], EDGE)
    assert {tuple(r) for r in graph.transitive(es).collect()} == {(-1, -3), (3, 1)}
    rows = [(-1, -2, 9), (-2, -3, 9), (-3, -4, 9), (-2, -9, 9)]
    es = spark.createDataFrame([_edge(*r) for r in rows] + [_edge(-b, -a, n) for a, b, n in rows], EDGE)
    assert {tuple(r) for r in graph.spurs(es, es).collect()} == {(-2, -9), (9, 2)}


def test_paths_and_rings(spark):
    es = spark.createDataFrame([_edge(1, 2, 5), _edge(2, 3, 6), _edge(3, 4, 7), _edge(10, 11, 1), _edge(11, 12, 2), _edge(12, 10, 3)], EDGE)
    found = {r["path"]: (r["first"], r["last"], r["edges"], r["bases"]) for r in graph.path_summary(graph.simple_paths(spark, es, Stages(spark, "t").keep)).collect()}
    assert found == {"1~2": (1, 4, 3, 18), "10~11": (10, 10, 3, 6)}


def test_reads_to_genome(spark):
    rng = random.Random(3)
    genome = "".join(rng.choice("ACGT") for _ in range(8000))
    reads = [genome[i : i + 3000] for i in range(0, 5001, 500)]
    reads = [r[::-1].translate(TURN) if k % 2 else r for k, r in enumerate(reads)]
    df = spark.createDataFrame([(k, r, len(r)) for k, r in enumerate(reads)], "read_id long, seq string, len int")
    got = pipeline.assemble(spark, df, pipeline.find_overlaps(spark, df), 90.0, 20, min_length=1000, min_aligned=1000).collect()
    assert [r["seq"] in (genome, genome[::-1].translate(TURN)) for r in got] == [True]


def test_lasting_stage_is_skipped(spark, tmp_path):
    st = Stages(spark, "x", f"file://{tmp_path}/stages")
    st.stage("a", lambda: spark.range(3), k=1)
    assert st.stage("a", lambda: 1 / 0, k=1).count() == 3
    assert st.stage("a", lambda: spark.range(5), k=2).count() == 5


def test_index_stream(spark, tmp_path):
    spark.createDataFrame([(1, "ACGTACGTACGTACG", 15)], "read_id long, seq string, len int").write.parquet(str(tmp_path / "in/a"))
    (tmp_path / "flat").mkdir()
    for p in (tmp_path / "in/a").glob("*.parquet"):
        p.rename(tmp_path / "flat" / p.name)
    index_stream(spark, str(tmp_path / "flat"), str(tmp_path / "index"), str(tmp_path / "cp"), 13, 1).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "index")).where(kmer_text(F.col("kmer")) == "ACGTACGTACGTA").count() == 1


def test_kmers_of_long_reads_in_linear_time(spark):
    import time

    from strandlake.operators import reads as rd

    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(2000)) + "N" + "".join(rng.choice("ACGT") for _ in range(900))
    df = spark.createDataFrame([(1, seq, len(seq)), (2, "ACG", 3), (3, "", 0)], "read_id long, seq string, len int")
    for step in (1, 10):
        got = sorted((r["pos"], r["t"]) for r in rd.kmers(df, 13, step).select("pos", kmer_text(F.col("kmer")).alias("t")).collect())
        assert got == [(i, seq[i : i + 13]) for i in range(0, len(seq) - 12, step) if "N" not in seq[i : i + 13]]

    def seconds(n):
        one = spark.range(1).select(F.lit(1).alias("read_id"), F.repeat(F.lit("ACGTTGCAAC"), n // 10).alias("seq"), F.lit(n).alias("len"))
        began = time.perf_counter()
        assert rd.kmers(one, 13).agg(F.sum("kmer")).first()[0] > 0
        return time.perf_counter() - began

    seconds(50_000)
    assert seconds(1_000_000) < 20 * seconds(100_000) + 2


def test_common_neighbours_meet_as_words(spark):
    links = [(a, b, a % 3 == 0, b % 2 == 0) for a in range(-2, 200) for b in (a + 1, a + 2, a + 64, (a * 7) % 200)]
    adj = {(a, b): (x, y) for a, b, x, y in links} | {(b, a): (y, x) for a, b, x, y in links}
    rows = spark.createDataFrame([(a, b, x, y) for (a, b), (x, y) in adj.items()], "read int, other int, at0 boolean, at1 boolean")
    pairs = sorted({(a, b) for a, b in adj if a < b})
    found = {tuple(r)[:2]: tuple(r)[2:] for r in ov.common_counts(spark.createDataFrame(pairs, "qid int, sid int"), rows, "at0", "at1").collect()}
    of = lambda r: {b for a, b in adj if a == r}
    want = {}
    for q, s in pairs:
        both = [n for n in of(q) & of(s) if n != s]
        if both:
            want[q, s] = (len(both), *[sum(adj[r, n][i] for n in both) for i in (0, 1) for r in (q, s)])
    assert found == want
    # A thousand neighbours of a read are 16 rows to meet, not a thousand.
    assert ov.neighbour_words(spark.range(1024).selectExpr("7 as read", "cast(id as int) as other")).count() == 16


def _splits(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("split(")


def test_m4_lines_are_split_once(spark):
    lines = spark.createDataFrame([(" 1 2\t91.5 0 0 0 10 20 1 5 15 30 ",), ("  ",), (None,)], "value string")
    rows = fm.parse_m4(lines)
    assert [(r["qid"], r["ident"], r["ssize"]) for r in rows.collect()] == [(1, 91.5, 30)]
    assert (_splits(rows), _splits(fm.parse_ovl(lines))) == (1, 1)


def test_paf_lines_are_split_once(spark):
    rows = fm.parse_paf(spark.createDataFrame([("a\t100\t0\t90\t-\tb\t120\t30\t120\t81\t90\t60",), (" ",), (None,)], "value string"))
    assert [(r["qid"], r["ident"], r["sdir"]) for r in rows.collect()] == [("a", 90.0, 1)]
    assert _splits(rows) == 1
