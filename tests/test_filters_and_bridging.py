"""Filter, saturation, read database and bridging: rows of their SQL, and small cases whose answer is known."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.operators import bridge, olfilter, overlap, pathgraph, quantiles, reads, saturation
from strandlake.plans import bridging, filters
from strandlake.plans.stages import Stages
from strandlake.sources import seqdb


@pytest.mark.parametrize("name", sorted((filters.ORACLES.keys() | bridging.ORACLES.keys()) - {"saturation"}))  # consensus_coverage runs it
def test_same_rows_as_sql(name, same_rows):
    both = filters.QUERIES | bridging.QUERIES, filters.ORACLES | bridging.ORACLES
    same_rows(both[0][name], both[1][name])


@pytest.fixture
def keep(spark):
    return Stages(spark, "tests").keep


def test_the_automatic_filter_keeps_reads_and_gives_every_reason(duck):
    found = dict(duck.sql(f"select coalesce(reason, 'kept'), count(*) from ({filters.ORACLES['filter_tiled']}) group by 1").fetchall())
    assert set(found) == {"kept", "Coverage", "LackOfSupport", "Contained", "BestN"} and found["kept"] > 1000


def test_medians_of_small_and_of_very_large_groups(spark, keep, monkeypatch):
    rng = random.Random(4)
    rows = [("hot", rng.randint(0, 10**6) / 8, rng.randint(1, 9)) for _ in range(3000)] + [(f"g{i % 40}", rng.randint(0, 30) / 2, rng.randint(0, 4)) for i in range(600)] + [("one", 5.0, 1), ("none", None, 3)]

    def median(values):
        values, total, run = sorted(values), sum(w for _, w in values), 0
        for v, w in values:
            run += w
            if 2 * run >= total:
                return v

    want = {}
    for g in {g for g, *_ in rows} - {"none"}:
        mine = [(v, w) for x, v, w in rows if x == g and w]
        want[g] = (m := median(mine), median([(abs(v - m), w) for v, w in mine]))
    df = spark.createDataFrame(rows, "g string, v double, w int")
    for bins in (512, 8):  # with 8, groups of more than 80 values are narrowed
        monkeypatch.setattr(quantiles, "BINS", bins)
        assert {r["g"]: (r["median"], r["mad"]) for r in quantiles.grouped_median_mad(df, "g", keep).collect()} == want


@pytest.mark.parametrize("most_bases,most_reads", [(1000, 10**6), (10**6, 7), (900, 4), (1, 5), (10**9, 10**9)])
def test_volumes_like_one_walk_over_all_reads(spark, most_bases, most_reads):
    rng = random.Random(most_reads)
    sizes = [(i * 3, rng.randint(1, 400)) for i in range(300)]
    want, volume, first, n, mass = [(0, 0, 300, sum(s for _, s in sizes))], 1, None, 0, 0
    for read, size in sizes:
        first, n, mass = (read if first is None else first), n + 1, mass + size
        if mass >= most_bases or n >= most_reads:
            want.append((volume, first, n, mass))
            volume, first, n, mass = volume + 1, None, 0, 0
    want += [(volume, first, n, mass)] if n else []
    df = spark.createDataFrame(sizes, "read_id long, len int").repartition(5)
    assert sorted(map(tuple, reads.volumes(spark, df, most_bases, most_reads).collect())) == want


def test_volumes_of_nothing(spark):
    assert [tuple(r) for r in reads.volumes(spark, spark.createDataFrame([], "read_id long, len int"), 10, 10).collect()] == [(0, None, 0, 0)]


def test_database_scans_open_the_volumes_they_need(spark, tmp_path, capsys):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ACGT" if i % 3 else "ACGTNNR") for _ in range(50 + i))) for i in range(40)] + [(99, None)]
    folder = f"file://{tmp_path}/db"
    seqdb.build(spark, spark.createDataFrame(rows, "read_id long, seq string"), folder, 700, 10**6, least=60)
    whole = seqdb.scan(spark, folder)
    got = {r["read_id"]: r for r in seqdb.restored(spark, folder, whole).collect()}
    assert {k: r["seq"] for k, r in got.items()} == {i: s for i, s in rows if s and len(s) >= 60}
    assert [got[k]["id"] for k in sorted(got)] == list(range(len(got))) and whole.where(F.col("seq").rlike("[^ACGT]")).count() == 0
    seqdb.scan(spark, folder, [2, 3]).explain("formatted")
    wanted = spark.read.parquet(f"{folder}/ambiguous").where("size >= 4").select("volume")
    seqdb.scan(spark, folder, wanted).explain("formatted")
    said = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(volume" in said or "PartitionFilters: [volume" in said
    assert "dynamicpruning" in said
    assert {r["volume"] for r in seqdb.scan(spark, folder, [2, 3]).collect()} == {2, 3}


def test_saturation_like_one_alignment_after_the_other(spark, keep):
    rng = random.Random(1)
    spans = []
    for subject in range(5):
        for rank in range(1, 25):
            a = rng.randint(0, 1500)
            spans.append((subject, rank, a, a + rng.choice([0, 30, 300, 700])))
    want = set()
    for subject in range(5):
        cover = [0] * 3000
        for s, rank, a, z in sorted(spans):
            if s == subject and z > a and sum(c < 3 for c in cover[a:z]) >= 100:
                want.add((s, rank))
                for i in range(a, z):
                    cover[i] += 1
    df = spark.createDataFrame(spans, "subject int, rank int, a int, z int")
    assert {tuple(r) for r in saturation.saturating(df, 3, 100, keep).collect()} == want
    assert saturation.saturating(df.limit(0), 3, 100, keep).count() == 0


def test_saturation_deals_spans_out_once(spark, keep):
    rows = spark.createDataFrame([(s, a, a + 400, s * a % 7) for s in range(6) for a in range(0, 900, 50)], "subject int, a int, z int, other int")
    by, written = [F.desc("other"), F.col("a")], []
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("subject").orderBy(*by)))
    want = {tuple(r) for r in saturation.saturating(ranked, 2, 150, keep).collect()}
    seen = lambda x, name: written.append(x._jdf.queryExecution().executedPlan().toString()) or keep(x, name)
    got = saturation.taken_spans(rows, 2, 150, seen, by=by)
    assert {(r["subject"], r["rank"]) for r in got.collect()} == want and len(written) == 1
    assert written[0].count("Exchange hashpartitioning") == 1


def test_saturation_is_one_pass_and_many_alignments_go_by_rounds(spark, keep):
    rng = random.Random(2)
    spans = [(subject, rank, a, a + 400) for subject, most in ((1, 3), (2, 40), (3, 12)) for rank in range(most) for a in [rng.randint(0, 900)]]
    df = spark.createDataFrame(spans, "subject int, rank int, a int, z int")
    written = []
    counted = lambda x, name: written.append(name) or keep(x, name)
    once = {tuple(r) for r in saturation.saturating(df, 2, 150, counted).collect()}
    assert len(written) == 1 and once
    assert {tuple(r) for r in saturation.saturating(df, 2, 150, counted, ordered=12).collect()} == once and len(written) > 2


def test_conditions_on_offsets_stay_behind_their_terms(spark):
    """A filter by location does not write out the terms of every offset again."""
    from strandlake.sources import projections as pr
    from strandlake.operators import overlap as ov
    from conftest import SMALL

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for source in (pr.tiled_overlaps, pr.overlaps):
        rows = source(spark, SMALL)
        assert plan(ov.load_filter(rows, 91.0, 3000, 2**31 - 1, 1000, 20)).count("l_linenumber") <= plan(rows).count("l_linenumber") + 2
        assert rows.schema["qoff"].dataType.simpleString() == "int" and tuple(rows.columns) == ov.COLUMNS


M4 = "qid int, sid int, ident double, qdir int, qoff int, qend int, qsize int, sdir int, soff int, send int, ssize int"


def test_reads_bridge_a_gap_and_contained_contigs_go(spark, keep):
    # Contig 1 ends 100 bases before contig 2 begins (on the other strand); contig 3 lies within contig 1.
    hits = []
    for i in range(6):
        left = 400 + 10 * i
        hits += [(i, 1, 99.0, 0, 0, left, 1000, 0, 5000 - left, 5000, 5000), (i, 2, 99.0, 0, left + 100, 1000, 1000, 1, 4000 - (900 - left), 4000, 4000)]
    for i in range(6, 12):
        size = 2110 + i  # over all of contig 3, which is contig 1's bases 1500 to 3500
        hits += [(i, 1, 99.0, 0, 0, size, size, 0, 1450 - i, 3560, 5000), (i, 3, 99.0, 0, 50 + i, 2050 + i, size, 0, 0, 2000, 2000)]
    links = keep(bridge.read_links(spark.createDataFrame(hits, M4), 20), "links")
    gap = [r for r in links.collect() if (r["c0"], r["c1"]) == (1, 2)]
    assert len(gap) == 6 and {(r["same"], r["lo"], r["hi"], r["loc"]) for r in gap} == {(False, 4100, 9100, "Right")}
    found = keep(bridge.supported_sessions(links, 200, 20, 3), "found")
    bunches = keep(bridge.best_bunches(found, keep(bridge.direct_links(spark.createDataFrame([], M4), 20), "direct"), 60), "bunches")
    assert {(r["c0"], r["c1"], r["loc"], r["support"]) for r in bunches.collect()} == {(1, 2, "Right", 6), (1, 3, "Containing", 6)}
    edges = keep(bridge.contig_graph(bunches), "edges")
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(-2, 3), (-3, 2)}
    assert pathgraph.chosen_paths(edges, keep).where("forward").count() == 1


def test_a_session_needs_links_all_over_its_part(spark, keep):
    def link(read, real_lo, real_hi):
        return (1, 2, read, True, 5000, 5000, -4000, -4000, 1000, 0, 1000, real_lo, real_hi, "Left")

    names = "c0 int, c1 int, read int, same boolean, len0 int, len1 int, pos0 long, lo long, hi long, expect_lo long, expect_hi long, real_lo long, real_hi long, loc string"
    whole = [link(i, 0, 1000) for i in range(5)]
    holed = [link(i, 0, 480 if i < 3 else 1000) for i in range(5)]
    assert [r["depth"] for r in bridge.supported_sessions(spark.createDataFrame(whole, names), 200, 20, 3).collect()] == [5]
    assert bridge.supported_sessions(spark.createDataFrame(holed, names), 200, 20, 3).count() == 0
    assert [r["depth"] for r in bridge.supported_sessions(spark.createDataFrame(holed, names), 200, 20, 1).collect()] == [2]


def test_direct_links_decide_between_sessions(spark, keep):
    found = spark.createDataFrame([(1, 2, True, 1, 9, -4000, "Left"), (1, 2, True, 2, 5, -3000, "Left"), (3, 4, True, 1, 4, 70, "Right"), (5, 6, True, 1, 8, 10, "Left")], "c0 int, c1 int, same boolean, session long, links long, pos0 long, loc string")
    direct = spark.createDataFrame([(1, 2, True, -2990, "Left", 800), (5, 6, False, 10, "Left", 700)], "c0 int, c1 int, same boolean, pos0 long, loc string, aligned long")
    assert {tuple(r) for r in bridge.best_bunches(found, direct, 60).collect()} == {(1, 2, True, "Left", 5, "direct"), (3, 4, True, "Right", 4, "reads")}


def test_local_limits_move_each_value_twice_and_meet_few_overlaps(spark):
    from conftest import SMALL, rows_of

    from strandlake.operators import olfilter
    from strandlake.sources import projections as pr

    o = pr.tiled_overlaps(spark, SMALL)
    found = olfilter.local_statistics(o)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(read") == 2 and "Join" not in plan
    limits = olfilter.local_limits(o, 92.0, 8.0).localCheckpoint()
    assert rows_of(olfilter.local_dropped(o, limits, 92.0, 8.0).collect()) == rows_of(olfilter.local_dropped(o, limits).collect()) != []


def test_best_of_pair_and_coverage_need_no_strands(spark):
    rows = [(1, 2, 90.0, 0, 100, 900, 1000, 0, 0, 800, 800), (2, 1, 90.0, 0, 0, 800, 800, 0, 100, 900, 1000), (1, 2, 95.0, 0, 0, 500, 1000, 1, 0, 500, 800), (3, 1, 91.0, 0, 5, 300, 400, 1, 10, 305, 1000)]
    df = spark.createDataFrame(rows, "qid int, sid int, ident double, qdir int, qoff int, qend int, qsize int, sdir int, soff int, send int, ssize int")
    assert {tuple(r) for r in overlap.best_of_pair(df).collect()} == {rows[0], rows[3]} and overlap.best_of_pair(df).dtypes == df.dtypes
    few = overlap.best_of_pair(df.drop("qdir", "sdir"))
    cov = {tuple(r) for r in olfilter.coverage(few.drop("ident")).collect()}
    assert cov == {(1, 1000, 0, 2), (2, 800, 1, 1), (3, 400, 0, 1)} == {tuple(r) for r in olfilter.coverage(overlap.best_of_pair(df)).collect()}
