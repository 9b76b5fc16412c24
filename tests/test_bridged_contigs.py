"""Bridged contigs spelled from contigs and reads of a genome that is known."""

import random

import pytest

from strandlake.operators import bridge, pathgraph
from strandlake.plans.stages import Stages

M4 = "qid int, sid int, ident double, qdir int, qoff int, qend int, qsize int, sdir int, soff int, send int, ssize int"
TURN = str.maketrans("ACGT", "TGCA")
# begin, end, strand: a gap of 100 bases, an overlap of 400, one contig within another, one alone.
CONTIGS = {0: (0, 5000, 0), 1: (5100, 9000, 1), 2: (8600, 13000, 0), 3: (9500, 10100, 1), 7: (15000, 16000, 1)}


def _rows(queries, subjects, least):
    out = []
    for q, (qa, qz, qt) in queries.items():
        for s, (sa, sz, st) in subjects.items():
            lo, hi = max(qa, sa), min(qz, sz)
            if hi - lo >= least and (queries is not subjects or q < s):
                off = lambda a, z, t: (z - hi, z - lo) if t else (lo - a, hi - a)
                out.append((q, s, 99.0, 0, *off(qa, qz, qt), qz - qa, int(qt != st), *off(sa, sz, st), sz - sa))
    return out


@pytest.mark.parametrize("with_direct", [False, True])
def test_gaps_are_filled_and_overlaps_cut(spark, with_direct):
    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(16000))
    reads = {i: (a, a + 1200, i % 2) for i, a in enumerate(range(0, 14800, 90))}
    cut = lambda a, z, t: genome[a:z][::-1].translate(TURN) if t else genome[a:z]
    keep = Stages(spark, "bridged").keep
    hits = keep(spark.createDataFrame(_rows(reads, CONTIGS, 150), M4), "hits")
    found = keep(bridge.supported_sessions(keep(bridge.read_links(hits, 20), "links"), 200, 20, 3), "found")
    direct = keep(bridge.direct_links(spark.createDataFrame(_rows(CONTIGS, CONTIGS, 150) if with_direct else [], M4), 20), "direct")
    bunches = keep(bridge.best_bunches(found, direct, 60), "bunches")
    edges = keep(bridge.contig_graph(bunches), "edges")
    joints = keep(bridge.bridges(found, hits, direct, bunches), "joints")
    # Contig 3 begins 500 bases after contig 1 ends, but lies within contig 2 and is in no path.
    assert {(r["c0"], r["c1"]): (r["gap"], r["read"] is None) for r in joints.collect()} == {(0, 1): (100, False), (1, 2): (-400, with_direct), (1, 3): (500, False)}
    sizes = spark.createDataFrame([(c, z - a) for c, (a, z, _) in CONTIGS.items()], "contig long, len long")
    pieces = keep(bridge.layout(pathgraph.chosen_paths(edges, keep), edges, joints, sizes, bridge.contained_contigs(bunches)), "pieces")
    sequences = lambda d: spark.createDataFrame([(i, cut(*v)) for i, v in d.items()], "id long, seq string")
    got = {r["path"]: r["seq"] for r in bridge.spelled(pieces, sequences(CONTIGS), sequences(reads)).collect()}
    assert len(got) == 2 and got.pop("7") == cut(*CONTIGS[7])
    (whole,) = got.values()
    assert whole in (genome[:13000], genome[:13000][::-1].translate(TURN))
    assert bridge.spelled(pieces, sequences(CONTIGS), sequences(reads), 2000).count() == 1
