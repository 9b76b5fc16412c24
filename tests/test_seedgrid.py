"""Seeds counted in the cells of a grid against seeds joined one by one."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from strandlake.operators import seedgrid, seeds
from strandlake.operators.reads import kmers
from strandlake.plans import pipeline

K = 11


@pytest.fixture(scope="module")
def reads(spark):
    """Copies, repeats within a read, a read too short for a k-mer, letters that are no base."""
    chance = random.Random(7)
    genome = "".join(chance.choice("ACGT") for _ in range(3000))
    unit = genome[:40]
    made = [genome[i * 200 : i * 200 + 900] for i in range(11)] + [genome[:900]] * 3 + [unit * 60, unit * 20 + genome[500:900], "ACGT", genome[100:300] + "N" + genome[301:700]]
    return spark.createDataFrame([(i * 3, seq, len(seq)) for i, seq in enumerate(made)], "read_id long, seq string, len int")


def test_grid_counts_what_the_join_counts(reads, monkeypatch):
    monkeypatch.setattr(seedgrid, "LEAST_BLOCKS", 3)
    hits = seeds.seeds(reads, K)
    sums = hits.groupBy("qid", "sid").agg(F.count("*"), F.sum(F.col("qoff").cast("long")), F.sum(F.col("soff").cast("long")))
    assert rows_of(seedgrid.pair_seeds(reads, K).collect()) == rows_of(sums.collect()) != []
    blocks = seeds.blocks(hits, 256).select("qid", "sid", "block", "hits", "score")
    assert rows_of(seedgrid.pair_blocks(reads, K, width=256).collect()) == rows_of(blocks.collect())
    best = seeds.top_subjects(seeds.blocks(hits, 256), 2)
    assert rows_of(seedgrid.best_subjects(reads, K, 2, width=256).collect()) == rows_of(best.collect())


def test_both_strands(reads):
    index = seeds.capped_index(reads, K)
    probes = kmers(pipeline.both_strands(reads), K).select("kmer", F.col("read_id").alias("qid"), F.col("pos").alias("qoff"))
    hits = index.join(probes, "kmer").where(F.col("sid") < F.floor(F.col("qid") / 2))
    want = seeds.qualifying_blocks(hits, 3, 256).select("qid", "sid", "block", "hits", "score")
    assert rows_of(seedgrid.strand_pair_blocks(reads, K, 3, width=256).collect()) == rows_of(want.collect()) != []


def test_no_seed_is_shuffled(spark, reads):
    from __spark_entry__ import queries
    from conftest import SMALL

    for name in ("seed_join", "seed_blocks", "strand_blocks"):
        plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(qid" not in plan and "Join" not in plan.split("MapInArrow")[0]


def test_blocks_move_once_however_many_there_are(spark, reads, monkeypatch):
    n, wrote, real = reads.count(), [], seedgrid.Stages.folders

    def folders(self, df, name, by):
        wrote.append(spark.read.parquet(real(self, df, name, by)).count())
        return real(self, df, name, by)

    monkeypatch.setattr(seedgrid.Stages, "folders", folders)
    got = []
    for blocks in (2, 5):
        monkeypatch.setattr(seedgrid, "LEAST_BLOCKS", blocks)
        met = seedgrid.pair_seeds(reads, K)
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        got.append(rows_of(met.collect()))
    assert got[0] == got[1] != [] and max(wrote) <= n
