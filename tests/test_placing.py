"""Reads by where they lie: every case of tags and places."""

from strandlake.operators import placing

TAGS = "read int, tag string, sid int, qoff int, qend int, qsize int, soff int, send int"
HITS = "qid int, sid int, ident double, qoff int, qend int, qsize int, soff int, send int, ssize int"


def test_pairs_of_tagged_reads(spark):
    tags = [
        (1, "perfect", 0, 0, 3000, 3000, 1000, 4000), (2, "perfect", 0, 0, 3000, 3000, 3900, 6900), (3, "perfect", 0, 0, 3000, 3000, 4001, 7001), (4, "perfect", 9, 0, 3000, 3000, 1000, 4000),
        (5, "unperfect", 0, 0, 100, 3000, 90000, 90100), (6, "circular", 0, 0, 2500, 3000, 8000, 9000), (7, "circular", 3, 0, 2500, 3000, 0, 9),
        (8, "perfect", 0, 0, 200, 200, 4100, 4300), (9, "perfect", 0, 0, 700, 700, 0, 699), (10, "perfect", 0, 0, 700, 700, 7800, 8500),
    ]
    pairs = [(a, b) for a, *_ in tags for b, *_ in tags if a != b] + [(1, 77), (77, 1)]
    got = {(r["qid"], r["sid"]): r["valid"] for r in placing.valid_pairs(spark.createDataFrame(pairs, "qid int, sid int"), spark.createDataFrame(tags, TAGS)).collect()}
    assert len(got) == 90
    want = {(1, 2): True, (2, 1): True, (1, 3): False, (1, 4): False, (1, 5): True, (5, 1): True, (5, 6): False, (6, 5): True, (6, 7): True, (7, 6): True, (9, 6): True, (6, 9): True, (1, 6): False, (6, 1): False, (10, 6): True, (6, 10): True, (2, 8): True, (1, 8): False}
    assert {k: got[k] for k in want} == want


def test_places_of_reads(spark):
    def hit(read, sid, ident=90.0, q=(0, 3000, 3000), s=(5000, 8000, 20000)):
        return (read, sid, ident, *q, *s)

    rows = [hit(1, 5), hit(1, 6, q=(100, 2900, 3000)), hit(2, 5), hit(2, 6), hit(3, 5, ident=79.0), hit(4, 5, q=(1000, 3000, 3000), s=(0, 2000, 20000)), hit(4, 6, q=(400, 2900, 3000))]
    rows += [hit(5, 5, q=(1000, 3000, 3000), s=(0, 2000, 20000)), hit(5, 6, q=(0, 1900, 3000), s=(18100, 20000, 20000)), hit(6, 5, q=(300, 2300, 3000)), hit(6, 6, q=(300, 2800, 3000)), hit(6, 7, q=(300, 900, 3000)), hit(7, 5, q=(0, 900, 900), s=(0, 900, 9000))]
    df = spark.createDataFrame(rows, HITS)
    got = {tuple(r) for r in placing.places(df).collect()}
    assert got == {(1, "end", 5), (4, "crossing", 5), (6, "part", 5), (6, "part", 6)}
    assert placing.places(df.limit(0)).count() == 0 and placing.placed_tags(df.limit(0)).count() == 0
    assert {(r["read"], r["tag"]) for r in placing.placed_tags(df).where("read in (1, 6)").collect()} == {(1, "perfect"), (6, "unperfect")}


def test_tags_of_placed_reads_are_not_broadcast(spark, tmp_path):
    # Written and read again, a hundred thousand tags are a small file.
    spark.range(100_000).selectExpr("cast(id as int) as read", "'perfect' as tag", "0 as sid", "0 as qoff", "9 as qend", "9 as qsize", "0 as soff", "9 as send").write.parquet(f"{tmp_path}/tags")
    pairs = spark.range(1000).selectExpr("cast(id as int) as qid", "cast(id + 1 as int) as sid")
    found = placing.valid_pairs(pairs, spark.read.parquet(f"{tmp_path}/tags"))
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    assert found.where("valid").count() == 1000
