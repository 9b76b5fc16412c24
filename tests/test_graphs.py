"""Path graph, cleaning and shortest ways: rows of their SQL, and small graphs whose answer is known."""

import heapq
import random
from collections import defaultdict

import pytest

from strandlake.operators import chains, cleaning, graph, pathgraph, shortest
from strandlake.plans.graphs import ORACLES, QUERIES
from strandlake.plans.stages import Stages


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLES[name])


def strand(spark, ways):
    """A string graph of (src, dst, len, score), with reverses."""
    both = [(a, b, n, s) for a, b, n, s in ways] + [(-b, -a, n, s) for a, b, n, s in ways]
    return spark.createDataFrame(both, "src int, dst int, len int, score int")


def paths(spark, ways, keep):
    return keep(pathgraph.path_edges(spark, keep(strand(spark, ways), "strand"), keep), "paths")


@pytest.fixture
def keep(spark):
    return Stages(spark, "graphs").keep


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def line(a, b, n=100, score=10):
    return [(x, x + 1, n, score) for x in range(a, b)]


def test_a_bubble_is_folded_and_its_graph_is_one_contig(spark, keep):
    # 1 .. 4, then 4-5-6-9 or 4-7-8-9, then 9 .. 12.
    ways = line(1, 4) + line(4, 6) + [(6, 9, 100, 10), (4, 7, 300, 50), (7, 8, 300, 50), (8, 9, 300, 50)] + line(9, 12)
    edges = paths(spark, ways, keep)
    found, members = pathgraph.bundles(edges, keep)
    assert ids(found, "start", "end", "len", "score", "size") == [(-9, -4, 900, 150, 2), (4, 9, 900, 150, 2)]
    assert members.count() == 4
    folded = keep(pathgraph.compounds(edges, keep), "folded")
    assert sorted(r["kind"] for r in folded.collect()) == ["compound"] * 2 + ["simple"] * 4
    chosen = pathgraph.chosen_paths(folded, keep)
    assert [r["eid"] for r in chosen.where("forward").orderBy("pos").collect()] in (["1~2~3~4", "4~0~0~9", "9~10~11~12"], ["-12~-11~-10~-9", "-9~0~0~-4", "-4~-3~-2~-1"])


def test_no_bubble_over_a_dead_end_or_back_into_itself_or_over_bounds(spark, keep):
    dead = paths(spark, [(1, 2, 9, 1), (1, 3, 9, 1), (2, 4, 9, 1), (3, 4, 9, 1), (3, 5, 9, 1)], keep)
    assert pathgraph.bundles(dead, keep)[0].where("start = 1").count() == 0
    turned = paths(spark, [(1, 2, 9, 1), (1, 3, 9, 1), (2, -3, 9, 1), (2, 4, 9, 1), (3, 4, 9, 1)], keep)
    assert pathgraph.bundles(turned, keep)[0].where("start = 1").count() == 0
    wide = paths(spark, [(1, x, 9, 1) for x in range(2, 8)] + [(x, 9, 9, 1) for x in range(2, 8)] + [(9, 10, 9, 1)], keep)
    assert pathgraph.bundles(wide, keep)[0].where("start = 1").count() == 1  # one path edge each: a single tip
    long = paths(spark, [(1, 2, 400_000, 1), (2, 3, 200_000, 5), (1, 3, 9, 1), (3, 4, 9, 1)], keep)
    assert pathgraph.bundles(long, keep)[0].where("start = 1").count() == 0
    assert pathgraph.bundles(long, keep, length=700_000)[0].where("start = 1").count() == 1


def test_larger_bubbles_go_first_and_share_no_edge(spark, keep):
    # A bubble 1-(2|3)-4 within 1-..-6: the larger one takes its edges.
    ways = [(1, 2, 9, 1), (1, 3, 9, 1), (2, 4, 9, 1), (3, 4, 9, 1), (4, 5, 9, 1), (4, 6, 9, 1), (5, 7, 9, 1), (6, 7, 9, 1), (1, 7, 9, 1)]
    edges = paths(spark, ways, keep)
    found, _ = pathgraph.bundles(edges, keep)
    assert {(1, 7), (4, 7)} <= {(r["start"], r["end"]) for r in found.collect()}
    folded = pathgraph.compounds(edges, keep)
    assert ids(folded.where("kind = 'compound'"), "src", "dst") == [(-7, -1), (1, 7)] and folded.count() == 2


def test_duplicates_keep_one_edge_and_its_reverse(spark, keep):
    edges = paths(spark, [(1, 2, 5, 1), (2, 4, 5, 1), (1, 3, 6, 1), (3, 4, 6, 1), (0 + 9, 1, 5, 1), (4, 10, 5, 1), (1, 20, 5, 1), (20, 21, 5, 1), (21, 4, 5, 1)], keep)
    left = pathgraph.without(edges, pathgraph.duplicates(edges))
    kept = {tuple(r) for r in left.select("eid", "rid").collect()}
    assert {(b, a) for a, b in kept} == kept and len(kept) == edges.count() - 2
    assert "1~20~21~4" in {a for a, _ in kept}  # three steps: no short one


def test_a_spur_goes_and_its_neighbours_merge_in_the_second_contraction(spark, keep):
    main = line(1, 9, 1000)
    ways = main + [(100, 101, 50, 1), (101, 5, 50, 1)]
    edges = paths(spark, ways, keep)
    gone = {r["eid"] for r in pathgraph.path_spurs(edges, 10, 500, keep).collect()}
    assert gone == {"100~101~101~5", "-5~-101~-101~-100"}
    left = [w for w in ways if w[0] < 100]
    again = paths(spark, left, keep)
    assert ids(again, "src", "dst") == [(-9, -1), (1, 9)]
    assert not pathgraph.path_spurs(again, 10, 500, keep).count()
    # Long enough, the same way is no spur.
    assert pathgraph.path_spurs(edges, 10, 60, keep).count() == 0


def test_chains_of_rings_and_lines(spark, keep):
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(60)]
    rng.shuffle(names)
    rings, lines, at = [names[:1], names[1:8], names[8:24]], [names[24:25], names[25:42], names[42:60]], []
    links = [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))] + [(c[i], c[i + 1]) for c in lines for i in range(len(c) - 1)]
    got = defaultdict(list)
    for r in chains.chains(spark.createDataFrame([(n,) for n in names], "e string"), spark.createDataFrame(links, "e string, next string"), keep).collect():
        got[r["chain"]].append((r["pos"], r["e"]))
    for r in rings:
        k = r.index(min(r))
        at.append(r[k:] + r[:k])
    assert sorted([e for _, e in sorted(v)] for v in got.values()) == sorted(at + lines)


def test_paths_never_cross_their_own_reverse(spark, keep):
    # 1-2-3, then an edge to the reverse of 3 (its own reverse), so the line goes on as -3 .. -1.
    edges = paths(spark, [(1, 2, 9, 1), (2, 3, 9, 1), (7, 3, 9, 1)], keep)
    hairpin = spark.createDataFrame([("3~-3~3~-3", "3~-3~3~-3", 3, -3, 9, 50, 1, "simple")], edges.schema)
    both = keep(edges.unionByName(hairpin), "both")
    got = pathgraph.chosen_paths(both, keep)
    members = defaultdict(set)
    for r in got.collect():
        members[r["path"]].add((r["eid"], r["rid"]))
    assert sum(map(len, members.values())) == both.count()
    for path in members.values():
        assert len(path) == 1 or not {e for e, _ in path} & {r for _, r in path}
    # A line that ends at the reverse of its own start is cut at one end, and so is its reverse.
    loop = spark.createDataFrame([(f"{a}~{b}~{a}~{b}", f"{-b}~{-a}~{-b}~{-a}", a, b, 9, 5, 1, "simple") for a, b in [(1, 2), (2, 3), (3, -1), (-2, -1), (-3, -2), (1, -3)]], edges.schema)
    found = pathgraph.chosen_paths(loop, keep)
    nodes = defaultdict(set)
    for r in found.join(loop.select("eid", "src", "dst"), "eid").collect():
        nodes[r["path"]] |= {r["src"], r["dst"]}
    assert all(-n not in v for k, v in nodes.items() for n in v if len(v) > 2) and found.count() == 6


def test_shortest_ways_with_cycles_and_ties(spark, keep):
    rng = random.Random(8)
    es = [(a, b, rng.choice([0, 1, 2, 7, 30])) for a in range(40) for b in rng.sample(range(40), 2)]
    want = {}
    for start in (0, 5, 17):
        dist, heap = {}, [(0, start)]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in dist:
                dist[v] = d
                for a, b, n in es:
                    if a == v:
                        heapq.heappush(heap, (d + n, b))
        want |= {(start, v): d for v, d in dist.items()}
    edges = spark.createDataFrame(es, "src int, dst int, len int")
    starts = spark.createDataFrame([(0,), (5,), (17,), (5,)], "start int")
    for limit in (None, 12):
        got = {(r["start"], r["node"]): (r["dist"], r["before"]) for r in shortest.shortest(edges, starts, 5, keep, limit).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: d for k, d in want.items() if limit is None or d <= limit}
        for (start, node), (d, before) in got.items():
            ways = [a for a, b, n in es if b == node and (start, a) in got and got[start, a][0] + n == d]
            assert before == (None if node == start else min(ways))
    assert shortest.shortest(edges, starts.limit(0), 5, keep).count() == 0


def test_a_chimera_goes_with_its_reverse_and_a_bridge_stays(spark, keep):
    # Two lines; 50 follows 3 beside 4 and leads to 24, which 23 leads to as well.
    ways = line(1, 10) + line(20, 30) + [(3, 50, 9, 1), (50, 24, 9, 1)]
    es = keep(strand(spark, ways), "es")
    marked = cleaning.chimeras(es, es, 5, keep)
    assert ids(marked, "node") == [(-50,), (50,)]
    assert ids(cleaning.edges_at(es, marked), "src", "dst") == [(-50, -3), (-24, -50), (3, 50), (50, 24)]
    # If both sides meet within five edges, seen from either end, it is a bubble.
    joined = keep(strand(spark, ways + [(6, 26, 9, 1), (2, 22, 9, 1)]), "joined")
    assert ids(cleaning.chimeras(joined, joined, 5, keep), "node") == []


def test_a_resolved_repeat_drops_the_other_edges(spark, keep):
    # 1-2-3 is a way through; 1-9 leads to a node with another origin and another future.
    ways = [(1, 2, 9, 1), (2, 3, 9, 1), (1, 9, 9, 1), (8, 9, 9, 1), (9, 10, 9, 1)]
    es = strand(spark, ways)
    assert ids(cleaning.repeat_edges(es, es), "src", "dst") == [(-9, -1), (1, 9)]
    shared = strand(spark, ways + [(9, 3, 9, 1)])
    assert ids(cleaning.repeat_edges(shared, shared), "src", "dst") == []
    assert graph.with_reverses(spark.createDataFrame([(1, 9)], "src int, dst int")).count() == 2


def test_best_edges_by_score_then_smaller_node_without_sorting(spark):
    rows = [(1, 5, -3), (1, -7, -3), (1, 2, -4), (-2147483646, 2147483646, 7), (-2147483646, -2147483646, 7), (9, 2147483646, 2147483647)]
    es = spark.createDataFrame([(*e, s) for a, b, s in rows for e in ((a, b), (-b, -a))], "src int, dst int, score int").distinct()
    edges = {tuple(r)[:2]: r["score"] for r in es.collect()}
    out = {a: min((b for x, b in edges if x == a), key=lambda b: (-edges[a, b], b)) for a, _ in edges}
    into = {b: min((a for a, y in edges if y == b), key=lambda a: (-edges[a, b], a)) for _, b in edges}
    marks = set(out.items()) | {(a, b) for b, a in into.items()}
    best = graph.best_edges(es)
    assert {tuple(r)[:2] for r in best.select("src", "dst").collect()} == marks | {(-b, -a) for a, b in marks}
    assert "SortAggregate" not in best._jdf.queryExecution().toString()


def test_finished_edges_of_chains_are_written_once(spark):
    from strandlake.operators.chains import chains
    from strandlake.operators.graph import simple_paths

    def kept():
        rows = []

        def keep(df, name):
            out = df.localCheckpoint()
            if name.startswith("chain"):
                rows.append(out.count())
            return out

        return rows, keep

    # One chain of 9 edges, 30 of one edge.
    pairs = [(i, i + 1) for i in range(1, 10)] + [(100 + 2 * i, 101 + 2 * i) for i in range(30)]
    es = spark.createDataFrame([(a, b, 5) for a, b in pairs], "src int, dst int, len int")
    rows, keep = kept()
    found = simple_paths(spark, es, keep).collect()
    assert sorted((r.src, r.dst) for r in found) == sorted(pairs) and max(r.pos for r in found) == 8
    assert rows[0] == 39 and all(n <= 8 for n in rows[1:])
    rows, keep = kept()
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "e int, next int")
    found = chains(spark.createDataFrame([(i,) for i in range(1, 40)], "e int"), links, keep).collect()
    assert {r.e: r.pos for r in found} == {i: i - 1 if i < 10 else 0 for i in range(1, 40)}
    assert rows[0] == 39 and all(n <= 8 for n in rows[1:])
