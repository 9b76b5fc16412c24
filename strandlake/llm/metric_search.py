"""Exact top-k inner products by best-first search in M-trees.

With one more component, sqrt(M - |x|**2) for the largest squared length M, all vectors lie on a sphere, and a larger
inner product is a smaller distance: |q' - x'|**2 = |q|**2 + M - 2 q.x. In that metric the vectors are kept as an
M-tree of three levels: routing vectors from a bounded sample, pages of up to ``PAGE`` vectors under the nearest routing
vector, and the vectors. A page stores its own routing vector, covering radius, distance to its parent, and each
member's distance to the page's routing vector. Stored distances and the triangle inequality rule out pages and members
before any distance to them is computed; scores of the others are exact integers. Where scores may pass 2**52, doubles
no longer hold them: bounds then leave room for rounding, and scores that may count are computed again as Python integers.

Pages are rows of a written table, so a hot cluster is many pages in many tasks. Queries come in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

PAGE = 256
#: Vectors of the sample that routing vectors and first bounds come from; routing vectors at most.
SAMPLE, ROUTERS = 4096, 512
#: Queries searched for in one pass over the pages; no more are on the driver or in a task at once.
BLOCK = 8192


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that puts them on the sphere of squared radius ``top``."""
    return np.concatenate((x, np.sqrt(np.maximum(0.0, top - (x * x).sum(1)))[:, None]), 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def routers_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Routing vectors: each the sample's farthest from those before it."""
    out = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(out) < min(n, len(sample)):
        k = int(np.argmax(near))
        if near[k] <= 0:
            break
        out.append(k)
        near = np.minimum(near, distances(sample, sample[k : k + 1])[:, 0])
    return sample[out]


def make_page(ids: np.ndarray, x: np.ndarray, parent: np.ndarray, top: float) -> dict:
    """A leaf: its routing vector is the member nearest to their mean."""
    y = lift(x.astype(float), top)
    own = int(np.argmin(((y - y.mean(0)) ** 2).sum(1)))
    to_own = distances(y, y[own : own + 1])[:, 0]
    return {"own": x[own].tobytes(), "radius": float(to_own.max()), "to_parent": float(np.sqrt(((y[own] - parent) ** 2).sum())), "ids": ids.tobytes(), "members": x.tobytes(), "to_own": to_own.tobytes()}


PAGE_SCHEMA = "router int, page long, own binary, radius double, to_parent double, ids binary, members binary, to_own binary"


def build(vectors: DataFrame, routers: np.ndarray, top: float, scratch: Scratch, partitions: int) -> DataFrame:
    """The written table of pages over ``vectors`` (vec_id, v array<long>); a router's vectors are dealt out in salted runs."""
    lifted = lift(routers, top)
    dim = routers.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            x = flat.reshape(-1, dim)
            d = distances(lift(x.astype(float), top), lifted)
            router = d.argmin(1)
            yield pa.RecordBatch.from_pydict({"router": pa.array(router, pa.int32()), "d": pa.array(d[np.arange(len(x)), router]), "vec_id": batch.column("vec_id"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple[int, int, bytes]] = []
        made = TaskContext.get().partitionId() << 40

        def out(n: int) -> pa.RecordBatch:
            nonlocal made
            ids = np.array([h[1] for h in held[:n]], np.int64)
            x = np.frombuffer(b"".join(h[2] for h in held[:n]), np.int64).reshape(n, -1)
            page = make_page(ids, x, lifted[held[0][0]], top)
            made += 1
            kinds = {"radius": pa.float64(), "to_parent": pa.float64()}
            row = [pa.array([held[0][0]], pa.int32()), pa.array([made], pa.int64()), *(pa.array([v], kinds.get(k, pa.binary())) for k, v in page.items())]
            del held[:n]
            return pa.RecordBatch.from_arrays(row, ["router", "page", *page])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("router", "vec_id", "x")), strict=True):
                if held and (held[0][0] != row[0] or len(held) == PAGE):
                    yield out(len(held))
                held.append(row)
        if held:
            yield out(len(held))

    spread = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, partitions // 4)))
    rows = vectors.mapInArrow(assign, "router int, d double, vec_id long, x binary")
    dealt = rows.repartition(partitions, "router", spread).sortWithinPartitions("router", "d", "vec_id")
    return scratch.table(dealt.mapInArrow(pages, PAGE_SCHEMA), "pages")


def wide_slack(dim: int) -> float:
    """How far a distance in doubles may be off, against the length of its vectors: differences of squares lose half of
    the digits."""
    return 8 * (dim * 2.0**-52) ** 0.5


def rounding(dim: int, a: float, b: float) -> float:
    """How far an inner product in doubles may be off, for vectors of squared lengths ``a`` and ``b``."""
    return 4 * (dim + 2) * 2.0**-52 * (a * b) ** 0.5


class Tree:
    """The pages of one task under their routing vectors."""

    def __init__(self, pages: list[dict], routers: np.ndarray, top: float, wide: bool = False):
        dim = routers.shape[1]
        self.top, self.wide = top, wide
        self.groups = []
        by_router: dict[int, list[dict]] = {}
        for p in pages:
            by_router.setdefault(p["router"], []).append(p)
        for r, own in sorted(by_router.items()):
            keys = lift(np.stack([np.frombuffer(p["own"], np.int64) for p in own]).astype(float), top)
            radius, to_parent = (np.array([p[k] for p in own]) for k in ("radius", "to_parent"))
            leaves = [(np.frombuffer(p["ids"], np.int64), np.frombuffer(p["members"], np.int64).reshape(-1, dim), np.frombuffer(p["to_own"])) for p in own]
            self.groups.append((r, keys, radius, to_parent, [(i, x if wide else x.astype(float), d) for i, x, d in leaves]))
        self.routers = lift(routers, top)[[g[0] for g in self.groups]]
        self.cover = np.array([(g[2] + g[3]).max() for g in self.groups])

    def search(self, query_id: int, q: np.ndarray, k: int, bound: float, counts: list[int]) -> list[tuple[int, int]]:
        """The task's best (score, vec_id) of one query; ``bound``: a score that k vectors are known to reach.

        ``q`` holds doubles, or 64-bit integers where scores are wide."""
        whole, q = q.tolist(), q.astype(float, copy=False)
        point = np.append(q, 0.0)
        length = q @ q + self.top
        slack = (wide_slack(len(q)) if self.wide else 1e-7) * (1.0 + np.sqrt(length))
        loose = rounding(len(q), q @ q, self.top) if self.wide else 0.0
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id)
        limit = np.sqrt(max(0.0, length - 2 * bound)) + slack if bound > -np.inf else np.inf
        to_router = np.sqrt(((self.routers - point) ** 2).sum(1))
        counts[0] += len(to_router)
        queue = [(float(b), 0, g, 0) for g, b in enumerate(np.maximum(0.0, to_router - self.cover)) if b <= limit]
        heapq.heapify(queue)
        while queue:
            least, kind, g, p = heapq.heappop(queue)
            if least > limit:
                break
            _, keys, radius, to_parent, leaves = self.groups[g]
            if kind == 0:
                # Stored distances to the parent rule pages out before their own distance is computed.
                open_ = np.flatnonzero(np.abs(to_router[g] - to_parent) - radius <= limit)
                d = np.sqrt(((keys[open_] - point) ** 2).sum(1))
                counts[0] += len(open_)
                for i, dist in zip(open_.tolist(), d.tolist(), strict=True):
                    if dist - radius[i] <= limit:
                        heapq.heappush(queue, (max(0.0, dist - float(radius[i])), 1, g, i))
                continue
            ids, x, to_own = leaves[p]
            dist = np.sqrt(((keys[p] - point) ** 2).sum())
            near = np.flatnonzero(np.abs(dist - to_own) <= limit) if limit < np.inf else np.arange(len(ids))
            if not len(near):
                continue
            near = near[ids[near] != query_id]
            counts[0] += len(near)
            scores = x[near].astype(float, copy=False) @ q
            if len(best) == k and limit < np.inf:
                keep = scores >= best[0][0] - loose
                near, scores = near[keep], scores[keep]
            if len(scores) > 4 * k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k] - 2 * loose
                near, scores = near[scores >= cut], scores[scores >= cut]
            exact = [sum(a * b for a, b in zip(m, whole, strict=True)) for m in x[near].tolist()] if self.wide else scores.tolist()
            for s, v in zip(exact, ids[near].tolist(), strict=True):
                item = (int(s), -v)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                limit = min(limit, np.sqrt(max(0.0, length - 2 * best[0][0])) + slack)
        return [(s, -v) for s, v in best]


def ordered(score: int) -> bytes:
    """Bytes of a score of up to 191 bits that compare as the scores do."""
    return (score + (1 << 191)).to_bytes(24, "big")


def top_k(spark: SparkSession, vectors: DataFrame, query: str, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` highest integer inner products of every query row: query_id, rank (from 1), vec_id, score.

    vectors: vec_id long, embedding array of numbers; other columns are ignored. ``query`` is the SQL condition on
    vec_id that makes a row a query. Components become floor(scale * x). Vectors that are null or empty, hold null or
    non-finite components, or have a null vec_id take no part; so do those whose length is not the most common (ties:
    the longest). Candidates are all rows with another vec_id; repeated rows are candidates of their own, a repeated
    query row counts once. Ties go to the smaller vec_id. Fewer candidates give fewer rows; an empty table gives none.
    Huge components are allowed: those beyond 64 bits become the nearest 64-bit integer, scores of any size are ranked
    exactly, and scores beyond 64 bits are returned as the nearest 64-bit integer.
    """
    scratch = Scratch(spark, "metric")
    # As double before the product, so that a 32-bit component is not rounded twice.
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), ints.cast("array<bigint>").alias("v"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if not size:
        return empty
    rows = scratch.table(rows.where(F.size("v") == size["size"]), "vectors")
    square = F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, top = rows.agg(F.count("*"), F.max(square)).first()
    wide = size["size"] * top >= 1 << 52  # scores that doubles do not hold
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # a bounded sample
    sample_ids, sample_x = np.array([r["vec_id"] for r in sample]), np.array([r["v"] for r in sample], float)
    lifted = lift(sample_x, top)
    pages_wanted = -(-total // PAGE)
    routers = routers_of(lifted, min(ROUTERS, max(1, int(pages_wanted**0.5) * 2)))[:, :-1]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages = build(rows, routers, float(top), scratch, partitions)
    queries = scratch.table(rows.where(query).dropDuplicates(), "queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    found = []
    for b in range(blocks):
        # About BLOCK queries at a time.
        own = sorted((r["vec_id"], r["v"]) for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect())
        if not own:
            continue
        ids, q = np.array([r[0] for r in own]), np.array([r[1] for r in own], np.int64 if wide else float)
        # k vectors of the sample already reach this score, so nothing under it needs to be looked at.
        scores = q.astype(float) @ sample_x.T
        scores[ids[:, None] == sample_ids] = -np.inf
        bounds = np.sort(scores, 1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
        if wide:
            bounds = bounds - 2 * rounding(q.shape[1], (q.astype(float) ** 2).sum(1), top)
        sent = spark.sparkContext.broadcast((ids, q, bounds, routers))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q, bounds, routers = sent.value
            bounds = bounds.copy()
            for batch in batches:
                tree, found = Tree(batch.to_pylist(), routers, float(top), wide), []
                for i in range(len(ids)):
                    got = tree.search(int(ids[i]), q[i], k, bounds[i], [0])
                    if len(got) == k:
                        bounds[i] = max(bounds[i], min(got)[0])
                    found += [(int(ids[i]), v, min(max(s, -(1 << 63)), (1 << 63) - 1), ordered(s) if wide else None) for s, v in got]
                columns = zip(*found, strict=True) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["query_id", "vec_id", "score", "exact"])

        part = pages.repartition(partitions, "page").mapInArrow(search, "query_id long, vec_id long, score long, exact binary")
        # Each task sends at most k rows a query and batch, and cuts them to k before the shuffle (window group limit).
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact" if wide else "score"), "vec_id"))
        best = part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        # A block's results are written before the next is collected.
        found.append(scratch.path("found"))
        best.write.parquet(found[-1])
        sent.unpersist()
    scratch.drop(pages, queries)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*found) if found else empty
