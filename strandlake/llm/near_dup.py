"""Near duplicates by circulant MinHash: signatures from two permutations, banding, exact verification, components.

A document's shingles are thrown into a universe of 2**BITS points by a first permutation (a keyed bijection of 64-bit
words, cut to its top bits); the second permutation, a table of the universe, is shifted circularly by one for each
coordinate. A shingle's values for all coordinates are thus one run of the table, and a signature is the minimum over
the document's runs. Bands of ``ROWS`` coordinates make candidates; at Jaccard 0.8 a pair misses all bands with a
probability of 3e-6, and full sets confirm every link.

Equal sets are one class; a bucket links its members to its smallest one; only members that are then still in different
components are compared further, in cells of bounded size: their pairs grow with the square of those still apart in one
bucket, as any two of them may be linked, but most are told apart by size and signature. Joins on keys that few groups
may fill (a set's key, a bucket, a hub) broadcast the few heavy keys (``spread_join``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, ascii_words, kept, mix64, odd_constants, shingle_hashes, spread_join

BITS, ROWS, BANDS = 20, 5, 32
COORDINATES = ROWS * BANDS
#: Members of a bucket compared at once in a task.
BLOCK = 2000
#: Shingles of texts that a task remembers at most (8 bytes each), besides the two it compares.
REMEMBERED = 1 << 22
#: Pairs of a hub that share a copy of its text.
PAIRS = 500
#: Ids up to this many are sent to all executors (8 bytes each); beyond, a shuffled join takes their place.
FEW = 1_000_000


@cache
def _table() -> np.ndarray:
    """Runs of the second permutation: row s holds the values of point s under every shift."""
    turn = np.random.default_rng(20).permutation(1 << BITS).astype(np.uint32)
    return sliding_window_view(np.concatenate((turn, turn[:COORDINATES])), COORDINATES)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, an empty one has none."""
    return np.unique(shingle_hashes(kept("words", WordHashes).of(ascii_words(text)), width))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash values of a non-empty set of shingle hashes."""
    points = np.unique(mix64(shingles) >> np.uint64(64 - BITS)).astype(np.int64)
    table, out = _table(), None
    for at in range(0, len(points), 4096):
        part = table[points[at : at + 4096]].min(0)
        out = part if out is None else np.minimum(out, part)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    mult = odd_constants(ROWS, 7)
    with np.errstate(over="ignore"):
        rows = mix64(sig.reshape(BANDS, ROWS).astype(np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * np.uint64(1 << 32))
        return mix64((rows * mult).sum(1, dtype=np.uint64)).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, key of the set (null if empty), band keys, and a byte of each coordinate."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bands, bytes_, sizes = [], [], [], []
            for text in batch.column("text"):
                shingles = shingle_set(text.as_py(), width)
                sizes.append(len(shingles))
                if len(shingles):
                    sig = signature(shingles)
                    keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    bands.append(band_keys(sig))
                    bytes_.append(sig.astype(np.uint8).tobytes())
                else:
                    keys.append(None), bands.append(None), bytes_.append(None)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64())), "sig": pa.array(bytes_, pa.binary())}
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_shingles long, key binary, bands array<long>, sig binary")


def _texts(scratch: Scratch, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The written texts (doc_id, text) of some documents."""
    ids = scratch.table(ids.distinct(), "ids")
    few = ids.count() <= FEW
    return scratch.table(docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "texts")


def verified(spark: SparkSession, scratch: Scratch, docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union, in a written table."""
    texts = _texts(scratch, docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            a, b, ta, tb = (batch.column(n).to_pylist() for n in ("a", "b", "ta", "tb"))
            keep = []
            for i in range(len(a)):
                if hub != (a[i], ta[i]):
                    hub, own = (a[i], ta[i]), shingle_set(ta[i], width)
                other = shingle_set(tb[i], width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both) > 0:
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())})

    # A hub's text is copied once for every so many pairs, which are dealt to the copies by their other end.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hubs = scratch.table(pairs.groupBy("a").agg(F.count("*").alias("size")).withColumn("copies", F.ceil(F.col("size") / PAIRS).cast("int")), "hubs")
    salted = spread_join(pairs, hubs, ["a"], "size", partitions).select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"))
    with_b = salted.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    hub_texts = hubs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    both = with_b.join(hub_texts, ["a", "salt"]).select("a", "b", "ta", "tb")
    out = scratch.table(both.mapInArrow(check, "a long, b long").distinct(), "links")
    scratch.drop(texts, hubs)
    return out


def components(spark: SparkSession, scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches, by alternating stars."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")), "least")
        # Stars round their smallest nodes: whoever has a smaller neighbour has no other.
        if least.where("m < u and size > 1").isEmpty():
            scratch.drop(least)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        old = edges
        # Large star: a node's larger neighbours go to the smallest of its neighbourhood. Repeated edges wait for the small star.
        large = spread_join(both.where("v > u"), least, ["u"], "size", partitions).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = scratch.table(large.where("u <> v"), "large")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        lower = scratch.table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")), "lower")
        moved = spread_join(large, lower, ["u"], "size", partitions).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = scratch.table(moved.union(lower.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(old, least, large, lower)


def _cells(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of buckets that are still apart, dealt to cells of at most about two blocks.

    members: bucket, c, n, component, main (component of the bucket's hub), sig and more. Pairs inside the main component
    are never met; a bucket's other members meet the main ones (kind 0) and each other (kind 1).
    """
    rows = members.join(sizes, "bucket").withColumn("apart", F.col("component") != F.col("main"))
    others, mains = F.col("b_apart"), F.col("b_main")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("c"), F.when(F.col("apart"), others).otherwise(mains)).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    main = F.transform(all_of(others), lambda j: cell(0, F.col("own"), j))
    cross = F.transform(all_of(mains), lambda i: cell(0, i, F.col("own")))
    among = F.transform(all_of(others), lambda j: cell(1, F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    cells = F.explode(F.when(F.col("apart"), F.concat(cross, among)).otherwise(main))
    return rows.select(*members.columns, "apart", "own", cells.alias("cell")).select(*members.columns, "apart", "own", "cell.*").drop("main")


def _sides(key: tuple, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a cell that are compared with each other."""
    kind, i, j = (x.as_py() for x in key[1:4])
    own, apart = table.column("own").to_numpy(), table.column("apart").to_numpy()
    return (np.flatnonzero(apart), np.flatnonzero(~apart)) if kind == 0 else (np.flatnonzero(own == i), np.flatnonzero(own == j))


def _signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, COORDINATES)


def nearest(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """For each member that is apart, the pair (a, b) with the likeliest member of another component in its cell."""

    def compare(key, table):
        left, right = _sides(key, table)
        c, n, comp = (table.column(x).to_numpy() for x in ("c", "n", "component"))
        sig, out = _signatures(table), set()
        for x in left:
            ok = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            if len(ok):
                y = ok[int((sig[ok] == sig[x]).sum(1).argmax())]
                out.add((min(c[x], c[y]), max(c[x], c[y])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return _cells(members, sizes).groupBy("bucket", "kind", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def joining(members: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join different components inside the cells, verified on full sets there; members also has text.

    Every pair of a cell whose components are still different is decided: by its sizes, by its signature (a pair at the
    threshold falls under the limit with a probability of about 1e-10), or by its sets. Only links are returned, and of
    those only enough to join what they join. A pair is left to the first bucket that it shares.
    """
    share = percent / 100
    least = int(COORDINATES * (share - 6.3 * (share * (1 - share) / COORDINATES) ** 0.5))

    def compare(key, table):
        left, right = _sides(key, table)
        c, n, names = (table.column(x).to_numpy() for x in ("c", "n", "component"))
        sig = _signatures(table)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        texts, bucket = table.column("text"), key[0].as_py()
        _, comp = np.unique(names, return_inverse=True)
        sets: dict[int, np.ndarray] = {}
        held = 0
        a, b = [], []

        def shingles(i: int) -> np.ndarray:
            nonlocal held
            if i not in sets:
                if held > REMEMBERED:
                    sets.clear()
                    held = 0
                sets[i] = shingle_set(texts[i].as_py(), width)
                held += len(sets[i])
            return sets[i]

        for x in left.tolist():
            ok = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            agree = (sig[ok] == sig[x]).sum(1)
            ok, agree = ok[agree >= least], agree[agree >= least]
            shared = bands[ok] == bands[x]
            first = bands[x][shared.argmax(1)] == bucket
            ok = ok[first][np.argsort(-agree[first], kind="stable")]
            own = shingle_set(texts[x].as_py(), width) if len(ok) else None
            for y in ok.tolist():
                if comp[y] == comp[x]:
                    continue
                other = shingles(y)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both) > 0:
                    a.append(c[x]), b.append(c[y])
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _cells(members, sizes).groupBy("bucket", "kind", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents under links with 100 * intersection >= percent * union of word-shingle sets.

    docs: doc_id long, text string; other columns are ignored. Words are lower-cased (A-Z) runs of non-blank bytes. A
    text of fewer than ``width`` words is one shingle; a null, empty or blank text has none and is linked with nothing.
    Rows that share a doc_id are one document for links and each keep their own row; a null doc_id takes no part and
    has a null component_id. Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id
    reachable), kept (doc_id = component_id; true for a null doc_id). An empty table gives no rows.
    """
    scratch = Scratch(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.table(sketches(docs, width), "sketches")
    usable = sketch.where("doc_id is not null and key is not null")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal sets are one class, named by its smallest document; copies are dealt by their own ids, never by the set's key.
    own = F.struct(F.col("n_shingles").alias("n"), "bands", "sig")
    classes = scratch.table(usable.groupBy("key").agg(F.min("doc_id").alias("c"), F.count("*").alias("copies"), F.min_by(own, "doc_id").alias("own")), "classes")
    reps = classes.select("c", "own.n", "own.bands", "own.sig")
    bands = reps.select("c", "n", F.explode("bands").alias("bucket"))
    hubs = bands.groupBy("bucket").agg(F.min(F.struct("c", "n")).alias("h"), F.count("*").alias("size")).where("size > 1")
    hubs = scratch.table(hubs.select("bucket", F.col("h.c").alias("hub"), F.col("h.n").alias("hub_n"), F.col("size").alias("large"), "size"), "hubs")
    members = scratch.table(spread_join(bands, hubs, ["bucket"], "size", partitions).select("bucket", "c", "n", F.col("large").alias("size"), "hub", "hub_n"), "members")
    stars = members.where(F.expr(f"c <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")).select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()
    tried = stars = scratch.table(stars, "stars")
    links = verified(spark, scratch, docs, stars, width, percent)
    found = components(spark, scratch, links)
    for step in range(4):
        # Buckets of three and more whose members are still apart: first likely pairs, as long as they join something.
        label = lambda df, c, out: df.join(found.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(out, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        large = scratch.table(label(label(members.where("size > 2").select("bucket", "c", "n", "hub"), "hub", "main"), "c", "component").drop("hub"), "large")
        # Blocks of at most about BLOCK members and REMEMBERED shingles.
        block = lambda apart: F.ceil(F.greatest(F.count_if(apart) / BLOCK, F.sum(F.when(apart, F.col("n")).otherwise(0)) / REMEMBERED)).cast("int")
        sizes = large.groupBy("bucket").agg(block(F.col("component") != F.col("main")).alias("b_apart"), block(F.col("component") == F.col("main")).alias("b_main")).where("b_apart > 0")
        sizes = scratch.table(sizes, "sizes")
        if not sizes.limit(1).count():
            break
        apart = large.join(sizes.select("bucket"), "bucket", "left_semi")
        if step < 3:
            pairs = scratch.table(nearest(apart.join(reps.select("c", "sig"), "c"), sizes, percent).join(tried, ["a", "b"], "left_anti"), "nearest")
            more = verified(spark, scratch, docs, pairs, width, percent)
            tried = tried.union(pairs)
        if step == 3 or not more.limit(1).count():
            apart = scratch.table(apart, "apart")
            texts = _texts(scratch, docs, apart.select(F.col("c").alias("doc_id")))
            known = reps.join(texts.withColumnRenamed("doc_id", "c"), "c").select("c", "sig", "bands", "text")
            more = scratch.table(joining(apart.join(known, "c"), sizes, width, percent), "joining")
            step = 3
        found = components(spark, scratch, found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        scratch.drop(large, sizes)
        if step == 3:
            break
    final = scratch.table(classes.join(found.withColumnRenamed("node", "c"), "c", "left").select("key", F.coalesce("component", "c").alias("component"), "copies"), "final")
    # Rows without an id or a set are alone; the others find their class, whose large ones are broadcast.
    alone = sketch.where("doc_id is null or key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = spread_join(usable.select("doc_id", "n_shingles", "key"), final, ["key"], "copies", partitions).select("doc_id", "n_shingles", "component").union(alone)
    scratch.drop(members, stars, classes, hubs)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the smallest doc_id.

    Every row is a document of its own, by a number it gets here: rows that share a doc_id go only if their texts are
    near copies, and rows with a null doc_id are compared like any (of equals a row with an id stays, then the first by
    number). Rows with a null, empty or blank text all stay.
    """
    scratch = Scratch(spark, "kept")
    row = next(f"row{'_' * i}" for i in range(len(docs.columns) + 1) if f"row{'_' * i}" not in {c.lower() for c in docs.columns})
    rows = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    decided = near_duplicates(spark, rows.select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text")), width, percent)
    # Rows of components of several: the one that stays is the smallest by doc_id.
    some = scratch.table(decided.select(F.col("doc_id").alias("row"), "component_id"), "decided")
    first = some.where("row <> component_id").select("component_id").distinct()
    members = some.join(F.broadcast(first) if first.count() <= FEW else first, "component_id", "left_semi")
    ids = rows.select(F.col(row).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"))
    named = scratch.table(members.join(ids, "row"), "members")
    stays = named.groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("s")).select("s.row")
    gone = scratch.table(named.select("row").join(stays, "row", "left_anti"), "gone").withColumnRenamed("row", row)
    scratch.drop(some, named)
    return rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
