"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

Every window of a document that is as long as an item has a 256-bit SimHash of its five-word shingles. A shingle that
occurs n times counts as n elements, (shingle, 1) to (shingle, n), so that the angle between two sketches follows the
weighted Jaccard similarity also where words repeat; the elements' random components are near-normal, so that small sets
have no ties. Fingerprints are cut into 16 blocks of 16 bits; two within distance 63 agree in at least one block up to
3 bits. The index holds each item under every block value up to 2 bits away, a query asks for every value up to 1 bit
away: together they meet all items within the radius. Candidates are then compared exactly, by the weighted Jaccard
similarity of their shingles (a shingle weighs as often as it occurs).

A pair at similarity 0.8 has an expected distance of 38 bits (standard deviation 5.7), so the radius misses it with a
probability of about 1e-5; nearer pairs less often. Windows with fewer benchmark shingles than any pair at the threshold
shares cannot be similar, so they get no fingerprint; a running count of those shingles tells.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, kept, mix64, odd_constants, rows_where, shingle_hashes

WIDTH, BITS, BLOCKS = 5, 256, 16
#: Bits of a block that may differ on the item's side and on the query's.
ITEM_NEAR, QUERY_NEAR = 2, 1
#: Two fingerprints this near agree in one of the blocks up to ITEM_NEAR + QUERY_NEAR bits.
RADIUS = BLOCKS * (ITEM_NEAR + QUERY_NEAR + 1) - 1
#: Items whose index a worker holds at once: 13 kB of block keys and about 4 kB of shingles each.
LOT = 4000
#: Bits of the table that tells which documents any lot can concern.
SIEVE = 1 << 23
_DROPPED = b".,;:!?\"'()[]{}*_`"


def item_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased, without punctuation."""
    return text.encode("utf-8", "replace").lower().translate(None, _DROPPED).split() if text else []


@cache
def _near_masks(bits: int) -> np.ndarray:
    """All 16-bit masks of at most so many bits."""
    return np.array([sum(1 << b for b in some) for n in range(bits + 1) for some in combinations(range(16), n)], np.uint16)


@cache
def _components() -> np.ndarray:
    """The value of each half byte: the middles of 16 equal shares of a normal distribution."""
    return np.array([round(1000 * NormalDist().inv_cdf((i + 0.5) / 16)) for i in range(16)], np.int32)


def elements(shingles: np.ndarray, nth: np.ndarray | int) -> np.ndarray:
    """Hashes of the ``nth`` occurrences (from 1) of shingles."""
    with np.errstate(over="ignore"):
        return mix64(shingles + np.asarray(nth, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    """The BITS components of each element."""
    with np.errstate(over="ignore"):
        words = mix64(hashes[:, None] * odd_constants(BITS // 16, 4) + np.arange(1, BITS // 16 + 1, dtype=np.uint64))
    bytes_ = np.ascontiguousarray(words).view(np.uint8)
    table = _components()
    return np.concatenate((table[bytes_ & 15], table[bytes_ >> 4]), 1)


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from sums of components, as 16 blocks of 16 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def occurrences(shingles: np.ndarray) -> np.ndarray:
    """Which occurrence of its shingle (from 1) each position holds."""
    seen: Counter[int] = Counter()
    out = np.empty(len(shingles), np.uint64)
    for i, x in enumerate(shingles.tolist()):
        seen[x] += 1
        out[i] = seen[x]
    return out


def window_sums(shingles: np.ndarray, span: int) -> np.ndarray:
    """Sums of the components of all windows of ``span`` shingles, as sets of (shingle, occurrence) elements."""
    if len(np.unique(shingles)) == len(shingles):
        sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(bit_rows(elements(shingles, 1)), 0, dtype=np.int32)))
        return sums[span:] - sums[:-span]
    # A window that moves on gains one more occurrence of the shingle it takes in and loses the last of the one it leaves.
    own, first = shingles.tolist(), shingles[:span]
    seen = Counter(own[:span])
    gained, lost = [], []
    for out, into in zip(own, own[span:], strict=False):
        lost.append(seen[out])
        seen[out] -= 1
        seen[into] += 1
        gained.append(seen[into])
    start = bit_rows(elements(first, occurrences(first))).sum(0, dtype=np.int32)
    if not gained:
        return start[None]
    steps = bit_rows(elements(shingles[span:], gained)) - bit_rows(elements(shingles[: len(lost)], lost))
    return np.concatenate((start[None], start + np.cumsum(steps, 0, dtype=np.int32)))


class HammingIndex:
    """Fingerprints by block; ``near`` gives every one within RADIUS of each query, with nothing left out."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        masks = _near_masks(ITEM_NEAR)
        self.tables = []
        for b in range(BLOCKS):
            keys = (prints[:, b][:, None] ^ masks).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], (order // len(masks)).astype(np.int32)))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) places of all pairs within RADIUS; call it on bounded numbers of queries."""
        masks, found = _near_masks(QUERY_NEAR), []
        for b, (keys, items) in enumerate(self.tables):
            asked = (queries[:, b][:, None] ^ masks).ravel()
            low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
            n = high - low
            if n.any():
                at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                found.append(np.repeat(np.arange(len(asked)) // len(masks), n) * len(self.prints) + items[at])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        query, item = np.divmod(np.unique(np.concatenate(found)), len(self.prints))
        near = np.bitwise_count(self.prints[item] ^ queries[query]).sum(1) <= RADIUS
        return query[near], item[near]


def _sieved(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SIEVE - 1)).astype(np.int64)


class Items:
    """Benchmark items by length, ready to be searched for in documents."""

    def __init__(self, rows: list[tuple[int | None, str]], percent: int):
        self.percent = percent
        self.words = WordHashes()
        self.ids: list[int | None] = []
        self.shingles: list[tuple[np.ndarray, np.ndarray]] = []
        by_size, prints = defaultdict(list), []
        for item_id, text in rows:
            words = self.words.of(item_words(text))
            if not len(words):
                continue
            own = shingle_hashes(words, WIDTH)
            by_size[len(words)].append(len(self.ids))
            self.ids.append(item_id)
            self.shingles.append(np.unique(own, return_counts=True))
            prints.append(packed(window_sums(own, len(own)))[0])
        self.sizes = {n: np.array(i) for n, i in sorted(by_size.items())}
        self.index = {n: HammingIndex(np.stack([prints[k] for k in i])) for n, i in self.sizes.items()}
        #: Shingles of items by the width they were cut at (short items are one shingle of all their words): the sorted
        #: hashes, a filter on their low bits, and the lengths of the items that have each.
        self.known = {}
        for width in sorted({min(n, WIDTH) for n in self.sizes}):
            pairs = [(x, np.full(len(x), n, np.int32)) for n, i in self.sizes.items() if min(n, WIDTH) == width for x in [np.unique(np.concatenate([self.shingles[k][0] for k in i]))]]
            hashes, lengths = (np.concatenate(c) for c in zip(*pairs, strict=True))
            order = np.argsort(hashes, kind="stable")
            known, first = np.unique(hashes[order], return_index=True)
            sieve = np.zeros(1 << 18, bool)
            sieve[(known & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
            self.known[width] = (known, np.append(first, len(hashes)), lengths[order], sieve)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        other, weights = self.shingles[item]
        values, counts = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(other, values), len(other) - 1)
        both = int(np.minimum(counts, weights[at])[other[at] == values].sum())
        return both / (len(window) + int(weights.sum()) - both)

    def search(self, text: str | None) -> dict[int, tuple[float, int, int]]:
        """Item to its best window in a text: similarity, first word, words."""
        words = self.words.of(item_words(text))
        best: dict[int, tuple[float, int, int]] = {}
        for width, (known, first, lengths, sieve) in self.known.items():
            if not len(words):
                continue
            cut = min(width, len(words))
            own = shingle_hashes(words, cut)
            hits = np.flatnonzero(sieve[(own & np.uint64((1 << 18) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, own[hits]), len(known) - 1)
            found = known[at] == own[hits]
            hits, at = hits[found], at[found]
            if not len(hits):
                continue
            # (length of an item, place in the text) of every known shingle, by length.
            n = first[at + 1] - first[at]
            size = lengths[np.repeat(first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            order = np.argsort(size, kind="stable")
            sizes, starts_of = np.unique(size[order], return_index=True)
            places = np.split(np.repeat(hits, n)[order], starts_of[1:])
            for n, mine in zip(sizes.tolist(), places, strict=True):
                span = min(n, len(words)) - cut + 1
                # Weighted Jaccard of p percent needs p percent of the item's shingles in the window.
                least = -(-self.percent * (n - width + 1) // 100)
                if len(mine) < least:
                    continue
                upto = np.zeros(len(own) + 1, np.int64)
                upto[mine + 1] = 1
                upto = np.cumsum(upto)
                starts = np.flatnonzero(upto[span:] - upto[:-span] >= least)
                if len(starts):
                    self._windows(own, starts, span, n, best, cut)
        return best

    def _windows(self, own, starts, span, n, best, width) -> None:
        members = self.sizes[n]
        for lot in np.split(starts, np.flatnonzero(np.diff(starts) > 4 * span) + 1):
            for k in range(0, len(lot), 512):
                part = lot[k : k + 512]
                region = own[part[0] : part[-1] + span]
                prints = packed(window_sums(region, span)[part - part[0]])
                for q, i in zip(*(x.tolist() for x in self.index[n].near(prints)), strict=True):
                    start, item = int(part[q]), int(members[i])
                    s = self.similarity(own[start : start + span], item)
                    if 100 * s >= self.percent - 1e-9 and s > best.get(item, (0.0,))[0]:
                        best[item] = (s, start, span + width - 1)


class Lots:
    """The benchmark in lots of about LOT items; each reaches the workers with the job that searches for it."""

    def __init__(self, spark: SparkSession, benchmark: DataFrame, percent: int):
        self.spark, self.percent = spark, percent
        self.scratch = Scratch(spark, "decontaminate")
        rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
        self.items = self.scratch.table(rows, "items")
        self.number = max(1, -(-self.items.count() // LOT))

    def search(self, lot: int) -> Callable[[str | None], dict[int | None, tuple[float, int, int]]]:
        """A function for tasks: item_id to its best window in a text."""
        own = self.items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.number)) == lot).collect()
        rows = sorted(((r["item_id"], r["text"]) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        sent, run, percent = self.spark.sparkContext.broadcast(rows), self.scratch.root, self.percent

        def search(text: str | None) -> dict[int | None, tuple[float, int, int]]:
            held = kept(f"items {run} {lot}", lambda: Items(sent.value, percent))
            out: dict[int | None, tuple[float, int, int]] = {}
            for item, hit in held.search(text).items():
                if held.ids[item] not in out or (-out[held.ids[item]][0], out[held.ids[item]][1]) > (-hit[0], hit[1]):
                    out[held.ids[item]] = hit
            return out

        return search

    def concerned(self) -> Callable[[str | None], bool]:
        """A function for tasks: whether a text has any shingle of any item, up to chance hits in a table of SIEVE bits."""

        def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, words, short = np.zeros(SIEVE, bool), WordHashes(), set()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    own = item_words(text)
                    short.add(min(len(own), WIDTH))
                    table[_sieved(shingle_hashes(words.of(own), WIDTH))] = True
            yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(table).tobytes()], pa.binary()), "widths": pa.array([sorted(short - {0})], pa.list_(pa.int64()))})

        # At most 16 tables of SIEVE / 8 bytes.
        found = self.items.coalesce(16).mapInArrow(tables, "bits binary, widths array<long>").collect()
        table = np.bitwise_or.reduce([np.frombuffer(r["bits"], np.uint8) for r in found])
        sent, run = self.spark.sparkContext.broadcast((table, sorted({w for r in found for w in r["widths"]}))), self.scratch.root

        def concerned(text: str | None) -> bool:
            bits, words = kept(f"sieve {run}", lambda: (np.unpackbits(sent.value[0]).astype(bool), WordHashes()))
            own = words.of(item_words(text))
            return any(bits[_sieved(shingle_hashes(own, w))].any() for w in sent.value[1])

        return concerned


def _where(docs: DataFrame, keep: Callable[[str | None], bool]) -> DataFrame:
    """Rows of ``docs`` whose text passes a test of the workers."""
    return rows_where(docs, lambda texts: [keep(x.as_py()) for x in texts])


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """Documents with a window like a benchmark item: doc_id, item_id, similarity, first_word, n_words (of the best).

    docs: doc_id long, text string; benchmark: item_id long, text string; other columns are ignored. An item shorter
    than five words is one shingle of all its words; a document shorter than an item is one window. Null, empty and
    blank texts on either side match nothing; ties go to the earliest window. Null doc_ids and item_ids come out as
    null, each as one id; repeated rows count once, and of rows that share an id the best window is told. An empty table
    on either side gives no rows. All documents are read once; a benchmark of more than LOT items takes a further pass a
    lot, over those documents alone that have a shingle of any item.
    """
    lots = Lots(spark, benchmark, percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if lots.number > 1:
        rows = lots.scratch.table(_where(rows, lots.concerned()), "concerned")
    out = None
    for lot in range(lots.number):
        search = lots.search(lot)

        def hits(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(doc, item, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for item, hit in search(text.as_py()).items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, kinds, strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = rows.mapInArrow(hits, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        if lots.number > 1:
            part = lots.scratch.table(part, "hits")
        out = part if out is None else out.union(part)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("f"), "n_words")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.similarity", (-F.col("b.f")).alias("first_word"), "b.n_words")


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; each row is decided by its own text.

    Null and repeated doc_ids are rows like any other; null and empty texts stay; an empty benchmark takes nothing.
    """
    lots = Lots(spark, benchmark, percent)
    if lots.number == 1:
        search = lots.search(0)
        return _where(docs, lambda text: not search(text))
    concerned = lots.concerned()
    left = lots.scratch.table(_where(docs, concerned), "concerned")
    for lot in range(lots.number):
        search, before = lots.search(lot), left
        left = lots.scratch.table(_where(before, lambda text, search=search: not search(text)), "left")
        lots.scratch.drop(before)
    return _where(docs, lambda text: not concerned(text)).union(left)
