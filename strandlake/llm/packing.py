"""Best-fit packing by bin completion: token sequences of a fixed length filled as full as they can be.

Pieces of one length are interchangeable, so the search runs on the histogram of lengths (at most ``capacity`` rows,
whatever the corpus holds) and returns patterns with multiplicities. Pieces find their place by their rank among pieces
of the same length: a count per task gives every task its first rank, so no group ever meets in one task.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokenizing import encoder, slices

#: Ranks that are sent to all executors (24 bytes each): up to so many; beyond, pieces are joined with them by a shuffle.
FEW = 1_000_000
#: Limits of the search unless the caller sets others: nodes, nodes without a better packing after a dive, and dominated
#: fillings that a completion looks at in a row.
NODES, PATIENCE, LOOKS = 20_000, 2_000, 500
#: Tables of reachable sums that the search holds at once (2 MB each at most).
TABLES = 32
#: A group of equal bins: the pieces of one bin as {length: how many}, and how many bins.
Group = tuple[dict[int, int], int]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: total length, or for some t the pieces over capacity - t alone plus what must overflow."""
    lengths = sorted(counts)
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    number, mass = np.zeros(capacity + 2, np.int64), np.zeros(capacity + 2, np.int64)
    for x in lengths:
        number[x], mass[x] = counts[x], counts[x] * x
    upto, mass_upto = np.cumsum(number), np.cumsum(mass)
    for t in [0, *[x for x in lengths if 2 * x <= capacity]]:
        big = upto[capacity] - upto[capacity - t]  # over capacity - t: nothing of t or more fits beside them
        mid = upto[capacity - t] - upto[capacity // 2]  # over half: one a bin
        mid_mass = mass_upto[capacity - t] - mass_upto[capacity // 2]
        low_mass = mass_upto[capacity // 2] - mass_upto[t - 1 if t else 0]
        best = max(best, int(big + mid + max(0, -(-(low_mass - (mid * capacity - mid_mass)) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing over whole groups of equal bins: each length goes to the tightest bins that take it."""
    open_bins: dict[int, list[Group]] = {}
    spaces: list[int] = []
    done: list[Group] = []

    def put(space: int, group: Group) -> None:
        if not space:
            done.append(group)
            return
        if space not in open_bins:
            open_bins[space] = []
            spaces.insert(bisect_left(spaces, space), space)
        open_bins[space].append(group)

    for x in sorted(counts, reverse=True):
        left, at = counts[x], bisect_left(spaces, x)
        taken: list[tuple[int, Group]] = []
        while left and at < len(spaces):
            space = spaces[at]
            groups = open_bins.pop(space)
            spaces.pop(at)
            most = space // x
            while groups:
                pattern, n = groups.pop()
                full = min(n, left // most)
                if full:
                    taken.append((space - most * x, (pattern | {x: pattern.get(x, 0) + most}, full)))
                    left -= full * most
                if full < n and left:
                    taken.append((space - left * x, (pattern | {x: pattern.get(x, 0) + left}, 1)))
                    left, full = 0, full + 1
                if full < n:
                    taken.append((space, (pattern, n - full)))
        for space, group in taken:
            put(space, group)
        if left:
            most = capacity // x
            if left // most:
                put(capacity - most * x, ({x: most}, left // most))
            if left % most:
                put(capacity - left % most * x, ({x: left % most}, 1))
    return done + [g for groups in open_bins.values() for g in groups]


class Stock:
    """Pieces left by length, with the lengths present as bits of a number, and the same bits mirrored."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = [0] * (capacity + 1)
        self.present = self.mirrored = 0
        for x, n in counts.items():
            self.add(x, n)

    def add(self, x: int, n: int) -> None:
        """``n`` more pieces of a length, or fewer where it is negative."""
        before = self.counts[x]
        self.counts[x] = before + n
        if bool(before) != bool(before + n):
            self.present ^= 1 << x
            self.mirrored ^= 1 << (self.capacity - x)

    def longest(self) -> int:
        return self.present.bit_length() - 1

    def left(self) -> dict[int, int]:
        return {x: n for x, n in enumerate(self.counts) if n}


def _smeared(bits: int, by: int) -> int:
    """Bits moved up by 0 to ``by`` places, all of them."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


def dominated(filling: tuple[int, ...], slack: int, stock: Stock) -> bool:
    """Whether some of a filling's pieces (or none, or all) can give way to one longer piece that is left: a single
    piece to a longer one, several to one of at least their sum, within the slack. All subsets are looked at, as sums."""
    one = several = free = 0
    for x in filling:
        several |= (several | one) << x
        one |= 1 << x
    free = stock.present
    for x in set(filling):
        if stock.counts[x] <= filling.count(x):
            free &= ~(1 << x)
    if free & ((2 << slack) - 1):
        return True
    return bool(slack and free & _smeared(one << 1, slack - 1)) or bool(free & _smeared(several, slack))


def undominated(stock: Stock, room: int, tables: deque[list] | None = None, looks: float = LOOKS) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room``, the fullest first, made as they are asked for.

    A piece as long as the room dominates every other filling. Pairs that fill the room come from the bits of the
    lengths and their mirror, those of the most equal pieces first, so that short pieces last. Then come all others,
    by the sums that can be reached with the lengths up to each: no step of theirs leads nowhere. ``tables`` holds the
    sums of the latest searches; those of earlier ones are dropped, and made again when more fillings are asked for.
    Where ``looks`` fillings in a row are dominated, the rest are not looked at; without such a limit (``math.inf``) all
    undominated fillings come.
    """
    if stock.present >> room & 1 and room:
        yield (room,)
        return
    pairs = stock.present & (stock.mirrored >> (stock.capacity - room)) & ~((1 << ((room + 1) // 2)) - 1)
    while pairs:
        low = pairs & -pairs
        pairs ^= low
        x = low.bit_length() - 1
        if (2 * x != room or stock.counts[x] > 1) and not dominated((x, room - x), 0, stock):
            yield (x, room - x)
    own: list = []
    looked = 0

    def table() -> tuple[list[int], list[int]]:
        """Lengths of up to ``room``, and for each number of them the sums they reach, as bits."""
        if not own:
            lengths = [x for x in range(1, room + 1) if stock.counts[x]]
            reach = [1]
            for x in lengths:
                sums, n, part = reach[-1], min(stock.counts[x], room // x), 1
                while n > 0:
                    sums |= sums << (x * min(part, n))
                    n, part = n - part, 2 * part
                reach.append(sums & ((2 << room) - 1))
            own.extend((lengths, reach))
            if tables is not None:
                tables.append(own)
                if len(tables) > TABLES:
                    tables.popleft().clear()
        return own[0], own[1]

    def fill(total: int, i: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        while i and table()[1][i] >> total & 1:
            x = table()[0][i - 1]
            for n in range(min(stock.counts[x], total // x), 0, -1):
                for rest in fill(total - n * x, i - 1):
                    yield (x,) * n + rest
            i -= 1

    for slack in range(room + 1):
        if table()[1][-1] >> (room - slack) & 1:
            for filling in fill(room - slack, len(table()[0])):
                looked += 1
                if looked > looks:
                    return
                if not (slack == 0 and len(filling) == 2) and not dominated(filling, slack, stock):
                    yield filling
                    looked = 0


def bin_completion(counts: dict[int, int], capacity: int, nodes: float = NODES, patience: float = PATIENCE, looks: float = LOOKS) -> list[Group]:
    """Fewest bins found by completing the bin of the longest piece, again and again.

    Best fit gives the first incumbent, and the search ends at once where that meets the lower bound. Otherwise each node
    completes the bin around the longest piece left by an undominated filling, for as many bins as there are pieces for,
    or for one. A branch ends when its waste is more than any packing with a bin less than the incumbent can have; where
    the pieces left have halved since, best fit of the rest is tried as a new incumbent. A dive uses up a length with
    almost every node, so it takes a few nodes a length, whatever the number of pieces. The search is exhaustive unless
    ``nodes`` run out, or ``patience`` nodes after a whole dive or a better packing bring no other; then the incumbent
    stands, and ``lower_bound`` tells how near it is. ``looks`` limits each completion (see ``undominated``). With
    ``math.inf`` for all three nothing is left out, and the packing is the best there is.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    size, least = sum(n for _, n in best), lower_bound(counts, capacity)
    if not counts or size == least:
        return best
    total, stock = sum(x * n for x, n in counts.items()), Stock(counts, capacity)
    left, path, waste, tried, wait = sum(counts.values()), [], 0, sum(counts.values()), nodes
    tables: deque[list] = deque()
    levels = [_completions(stock, tables, looks)]
    while levels and nodes > 0 and wait > 0 and size > least:
        allowed = (size - 1) * capacity - total - waste
        step = next(levels[-1], None)
        if step is not None:
            pattern, times, slack = step
            times = min(times, allowed // slack) if slack else times
        if step is None or times < 1:
            # No filling left, or all that follow waste too much.
            levels.pop()
            wait = min(wait, patience)
            if path:
                pattern, times, slack = path.pop()
                for x, n in pattern.items():
                    stock.add(x, n * times)
                left, waste = left + times * sum(pattern.values()), waste - slack * times
            continue
        nodes, wait = nodes - 1, wait - 1
        for x, n in pattern.items():
            stock.add(x, -n * times)
        path.append((pattern, times, slack))
        left, waste = left - times * sum(pattern.values()), waste + slack * times
        if not left or 2 * left <= tried or left <= 12:
            tried = left
            tail, used = best_fit(stock.left(), capacity), sum(t for _, t, _ in path)
            if used + (n := sum(k for _, k in tail)) < size:
                best, size, wait = [(p, t) for p, t, _ in path] + tail, used + n, max(wait, patience)
        levels.append(_completions(stock, tables, looks) if left else iter(()))
    return best


def _completions(stock: Stock, tables: deque[list], looks: float) -> Iterator[tuple[dict[int, int], int, int]]:
    """Bins around the longest piece left, the fullest first: {length: pieces}, for how many bins, and the waste of one."""
    top = stock.longest()
    stock.add(top, -1)
    fillings = undominated(stock, stock.capacity - top, tables, looks)
    while True:
        filling = next(fillings, None)
        if filling is None:
            stock.add(top, 1)
            return
        pattern = {top: 1}
        for x in filling:
            pattern[x] = pattern.get(x, 0) + 1
        slack = stock.capacity - top - sum(filling)
        stock.add(top, 1)
        times = min(stock.counts[x] // n for x, n in pattern.items())
        yield pattern, times, slack
        if times > 1:
            yield pattern, 1, slack
        stock.add(top, -1)


def places(groups: list[Group], longest_first: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces a sequence, offset) of runs of pieces; by length, then rank."""
    out, ranks, sequence = [], {}, 0
    for pattern, times in groups:
        offset = 0
        for x in sorted(pattern, reverse=longest_first):
            out.append((x, ranks.get(x, 0), sequence, pattern[x], offset))
            ranks[x] = ranks.get(x, 0) + times * pattern[x]
            offset += x * pattern[x]
        sequence += times
    return sorted(out)


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of tokenized documents; ``task`` and ``nth`` rank a piece among those of its length from the same task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at, part in slices(batch.column("text")):
                rows: dict[str, list] = {k: [] for k in ("task", "nth", "doc_id", "piece", "start", "length", "ids")}
                for k, raw in enumerate(encoder(tokenizer_path).encode(part)):
                    raw = bytes(raw) + end_id.to_bytes(4, "little")
                    for i in range(0, len(raw), 4 * capacity):
                        own = raw[i : i + 4 * capacity]
                        n = len(own) // 4
                        for name, value in zip(rows, (task, seen.get(n, 0), ids[at + k], i // (4 * capacity), i // 4, n, own), strict=True):
                            rows[name].append(value)
                        seen[n] = seen.get(n, 0) + 1
                types = [pa.binary() if name == "ids" else pa.int64() for name in rows]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], list(rows))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pieces, "task long, nth long, doc_id long, piece long, start long, length long, ids binary")


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, nodes: float = NODES, patience: float = PATIENCE, looks: float = LOOKS) -> DataFrame:
    """Packs all documents into as few sequences of at most ``capacity`` tokens as the search finds.

    docs: doc_id long, text string; other columns are ignored. A null or empty text is its end id alone. Documents
    over ``capacity`` ids are cut into pieces of ``capacity``, the last shorter. Null and repeated doc_ids are packed
    like any; equal pieces stand for one another. An empty table gives no rows. ``nodes``, ``patience`` and ``looks``
    limit the search on the driver (see ``bin_completion``), never what is packed. Returns doc_id, piece, start, length,
    ids (little-endian unsigned 32-bit words), sequence_id, offset.
    """
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(cut(docs, tokenizer_path, end_id, capacity), "pieces")
    by_task = scratch.table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    # At most ``capacity`` rows, one for each length.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = places(bin_completion(counts, capacity, nodes, patience, looks))
    first = np.zeros(capacity + 2, np.int64)
    for x, *_ in found:
        first[x + 1] += 1
    first = np.cumsum(first)
    length, rank, sequence, per, offset = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5
    span = int(rank.max(initial=0)) + 1 if len(rank) else 1
    wide = span + max(counts.values(), default=0) + 1
    if wide * (capacity + 1) > 1 << 62:
        raise ValueError("too many pieces of one length")
    keys = length * wide + rank

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("length").to_numpy()
            r = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, x * wide + r, "right") - 1
            within = r - rank[at]
            bins, slot = within // per[at], within % per[at]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(sequence[at] + bins), pa.array(offset[at] + slot * x)], [*kept, "sequence_id", "offset"])

    # A task's pieces of one length are as many as its texts hold, so (task, length) is no hot key.
    base = scratch.table(by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("base")), "base")
    kept = ["doc_id", "piece", "start", "length", "ids"]
    ranked = pieces.join(F.broadcast(base) if base.count() <= FEW else base.hint("merge"), ["task", "length"]).select(*kept, (F.col("base") + F.col("nth")).alias("rank"))
    kinds = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in kept)
    scratch.drop(by_task)
    return ranked.mapInArrow(placed, f"{kinds}, sequence_id long, offset long")


def fullness(sequences: int, tokens: int, capacity: int) -> float:
    """Share of the sequences' room that tokens fill."""
    return tokens / (sequences * capacity) if sequences else math.nan
