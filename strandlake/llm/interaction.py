"""Filter interaction audit: what every order of a few filters removes, from one pass over the texts.

Which filters a document fails is a number of as many bits; for every order of the filters a table made once tells at
which step a document with these bits goes. A task counts bits and labels of its documents, looks the counts' steps up
for all orders and adds them up in arrays of fixed length, one for each value of the part column; those are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, place, spread_join, texts_of

LETTERS = "ABCDE"
N, ORDERS = len(LETTERS), factorial(len(LETTERS))
#: Parts whose arrays a task holds before it hands them on.
PARTS = 256
_UPPER = bytes(range(0x41, 0x5B))
_MARKS = b"#$%&*|"
#: Where each sum starts in a part's array: documents; failing each filter, failing it alone; removals by order and step.
_FAILS, _ALONE, _REMOVED = 1, 1 + N, 1 + 2 * N
_SIZE = _REMOVED + 3 * ORDERS * N
_ROW = pa.schema([("part", pa.string()), ("doc_id", pa.int64()), ("fails", pa.int32()), ("sum", pa.binary())])


def orders() -> list[str]:
    """All orders of the filters."""
    return ["".join(p) for p in permutations(LETTERS)]


@cache
def first_failures() -> np.ndarray:
    """For each set of failed filters (bit i: filter i) and order: the step of its first failed filter, N if none is."""
    table = np.full((1 << N, ORDERS), N, np.int64)
    for o, order in enumerate(orders()):
        for step in reversed(range(N)):
            failing = np.flatnonzero(np.arange(1 << N) >> LETTERS.index(order[step]) & 1)
            table[failing, o] = step
    return table


def failed_alone(text: bytes, chars: int) -> int:
    """Bits 0 to 3: few words, few distinct words, many capitals, a mark."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _UPPER))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 3 * chars) << 2 | (len(text.translate(None, _MARKS)) < len(text)) << 3


def _rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(texts_of(batch), "")
        chars = pc.utf8_length(texts).to_pylist()
        raw = texts.cast(pa.binary())
        fails, sums = [], []
        for i, n in enumerate(chars):
            text = raw[i].as_py()
            fails.append(failed_alone(text, n))
            sums.append(hashlib.blake2b(text, digest_size=16).digest())
        column = lambda c, t: pc.cast(batch.column(place(batch.schema, c)), t)  # noqa: E731,B023
        yield pa.RecordBatch.from_arrays([pc.fill_null(column("lang", pa.string()), ""), column("doc_id", pa.int64()), pa.array(fails, pa.int32()), pa.array(sums, pa.binary())], schema=_ROW)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, fails, good, toxic) to one array of sums a part."""
    table, held = first_failures(), {}
    place_of = np.arange(ORDERS)[None, :] * (N + 1) + table  # of a set's removal, in rows of N + 1 steps an order

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))], ["part", "sums"])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        fails, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
        at = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) << N
        names = parts.dictionary.to_pylist()
        sets = [np.bincount(at + fails, weights, minlength=len(names) << N).astype(np.int64).reshape(-1, 1 << N) for weights in (None, good, toxic)]
        for p, name in enumerate(names):
            sums = held.setdefault(name, np.zeros(_SIZE, np.int64))
            counts = sets[0][p]
            sums[0] += counts.sum()
            for i in range(N):
                sums[_FAILS + i] += counts[np.arange(1 << N) >> i & 1 == 1].sum()
                sums[_ALONE + i] += counts[1 << i]
            for k, by_set in enumerate(sets):
                removed = np.bincount(place_of.ravel(), np.repeat(by_set[p], ORDERS), minlength=ORDERS * (N + 1)).astype(np.int64)
                sums[_REMOVED + k * ORDERS * N :][: ORDERS * N] += removed.reshape(ORDERS, N + 1)[:, :N].ravel()
        if len(held) > PARTS:
            yield out()
            held.clear()
    if held:
        yield out()


def failures(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """part, doc_id and the failed filters (bit 4: a smaller doc_id has the same text) of every document, written.

    A text is known by 128 bits of BLAKE2. Copies are few or many: only texts that occur more than once are looked up,
    and those of very many rows are spread.
    """
    scratch, partitions = Scratch(spark, "interaction"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rated = scratch.table(docs.select("text", "lang", "doc_id").mapInArrow(_rate, "part string, doc_id long, fails int, sum binary"), "rated")
    copied = scratch.table(rated.groupBy("sum").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")).where("rows > 1"), "copied")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.col("least").isNotNull())
    return spread_join(rated, copied, ["sum"], "rows", partitions, "left").select("part", "doc_id", F.when(later, F.col("fails").bitwiseOR(1 << 4)).otherwise(F.col("fails")).alias("fails"))


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the five filters and step: what the step's filter removes, and what it costs.

    docs: doc_id, text, lang; null texts are empty, a null lang is the part ''. Filters fail documents A of under 200
    words; B with fewer than half of the words distinct; C with more than 3 capitals A-Z a hundred characters; D with any
    of #$%&*|; E with the text of a smaller doc_id, removed or not (null stands behind all numbers; nulls, and rows of
    one doc_id, do not fail each other). labels: doc_id, quality, toxic; a document is good or toxic if a label of its
    doc_id says so. Columns: part, filter_order, step (from 1), kept after the step, removed by it, redundant (failing
    its filter, removed earlier), unique_fails (failing its filter alone), good_lost, toxic_lost, shapley (what its
    filter removes at any step, over all orders). Each part has a row for every order and step, zeros included;
    repeated rows count as often as they occur; an empty table gives no rows; other columns are left out.
    """
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(mark("quality"), mark("toxic"))
    rows = failures(spark, docs).join(marked, "doc_id", "left").select("part", "fails", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")])
    partial = rows.mapInArrow(_tally, "part string, sums array<long>").select("part", F.posexplode("sums").alias("at", "n"))
    sums = partial.groupBy("part", "at").agg(F.sum("n").alias("n"))
    # One row of _SIZE numbers a part, then a row an order and step.
    whole = sums.groupBy("part").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("s"))
    names = F.array(*[F.lit(o) for o in orders()])
    each = whole.select("part", "s", F.posexplode(names).alias("o", "filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(N))).alias("step"))
    letter = F.instr(F.lit(LETTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1
    get = lambda at: F.get("s", at.cast("int"))
    at = F.col("o") * N + F.col("step") - 1
    removed = get(at + _REMOVED)
    upto = F.aggregate(F.slice("s", (F.lit(_REMOVED + 1) + F.col("o") * N).cast("int"), F.col("step")), F.lit(0).cast("long"), lambda x, y: x + y)
    rows = each.select("part", "filter_order", "step", letter.alias("f"), (get(F.lit(0)) - upto).alias("kept"), removed.alias("removed"), (get(letter + _FAILS) - removed).alias("redundant"), get(letter + _ALONE).alias("unique_fails"), get(at + _REMOVED + ORDERS * N).alias("good_lost"), get(at + _REMOVED + 2 * ORDERS * N).alias("toxic_lost"))
    shapley = rows.groupBy("part", "f").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "f"]).drop("f")
