"""Shared scratch tables, stable hashing and text helpers of the training-data operators.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``; every executor and the driver
reach it, so a lost executor costs a recomputation of its tasks and nothing else.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import shared_folder

MASK64 = (1 << 64) - 1


class Scratch:
    """Tables written under one folder of their own; ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again: its lineage ends at files that survive executors."""
        at = self.path(name)
        df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            at = getattr(df, "_scratch_path", None)
            if at:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def place(schema: pa.Schema, name: str) -> int:
    """Place of a column, whatever the case of its name."""
    return [n.lower() for n in schema.names].index(name)


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The text column of a batch as strings."""
    return pc.cast(batch.column(place(batch.schema, "text")), pa.string())


def rows_where(docs: DataFrame, keep: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """Rows of ``docs`` whose texts pass a test of the workers (a batch's texts to a flag each); all columns stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(texts_of(batch)), pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def spread_join(rows: DataFrame, lookup: DataFrame, on: list[str], size: str, partitions: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with a written ``lookup`` of unique, non-null ``on`` keys, of which few may hold most rows.

    ``lookup`` tells in column ``size`` how many rows have each key. Keys with more than a quarter of a task's fair share
    are at most 4 * ``partitions``, whatever the data; those are broadcast, so their rows stay where they are. All other
    rows meet their key in a shuffled join, where no key is large.
    """
    total, most = lookup.agg(F.sum(size), F.max(size)).first()
    limit = max(100, (total or 0) // (4 * partitions))
    if not most or most <= limit:
        return rows.join(lookup.drop(size), on, how)
    heavy, light = lookup.where(F.col(size) > limit), lookup.where(F.col(size) <= limit).drop(size)
    at_heavy = rows.join(F.broadcast(heavy.drop(size)), on, "inner")
    return at_heavy.union(rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how).select(at_heavy.columns))


_HELD: dict[str, object] = {}


def kept(name: str, make):
    """What a worker process remembers between tasks: one thing at a time, so that stages' memories do not add up."""
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps what it freed
                pass
        _HELD[name] = make()
    return _HELD[name]


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash, remembered up to a bound of entries."""

    def __init__(self, seed: int = 0, bound: int = 400_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < self.bound:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers drawn from a seeded generator."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-word shingles in order; the whole sequence is one shingle where it is shorter."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(width, n)
    mult = odd_constants(width, 40 + width)
    with np.errstate(over="ignore"):
        out = words[: n - width + 1] * mult[0]
        for j in range(1, width):
            out += words[j : n - width + 1 + j] * mult[j]
    return mix64(out)


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs of bytes other than blanks \\x09-\\x0D and \\x20."""
    return text.encode("utf-8", "replace").lower().split() if text else []
