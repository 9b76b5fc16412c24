"""Token-ID / binary output: concatenated ids with Elias-Fano document boundaries.

A shard file holds the ids of its documents one after another (16-bit where the vocabulary fits), then two Elias-Fano
sequences: the documents' ids (ascending) and their end offsets. Each costs about 2 + log2(span / n) bits a document;
sampled positions of the upper bits give ``select`` without a table of 64-bit offsets.

    file    = MAGIC, ids, doc_ids, ends, footer
    footer  = n_docs, n_ids, width of an id in bytes, null doc_ids, lowest doc_id, bytes of doc_ids, bytes of ends, MAGIC
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch
from .tokenizing import encoder, slices

MAGIC = b"STRKEF01"
FOOTER = struct.Struct("<QQBQqQQ8s")
#: One sampled position for so many documents.
EVERY = 256


class EliasFano:
    """An ascending sequence of non-negative integers: low bits packed, high bits in unary, sampled select."""

    HEAD = struct.Struct("<QQB")

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        packed = []
        for at in range(0, n, 1 << 16):  # a multiple of 8 values fills whole bytes
            part = values[at : at + (1 << 16)]
            packed.append(np.packbits(((part[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((top >> low_bits) + n + 1, np.uint8)
        bits[ones] = 1
        return cls(n, top, low_bits, np.concatenate(packed) if packed else np.empty(0, np.uint8), np.packbits(bits, bitorder="little"), ones[::EVERY].astype("<u8"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.top, self.low_bits) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, low_bits = cls.HEAD.unpack_from(data)
        raw, at = np.frombuffer(data, np.uint8), cls.HEAD.size
        whole, rest = divmod(n, 1 << 16)
        sizes = (whole * (low_bits << 13) + (rest * low_bits + 7) // 8, ((top >> low_bits) + n + 8) // 8)
        low, high = raw[at : at + sizes[0]], raw[at + sizes[0] : at + sum(sizes)]
        return cls(n, top, low_bits, low, high, raw[at + sum(sizes) :].view("<u8"))

    def select(self, i: int) -> int:
        """The i-th value (from 0): from the nearest sample, count ones in the upper bits, then add the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // EVERY]), i % EVERY
        byte = at // 8
        seen = -bin(int(self.high[byte]) & ((1 << (at % 8)) - 1)).count("1")
        while True:
            ones = bin(int(self.high[byte])).count("1")
            if seen + ones > left:
                break
            seen, byte = seen + ones, byte + 1
        for bit in range(8):
            if int(self.high[byte]) >> bit & 1:
                if seen == left:
                    break
                seen += 1
        return ((byte * 8 + bit - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        part = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return (part >> (first % 8)) & ((1 << self.low_bits) - 1)

    def run(self, first: int, end: int) -> np.ndarray:
        """Values ``first`` to ``end``: ``select`` of many neighbours, from the sample before them to the one behind."""
        if first >= end:
            return np.empty(0, np.uint64)
        at, behind = int(self.samples[first // EVERY]), -(-end // EVERY)
        stop = int(self.samples[behind]) if behind < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at // 8 : stop // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits[at % 8 :])[first % EVERY :][: end - first] + at
        out = (ones - np.arange(first, end)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit, last = first * self.low_bits, end * self.low_bits
            low = np.unpackbits(self.low[bit // 8 : (last + 7) // 8], bitorder="little")[bit % 8 :][: last - bit]
            out |= (low.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out

    def values(self) -> np.ndarray:
        """All values in order."""
        return np.concatenate([np.empty(0, np.uint64), *(self.run(i, min(i + (1 << 16), self.n)) for i in range(0, self.n, 1 << 16))])


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI in the shared folder."""
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams documents' ids to a file; boundaries stay in memory (16 bytes a document) until the end."""

    def __init__(self, uri: str, width: int):
        self.uri, self.width = uri, width
        where, self.at = opened(uri)
        where.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.where, self.out = where, where.open_output_stream(self.at + ".part", buffer_size=1 << 20)
        self.out.write(MAGIC)
        self.docs, self.ends = array("q"), array("Q")
        self.n = self.nulls = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.n += len(ids)
        if doc_id is None:
            if self.docs:
                raise ValueError("null doc_ids come first")
            self.nulls += 1
        else:
            self.docs.append(doc_id)
        self.ends.append(self.n)

    def close(self) -> None:
        known = np.frombuffer(self.docs, np.int64)
        least = int(known[0]) if len(known) else 0
        with np.errstate(over="ignore"):  # differences of 64-bit ids, modulo 2 ** 64
            docs = EliasFano.of(known.view(np.uint64) - np.array([least], np.int64).view(np.uint64)).to_bytes()
        ends = EliasFano.of(np.frombuffer(self.ends, np.uint64)).to_bytes()
        self.out.write(docs + ends + FOOTER.pack(len(self.ends), self.n, self.width, self.nulls, least, len(docs), len(ends), MAGIC))
        self.out.close()
        self.where.move(self.at + ".part", self.at)


class Shard:
    """Random access to a shard file: ``ids(i)`` reads one document's ids through ``select``."""

    def __init__(self, uri: str):
        where, at = opened(uri)
        self.file = where.open_input_file(at)
        size = self.file.size()
        self.n_docs, self.n_ids, self.width, self.nulls, self.least, docs, ends, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a whole shard")
        self.doc_ids = EliasFano.from_bytes(self.file.read_at(docs, size - FOOTER.size - docs - ends))
        self.ends = EliasFano.from_bytes(self.file.read_at(ends, size - FOOTER.size - ends))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.doc_ids.select(i - self.nulls)

    def span(self, first: int, end: int) -> np.ndarray:
        """Ids at places ``first`` to ``end`` of the concatenation."""
        return np.frombuffer(self.file.read_at((end - first) * self.width, len(MAGIC) + first * self.width), f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        return self.span(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def blocks(self, most: int = 1 << 20) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """All documents in order: doc_ids, ends and ids of runs of about ``most`` ids; boundaries are selected by runs."""
        first = 0
        for i in range(0, self.n_docs, 16 * EVERY):
            end = min(self.n_docs, i + 16 * EVERY)
            ends = self.ends.run(i, end).astype(np.int64)
            known = self.doc_ids.run(max(i - self.nulls, 0), max(end - self.nulls, 0))
            docs = [None] * (end - i - len(known)) + (known.astype(object) + self.least).tolist()
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, first + most, "right")))
                yield docs[at:to], np.concatenate(([first], ends[at:to])), self.span(first, int(ends[to - 1]))
                at, first = to, int(ends[to - 1])


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Writes shard files under ``folder`` in ascending doc_id; returns what to write as the store's table of shards.

    An id takes 16 bits where the vocabulary and the end id fit, else 32.

    docs: doc_id long, text string (null: empty); other columns are ignored. Null doc_ids come first, rows with equal
    doc_ids stay neighbours. A task that is run again writes another file and reports that one.
    """

    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        uri = f"{folder}/shard-{task.partitionId():06d}-{uuid.uuid4().hex}.ids"
        out, own = None, np.array([end_id], np.uint32)
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            for at, part in slices(texts):
                out = out or ShardWriter(uri, width)
                for k, raw in enumerate(encoder(tokenizer_path).encode(part)):
                    out.add(ids[at + k], np.concatenate((np.frombuffer(raw, "<u4"), own)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "uri": [uri], "n_docs": [len(out.ends)], "n_ids": [out.n]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    return rows.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(shards, "part long, uri string, n_docs long, n_ids long")


def read_store(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Every document of a store, read from its files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    # One row a shard file; a store has as many as the writing job had partitions.
    shards = sorted(table.collect(), key=lambda r: r["part"])
    starts = np.cumsum([0, *[r["n_ids"] for r in shards]]).tolist()
    rows = [(r["uri"], s) for r, s in zip(shards, starts, strict=False)]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                for docs, ends, ids in Shard(uri).blocks():
                    at = ends - ends[0]
                    words = ids.astype("<u4")
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(docs, pa.int64()),
                            "start": pa.array(base + ends[:-1], pa.int64()),
                            "n_tokens": pa.array(np.diff(ends), pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(words[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                        }
                    )

    listed = spark.createDataFrame(rows, "uri string, base long").repartition(max(1, len(rows)), "uri")
    return listed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Writes ``docs`` to a store in the shared folder and reads it back. An empty table gives no rows."""
    scratch = Scratch(spark, "tokens")
    table = scratch.table(write_store(docs, scratch.path("ids"), tokenizer_path, end_id, partitions=partitions), "shards")
    return read_store(spark, table)
