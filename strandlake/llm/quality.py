"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

Both models are bags of hashed n-grams: words, closing marks, pairs of neighbouring words and of word shapes. The target
model comes from labelled good rows (a bounded sample), the raw one from all documents. A document's log weight is the
sum of log ratios over its n-grams. Gumbel noise is added to it, and the k largest are drawn: a sample without
replacement in proportion to the weights. Long documents of either kind have weights far from 0, where noise of about 1.3
changes nothing; among short ones, and near the end of the draw, it decides.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import Scratch, kept, mix64, spread_join, texts_of

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Labelled rows used at most for the target model and the share of good rows; the first by a hash of their id.
SAMPLE = 20_000
#: Hashes of copied texts that are broadcast at most; beyond, they are joined by a shuffle.
FEW = 1_000_000
#: Sightings of a bucket in raw text at which its ratio counts half.
RARE = 5.0
_MARKS = ".,;:!?()[]{}\"'«»„“”‘’…*_-–—/\\|#$%&+=<>~^@"


class _Vocabulary(dict):
    """Word to a row of arrays: hash of its core, hash of its closing marks, shape. Emptied beyond a bound of words."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound
        self.rows = array("Q")

    def __missing__(self, word: str) -> int:
        core = word.strip(_MARKS)
        marks = word[len(word.rstrip(_MARKS)) :] if core else word
        if not core:
            shape = 5
        elif len(marks) > 2:
            shape = 4
        elif core.isdigit():
            shape = 3
        elif len(core) > 1 and core.isupper():
            shape = 2
        else:
            shape = int(core[0].isupper())
        self.rows.extend((xxhash.xxh3_64_intdigest(core.lower()), xxhash.xxh3_64_intdigest(marks, 1) if marks else 0, shape))
        self[word] = len(self.rows) // 3 - 1
        return self[word]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts, and the number of each text's."""
    known = kept("vocabulary", _Vocabulary)
    if len(known) > known.bound:
        known.clear()
        known.rows = array("Q")
    split = [t.split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    index = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
    table = np.array(known.rows, np.uint64).reshape(-1, 3)
    core, marks, shape = table[index, 0], table[index, 1], table[index, 2]
    owner = np.repeat(np.arange(len(texts)), sizes)
    near = np.flatnonzero(owner[1:] == owner[:-1])
    with np.errstate(over="ignore"):
        pairs = core[near] * np.uint64(0x9E3779B97F4A7C15) + core[near + 1]
        pairs = np.where(core[near] == core[near + 1], np.uint64(11), pairs)  # a word said twice is one n-gram, whatever the word
        shapes = np.uint64(1000) + shape[near] * np.uint64(8) + shape[near + 1]
    marked = np.flatnonzero(marks)
    every = np.concatenate((core, marks[marked], pairs, shapes))
    of = np.concatenate((owner, owner[marked], owner[near], owner[near]))
    return (mix64(every) % np.uint64(BUCKETS)).astype(np.int64), of


def with_shares(texts: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """text and share of all texts but null ones: 1 over the number of rows with that text.

    All copies of a text together say as much as one, however many rows the table has, and a clean text does not look
    unlike the target for being copied. Only hashes of copied texts are joined: up to FEW by broadcast, more by a
    shuffle that leaves the rows of hot ones where they are.
    """
    hashed = texts.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    scratch = scratch or Scratch(texts.sparkSession, "shares")
    copied = scratch.table(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", "n", (1.0 / F.col("n")).alias("part")), "copied")
    if copied.count() <= FEW:
        joined = hashed.join(F.broadcast(copied.drop("n")), "h", "left")
    else:
        joined = spread_join(hashed, copied, ["h"], "n", int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "left")
    return joined.select("text", F.coalesce("part", F.lit(1.0)).alias("share"))


def counted(texts: DataFrame) -> np.ndarray:
    """n-grams by bucket over all rows of ``texts`` (text, share); each task adds up its own rows first, and at most
    BUCKETS rows are collected."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS)
        for batch in batches:
            column, share = batch.column("text").to_pylist(), batch.column("share").to_numpy()
            for at in range(0, len(column), 500):
                buckets, of = ngrams(column[at : at + 500])
                total += np.bincount(buckets, share[at + of], BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": total[used]})

    out = np.zeros(BUCKETS)
    for r in texts.select("text", "share").mapInArrow(counts, "bucket long, n double").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = round(r["n"], 6)
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the buckets' shares in target and raw text, one added to each count; at most 4 either way.

    Buckets seen seldom in raw text say little either way: a ratio counts for n / (n + RARE) of itself.
    """
    ratio = np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    return np.clip(ratio, -4.0, 4.0) * raw / (raw + RARE)


def with_log_weights(spark: SparkSession, docs: DataFrame, ratio: np.ndarray, weight: str, size: str) -> DataFrame:
    """All rows of ``docs`` with their log weight and number of n-grams in two more columns."""
    sent = spark.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        for batch in batches:
            column, sums, sizes = texts_of(batch).to_pylist(), [], []
            for at in range(0, len(column), 500):
                part = column[at : at + 500]
                buckets, of = ngrams(part)
                sums.append(np.bincount(of, ratio[buckets], len(part)))
                sizes.append(np.bincount(of, minlength=len(part)))
            more = [pa.array(np.concatenate(sums or [[]]), pa.float64()), pa.array(np.concatenate(sizes or [[]]), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, weight, size])

    return docs.mapInArrow(weigh, StructType([*docs.schema.fields, StructField(weight, DoubleType()), StructField(size, LongType())]))


def calibrated(rows: list[tuple[float, int]], rounds: int = 50) -> tuple[float, float]:
    """Slope and constant of the chance that a row is good, given its log weight: logistic regression by Newton steps,
    on weights cut to +-30, with a weak prior that keeps the slope finite where the classes do not overlap."""
    x, y = np.clip(np.array([r[0] for r in rows]), -30, 30), np.array([r[1] for r in rows], float)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p)
        g = np.array([((p - y) * x).sum() + (a - 1.0), (p - y).sum() + 0.1 * b])
        h = np.array([[(v * x * x).sum() + 1.0, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def top_k(keyed: DataFrame, k: int) -> tuple[float, int] | None:
    """(key, doc_id) of the k-th row by key descending, then doc_id: narrowed by counts, never by a global sort."""
    if k <= 0:
        return None
    low, high, left = *keyed.agg(F.min("key"), F.max("key")).first(), k
    rows = keyed.where(F.col("key").between(low, high))
    while True:
        if low == high:
            break
        step = (high - low) / 512
        if step <= abs(low) * 1e-14 + 1e-300:
            break
        bin_ = F.least(F.floor((F.col("key") - low) / step), F.lit(511)).cast("int")
        counts = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in rows.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if left <= counts[b][0]:
                break
            left -= counts[b][0]
        n, low, high = counts[b]
        rows = keyed.where(F.col("key").between(low, high))
        if n <= 10_000:
            break
    last = rows.orderBy(F.desc("key"), "doc_id").limit(left).agg(F.min(F.struct("key", -F.col("doc_id")))).first()[0]
    return last[0], -last[1]


def weighed(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, weight: str, size: str, sample: int = SAMPLE) -> tuple[DataFrame, int]:
    """A written table of ``docs`` with log weights, and how many target-like documents it is expected to hold.

    That number, rounded up, is the sum over all documents of the chance that one of its log weight is good, as labelled rows (at
    most ``sample``) tell; without labelled good rows every document counts.
    """
    usable = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    first = scratch.table(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = scratch.table(own.join(F.broadcast(first), "doc_id"), "sample")
    if not table.where("quality > 0").limit(1).count():
        out = scratch.table(with_log_weights(spark, docs, np.zeros(BUCKETS), weight, size), "weights")
        return out, out.count()
    target = table.where("quality > 0").select("text", F.lit(1.0).alias("share"))
    # The target is part of the raw text: the bound on what one n-gram can say keeps unseen ones from deciding alone.
    out = scratch.table(with_log_weights(spark, docs, log_ratios(counted(target), counted(with_shares(own, scratch))), weight, size), "weights")
    # At most ``sample`` labelled rows (and rows that repeat their ids).
    known = out.select(F.col("doc_id").cast("long").alias("doc_id"), weight).join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.min(weight).alias("w"), F.min("quality").alias("q")).collect()
    a, b = calibrated([(r["w"], int(r["q"] > 0)) for r in known])
    likely = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(weight))) + b))))
    scratch.drop(table)
    return out, ceil(out.agg(F.sum(likely)).first()[0] or 0.0)


def draw(rows: DataFrame, k: int, weight: str, key: str, temperature: float = 1.0, seed: int = 6) -> tuple[DataFrame, Column]:
    """Gumbel top-k: ``rows`` with their ``key``, and the condition that holds for the k drawn ones.

    The key is the log weight over ``temperature`` plus Gumbel noise, so at temperature 1 the k largest keys are a draw
    without replacement in proportion to the weights. The noise is fixed by the seed, the doc_id and the text: rows
    alike in both share a key. Ties go to the smaller doc_id, null last; rows alike in key and doc_id go together.
    """
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = rows.withColumn(key, F.col(weight) / temperature - F.log(-F.log(uniform)))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    last = top_k(keyed.select(doc.alias("doc_id"), F.col(key).alias("key")), k)
    return keyed, F.lit(False) if last is None else (F.col(key) > last[0]) | ((F.col(key) == last[0]) & (doc <= last[1]))


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    return [next(f"{n}{'_' * i}" for i in range(len(taken) + 1) if f"{n}{'_' * i}" not in taken) for n in names]


def importance_resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, seed: int = 6, sample: int = SAMPLE) -> DataFrame:
    """Draws ``k`` documents in proportion to their importance weights: doc_id, n_grams, log_weight, score, key, kept.

    docs: doc_id long, text string; labels: doc_id long, quality 0/1; other columns are ignored. ``log_weight`` is the
    sum of log ratios over a document's n-grams, ``score`` their mean, ``key`` what Gumbel top-k compares (see ``draw``).
    The caller gives k; without it, it is the number of target-like documents that the table is expected to hold (see
    ``weighed``). Null and empty texts have weight 0. Without labelled good rows all weights are 0 and all documents are
    drawn. Null doc_ids take part; repeated rows share a key and go together, so that a tie at the end may give more
    than k. Very long texts are weighed whole. An empty table gives no rows.
    """
    scratch = Scratch(spark, "quality")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table, expected = weighed(spark, rows, labels, scratch, "log_weight", "n_grams", sample)
    keyed, drawn = draw(table, expected if k is None else k, "log_weight", "key", temperature, seed)
    return keyed.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") / F.greatest("n_grams", F.lit(1))).alias("score"), "key", drawn.alias("kept"))


def resampled(spark: SparkSession, docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; each row has the weight of its own text."""
    weight, size, key = _fresh(docs, "log_weight", "n_grams", "key")
    table, expected = weighed(spark, docs, labels, Scratch(spark, "quality"), weight, size)
    keyed, drawn = draw(table, expected if k is None else k, weight, key)
    return keyed.where(drawn).select(*[f"`{c}`" for c in docs.columns])
