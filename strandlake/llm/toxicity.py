"""Toxicity scores from a linear classifier with a counterfactual penalty.

A document's features are its words with their first four, five and seven letters and their last five, present or not.
Counts over a bounded sample of labelled rows choose the features that tell the classes apart, and logistic regression
weighs them. Each labelled text with an identity term is also scored with the term swapped for another of its group; the
squared difference of the two scores is part of the loss, so a term alone cannot carry weight.

Identity terms are the caller's groups and groups learned from the labelled sample itself, for corpora that name other
groups than the list knows: frequent words whose share does not differ between the classes, put together with those that
occur in the same texts. Their parts (first and last letters) do get chosen as features, by words that share them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, rows_where

#: Labelled rows used at most; they are the first by a hash of their id.
SAMPLE = 8000
#: Features weighed at most.
FEATURES = 4000
#: Words looked at for learned groups at most, and words in one group.
TERMS, GROUP = 256, 4
THRESHOLD = 0.3
#: Groups whose names may stand for one another, by language.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
)
_EDGES = ".,;:!?()[]{}\"'«»„“”‘’…*_-–—/\\|"


def words(text: str | None) -> list[str]:
    """Lower-cased words of a text without the marks at their edges."""
    return [x for x in (w.strip(_EDGES) for w in text.lower().split()) if x] if text else []


def features(word: str) -> tuple[int, ...]:
    """Hashes of a word's features."""
    parts = [f"w{word}", *(f"{n}{word[:n]}" for n in (4, 5, 7) if len(word) >= n), *([f"s{word[-5:]}"] if len(word) > 5 else [])]
    return tuple(xxhash.xxh3_64_intdigest(p) >> 1 for p in parts)


class _Cache(dict):
    """Raw word to what ``make`` gives for it, remembered up to a bound."""

    def __init__(self, make, bound: int = 400_000):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, raw: str):
        word = raw.lower().strip(_EDGES)
        out = self.make(word) if word else ()
        if len(self) < self.bound:
            self[raw] = out
        return out


def swaps(groups) -> dict[str, str]:
    """Each term to the next of its group; a term of several groups keeps its first."""
    out: dict[str, str] = {}
    for group in groups:
        for i, x in enumerate(group):
            out.setdefault(x, group[(i + 1) % len(group)])
    return out


def neutral_words(sample: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The most frequent words of ``sample`` (text, toxic) whose share is the same in both classes, TERMS at most."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for w in set(words(text)):
                    seen.setdefault(w, [0, 0])[int(toxic > 0)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), *(pa.array([x[i] for x in seen.values()], pa.int64()) for i in (0, 1))], ["word", "clean", "toxic"])

    found = sample.select("text", "toxic").mapInArrow(counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    pool = (F.col("a") + F.col("b") + 1) / (n_toxic + n_clean + 2)
    z = F.abs(F.col("a") / n_clean - F.col("b") / n_toxic) / F.sqrt(pool * (1 - pool) * (1 / n_toxic + 1 / n_clean))
    rows = found.where((F.col("a") + F.col("b")) * 100 >= n_toxic + n_clean).where(z < 1).orderBy(F.desc(F.col("a") + F.col("b")), "word").limit(TERMS).collect()
    return [r["word"] for r in rows]


def learned_groups(terms: list[str], presence: np.ndarray) -> list[tuple[str, ...]]:
    """Groups of GROUP terms that occur in the same texts: ``presence`` has a row a text and a column a term.

    From the most frequent term down, each takes the terms nearest to it (cosine of 0.2 and more) that are still free.
    """
    x = presence.astype(float)
    x /= np.maximum(np.sqrt(x.sum(0)), 1e-9)
    near, free, out = x.T @ x, set(range(len(terms))), []
    for i in range(len(terms)):
        if i in free:
            some = sorted((j for j in free if j != i and near[i, j] >= 0.2), key=lambda j: (-near[i, j], j))[: GROUP - 1]
            if some:
                free -= {i, *some}
                out.append(tuple(terms[j] for j in (i, *some)))
    return out


def _presence(texts: pa.Array, cache: dict) -> Iterator[set[int]]:
    for text in texts.to_pylist():
        yield set(chain.from_iterable(map(cache.__getitem__, set(text.split())))) if text else set()


def count_features(sample: DataFrame) -> DataFrame:
    """feature, and how many toxic and clean documents of ``sample`` (text, toxic) have it."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache(features)
        for batch in batches:
            found = list(_presence(batch.column("text"), cache))
            toxic = np.repeat(batch.column("toxic").to_numpy() > 0, [len(x) for x in found])
            ids = np.fromiter(chain.from_iterable(found), np.int64, len(toxic))
            seen, inverse, n = np.unique(ids, return_inverse=True, return_counts=True)
            hit = np.bincount(inverse, toxic, len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"feature": seen, "n_toxic": hit, "n_clean": n - hit})

    return sample.select("text", "toxic").mapInArrow(counts, "feature long, n_toxic long, n_clean long").groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def chosen_features(counts: DataFrame, n_toxic: int, n_clean: int, most: int = FEATURES) -> list[int]:
    """Features whose share differs most between the classes, by a z-score of the difference."""
    a, b = F.col("n_toxic"), F.col("n_clean")
    pool = (a + b + 1) / (n_toxic + n_clean + 2)
    z = F.abs(a / n_toxic - b / n_clean) / F.sqrt(pool * (1 - pool) * (1 / n_toxic + 1 / n_clean))
    rows = counts.where(a + b >= 3).select("feature", z.alias("z")).where("z > 3").orderBy(F.desc("z"), "feature").limit(most).collect()
    return [r["feature"] for r in rows]


def fit(examples: list[tuple[list[int], float]], twins: list[tuple[list[int], list[int]]], n: int, fairness: float = 4.0, decay: float = 2e-4, rounds: int = 600) -> np.ndarray:
    """Weights of ``n`` features and a constant, by Adam on log loss, decay and the mean squared change of twins' scores."""

    def matrix(rows):
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.fromiter(chain.from_iterable(rows), np.int64)

    def score(m, size):
        return 1 / (1 + np.exp(-np.clip(np.bincount(m[0], w[m[1]], size) + w[n], -30, 30)))

    x, y = matrix([f for f, _ in examples]), np.array([t for _, t in examples])
    left, right = matrix([a for a, _ in twins]), matrix([b for _, b in twins])
    w, m1, m2 = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for t in range(1, rounds + 1):
        g = (score(x, len(y)) - y) / len(y)
        grad = np.append(np.bincount(x[1], g[x[0]], n), g.sum()) + decay * np.append(w[:n], 0)
        if twins:
            a, b = score(left, len(twins)), score(right, len(twins))
            d = 2 * fairness * (a - b) / len(twins)
            ga, gb = d * a * (1 - a), d * b * (1 - b)
            grad += np.append(np.bincount(left[1], ga[left[0]], n) - np.bincount(right[1], gb[right[0]], n), ga.sum() - gb.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    return w


def change(w: np.ndarray, twins: list[tuple[list[int], list[int]]]) -> float:
    """Mean absolute change of the score between twins."""
    score = lambda x: 1 / (1 + np.exp(-np.clip(w[x].sum() + w[-1], -30, 30)))
    return float(np.mean([abs(score(a) - score(b)) for a, b in twins])) if twins else 0.0


def examples_of(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, identities=IDENTITIES, sample: int = SAMPLE):
    """Chosen features, examples (features, class) and twins (features, features after the swap), or None and the class
    there is where labels are of one class alone; from at most ``sample`` labelled rows that are not held out."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    first = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    table = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(first), "doc_id").select("text", "toxic"), "sample")
    sizes = {r["toxic"]: r["n"] for r in table.groupBy(F.col("toxic") > 0).agg(F.count("*").alias("n")).toDF("toxic", "n").collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return None, n_toxic
    chosen = chosen_features(count_features(table), n_toxic, n_clean)
    index = {f: i for i, f in enumerate(chosen)}
    terms = neutral_words(table, n_toxic, n_clean)
    column = {w: i for i, w in enumerate(terms)}

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"terms": pa.array([sorted({column[w] for w in words(t) if w in column}) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))})

    presence = np.zeros((n_toxic + n_clean, len(terms)), bool)
    # At most ``sample`` rows of at most TERMS places.
    for i, r in enumerate(table.select("text").mapInArrow(holding, "terms array<int>").collect()):
        presence[i, r["terms"]] = True
    swap = swaps([*identities, *learned_groups(terms, presence)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = _Cache(lambda w: tuple(index[f] for f in features(w) if f in index))
        swapped = _Cache(lambda w: tuple(index[f] for f in features(swap.get(w, w)) if f in index))
        for batch in batches:
            own = [sorted(x) for x in _presence(batch.column("text"), pick)]
            twin = [sorted(x) for x in _presence(batch.column("text"), swapped)]
            # A swap that touches no chosen feature says nothing.
            twin = [x if x != o else None for x, o in zip(twin, own, strict=True)]
            yield pa.RecordBatch.from_pydict({"own": pa.array(own, pa.list_(pa.int32())), "twin": pa.array(twin, pa.list_(pa.int32())), "toxic": batch.column("toxic")})

    # At most ``sample`` rows of chosen features.
    got = table.mapInArrow(rows, "own array<int>, twin array<int>, toxic int").collect()
    examples = sorted((r["own"], float(r["toxic"] > 0)) for r in got)
    scratch.drop(table)
    return chosen, examples, sorted((r["own"], r["twin"]) for r in got if r["twin"] is not None)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, identities=IDENTITIES) -> tuple[dict[int, float], float]:
    """Weights by feature and the constant."""
    chosen, *rest = examples_of(spark, docs, labels, scratch, identities)
    if chosen is None:
        return {}, 30.0 if rest[0] else -30.0
    w = fit(*rest, len(chosen))
    return {f: float(w[i]) for i, f in enumerate(chosen) if w[i]}, float(w[-1])


def held_out(doc_id):
    """Rows whose labels are kept for measuring: crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2


def scorer(spark: SparkSession, docs: DataFrame, labels: DataFrame, identities=IDENTITIES):
    """A function for tasks: a column of texts to their scores."""
    weights, constant = train(spark, docs, labels, Scratch(spark, "toxicity"), identities)
    # At most FEATURES weights.
    sent = spark.sparkContext.broadcast(({f: i for i, f in enumerate(weights)}, np.array(list(weights.values()) or [0.0])))

    def scores(texts: pa.Array, held: list = []) -> np.ndarray:  # noqa: B006 (a task's memory)
        index, w = sent.value
        if not held:
            held.append(_Cache(lambda x: tuple(index[f] for f in features(x) if f in index)))
        z = np.array([w[sorted(x)].sum() if x else 0.0 for x in _presence(texts, held[0])]) + constant
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; each row is decided by its own text.

    Null and repeated doc_ids are rows like any other; a null or empty text has the constant's score.
    """
    scores = scorer(spark, docs, labels)
    return rows_where(docs, lambda texts: (scores(texts) < THRESHOLD).tolist())


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, identities=IDENTITIES) -> DataFrame:
    """Scores every document; returns doc_id, held_out, score (0 to 1), predicted (1 from 0.3).

    docs: doc_id long, text string; labels: doc_id long, toxic 0/1; other columns are ignored. ``identities`` are groups
    of terms that may stand for one another, besides those learned from the labelled texts. Rows of labels with nulls are ignored, and of several for a document the largest counts. Without labels of both classes the score is
    the one class's (0 with none). A null or empty text has the constant's score; a null doc_id is kept and not held
    out. Repeated rows are scored alike. An empty table gives no rows.
    """
    scores = scorer(spark, docs, labels, identities)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores(batch.column("text")), pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
