"""Source divergence audit: how far apart the term distributions of a language's sources are, exactly.

One pass counts terms in Arrow batches, combined per task before anything moves. The kept terms of a language, each
with its counts by source in one row, then give joint count histograms: how many terms have the counts (a, b) in a pair
of sources. Counts of most terms are small, so few combinations stand for many terms, and the distance of two smoothed
probabilities is worked out once a combination. Terms that one or both sources lack are the histograms' zero cells;
they follow from the sources' own histograms and are never written out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, place, texts_of

#: Counts (language, source, term) that a task holds before it hands them on.
HELD = 300_000
#: Pairs of counts that a task makes at once, and distinct ones it holds.
PAIRS = 500_000
_TERM_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_CELLS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("na", pa.int64()), ("nb", pa.int64()), ("terms", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters A-Z and a-z and of everything beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each term by language and source; the term '' stands for the pair itself."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            both = np.fromiter(counts.values(), np.int64, len(counts))
            n = len(both)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.repeat(source, n), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(both & ((1 << 40) - 1)), pa.array(both >> 40)], schema=_COUNTS)

    for batch in batches:
        texts = pc.fill_null(texts_of(batch), "").cast(pa.binary())
        langs, sources = (pc.fill_null(pc.cast(batch.column(place(batch.schema, c)), pa.string()), "").to_pylist() for c in ("lang", "source"))
        for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
            counts = held.setdefault((lang, source), {})
            before = len(counts)
            # A count and, from bit 40, the number of documents.
            counts[b""] = counts.get(b"", 0) + (1 << 40)
            for term, n in Counter(terms_of(texts[i].as_py())).items():
                counts[term] = counts.get(term, 0) + n + (1 << 40)
            size += len(counts) - before
            if size > HELD:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def _joint_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, entries sorted by source): how many terms have the counts (na, nb) in sources a < b, both over 0;
    and, to be taken off the zero cells, how many have na in a, or nb in b, and some count in the other."""
    keys = ["lang", "a", "b", "na", "nb"]
    held: list[pa.Table] = []

    def folded() -> pa.Table:
        return pa.concat_tables(held).group_by(keys).aggregate([("terms", "sum")]).rename_columns([*keys, "terms"]) if len(held) > 1 else held[0]

    def out(langs: pa.Array, names: pa.Array, cells: pa.Table) -> Iterator[pa.RecordBatch]:
        signed = [cells]
        for zero in (["nb"], ["na"], ["na", "nb"]):
            left = [k for k in keys if k not in zero]
            off = cells.group_by(left).aggregate([("terms", "sum")])
            columns = {k: off[k] for k in left} | {k: pa.array(np.zeros(len(off), np.int64)) for k in zero}
            sign = 1 if len(zero) == 2 else -1
            signed.append(pa.table([*[columns[k] for k in keys], pc.multiply(off["terms_sum"], sign)], names=[*keys, "terms"]))
        for t in signed:
            t = pa.table([langs.take(t["lang"]), names.take(t["a"]), names.take(t["b"]), t["na"], t["nb"], t["terms"]], schema=_CELLS)
            yield from t.to_batches(max_chunksize=100_000)

    for batch in batches:
        if not batch.num_rows:
            continue
        lang = batch.column(0).dictionary_encode()
        entries = batch.column(1)
        sizes = pc.list_value_length(entries).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = entries.flatten()
        source, n = flat.field(0).dictionary_encode(), flat.field(1).to_numpy(zero_copy_only=False)
        of_term = np.repeat(lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        codes = source.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes)) - 1  # entries of the same term behind each
        ends, at = np.cumsum(after), 0
        held, rows = [], 0
        while at < len(codes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            many = after[at:to]
            left = np.repeat(np.arange(at, to), many)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
            one = pa.table([pa.array(of_term[left]), pa.array(codes[left]), pa.array(codes[right]), pa.array(n[left]), pa.array(n[right])], names=keys)
            held.append(one.group_by(keys).aggregate([([], "count_all")]).rename_columns([*keys, "terms"]))
            rows += len(held[-1])
            if rows > 4 * PAIRS:
                held = [folded()]
                rows = len(held[0])
                if rows > 2 * PAIRS:
                    yield from out(lang.dictionary, source.dictionary, held[0])
                    held, rows = [], 0
            at = to
        if held:
            yield from out(lang.dictionary, source.dictionary, folded())


def probability(n: str, total: str, kept: str, scale: int, alpha: int) -> Column:
    """1 + floor(scale * (n + alpha) / (total + alpha * kept)), in whole numbers."""
    wide = lambda x: f"cast({x} as decimal(38,0))"
    return F.expr(f"1L + ({wide(n)} + {alpha}) * {wide(scale)} div ({wide(total)} + {wide(kept)} * {alpha})")


def term_counts(spark: SparkSession, docs: DataFrame, scratch: Scratch, least: int) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, entries of (source, n), source in order) and all pairs (lang, source), both written."""
    counted = docs.select("text", "lang", "source").mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    dealt = counted.repartition("lang", "term")
    each = scratch.table(dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("entries")).where(f"term = '' or docs >= {int(least)}"), "terms")
    groups = each.where("term = ''").select("lang", F.explode("entries.source").alias("source"))
    return each.where("term <> ''").select("lang", "term", "entries"), scratch.table(groups, "groups")


def audit(spark: SparkSession, docs: DataFrame, least: int = 30, top: int = 50, scale: int = 1_000_000_000, alpha: int = 5) -> DataFrame:
    """Distances between the sources of each language, and the terms that set each source apart.

    docs: text, lang, source; null is '' in all three. A language keeps the terms that ``least`` of its documents hold.
    Every (lang, source) that occurs gives each kept term the whole number p = 1 + floor(scale * (count + alpha) / (N +
    alpha * V)), with N its counts of kept terms and V their number; the whole language does so too. Rows (lang, source,
    part, item, value, rank), ranks by value descending, then item ascending:

    * part ``pair``: item is every other source of the language, value the sum over all kept terms of the distances of
      the two p; 0 where no term is kept, so ties are ranked by name alone.
    * part ``term``: item is a kept term that the source has more often, by p, than the whole language; value is the
      difference; the ``top`` first ones.

    A source without terms has pairs and no terms. Repeated rows count as often as they occur; an empty table gives no
    rows; other columns, whatever their names, are left out. A row of the result of ``pair`` is one pair of sources, so
    the result, and what a term's row holds at most, grow with a language's sources, not with documents.
    """
    scratch = Scratch(spark, "divergence")
    terms, groups = term_counts(spark, docs, scratch, least)
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("entries.n", F.lit(0).cast("long"), lambda x, y: x + y)).alias("lang_total"))
    counts = terms.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source", "e.n").agg(F.count("*").alias("terms"))
    histogram = scratch.table(counts, "histogram")
    totals = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("has"))
    known = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = scratch.table(known.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "has", "kept", "lang_total")]), "totals")

    # Terms: both probabilities of a count, then the first of each source, cut in every task before they move.
    seen = terms.select("lang", "term", F.explode("entries").alias("e"), F.aggregate("entries.n", F.lit(0).cast("long"), lambda x, y: x + y).alias("all_n")).select("lang", "term", "all_n", "e.*")
    rated = seen.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (probability("n", "total", "kept", scale, alpha) - probability("all_n", "lang_total", "kept", scale, alpha)).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    first = rated.where("value > 0").withColumn("rank", rank).where(F.col("rank") <= top)

    # Pairs: the joint histogram of each, its zero cells from what the sources' own histograms have left.
    cells = terms.select("lang", "entries").where(F.size("entries") > 1).mapInArrow(_joint_cells, "lang string, a string, b string, na long, nb long, terms long")
    side = lambda c: groups.select("lang", F.col("source").alias(c), F.col("has").alias(f"has_{c}"), F.col("total").alias(f"total_{c}"), "kept")
    pairs = scratch.table(side("a").join(side("b").drop("kept"), "lang").where("a < b"), "pairs")  # as many rows as the result
    own = lambda c: pairs.select("lang", "a", "b").join(histogram.withColumnRenamed("source", c), ["lang", c]).select("lang", "a", "b", *[(F.col("n") if x == c else F.lit(0).cast("long")).alias(f"n{x}") for x in ("a", "b")], "terms")
    neither = pairs.select("lang", "a", "b", F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), (F.col("kept") - F.col("has_a") - F.col("has_b")).alias("terms"))
    joint = cells.unionByName(own("a")).unionByName(own("b")).unionByName(neither).groupBy("lang", "a", "b", "na", "nb").agg(F.sum("terms").alias("terms")).where("terms > 0")
    distance = F.abs(probability("na", "total_a", "kept", scale, alpha) - probability("nb", "total_b", "kept", scale, alpha))
    values = joint.join(pairs, ["lang", "a", "b"]).groupBy("lang", "a", "b").agg(F.sum(distance * F.col("terms")).alias("value"))
    whole = scratch.table(pairs.select("lang", "a", "b").join(values, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long"))), "values")
    ways = whole.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w"), "value")
    near = ways.select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", rank)
    return near.unionByName(first)
