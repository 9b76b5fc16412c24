"""Mixing sources to target weights: hash-random order within each source, prefix sums of sizes, a cut at each budget.

Only DataFrame functions. Texts are read once, for their sizes; what moves afterwards is a narrow row a document. The
random keys are uniform, so equal slices of the key space are ranges of about equal size: a source is cut into as many
slices as it has quarters of a task's fair share, whatever part of all rows it holds. Sums within slices, on top of the
sums of the slices before (at most four a partition, and one a source), give every document its place in its source.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, spread_join

#: Copies of one row that one task puts out.
COPIES = 1000
WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks \\x09-\\x0D and \\x20; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _before(scratch: Scratch, df: DataFrame, order: Column, **sums: Column) -> DataFrame:
    """``df`` with sums over all rows before each in ``order``, where ties may go either way; no window over all rows.

    Rows are dealt out by ranges and written; one row of sums a range goes to all tasks.
    """
    placed = df.withColumns({"_order": order, **{f"_{k}": v.cast(WIDE) for k, v in sums.items()}})
    rows = scratch.table(placed.repartitionByRange("_order").withColumn("_range", F.spark_partition_id()), "ranges")
    each = rows.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in sums])
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = each.select("_range", *[F.coalesce(F.sum(f"_all_{k}").over(upto), F.lit(0)).alias(f"_base_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda k: (F.col(f"_base_{k}") + F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0))).cast(WIDE).alias(k)
    return rows.join(F.broadcast(bases), "_range").select(*df.columns, *[own(k) for k in sums])


def targets(spark: SparkSession, sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """sources (source, source_size) with weight, target, and the whole epochs and further words of the budget.

    ``weights`` repeat over the sources in code point order, null last, and divide share[0] / share[1] of all sizes. A
    target stops at ``most`` times its source's size and the excess is divided again by weight. Dividing again and
    again ends where one pass does: in order of size a weight, a source is at that stop if its part of what the
    sources before it leave reaches the stop. The budget is the target rounded down to whole words.
    """
    scratch = Scratch(spark, "targets")
    ranked = _before(scratch, scratch.table(sources.select("source", "source_size"), "sources"), F.struct(F.col("source").isNull().alias("last"), "source"), nth=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    weighed = scratch.table(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    by_ratio = F.expr(f"cast(source_size as {WIDE}) * ({lcm(*weights)} div weight)")
    placed = scratch.table(_before(scratch, weighed, by_ratio, sizes=F.col("source_size"), weights=F.col("weight")), "placed")
    # All amounts are share[1] times as large, so that they are whole.
    wide = lambda c: F.col(c).cast(WIDE)
    total = placed.agg(F.sum(wide("source_size")).alias("all_sizes"), F.sum(wide("weight")).alias("all_weights"))
    stop = wide("source_size") * most * share[1]
    left = wide("all_sizes") * share[0] - wide("sizes") * most * share[1]
    rows = placed.crossJoin(F.broadcast(total)).withColumn("stopped", stop * (wide("all_weights") - wide("weights")) <= wide("weight") * left)  # one row of totals
    at_stop = rows.where("stopped").agg(F.coalesce(F.sum(wide("source_size")), F.lit(0)).alias("stop_sizes"), F.coalesce(F.sum(wide("weight")), F.lit(0)).alias("stop_weights"))
    rows = rows.crossJoin(F.broadcast(at_stop)).withColumns({
        "over": wide("weight") * (wide("all_sizes") * share[0] - wide("stop_sizes") * most * share[1]), "under": (wide("all_weights") - wide("stop_weights")) * share[1],
    })
    target = F.when(F.col("stopped"), (F.col("source_size") * most).cast("double")).otherwise(F.col("over").cast("double") / F.col("under").cast("double"))
    budget = F.when(F.col("stopped"), F.col("source_size") * most).otherwise(F.expr("over div under"))
    out = rows.select("source", "source_size", "weight", target.alias("target"), budget.cast("long").alias("budget"))
    return out.select("source", "source_size", "weight", "target", F.expr("budget div greatest(source_size, 1)").alias("epochs"), F.expr("budget % greatest(source_size, 1)").alias("rest"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 11) -> DataFrame:
    """What a mixture of all sources takes of every document: doc_id, source, size, source_size, target, taken.

    docs: doc_id, text, source. The size of a document is its number of words, 0 for a null or empty text. Each source's
    documents stand in the order of an MD5 sum of ``seed`` and doc_id (ties: doc_id, then size); the mixture takes them
    whole in that order, epoch by epoch, and of the last document as many words as the budget leaves, so a source's
    taken words are its target rounded down, and none is taken more than ``most`` times. Null is a source of its own,
    the last one, and so is the empty name. Rows alike in source, doc_id (null too) and size are copies of one
    document: they are counted first and stand side by side. A source of no words, and an empty table, take nothing.
    Other columns, whatever their names, are left out; the same rows in any order or number of files give the same rows.
    """
    partitions, scratch = int(spark.conf.get("spark.sql.shuffle.partitions")), Scratch(spark, "mixing")
    key = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).cast("binary")), 1, 16)
    # A source's name as a key that is never null.
    sized = docs.select(F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")).alias("name"), "doc_id", key.alias("key"), word_count(F.col("text")).alias("size"))
    rows = scratch.table(sized.groupBy("name", "doc_id", "key", "size").agg(F.count("*").alias("copies")), "sizes")
    sources = scratch.table(rows.groupBy("name").agg(F.count("*").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("source_size")), "names")
    total = sources.agg(F.sum("rows")).first()[0] or 0
    source = F.when(F.col("name") != "-", F.expr("substring(name, 2)")).alias("source")
    cut = targets(spark, sources.select(source, "source_size"), weights, share, most)
    name = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")).alias("name")
    slices = F.greatest(F.ceil(F.col("rows") * 4 * partitions / F.lit(max(total, 1))), F.lit(1)).cast("long")
    budgets = scratch.table(cut.select(name, "source_size", "target", "epochs", "rest").join(sources.select("name", "rows", slices.alias("slices")), "name"), "budgets")
    nth = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("slices"), 32)
    here = F.col("size") * F.col("copies")
    dealt = spread_join(rows, budgets.drop("target", "epochs", "rest", "source_size"), ["name"], "rows", partitions).withColumn("slice", nth).drop("slices")
    sums = dealt.groupBy("name", "slice").agg(F.sum(here).alias("words"))
    # At most four slices a partition, and one a source.
    upto = Window.partitionBy("name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.table(sums.withColumn("base", F.coalesce(F.sum("words").over(upto), F.lit(0))).drop("words").join(budgets.drop("rows", "slices"), "name"), "slices")
    inside = Window.partitionBy("name", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum(here).over(inside), F.lit(0))).join(bases, ["name", "slice"])
    last = F.least(F.greatest(F.col("rest") - F.col("base") - F.col("inside"), F.lit(0)), here)
    placed = scratch.table(placed.select(source, "doc_id", "size", "copies", "source_size", "target", "epochs", last.alias("last")), "places")
    few = placed.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    lots = placed.where(F.col("copies") > COPIES).withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).repartition(partitions, "source", "doc_id", "size", "lot")
    many = lots.withColumn("copy", F.explode(F.expr(f"sequence(lot * {COPIES}, least(copies, (lot + 1) * {COPIES}) - 1)"))).drop("lot")
    own = F.least(F.greatest(F.col("last") - F.col("copy") * F.col("size"), F.lit(0)), F.col("size"))
    return few.unionByName(many).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + own).cast("long").alias("taken"))
