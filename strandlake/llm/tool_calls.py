"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Only DataFrame functions: calls meet results in a hash join on (conversation, identifier). A conversation of at most
CALLS calls whose needs all point backwards, as causes do, is ordered in one pass over its calls, whatever the depth of
its graph. Others (larger, or with needs that point forwards, so perhaps in cycles) are peeled, a join a level, on
(conversation, identifier) keys, so that a conversation of any size is spread over all tasks. Arguments are parsed to
variants, whose objects keep their keys sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Calls of a conversation that are put together in one row at most.
CALLS = 10_000
#: Conversations up to this many are sent to all executors; beyond, a shuffled join takes their place.
FEW = 1_000_000
#: Types a schema may ask for, as the type names of variants.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "boolean": ("BOOLEAN",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "array": ("ARRAY",), "object": ("OBJECT",)}


def argument_error(name: Column, parsed: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """First fault of a call's arguments, or null: malformed, unknown_tool, missing:field, type:field (fields by name)."""
    kind_of = lambda v: F.schema_of_variant(v)
    faults = F.when(parsed.isNull() | ~F.startswith(F.coalesce(kind_of(parsed), F.lit("")), F.lit("OBJECT")), F.lit("malformed"))
    faults = faults.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown_tool"))
    for tool, fields in sorted(schemas.items()):
        for field, (kind, required) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            gone = value.isNull() | F.is_variant_null(value)
            fits = reduce(lambda a, b: a | b, [F.startswith(kind_of(value), F.lit(k)) for k in KINDS[kind]])
            if required:
                faults = faults.when((name == tool) & gone, F.lit(f"missing:{field}"))
            faults = faults.when((name == tool) & ~gone & ~fits, F.lit(f"type:{field}"))
    return faults


def in_order(calls: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Levels (conv_id, call_id, level) of conversations whose needs point backwards, and the conv_ids of the others.

    calls: conv_id, call_id, turn, needs, each call once. Only conversations of at most CALLS calls are put together.
    """
    large = scratch.table(calls.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > CALLS).select("conv_id"), "large")
    small = calls.select("conv_id", "call_id", "turn", "needs").join(F.broadcast(large) if large.count() <= FEW else large, "conv_id", "left_anti")
    rows = small.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "call_id", "needs"))).alias("calls"))
    rows = scratch.table(rows.withColumn("ids", F.transform("calls", lambda c: c["call_id"])), "conversations")
    # Places (from 1) of the calls that each call waits for.
    others = lambda c: F.filter(F.coalesce(c["needs"], F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != c["call_id"]))
    places = F.transform("calls", lambda c: F.filter(F.transform(others(c), lambda x: F.array_position(F.col("ids"), x)), lambda p: p > 0))
    rows = scratch.table(rows.select("conv_id", "ids", places.alias("places")), "places")
    backwards = F.forall(F.transform("places", lambda p, i: F.coalesce(F.array_max(p), F.lit(0)) <= i), lambda x: x)
    level = lambda done, p: F.coalesce(F.array_max(F.transform(p, lambda x: F.get(done, (x - 1).cast("int")))), F.lit(-1)) + 1
    found = F.aggregate("places", F.array().cast("array<int>"), lambda done, p: F.concat(done, F.array(level(done, p))))
    each = F.explode(F.arrays_zip(F.col("ids").alias("call_id"), found.alias("level")))
    fine = rows.where(backwards).select("conv_id", each.alias("c")).select("conv_id", F.col("c.call_id").alias("call_id"), F.col("c.level").alias("level"))
    return fine, large.union(rows.where(~backwards).select("conv_id"))


def levels(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of every node (conv_id, call_id): 0 without parents, else one more than the highest parent's.

    edges: conv_id, call_id, parent; both ends must be nodes. Nodes on or behind a cycle get no row.
    """
    scratch = Scratch(spark, "levels")
    edges = scratch.table(edges, "edges")
    ready = scratch.table(nodes.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "level")
    out, left, step = ready, edges, 0
    while ready.limit(1).count() and left.limit(1).count():
        # Edges whose parent has just got its level are paid; a node is ready when its last one is.
        step += 1
        paid = ready.select("conv_id", F.col("call_id").alias("parent"))
        open_ = scratch.table(left.join(paid, ["conv_id", "parent"], "left_anti"), "open")
        touched = left.join(paid, ["conv_id", "parent"], "left_semi").select("conv_id", "call_id").distinct()
        ready = scratch.table(touched.join(open_, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(step)), "level")
        scratch.drop(left)
        out, left = out.union(ready), open_
    return out


def link(spark: SparkSession, calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per call: its result, level, fault and canonical JSON.

    calls: conv_id, call_id, turn, name, arguments (JSON text), needs (array of call_ids); results: conv_id, call_id,
    turn, content; other columns are ignored. Rows with a null conv_id or call_id are left out. Of repeated call_ids in
    a conversation the first turn counts (ties: smallest name and arguments), of repeated results likewise. A need that
    is no call of the conversation or the call itself is not waited for and counted in n_missing; a call on or behind a
    cycle has a null level. A call without a result has null result columns; a result without a call is dropped.
    Returns conv_id, call_id, turn, name, level, n_missing, arguments (canonical; null if malformed), fault,
    result_turn, content, message. An empty table gives no rows.
    """
    scratch = Scratch(spark, "calls")
    key = ["conv_id", "call_id"]
    named = lambda df: df.where("conv_id is not null and call_id is not null")
    first = named(calls).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "needs")).alias("c")).select(*key, "c.*")
    first = scratch.table(first, "calls")
    answers = named(results).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r")).select(*key, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"))
    wanted = first.select(*key, F.explode(F.array_distinct("needs")).alias("parent"))
    known = wanted.where("parent <> call_id").join(first.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"]).select(*key, "parent")
    known = scratch.table(known, "needs")
    found = known.groupBy(*key).agg(F.count("*").alias("n_known"))
    level, rest = in_order(first, scratch)
    rest = scratch.table(rest, "rest")
    if rest.limit(1).count():
        of_rest = lambda df: df.join(F.broadcast(rest) if rest.count() <= FEW else rest, "conv_id", "left_semi")
        level = level.union(levels(spark, of_rest(first.select(*key)), of_rest(known)))
    parsed = F.try_parse_json("arguments")
    out = first.join(answers, key, "left").join(level, key, "left").join(found, key, "left").withColumn("parsed", parsed)
    out = out.withColumn("fault", argument_error(F.col("name"), F.col("parsed"), schemas))
    canonical = F.when(~F.coalesce(F.col("fault") == "malformed", F.lit(False)), F.to_json("parsed"))
    n_missing = F.coalesce(F.size(F.array_distinct("needs")), F.lit(0)) - F.coalesce("n_known", F.lit(0))
    out = out.select(*key, "turn", "name", "level", F.greatest(n_missing, F.lit(0)).cast("int").alias("n_missing"), canonical.alias("arguments"), "fault", "result_turn", "content")
    quoted = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.substring(F.to_json(F.array(F.col(c))), F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2))
    message = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"result":'), quoted("content"), F.lit("}"))
    return out.withColumn("message", message)
