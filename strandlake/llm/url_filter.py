"""URL filters: dated list entries as validity intervals, and an as-of join of captures.

Only DataFrame functions. Captures are first reduced to their distinct (host, first path segment, day); each of those
meets the intervals of its few patterns, held in one row a pattern, and the verdicts are joined back on all three columns.
Patterns that many sites ask for (a shared parent domain, a hot host) and sites with many captures are few by
definition; they are broadcast (``spread_join``), so no task gets their rows together. Captures without a host or a day
take part in no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, spread_join


def url_host(url: Column) -> Column:
    """Lower-cased host of a URL without user and port; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def url_segment(url: Column) -> Column:
    """First path segment of a URL, empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (pattern, valid_from, valid_to) of dated entries (pattern, day, active).

    A pattern is active from an entry that says so until its next entry; entries of the same day count as active if one
    is. valid_to is null while nothing follows. Rows with nulls are ignored.
    """
    daily = entries.where("pattern is not null and day is not null and active is not null").groupBy("pattern", "day").agg(F.max("active").alias("active"))
    following = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return daily.withColumn("valid_to", following).where("active").select("pattern", F.col("day").alias("valid_from"), "valid_to")


def patterns(host: Column, segment: Column) -> Column:
    """Patterns a capture can match: its host, every parent domain of two labels and more, host/segment."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(parents, F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))))


def evaluate(spark: SparkSession, captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All captures with the list's verdict at their fetch day.

    captures: url string, day date, and any other columns, which are kept; entries: pattern string, day date, active
    boolean. Adds blocked, n_matches, pattern (the longest active one, ties: smallest) and listed_from. A capture with
    a null day, or a null or unreadable url, is not blocked. Repeated captures each keep their row; empty tables are
    allowed on both sides. Columns named like the added ones are replaced.
    """
    host, segment, day = "_host", "_segment", "_day"
    site, scratch, partitions = [host, segment, day], Scratch(spark, "lists"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = captures.drop("blocked", "n_matches", "pattern", "listed_from")
    rows = rows.withColumn(host, url_host(F.col("url"))).withColumn(segment, url_segment(F.col("url"))).withColumn(day, F.col("day"))
    placed = rows.where(f"{host} is not null and {day} is not null")
    sites = scratch.table(placed.groupBy(*site).agg(F.count("*").alias("_captures")), "sites")
    asked = scratch.table(sites.select(*site, "_captures", F.explode(patterns(F.col(host), F.col(segment))).alias("pattern")), "asked")
    # A pattern's intervals are disjoint and at most one a day, so one row holds them and at most one is active.
    listed = intervals(entries).groupBy("pattern").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("_spans"))
    lookup = scratch.table(listed.join(asked.groupBy("pattern").agg(F.count("*").alias("_asked")), "pattern"), "lookup")
    active = F.filter("_spans", lambda s: (s["valid_from"] <= F.col(day)) & (s["valid_to"].isNull() | (F.col(day) < s["valid_to"])))
    met = spread_join(asked, lookup, ["pattern"], "_asked", partitions).withColumn("_active", active).where(F.size("_active") > 0)
    longest = F.min(F.struct((-F.length("pattern")).alias("l"), "pattern", F.col("_active")[0]["valid_from"].alias("valid_from")))
    verdicts = scratch.table(met.groupBy(*site, "_captures").agg(F.count("*").alias("n_matches"), longest.alias("_best")), "verdicts")
    out = spread_join(placed, verdicts, site, "_captures", partitions, "left")
    out = out.unionByName(rows.where(f"{host} is null or {day} is null"), allowMissingColumns=True)
    return out.withColumns({"blocked": F.col("n_matches").isNotNull(), "n_matches": F.coalesce("n_matches", F.lit(0).cast("long")), "pattern": F.col("_best.pattern"), "listed_from": F.col("_best.valid_from")}).drop(host, segment, day, "_best")
