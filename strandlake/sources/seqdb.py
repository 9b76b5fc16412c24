"""A read database: reads by volume in Parquet, with dense ids, coded bases and the runs of codes that are no base.

``reads`` is partitioned by volume, so a scan of some volumes opens their files alone, whether the volumes are known
when the plan is made (partition filters) or come from a join (dynamic partition pruning). Bits are Parquet's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reads import volume_of_reads


def build(spark: SparkSession, reads: DataFrame, folder: str, most_bases: int, most_reads: int, least: int = 0) -> None:
    """Writes reads (read_id, seq; other columns stay) of at least ``least`` bases to ``folder``.

    id is dense from 0 in the order of read_id. A volume closes when it has reached ``most_bases`` or ``most_reads``. All
    codes other than A, C, G and T are A in ``reads``; ``ambiguous`` has their runs (id, volume, start, size, code).
    A null sequence is left out.
    """
    sized = reads.withColumn("len", F.length("seq")).where(F.col("len") >= max(least, 0))
    at = volume_of_reads(spark, sized.select("read_id", "len"), most_bases, most_reads)
    rows = sized.join(at, "read_id").withColumnRenamed("place", "id")
    plain = rows.withColumn("seq", F.regexp_replace(F.upper("seq"), "[^ACGT]", "A"))
    # A volume's rows come from few tasks, so a volume has few files; a volume is bounded, so no task is large.
    plain.repartition("volume").sortWithinPartitions("volume", "id").write.mode("overwrite").partitionBy("volume").parquet(f"{folder}/reads")
    pieces = F.regexp_extract_all(F.upper("seq"), F.lit(r"[ACGT]+|([^ACGT])\1*"), F.lit(0))
    each = rows.where(F.upper("seq").rlike("[^ACGT]")).select("id", "volume", F.posexplode(pieces).alias("nth", "piece")).select("id", "volume", "nth", F.length("piece").alias("size"), F.substring("piece", 1, 1).alias("code"))
    start = F.sum("size").over(Window.partitionBy("id").orderBy("nth")) - F.col("size")  # of one read's pieces
    runs = each.withColumn("start", start.cast("int")).where(~F.col("code").isin("A", "C", "G", "T")).select("id", "volume", "start", "size", "code")
    runs.write.mode("overwrite").parquet(f"{folder}/ambiguous")


def scan(spark: SparkSession, folder: str, volumes: list[int] | DataFrame | None = None) -> DataFrame:
    """Reads of the database, or of the named volumes: a list of numbers, or a DataFrame with a column volume."""
    rows = spark.read.parquet(f"{folder}/reads")
    if volumes is None:
        return rows
    if isinstance(volumes, list):
        return rows.where(F.col("volume").isin(volumes))
    return rows.join(volumes.select("volume").distinct(), "volume", "left_semi")


def restored(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """``rows`` of a scan with the original codes back in place."""
    runs = spark.read.parquet(f"{folder}/ambiguous").join(rows.select("id"), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "size", "code"))).alias("runs"))
    put = lambda seq, r: F.concat(F.substring(seq, F.lit(1), r["start"]), F.repeat(r["code"], r["size"]), F.substring(seq, r["start"] + r["size"] + 1, F.length(seq)))
    return rows.join(runs, "id", "left").withColumn("seq", F.when(F.col("runs").isNull(), F.col("seq")).otherwise(F.aggregate("runs", F.col("seq"), put))).drop("runs")
