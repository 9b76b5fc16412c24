"""Tables written between steps, in the folder that all machines share; a manifest lets a finished stage be skipped."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset (one process, as in tests), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    # With its scheme, as readers outside Spark need it.
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().replace("file:/", "file:///", 1).replace("file:////", "file:///").rstrip("/")


class Stages:
    """Stages under one folder. With ``folder`` given they outlive the run: a stage with the same parameters is read
    again instead of run again."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark, self.lasting = spark, folder is not None
        self.root = folder or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again."""
        self.count += 1
        at = f"{self.root}/{self.count:03d}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def folders(self, df: DataFrame, name: str, by: str) -> str:
        """Where ``df`` is written, a folder for each value of ``by``, for tasks that read some of them themselves."""
        self.count += 1
        at = f"{self.root}/{self.count:03d}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(at)
        return at

    def stage(self, name: str, make, **parameters) -> DataFrame:
        """The table of a named stage: read if it is there with the same parameters, else made and written."""
        mark = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
        at = f"{self.root}/{name}-{mark}"
        done, files = self._path(f"{at}/_SUCCESS")
        if not (self.lasting and files.exists(done)):
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def remove(self) -> None:
        path, files = self._path(self.root)
        files.delete(path, True)
