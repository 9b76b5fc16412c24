import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.codegen.fallback", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


def rows_of(values):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in values)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compares a query with its SQL, columns sorted by name."""

    def check(query, sql):
        df = query(spark, SMALL)
        columns = sorted(df.columns)
        got = rows_of(df.select(*[f"`{c}`" for c in columns]).collect())
        want = rows_of(duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({sql})").fetchall())
        assert got == want

    return check
