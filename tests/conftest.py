import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
# Python workers of the test session find the library as the tests do
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    """A value as text, so that rows of both engines compare."""
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 8) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(normal, value)) + "]"
    return str(value)


@pytest.fixture(scope="session")
def agrees(spark):
    """Checks a query against its SQL in DuckDB over the smallest tables."""
    import duckdb

    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()

    def check(name: str) -> None:
        df = known[name](spark, folder)
        columns = sorted(df.columns)
        got = sorted("|".join(normal(r[c]) for c in columns) for r in df.collect())
        cursor = db.execute(sql[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted("|".join(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
        assert got == want

    return check
