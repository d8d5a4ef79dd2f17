import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from sparkloom.session import SETTINGS

    builder = SparkSession.builder.master("local[4]").appName("tests")
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows and columns on the small tables."""

    def check(query, sql):
        df = query(spark, SMALL)
        names = sorted(df.columns)
        answer = duck.execute(sql)
        order = [x[0] for x in answer.description]
        assert sorted(order) == names
        key = lambda rows: sorted(rows, key=repr)
        ours = key([tuple(row[c] for c in names) for row in df.collect()])
        theirs = key([tuple(row[order.index(c)] for c in names) for row in answer.fetchall()])
        assert ours == theirs

    return check
