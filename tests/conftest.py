import os

import duckdb
import pytest
from pyspark.sql import SparkSession

os.environ["TZ"] = "UTC"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def sql(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


def same_rows(spark_rows, columns, sql_rows, sql_columns):
    """Compare two results as bags of rows, columns by name, floats to nine digits."""

    def plain(v):
        if isinstance(v, float):
            return None if v != v else float(f"{v:.9g}")
        if isinstance(v, (bytes, bytearray)):
            return bytes(v).hex()
        if hasattr(v, "tzinfo") and v.tzinfo:
            return v.replace(tzinfo=None)
        if isinstance(v, list):
            return tuple(plain(x) for x in v)
        return v

    def bag(rows, names):
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(repr([plain(r[i]) for i in order]) for r in rows)

    assert sorted(columns) == sorted(sql_columns)
    assert bag(spark_rows, columns) == bag(sql_rows, sql_columns)


@pytest.fixture(scope="session")
def compare(spark, data, sql):
    def run(query, text):
        df = query(spark, data)
        result = sql.execute(text)
        same_rows([tuple(r) for r in df.collect()], df.columns, result.fetchall(), [c[0] for c in result.description])

    return run
