import math
import os

import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    yield s
    s.stop()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a query with its SQL twin; gives the rows."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")

    def check(query, sql):
        df, twin = query(spark, DATA), con.sql(sql)
        assert sorted(df.columns) == sorted(twin.columns)
        at = [twin.columns.index(c) for c in sorted(twin.columns)]
        got = sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
        assert got == sorted((tuple(_plain(r[i]) for i in at) for r in twin.fetchall()), key=repr)
        return got

    return check
