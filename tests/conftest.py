import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import open_session

    s = open_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def compare(spark, sf):
    """Holds a query against its SQL: column names, row count and values, in any order."""
    import decimal

    import duckdb

    def plain(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        return 0.0 if isinstance(v, float) and v == 0 else v

    def check(query, sql):
        con = duckdb.connect()
        for name in os.listdir(sf):
            con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
        rel = con.execute(sql)
        names = [c[0] for c in rel.description]
        theirs = rel.fetchall()
        df = query(spark, sf)
        ours = [tuple(r) for r in df.collect()]
        order = sorted(names)
        assert sorted(df.columns) == order
        rows = lambda rs, cs: sorted((tuple(plain(r[cs.index(c)]) for c in order) for r in rs), key=repr)
        assert rows(ours, df.columns) == rows(theirs, names)

    return check
