"""Every registered reference query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from kinspark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def value(x):
        try:
            return repr(round(float(x), 5) + 0.0) if not isinstance(x, (str, bool)) else str(x)
        except (TypeError, ValueError):
            return str(getattr(x, "replace", lambda **_: x)(tzinfo=None)) if hasattr(x, "tzinfo") else str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.ORACLE_SQL.get(name)
    if sql is None:
        assert df.columns
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(found.fetchall(), names)
