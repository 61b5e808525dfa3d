"""Every named query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if v.__class__.__name__ == "Decimal":
        return round(float(v), 5)
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert a == b or isinstance(a, (int, float)) and a == pytest.approx(b, abs=2e-5), (g, w)


def test_quality_report_at_ties(spark, duck, tmp_path):
    """Scores and changes in the middle of two decimals are rounded as the SQL rounds them (71.25: 71.2; -31.25: -31.2)."""
    lines = [(1, k, "R" if k < 5 else "A", "O") for k in range(16)]  # 11 of 16 lines are left
    lines += [(2, 4 * k, "R" if k < 3 else "A", "O") for k in range(8)] + [(3, 1, "R" if k < 1 else "N", "F") for k in range(16)]
    cols = "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(o, n, flag, status) for o, n, flag, status in lines], cols).selectExpr("*", "1L as l_partkey", "1L as l_suppkey").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    own = duckdb.connect()
    own.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = {r["doc_id"]: r["report"] for r in registry.queries()["quality_report"](spark, str(tmp_path)).collect()}
    want = dict(own.execute("select doc_id, report from (" + registry.oracle_sql()["quality_report"] + ")").fetchall())
    assert got == want and len(want) == 3
