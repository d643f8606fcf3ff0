"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "StringType()": "VARCHAR",
                 "BooleanType()": "BOOLEAN", "DateType()": "DATE", "DoubleType()": "DOUBLE",
                 "TimestampNTZType()": "TIMESTAMP"}
ORACLES = E.oracle_sql()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in (f.removesuffix(".parquet") for f in sorted(os.listdir(SF)) if f.endswith(".parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return
    rel = duck.sql(ORACLES[name])
    dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    stypes = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    assert stypes == dtypes
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(drows)
    assert _digest(rows, df.columns) == _digest(drows, cols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:8] == ["article_title", "original_url", "archive_url", "has_archive", "error_code",
                              "timestamp", "browser_validation_check", "browser_validation_check_detail"]
    assert df.count() >= 0
