"""Every query of the library against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from folioscope.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "customer"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows(names, table):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in sorted(names))]) for r in table)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    found = df.collect()
    assert found
    if name in catalog.oracle_sql():
        wanted = duck.sql(catalog.oracle_sql()[name])
        assert sorted(df.columns) == sorted(wanted.columns)
        assert rows(df.columns, found) == rows(df.columns, [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()])


def test_stream(spark, tmp_path):
    from folioscope.streaming.census import watch

    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, 0, "text", "Fig. 1. x", 0, None), (1, 1, "text", "as Fig. 2 says", 0, None)], "doc_id bigint, pos int, kind string, text string, level int, media string").write.parquet(source)
    watch(spark, source, target, f"{tmp_path}/cp").awaitTermination(120)
    assert [(r.captions, r.referenced, len(r.problems)) for r in spark.read.parquet(target).collect()] == [([1], [1, 2], 1)]
