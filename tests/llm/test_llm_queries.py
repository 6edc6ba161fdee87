import pytest

from tallyloom.llm import queries as L


@pytest.mark.parametrize("name", sorted(L.QUERIES))
def test_query_runs(spark, small_dir, name):
    df = L.QUERIES[name](spark, small_dir)
    rows = df.collect()
    assert df.columns
    if name in L.SQL:
        import glob
        import os

        import duckdb

        con = duckdb.connect()
        for path in glob.glob(f"{small_dir}/*.parquet"):
            con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        want = con.sql(L.SQL[name])
        assert sorted(tuple(map(str, r)) for r in rows) == sorted(tuple(map(str, r)) for r in want.fetchall())


FORMS = {"p1_found": ["chunk_id", "evidence_id"], "p3_found": ["conversation_id"], "p4_found": ["built_id"], "p6_found": ["record_id", "defect"], "p8_found": ["item_id", "doc_id"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(FORMS))
def test_found_has_the_columns_asked_for(spark, small_dir, name):
    assert sorted(L.QUERIES[name](spark, small_dir).columns) == sorted(FORMS[name])
