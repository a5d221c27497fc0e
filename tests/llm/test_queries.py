import glob
import os

import duckdb
import pytest

from tidewords.llm import queries

COLUMNS = {
    "p1_found": "tbl:string,row_key:string", "p3_found": "tbl:string,row_key:string,lang:string", "p4_found": "tbl:string,row_key:string",
    "p5_found": "source_id:string,pos:int", "p6_found": "source_a:string,source_b:string", "p7_found": "tbl:string,row_key:string",
    "p8_ids": "doc_id:bigint,ids:array<int>", "p9_found": "doc_id:bigint,item_id:bigint", "p10_found": "doc_id:bigint,level:int",
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs_with_its_columns(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.count()
    assert rows > 0
    if name in COLUMNS:
        assert ",".join(f"{c}:{k}" for c, k in df.dtypes) == COLUMNS[name]
        assert df.distinct().count() == rows


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql_agrees(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    got = {tuple(r) for r in queries.QUERIES[name](spark, data).collect()}
    assert got == set(con.execute(queries.SQL[name]).fetchall())
