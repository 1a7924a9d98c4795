"""The queries that have SQL against DuckDB on a small scale factor, and all others for their contract's columns."""

import glob
import os

import pytest

queries = pytest.importorskip("mergeloom.llm.queries")
SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    got = con.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in got.description)
    assert sorted(df.columns) == columns
    want = got.fetchdf()[columns].sort_values(columns).reset_index(drop=True)
    rows = df.select(*columns).toPandas().sort_values(columns).reset_index(drop=True)
    assert rows.astype(object).where(rows.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


COLUMNS = {
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    kinds = dict(queries.queries()[name](spark, "/root/testdata/sf0.001").dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
