"""The opN queries: against their SQL where there is one, else their contract's columns."""

import duckdb
import pytest

import __spark_entry__ as E
from remuneria.llm import catalogue
from test_oracle import canon

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "labels", "pages")
COLUMNS = {
    "op1": "doc_id held_out n_tokens n_known train_tokens base_score score", "op2": "page_id host path rule verdict",
    "op3": "doc_id text n_lines n_removed removed", "op4": "doc_id held_out lang_pred score",
    "op5": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op6": "doc_id n_words n_hit n_items items_sha256 contaminated", "op7": "doc_id held_out score predicted",
    "op8": "doc_id domain lang source n_tokens copies tokens", "op9": "doc_id n_shingles component_id",
    "op10": "doc_id keep_id group_size kept text_sha256", "op11": "word form root n n_near form_n",
    "op12": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_all_registered():
    assert {q.split("_")[0] for q in catalogue.QUERIES} == set(COLUMNS)
    assert set(catalogue.QUERIES) <= set(E.queries()) and "pipeline" in E.queries()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = E.queries()[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    rows = [tuple(r) for r in df.collect()]
    if name in catalogue.ORACLE:
        rel = duck.sql(catalogue.ORACLE[name])
        assert canon(df.columns, rows) == canon(rel.columns, rel.fetchall())
    elif name.startswith("op2"):
        assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    else:
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
