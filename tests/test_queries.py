import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from strandline.operators import retrieval  # noqa: E402
from strandline.plans import catalogue  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


#: Of the other modules those that take a few seconds; entry.queries() has all, each with its SQL.
QUICK = ["damaged_beside_pages", "enrichment_totals", "graph_store_edges", "ledger_cumulative", "vector_store_units", "window_meta_conversations", "window_metadata_conversations", "workbooks_customer"]


@pytest.mark.parametrize("name", sorted(catalogue.queries()) + QUICK)
def test_query_equals_its_sql(spark, duck, small, name):
    got = entry.queries()[name](spark, small)
    rows, sql = got.collect(), entry.oracle_sql().get(name)
    assert rows
    if sql is None:
        return
    want = duck.sql(sql)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: KINDS[k] for c, k in got.dtypes} == kinds
    order = sorted(got.columns)
    mine = sorted(repr(tuple(r[c] for c in order)) for r in rows)
    at = [want.columns.index(c) for c in order]
    assert mine == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = set(entry.queries()) - set(entry.llm.queries() if entry.llm else ()) - {"pipeline"}
    assert own - set(entry.oracle_sql()) == {"clean_documents_nfkc", "chunk_pages", "tabular_units_customer", "event_units", "index_search_every_20th"}


def test_every_line_is_in_one_unit(spark, small):
    units = catalogue.paragraph_pack_units(spark, small).groupBy("doc_id").sum("elements").collect()
    lines = {r.doc_id: r.text.count("\n") + 1 for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r.doc_id: r["sum(elements)"] for r in units} == lines


def test_plans_shuffle_by_document_only(spark, small):
    plan = catalogue.section_ids(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_every_query_vector_has_its_best_rows_in_any_block(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    wanted = rows.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")
    whole, parts = ({tuple(r) for r in retrieval.top_k_each(wanted, rows, "vec_id", "embedding", block=b).collect()} for b in (1000, 7))
    assert whole == parts and len(whole) == 5 * wanted.count()
    assert [(r.vec_id, r.score) for r in catalogue.topk_search(spark, small).collect()] == [x[1:3] for x in sorted((r for r in whole if r[0] == 0), key=lambda r: r[3])]
