import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from strandline.llm.exact_dedup import exact_duplicates, keep_documents

SCHEMA = "doc_id long, text string, keep_id string"


def brute(rows, best=max):
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[t or ""].append(k)
    return {(k, best(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for k in g}


def found(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()}


def test_nulls_empties_long_texts_and_clashing_columns(spark):
    long = "word " * 50_000
    rows = [(1, None, "x"), (2, "", None), (3, "a", "y"), (4, "a ", "y"), (5, "a", ""), (6, long, ""), (7, long + ".", ""), (8, long, "")]
    out = exact_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert found(out) == brute(rows)
    assert {r.doc_id for r in out.filter("kept").collect()} == {2, 4, 5, 7, 8}


def test_hot_group_is_salted_and_whole(spark):
    rows = [(k, "the same text" if k % 3 else f"text {k}", "") for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(exact_duplicates(df)) == brute(rows)
    assert found(exact_duplicates(df, keep="smallest")) == brute(rows, min)
    assert keep_documents(df).count() == 201


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a", ""), (1, "a", ""), (None, "a", ""), (None, "b", "")]
    out = exact_duplicates(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.keep_id, r.group_size) for r in out if r.doc_id] == [(1, 1, 3), (1, 1, 3)]
    assert sum(r.kept for r in out) == 2  # one of the rows with id 1, and the only "b"


def test_kept_documents_with_nulls_and_repeats(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (None, "a", ""), (None, "b", "z"), (None, "b", "w"), (3, None, None), (2, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id or 0, r.text or "") for r in keep_documents(df).collect()) == [(0, "b"), (1, "a"), (3, "")]
    assert keep_documents(df.filter("false")).count() == 0 and keep_documents(df).columns == df.columns


def test_query_equals_its_sql(spark, small):
    import duckdb

    from strandline.llm import queries

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    got = queries.op4_exact_dedup(spark, small)
    order = sorted(got.columns)
    want = con.sql(queries.oracle_sql()["op4_exact_dedup"])
    at = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_empty_table_and_normalisation(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(none).count() == 0
    rows = [(1, "A", ""), (2, "a", "")]
    assert exact_duplicates(spark.createDataFrame(rows, SCHEMA), normalise=F.lower).filter("kept").count() == 1


def test_content_sort_needs_one_shuffle(spark, small):
    plan = exact_duplicates(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Python" not in plan


def test_clashing_names_of_helpers(spark):
    from pyspark.sql import functions as F
    from strandline.llm.exact_dedup import keep_documents

    names = ("__id", "__sha", "__stays", "__copies", "__first", "h", "body", "kept")
    df = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (None, "y")], "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in names])
    out = keep_documents(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0) for r in out.collect()) == [0, 2] and all(r[c] == c for r in out.collect() for c in names)
