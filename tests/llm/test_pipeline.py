

import corpus_pipeline
from strandline.llm.shared import written


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = [(9001, "12 34 ...", "en", "s", 9), (9002, docs.filter("doc_id = 3").first().text, "en", "s", 1), (9003, None, "de", "s", 0)]
    now = docs.union(spark.createDataFrame(extra, docs.schema))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, small), name)
        assert now.columns == docs.columns
        seen.append({r.doc_id for r in now.collect()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "packing"]
    assert 9001 not in seen[0] and 9003 not in seen[0] and 9002 in seen[0] and 9002 not in seen[1]
    assert len(seen[2]) <= len(seen[1]) and 3 in seen[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, small).collect()
    assert {r.doc_id for r in pieces} == seen[2]


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.count() > 0
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_handle_odd_rows(spark, small):
    """Nulls in any column, repeated rows, empty tables, columns with the names that operators use."""
    text = " ".join(f"the word number {k} and of the house" for k in range(12))
    rows = [(1, text, "en", "a", 1, "x", 0.5), (1, text, "en", "a", 1, "x", 0.5), (None, text + " more", None, None, None, None, None), (3, None, "en", "a", 0, "y", 1.0), (4, "", "de", "a", 0, "z", 2.0), (5, "der hund und die katze sind im haus", "de", None, 3, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")
    none = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.count() > 0 and stage(spark, none, small).count() == 0, name
        assert all(r.score in (0.5, None, 1.0, 2.0) for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, none, small).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= len(rows)
    near = corpus_pipeline.drop_near_copies(spark, docs, small).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near) == [(1, text), (3, ""), (4, ""), (5, rows[5][1])]


def test_run_equals_its_stages_by_brute_force(spark, small):
    """The stages over plain Python: what stays after lines and near copies is what is packed, id by id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_file("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small), name)
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for r in corpus_pipeline.run(spark, small).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want


def test_clashing_names_of_the_language_stage(spark):
    docs = spark.createDataFrame([(1, "the and of the house is here", "en", "a", 0.5), (2, "der und das haus ist hier", "de", "b", 0.1)], "doc_id long, text string, lang string, __lang string, __score double")
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns
    assert {(r.doc_id, r["__lang"], r["__score"]) for r in out.collect()} <= {(1, "a", 0.5), (2, "b", 0.1)}
