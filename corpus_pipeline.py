"""The corpus pipeline: documents are identified by language, rid of repeated lines and near copies, and packed.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import language_id, line_dedup, near_dedup, packing
from strandline.llm.queries import tokenizer_file
from strandline.llm.shared import documents, free_names, written

#: A document stays if its language is determined with at least this probability.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is determined, with that as their ``lang``; other columns stay as they are.

    Null, empty and letterless texts go. Repeated rows, null ids and null labels are rows like others; without any label
    nothing is learned, and all documents go. An empty table stays one.
    """
    vocabulary = tokenizer_file("piece_bpe_32k.model")
    model = language_id.train(docs, vocabulary)
    lang, score = free_names(docs, "lang", "score")
    found = language_id.identify_rows(docs, model, vocabulary, pred_col=lang, score_col=score)
    kept = found.filter((F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= MIN_SCORE))
    return kept.select(*[F.col(lang).alias(c) if c == "lang" else c for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that occurred before, alike but for two edits, short ones if they are the same; a document of which
    nothing but white space is left goes.

    Null and empty texts have no lines and stay. Rows that repeat an id follow each other by the hash of their texts; rows
    without an id come last. Other columns stay as they are, but ``n_chars`` is counted anew. An empty table stays one.
    """
    kept = line_dedup.drop_repeated_lines(docs, exact_short=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by 0.8 of their five-word shingles, that with the least id.

    Documents without words are linked with nothing and stay, as often as they occur. Of equal rows one stays; a null id comes
    after all others. All columns stay as they are. An empty table stays one.
    """
    return near_dedup.keep_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows of 2048 ids; null and empty texts are their end id, a row is a document whatever its
    id, and an empty table has no windows."""
    packed = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("packing", pack),
]
#: Language models, trees of minwise tokens and byte-level BPE have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
