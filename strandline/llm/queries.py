"""The queries over whole tables that apply the operators of this folder, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import ball_tree, html_text, language_id, line_dedup, near_dedup, packing, pieces, sharding, spelling, substring_dedup, tiff, warc
from strandline.llm.exact_dedup import exact_duplicates
from strandline.llm.shared import documents, fresh_path, pages


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to the ids of a 32,000-piece vocabulary and back."""
    model = tokenizer_file("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(documents(spark, sf_dir), model), model)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "score", F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"), F.length("text").cast("long").alias("decoded_chars"))


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, hashed over 32 old shards, put into 40 of equal bytes with the fewest bytes moved: the shards that change are
    written and read back, what stays where it is comes from the plan."""
    docs, path = documents(spark, sf_dir), fresh_path(spark, "resharded")
    placement = sharding.place(docs, new_shards=40, old_shards=32)
    sharding.write_shards(docs, placement, path, old_shards=32)
    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    size = (F.octet_length(body) + sharding.OVERHEAD).cast("long")
    files = sharding.read_shards(docs, path).select("doc_id", size.alias("size"), F.crc32(body).alias("text_crc32"), "shard", "slot")
    kept = sharding.slots(placement).join(F.broadcast(sharding.affected_shards(placement.parts)), "shard", "left_anti")  # as few rows as shards
    rows = files.union(kept.select("doc_id", "size", "text_crc32", "shard", "slot"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose labels are not held out."""
    docs, vocabulary = documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model")
    held = language_id.held_out()
    model = language_id.train(docs.filter(~held), vocabulary)
    return language_id.identify(docs, model, vocabulary).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="largest")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as TIFF files and read back."""
    found = tiff.round_trip(documents(spark, sf_dir))
    tail = F.crc32(F.expr("substring(payload, -16, 16)"))
    return found.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", "feature")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of archives, and the archives read back."""
    files = warc.write_archives(warc.plan_records(pages(spark, sf_dir), min_bytes=1000), warc.archive_folder(spark))
    records = warc.read_archives(spark, files).filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "intact")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids in windows of 2048."""
    packed = packing.pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents that occurred before, alike but for two edits."""
    return _repeated_lines(documents(spark, sf_dir))


def op9_line_dedup_short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_line_dedup, and lines of less than 20 characters that are the same as one before."""
    return _repeated_lines(documents(spark, sf_dir), exact_short=True)


def _repeated_lines(docs: DataFrame, **options) -> DataFrame:
    gone = line_dedup.repeated_lines(docs, max_edits=2, min_chars=20, **options)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    rows = docs.select("doc_id", lines.alias("n_lines")).join(gone.withColumnRenamed("doc_id", "of"), F.expr("doc_id <=> of"), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), F.array_join(dropped.cast("array<string>"), ",").alias("dropped"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(pages(spark, sf_dir))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors in 16 clusters after three rounds."""
    return ball_tree.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _clusters_sql(clusters: int = 16, rounds: int = 3) -> str:
    """The rounds as chained subqueries over (vector, component)."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
            d{k} AS (SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{k} c USING (i) GROUP BY v.vec_id, c.c),
            a{k} AS (SELECT vec_id, d, c FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if k < rounds:
            steps.append(f"""
            s{k} AS (SELECT a.c, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} a JOIN v USING (vec_id) GROUP BY a.c, v.i),
            c{k + 1} AS (SELECT c.c, c.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.x)::BIGINT AS x FROM c{k} c LEFT JOIN s{k} s ON s.c = c.c AND s.i = c.i)""")
    return f"""
        WITH k AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS (SELECT vec_id, i, floor(64 * embedding[i]::DOUBLE)::BIGINT AS x FROM k, range(1, 65) t(i)),
        f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM k QUALIFY c < {clusters}),
        c0 AS (SELECT f.c, v.i, v.x FROM f JOIN v USING (vec_id)), {",".join(steps)},
        h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha AS centroid_sha256
        FROM a{rounds} JOIN h USING (c)"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(documents(spark, sf_dir))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents that repeated passages of 20 words take."""
    return substring_dedup.repeated_passages(documents(spark, sf_dir), window=20)


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_resharding, op3_language_id, op4_exact_dedup, op5_minhash_near_dedup, op6_tiff, op7_warc, op8_packing, op9_line_dedup, op9_line_dedup_short_lines, op10_html_text, op11_ball_tree, op12_spelling_variants, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op11_ball_tree": _clusters_sql(),
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op7_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
            g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
            SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to, true AS intact FROM g""",
        "op9_line_dedup": """
            WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
            o AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS no FROM l),
            f AS (SELECT line, length(line) AS n, min(doc_id * 2147483648::HUGEINT + no) AS first FROM o WHERE length(line) >= 20 GROUP BY line),
            near AS (SELECT DISTINCT a.line FROM f a JOIN f b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND b.first < a.first AND a.line <> b.line AND levenshtein(a.line, b.line) <= 2),
            gone AS (SELECT o.doc_id, o.no FROM o JOIN f USING (line) WHERE f.first <> o.doc_id * 2147483648::HUGEINT + o.no OR o.line IN (SELECT line FROM near))
            SELECT l.doc_id, len(parts) AS n_lines, count(gone.no) AS n_dropped, coalesce(string_agg(gone.no::VARCHAR, ',' ORDER BY gone.no), '') AS dropped
            FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id GROUP BY l.doc_id, parts""",
        "op9_line_dedup_short_lines": r"""
            WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
            o AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS no FROM l),
            f AS (SELECT line, length(line) AS n, min(doc_id * 2147483648::HUGEINT + no) AS first FROM o WHERE length(line) >= 20 OR regexp_matches(line, '[^\s\x0B]') GROUP BY line),
            near AS (SELECT DISTINCT a.line FROM f a JOIN f b ON a.n >= 20 AND b.n >= 20 AND b.n BETWEEN a.n - 2 AND a.n + 2 AND b.first < a.first AND a.line <> b.line AND levenshtein(a.line, b.line) <= 2),
            gone AS (SELECT o.doc_id, o.no FROM o JOIN f USING (line) WHERE f.first <> o.doc_id * 2147483648::HUGEINT + o.no OR o.line IN (SELECT line FROM near))
            SELECT l.doc_id, len(parts) AS n_lines, count(gone.no) AS n_dropped, coalesce(string_agg(gone.no::VARCHAR, ',' ORDER BY gone.no), '') AS dropped
            FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id GROUP BY l.doc_id, parts""",
    }
