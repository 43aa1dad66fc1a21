"""The queries over whole tables, by name; their SQL is in ``oracle``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import cleaning
from strandline.functions.text import norm
from strandline.operators import boundary, graph, profile, quality, retrieval, tables, turns, usage, video
from strandline.plans import chunking, driver
from strandline.sources import elements as sources
from strandline.stored import stored

#: The tables' text is clean; these endings give the rules something to do. The expression is the same in both dialects.
DEBRIS = """concat(text, CASE doc_id % 6
  WHEN 0 THEN ' , see Table 1 .' WHEN 1 THEN ' 【 58†L23-L31 】 done' WHEN 2 THEN concat(' inges-', chr(10), 'tion ....... x')
  WHEN 3 THEN concat('​ ( a ) ', chr(10), chr(10), chr(10), chr(10), 'b •  ') WHEN 4 THEN ' 【12 L3】【 open' ELSE ' ﬁne ﬂow z   end  ' END)"""
ASKING = "CASE WHEN turn % 2 = 0 THEN concat(text, ' ?') ELSE text END"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, d):
    return sources.from_lines(_read(spark, d, "documents"))


def _hosts(spark, d):
    return sources.from_pages(_read(spark, d, "pages"))


def _speech(spark, d, asking: bool = False):
    rows = _read(spark, d, "conversations")
    return sources.from_conversations(rows.withColumn("text", F.expr(ASKING)) if asking else rows)


def _seconds(segments):
    return segments.withColumns({"t0": F.col("t0_ms") / 1000, "t1": F.col("t1_ms") / 1000})


def token_counts(spark, d):
    from strandline.functions.text import count_tokens

    return _read(spark, d, "documents").select("doc_id", count_tokens(F.col("text")).cast("long").alias("n_tokens"))


def normalize_probe(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(norm(F.col("text"))).alias("digest"))


def _cleaned(spark, d, normalise=False):
    return cleaning.clean(_read(spark, d, "documents").select("doc_id", F.expr(DEBRIS).alias("text")), normalise=normalise)


def clean_documents(spark, d):
    total = F.aggregate(F.map_values("fixes"), F.lit(0).cast("long"), lambda a, x: a + x)
    return _cleaned(spark, d).select("doc_id", F.md5("text").alias("digest"), total.alias("n_fixes"))


def cleaning_report(spark, d):
    return cleaning.report(_cleaned(spark, d))


def clean_documents_nfkc(spark, d):
    """With compatibility normalisation first, which SQL has no function for."""
    return _cleaned(spark, d, True).select("doc_id", F.md5("text").alias("digest"), F.to_json("fixes").alias("fixes"))


def doc_profile(spark, d):
    p = profile.profile(_lines(spark, d))
    return p.select("doc_id", "element_count", "text_count", "heading_count", "total_tokens", "prose_tokens", "is_tabular", "heading_density")


def route_documents(spark, d):
    routed = profile.route(profile.profile(_hosts(spark, d)))
    return routed.select("doc_id", "element_count", "text_count", "heading_count", "total_tokens", "heading_density", "route")


def anaphora_rate(spark, d):
    own = profile.sentences(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.size(own).cast("long").alias("sentences"), F.round(profile.anaphora_rate(F.col("text")), 6).alias("rate"))


def escalation_flags(spark, d):
    rate = profile.anaphora_rate(F.col("text"))
    path = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    flags = profile.escalation_flags(rate, path, F.lit("structural"), F.when(F.col("doc_id") % 3 == 0, "table").otherwise("text"), F.lit(False))
    has = lambda start: F.exists("flags", lambda f: f.startswith(start))
    return _read(spark, d, "documents").withColumn("flags", flags).select("doc_id", F.size("flags").cast("long").alias("n_flags"), has("anaphora").alias("leans"), has("orphan").alias("orphan"), has("uncaptioned").alias("bare"))


def fixed_chunks_512_64(spark, d):
    rows = retrieval.fixed_windows(_read(spark, d, "documents"))
    return rows.select("doc_id", F.col("window").cast("long").alias("window"), F.col("start").cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("content").alias("digest"))


def section_ids(spark, d):
    rows = chunking.sections(_hosts(spark, d))
    return rows.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("elements"), F.sum("n_tokens").alias("n_tokens"), F.min("pos").cast("long").alias("first_pos"))


def heading_path(spark, d):
    rows = graph.heading_paths(_hosts(spark, d))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("heading_path", " > ").alias("path"), F.col("parent_pos").cast("long").alias("parent_pos"))


def surrounding_text(spark, d):
    rows = graph.surrounding_text(_hosts(spark, d))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce("leading", F.lit("")).alias("leading"), F.coalesce("trailing", F.lit("")).alias("trailing"))


def _long_ends(edges):
    return edges.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")})


def reading_order_edges(spark, d):
    return _long_ends(graph.next_edges(_lines(spark, d)))


def qa_edges(spark, d):
    return _long_ends(graph.question_edges(_speech(spark, d, True)))


def _resolved(spark, d):
    speech = _speech(spark, d, True)
    return graph.resolve(graph.next_edges(speech).union(graph.question_edges(speech)))


def edge_conflicts(spark, d):
    return _long_ends(_resolved(spark, d))


def relationship_loss(spark, d):
    rows = graph.relationship_loss(_resolved(spark, d)).filter("loss > 0")
    return rows.select("doc_id", F.col("cut").cast("long").alias("cut"), "loss")


def _with_tables(spark, d):
    """Lines of documents as elements, every fourth one a table, the others with a reference to one."""
    rows = _lines(spark, d)
    text = F.when(F.col("pos") % 4 == 1, F.col("text")).otherwise(F.concat("text", F.lit(" see Table "), (1 + F.col("pos") % 3).cast("string")))
    return rows.withColumns({"kind": F.when(F.col("pos") % 4 == 1, "table").otherwise("paragraph"), "text": text})


def references_resolve(spark, d):
    rows = _with_tables(spark, d)
    none = graph.next_edges(rows).filter("false")
    return _long_ends(graph.reference_edges(rows, none))


def explaining_edges(spark, d):
    return _long_ends(graph.explaining_edges(_with_tables(spark, d)))


def speaker_turns(spark, d):
    rows = turns.speaker_runs(_seconds(_speech(spark, d)))
    units = turns.turn_units(rows, ["turn"])
    return units.select("doc_id", "turn", F.md5("content").alias("digest"), "start_s", "end_s", "speaker", "segments", "n_tokens")


def micro_turn_merge(spark, d):
    rows = _seconds(_speech(spark, d)).withColumn("speaker", F.when(F.col("pos") % 3 != 0, F.col("speaker")))
    merged = turns.absorb_short(turns.speaker_runs(rows), short=20.0)
    return merged.groupBy("doc_id", "turn").agg(F.count(F.lit(1)).alias("segments"), F.min("pos").cast("long").alias("first_pos"))


def long_turn_split(spark, d):
    rows = turns.split_long(_seconds(_speech(spark, d)).withColumn("turn", F.lit(0).cast("long")), long=40.0)
    return rows.select("doc_id", "turn", F.col("pos").cast("long").alias("pos"), "part")


def conversational_type(spark, d):
    return turns.conversational_type(_speech(spark, d, True)).select("doc_id", "speakers", "turns", "type")


def _column_profile(name):
    def query(spark, d):
        return tables.profile_columns(tables.unpivot(_read(spark, d, name)))

    query.__name__ = f"column_profile_{name}"
    return query


HEADER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def row_groups_customer(spark, d):
    """The customers of a nation as a sheet of rows, in groups of at most 300 tokens."""
    rows = sources.cells_of(_read(spark, d, "customer"), "c_nationkey", ["c_custkey"])
    groups = tables.row_groups(rows, HEADER, 300)
    units = tables.group_units(rows, HEADER, groups)
    return units.select("sheet", F.col("group").cast("long").alias("grp"), F.col("rows").cast("long").alias("n_rows"), F.col("first_row").cast("long").alias("first_row"), F.col("last_row").cast("long").alias("last_row"), F.md5("content").alias("digest"))


def schema_card_orders(spark, d):
    return tables.describe(tables.profile_columns(tables.unpivot(_read(spark, d, "orders")))).select("name", "dtype", "line")


def _events(spark, d):
    """A user's events as a document: views as pictures, others as speech, each for an hour."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t0 = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return _read(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.row_number().over(order) - 1).alias("pos"), F.when(F.col("event_id") % 3 == 0, "visual_event").otherwise("speech_segment").alias("kind"), t0.alias("t0"), (t0 + 3600).alias("t1"))


def overlap_edges(spark, d):
    rows = _events(spark, d)
    found = graph.overlap_edges(rows.filter("kind = 'speech_segment'"), rows.filter("kind = 'visual_event'"), bucket=3600.0)
    return _long_ends(found).select("doc_id", "src", "dst", "type", "confidence")


def fusion_confidence(spark, d):
    rows = _events(spark, d)
    own = rows.groupBy("doc_id").agg(*[f(F.when(F.col("kind") == k, F.col(t))).alias(n) for n, f, k, t in (("s0", F.min, "speech_segment", "t0"), ("s1", F.max, "speech_segment", "t1"), ("v0", F.min, "visual_event", "t0"), ("v1", F.max, "visual_event", "t1"))])
    none = F.array().cast("array<string>")
    score = video.fusion(F.col("s0"), F.col("s1"), F.col("v0"), F.col("v1"), none, none)
    return own.select("doc_id", F.round(score, 6).alias("score"), video.fusion_label(score).alias("label"))


def semantic_drift_groups(spark, d):
    rows = _read(spark, d, "embeddings").withColumn("doc_id", F.floor(F.col("vec_id") / 25))
    found = retrieval.semantic_groups(rows, "doc_id", "vec_id", "embedding")
    return found.groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


def semantic_shifts(spark, d):
    """Vectors as the speech of documents of 25 segments."""
    rows = _read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 25).alias("doc_id"), F.col("vec_id").alias("pos"), F.lit("speech_segment").alias("kind"), F.lit("said").alias("text"), "embedding")
    return video.semantic_shifts(rows).withColumn("semantic_shift", F.round("semantic_shift", 2))


def topk_search(spark, d):
    rows = _read(spark, d, "embeddings")
    query = rows.filter("vec_id = 0").first()
    return retrieval.top_k(rows, [float(x) for x in query.embedding], "vec_id", "embedding")


def topk_search_every_20th(spark, d):
    """Every 20th vector as a query against all of them."""
    rows = _read(spark, d, "embeddings")
    wanted = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.top_k_each(wanted, rows, "vec_id", "embedding").withColumn("rank", F.col("rank").cast("long"))


def retrieval_eval(spark, d):
    """The first lines of every 20th document as probes for the documents."""
    docs = _read(spark, d, "documents")
    probes = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("probe_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("text"))
    units = docs.select(F.col("doc_id").alias("unit_id"), F.col("text").alias("content"))
    return retrieval.overlap_retrieval(probes, units, probes.select("probe_id", F.col("probe_id").alias("unit_id")))


def retrieval_eval_benchmark(spark, d):
    """The whole benchmark texts as probes for the documents that contain them; those of no document have nothing to find."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.col("text").alias("content"))
    probes = _read(spark, d, "benchmark").select(F.col("item_id").alias("probe_id"), "text")
    truth = docs.join(F.broadcast(probes), F.contains("content", "text")).select("probe_id", "unit_id")
    return retrieval.overlap_retrieval(probes, docs, truth)


def _section_units(spark, d):
    rows = chunking.sections(_hosts(spark, d))
    parts = F.sort_array(F.collect_list(F.struct("pos", "kind", "text")))
    units = rows.groupBy("doc_id", F.col("section").alias("unit_id")).agg(parts.alias("e"), F.sum("n_tokens").alias("n_tokens"))
    return units.select("doc_id", "unit_id", F.array_join("e.text", "\n\n").alias("content"), F.when(F.element_at("e.kind", 1) == "heading", "section").otherwise("narrative").alias("unit_type"), F.lit("structural").alias("strategy"), "n_tokens")


def completeness(spark, d):
    kind = F.when(F.col("unit_id") % 5 == 0, "row_group").when(F.col("unit_id") % 5 == 1, "table").otherwise("section")
    odd = F.col("unit_id") % 2 == 1
    text = F.when(F.col("unit_id") % 3 == 0, F.concat("content", F.lit(" as shown above"))).otherwise(F.col("content"))
    units = _section_units(spark, d).select("doc_id", "unit_id", text.alias("content"), F.lit("document").alias("modality"), kind.alias("element_kind"), F.when(F.col("unit_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("unit_type")).alias("heading_path"), odd.alias("has_schema"), F.lit(True).alias("has_columns"), odd.alias("has_caption"), (F.col("unit_id") % 7 == 0).alias("has_context"), F.lit(False).alias("has_relations"), odd.alias("timed"), F.when(F.col("unit_id") % 3 == 1, F.lit("a")).alias("speaker"), F.lit(False).alias("has_visual"))
    return quality.completeness(units).select("doc_id", "unit_id", "completeness")


def unit_measures(spark, d):
    units = _section_units(spark, d).withColumns({"strategy": F.when(F.col("unit_id") % 2 == 0, "semantic").otherwise("structural"), "element_kind": F.when(F.col("unit_id") % 4 == 0, "section").otherwise("text"), "semantic_shift": F.lit(0.0), "speaker_change": F.lit(0.0), "vetoes": F.lit(0)})
    return quality.measures(units, ["doc_id"])


def cross_doc_links(spark, d):
    """Pages that name the host of the next page."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    rows = _read(spark, d, "pages").select("page_id", host.alias("doc_id"))
    after = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("doc_id").alias("other"))
    units = rows.join(after, "page_id").select("doc_id", F.col("page_id").alias("unit_id"), F.concat(F.lit("See "), "other", F.lit(" for more")).alias("content"), F.lit("section").alias("element_kind"))
    found = quality.cross_document_links(units, rows.select("doc_id", F.col("doc_id").alias("name")).distinct())
    return found.select("doc_id", "unit_id", "target_doc", "target_id", "type", "confidence")


def usage_ledger(spark, d):
    """Events as calls: the user's number gives the model."""
    model = F.element_at(F.array(*map(F.lit, ("gemini-2.5-flash", "gemini-2.5-flash-lite", "gemini-2.0-flash", "ollama/small", "unknown-1"))), (F.col("user_id") % 5 + 1).cast("int"))
    calls = _read(spark, d, "events").select(model.alias("model"), (F.col("event_id") % 997).alias("in_tokens"), (F.col("event_id") % 101).alias("out_tokens"), (F.col("event_id") % 53).alias("cached_tokens"))
    return usage.ledger(calls)


def enrichment_batches(spark, d):
    rows = usage.batches(_section_units(spark, d).filter("unit_type = 'section'"))
    return rows.select("doc_id", "batch", "units", F.md5("prompt").alias("digest"))


def enrichment_prompts(spark, d):
    """The sections of hosts in batches, each after its host's text."""
    units = _section_units(spark, d).withColumn("heading_path", F.when(F.col("unit_type") == "section", F.array(F.split_part("content", F.lit("\n"), F.lit(1)))).otherwise(F.array().cast("array<string>")))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_id", "content"))), lambda x: x["content"]), "\n\n")
    rows = usage.prompts(units.filter("unit_type = 'section'"), units.groupBy("doc_id").agg(texts.alias("text")))
    return rows.select("doc_id", F.col("batch").cast("long").alias("batch"), "units", F.md5("prompt").alias("digest"))


def enrichment_applied(spark, d):
    """Replies to the batches of hosts' sections, made up here: some empty, some by a local model, one no JSON."""
    units = _section_units(spark, d).filter("unit_type = 'section'").select("doc_id", "unit_id")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("unit_id")) - 1
    result = F.struct(F.col("unit_id").cast("string").alias("id"), F.when(F.col("unit_id") % 4 != 0, F.concat(F.lit(" about "), F.col("unit_id").cast("string"))).alias("summary"), F.transform(F.sequence(F.lit(1), F.col("unit_id") % 11 + 1), lambda k: F.concat(F.lit("e"), k.cast("string"))).alias("entities"))
    rows = units.withColumn("batch", F.floor(number / 6)).groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("units"), F.sort_array(F.collect_list(result)).alias("results"))
    reply = F.when(F.col("batch") % 5 == 4, "no JSON").otherwise(F.to_json(F.struct("results")))
    replies = rows.select("doc_id", "batch", "units", reply.alias("reply"), F.when(F.col("batch") % 2 == 0, "ollama/small").otherwise("gemini-2.5-flash").alias("model"), (F.col("units") * F.col("batch") * 0.25).alias("cost"))
    return usage.apply_replies(units, replies).select("doc_id", "unit_id", F.coalesce("summary", F.lit("")).alias("summary"), F.col("tier").cast("long").alias("tier"), F.array_join("entities", ",").alias("entities"), "cost_usd")


def column_examples_customer(spark, d):
    table = _read(spark, d, "customer")
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), sources.as_text(n, t).alias("value")) for n, t in table.dtypes]))
    cells = table.select(F.col("c_custkey").alias("place"), cells.alias("c")).select("place", "c.name", "c.value")
    return tables.with_examples(tables.profile_columns(cells), cells).select("name", "dtype", F.array_join("examples", "|").alias("examples"))


def export_chroma(spark, d):
    return chunking.export_chroma(_section_units(spark, d)).withColumn("document", F.md5("document"))


def export_langchain(spark, d):
    rows = chunking.export_langchain(_section_units(spark, d))
    return rows.select("doc_id", "unit_id", F.md5("page_content").alias("digest"), F.get_json_object("metadata", "$.unit_type").alias("unit_type"))


def unit_hierarchy(spark, d):
    units = _section_units(spark, d).withColumn("heading_path", F.when(F.col("unit_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("unit_id") % 3).cast("string"))))
    return chunking.hierarchy(chunking.linked_units(units)).select("doc_id", "unit_id", "previous_id", "next_id", "parent_id")


def paragraph_pack_units(spark, d):
    """Documents packed into units of at most 700 tokens where a cut is legal."""
    rows = _lines(spark, d)
    return chunking.packed_units(rows, graph.resolve(graph.next_edges(rows)))


def structural_units(spark, d):
    """Sections of hosts; a section's heading is the parent of its elements."""
    rows = graph.heading_paths(_hosts(spark, d))
    return chunking.structural_units(rows, graph.resolve(graph.next_edges(rows).union(graph.parent_edges(rows))))


def boundary_candidates(spark, d):
    """The signals and score of each possible cut between a conversation's turns."""
    rows = _seconds(_speech(spark, d, True)).withColumn("region", F.lit(0))
    found = boundary.candidates(rows, _resolved(spark, d), ["region"])
    value = boundary.score(F.col("tokens_before"), F.col("loss"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "speaker_change", "temporal_gap", "graph_separation", "loss", "vetoed", F.round(value, 6).alias("score"))


def event_windows(spark, d):
    rows = _seconds(_speech(spark, d, True)).withColumn("region", F.lit(0))
    found = boundary.candidates(rows, _resolved(spark, d), ["region"])
    scored = found.select("doc_id", "pos", boundary.score(F.col("tokens_before"), F.col("loss")).alias("score"), "vetoed", "loss", F.col("multimodal_consensus").alias("consensus"))
    return video.event_windows(rows, scored).groupBy("doc_id", "window").agg(F.count(F.lit(1)).alias("elements"), F.sum("n_tokens").alias("n_tokens"))


def heading_scorecard(spark, d):
    """How often a paragraph of a host is found with its heading: in sections, and in fixed windows."""
    rows = stored(graph.heading_paths(_hosts(spark, d)))
    heads = rows.filter("kind = 'heading'").select("doc_id", F.col("pos").alias("parent_pos"), F.col("text").alias("head"))
    probes = rows.filter((F.col("kind") == "paragraph") & (F.length("text") >= 60)).join(heads, ["doc_id", "parent_pos"])
    probes = probes.select("doc_id", F.col("pos").alias("probe_id"), F.lit("heading").alias("metric"), F.substring(norm(F.col("text")), 1, 80).alias("bearing"), F.substring(norm(F.col("head")), 1, 60).alias("wanted"))
    units = _section_units(spark, d)
    fixed = retrieval.fixed_windows_of(rows)
    score = lambda arm, df: quality.containment(probes, df.select("doc_id", norm(F.col("content")).alias("chunk"), F.lit(None).cast("string").alias("context"))).withColumn("arm", F.lit(arm))
    return score("sections", units).unionByName(score("fixed", fixed))


def tabular_units_customer(spark, d):
    """Schema cards and row groups of the customers of each nation."""
    table = _read(spark, d, "customer")
    rows = sources.cells_of(table, "c_nationkey", ["c_custkey"])
    cells = table.select(F.col("c_nationkey").alias("sheet"), F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("name"), sources.as_text(n, t).alias("value")) for k, (n, t) in enumerate(table.dtypes)])).alias("c"))
    profiles = tables.describe(tables.profile_columns(cells.select("sheet", "c.place", "c.name", "c.value"), ["sheet", "place", "name"]))
    units = chunking.tabular_units(rows, profiles, HEADER, 300)
    return units.select("sheet", "unit_id", "unit_type", F.md5("content").alias("digest"), "first_row", "last_row", "overflow", F.size("relations").alias("relations"), "n_tokens")


def event_units(spark, d):
    """Conversations' windows as events: every third turn is taken as a picture."""
    rows = _seconds(_speech(spark, d, True)).withColumns({"region": F.lit(0), "kind": F.when(F.col("pos") % 3 == 2, "visual_event").otherwise("speech_segment")})
    found = boundary.candidates(rows, graph.resolve(graph.next_edges(rows)), ["region"])
    scored = found.select("doc_id", "pos", boundary.score(F.col("tokens_before"), F.col("loss")).alias("score"), "vetoed", "loss", F.col("multimodal_consensus").alias("consensus"))
    units = chunking.event_units(video.event_windows(rows, scored))
    return units.select("doc_id", "unit_id", F.md5("content").alias("digest"), "unit_type", "start_s", "end_s", "members", "fusion", "agreement")


def _chunked(elements, clean=False):
    units = driver.chunk(elements, clean=clean)
    return units.select("doc_id", F.col("unit_id").cast("long").alias("unit_id"), F.md5("content").alias("digest"), "unit_type", "strategy", "route", F.col("n_tokens").cast("long").alias("n_tokens"), "overflow", F.size("members").cast("long").alias("elements"), F.col("next_id").cast("long").alias("next_id"))


def chunk_documents(spark, d):
    """Documents by the whole way from elements to units; their text is clean."""
    return _chunked(_lines(spark, d))


def chunk_conversations(spark, d):
    return _chunked(_seconds(_speech(spark, d)))


def chunk_pages(spark, d):
    """Hosts by the whole way, cleaned: sections where there are headings enough, else paragraphs packed."""
    units = driver.chunk(_hosts(spark, d))
    return units.select("doc_id", F.col("unit_id").cast("long").alias("unit_id"), F.md5("content").alias("digest"), "unit_type", "strategy", "reason", F.array_join("heading_path", " > ").alias("path"), F.array_join("flags", ", ").alias("flags"), "n_tokens", "overflow", F.size("references").cast("long").alias("references"), "parent_id", "completeness")


def heading_path_numbered(spark, d):
    """Lines of documents as headings with a title, numbers and none: every fifth line is one."""
    rows = _lines(spark, d)
    k = F.col("pos") / 5
    number = F.when(F.col("pos") % 20 == 5, F.concat(F.ceil(k).cast("string"), F.lit(" "))).when(F.col("pos") % 20 == 10, F.concat(F.ceil(k - 1).cast("string"), F.lit(".1 "))).otherwise(F.lit("x"))
    head = F.col("pos") % 5 == 0
    rows = rows.withColumns({"kind": F.when(head, "heading").otherwise("paragraph"), "level": F.when(F.col("pos") == 0, 1), "text": F.when(head, F.concat(number, F.lit("h"), F.col("pos").cast("string"))).otherwise(F.col("text"))})
    found = graph.heading_paths(rows)
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("heading_path", " > ").alias("path"), F.col("parent_pos").cast("long").alias("parent_pos"), F.col("level").cast("long").alias("level"))


def queries() -> dict:
    own = [
        chunk_documents, chunk_conversations, chunk_pages, heading_path_numbered, enrichment_prompts, enrichment_applied, column_examples_customer,
        token_counts, normalize_probe, clean_documents, cleaning_report, clean_documents_nfkc, doc_profile, route_documents, anaphora_rate,
        escalation_flags, fixed_chunks_512_64, section_ids, heading_path, surrounding_text, reading_order_edges, qa_edges, edge_conflicts,
        relationship_loss, references_resolve, explaining_edges, speaker_turns, micro_turn_merge, long_turn_split, conversational_type,
        *map(_column_profile, ("lineitem", "orders", "part", "customer")), row_groups_customer, schema_card_orders, overlap_edges,
        fusion_confidence, semantic_drift_groups, semantic_shifts, topk_search, topk_search_every_20th, retrieval_eval, retrieval_eval_benchmark, completeness, unit_measures, cross_doc_links, usage_ledger,
        enrichment_batches, export_chroma, export_langchain, unit_hierarchy, paragraph_pack_units, structural_units, boundary_candidates,
        event_windows, heading_scorecard, tabular_units_customer, event_units,
    ]
    return {f.__name__: f for f in own}
