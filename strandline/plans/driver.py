"""From elements to units: documents are cleaned, linked, profiled and routed; tables and figures become units of their own,
the rest is cut by its route, and all units come back in reading order with their reasons, flags and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import cleaning
from strandline.functions.text import body_rows, count_tokens
from strandline.operators import graph, profile, quality, tables, turns
from strandline.operators.boundary import candidates, cut_regions, score
from strandline.operators.profile import anaphora_rate, escalation_flags
from strandline.operators.retrieval import dot
from strandline.operators.video import event_windows, semantic_shifts
from strandline.plans import chunking
from strandline.settings import Settings, settings
from strandline.stored import stored

#: What elements may have besides doc_id, pos, kind, text and n_tokens.
OPTIONAL = {"level": "int", "page": "int", "bbox": "array<double>", "t0": "double", "t1": "double", "speaker": "string", "caption_ids": "array<string>", "el_id": "string", "grid": "array<array<string>>", "header_row": "array<string>", "sheet": "string"}
UNIT = ["doc_id", "first_pos", "rank", "content", "unit_type", "strategy", "reason", "heading_path", "speaker", "start_s", "end_s", "n_tokens", "overflow", "has_caption", "members"]


def clean_elements(elements: DataFrame) -> DataFrame:
    """``elements`` (with OPTIONAL ones) with cleaned texts and cells, counted anew; code keeps its spacing. Those left without
    text go, but tables and figures stay. They are stored before that filter: moved below the rules it would hold each rule twice or
    more for each rule after it, which no driver's memory has room for."""
    rows = stored(cleaning.clean(elements, verbatim=F.col("kind") == "code").drop("fixes"))
    text = F.coalesce("text", F.lit(""))
    rows = rows.withColumns({"text": text, "n_tokens": count_tokens(text), "grid": cleaning.clean_cells(F.col("grid")), "header_row": cleaning.clean_cells(F.array("header_row"))[0]})
    return rows.filter((F.trim("text") != "") | F.col("kind").isin("table", "figure"))


def with_optional(elements: DataFrame) -> DataFrame:
    return elements.withColumns({c: F.lit(None).cast(k) for c, k in OPTIONAL.items() if c not in elements.columns})


def all_edges(elements: DataFrame) -> DataFrame:
    """The relations of elements (with parent_pos), one for each pair: reading order, headings, captions, references, questions,
    explanations, and speech during pictures."""
    captions = graph.declared_captions(elements).unionByName(graph.adjacent_captions(elements))
    timed = elements.filter("t0 is not null and t1 is not null")
    every = [graph.next_edges(elements), graph.parent_edges(elements), graph.question_edges(elements), captions, graph.reference_edges(elements, captions), graph.explaining_edges(elements)]
    every.append(graph.overlap_edges(timed.filter("kind = 'speech_segment'"), timed.filter("kind = 'visual_event'")))
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return graph.resolve(out)


def _regions(elements: DataFrame, edges: DataFrame, region: str, strategy: str, own: Settings) -> DataFrame:
    """Units of regions, cut where they are larger than a unit may be, each with the reason for its size."""
    rows = cut_regions(elements, edges, [region], own.target_chunk_tokens, own.max_chunk_tokens, own)
    size = Window.partitionBy("doc_id", region)
    rows = rows.withColumns({"region_tokens": F.sum("n_tokens").over(size), "parts": F.max("part").over(size) + 1})
    e = F.sort_array(F.collect_list(F.struct("pos", "kind", "text", "heading_path")))
    units = rows.groupBy("doc_id", region, "part").agg(e.alias("e"), F.sum("n_tokens").alias("tokens"), F.bool_or("overflow").alias("overflow"), F.max("region_tokens").alias("region_tokens"), F.max("parts").alias("parts"))
    head = F.element_at("e", 1)
    is_head = head["kind"] == "heading"
    title = F.try_element_at(F.filter("e", lambda x: x["kind"] == "heading"), F.lit(1))["text"] if strategy == "structural" else F.lit(None).cast("string")
    whole = F.when(title.isNotNull(), F.format_string("section '%s' fits with %d tokens", F.substring(title, 1, 60), "tokens")).otherwise(F.format_string("%d elements fit with %d tokens", F.size("e"), "tokens"))
    reason = F.when(F.col("overflow"), F.format_string("%d tokens, no legal place to cut", "tokens")).when(F.col("parts") > 1, F.format_string("part %d of %d of %d tokens, cut nearest to %d tokens", F.col("part") + 1, "parts", "region_tokens", F.lit(own.target_chunk_tokens))).otherwise(whole)
    path = F.coalesce(head["heading_path"], F.array().cast("array<string>"))
    return units.select(
        "doc_id", head["pos"].alias("first_pos"), F.lit(1).alias("rank"), F.array_join(F.filter(F.col("e.text"), lambda t: t != ""), "\n\n").alias("content"),
        F.when(is_head, "section").otherwise("narrative").alias("unit_type"), F.lit(strategy).alias("strategy"), reason.alias("reason"),
        F.when(is_head, F.concat(path, F.array(head["text"]))).otherwise(path).alias("heading_path"), *_no_time(), F.col("tokens").alias("n_tokens"), "overflow", F.lit(True).alias("has_caption"), F.col("e.pos").alias("members"),
    )


def _no_time():
    return [F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s")]


def _atomic(elements: DataFrame, captions: DataFrame, settings: Settings) -> DataFrame:
    """Tables and figures with their captions; large tables with a grid in parts that repeat the header."""
    own = captions.filter("type = 'captions'").select("doc_id", F.col("src").alias("cap"), F.col("dst").alias("pos"))
    said = own.join(elements.select("doc_id", F.col("pos").alias("cap"), F.col("text").alias("said")), ["doc_id", "cap"])
    said = said.groupBy("doc_id", "pos").agg(F.sort_array(F.collect_list(F.struct("cap", "said"))).alias("c"))
    floats = elements.filter(F.col("kind").isin("table", "figure")).join(said, ["doc_id", "pos"], "left")
    caption = F.when(F.col("c").isNotNull(), F.array_join("c.said", "\n"))
    floats = floats.withColumns({"caption": caption, "members": F.concat(F.array("pos"), F.coalesce(F.col("c.cap"), F.array().cast("array<int>")))})
    about = floats.select("doc_id", "pos", "kind", "heading_path", "members", F.col("caption").isNotNull().alias("has_caption"))
    grids = chunking.split_floats(floats.filter("kind = 'table' and grid is not null").select("doc_id", "pos", "grid", "header_row", "caption"), settings.target_chunk_tokens, settings.max_chunk_tokens)
    bare = F.when(F.col("kind") == "figure", F.when(F.col("caption").isNull(), F.concat(F.lit("[uncaptioned figure"), F.when(F.col("page").isNotNull(), F.concat(F.lit(" on page "), F.col("page").cast("string"))).otherwise(""), F.lit("]"))))
    plain = floats.filter("kind = 'figure' or grid is null").select("doc_id", "pos", F.lit(0).alias("part"), F.lit(1).alias("parts"), F.concat_ws("\n\n", "caption", F.when(F.col("kind") == "table", F.col("text")), bare).alias("content"))
    rows = grids.select("doc_id", "pos", "part", "parts", "content").unionByName(plain).join(about, ["doc_id", "pos"])
    reason = F.when(F.col("parts") > 1, F.format_string("%s kept with its caption, rows %d of %d", "kind", F.col("part") + 1, "parts")).otherwise(F.concat("kind", F.lit(" kept whole with its caption")))
    tokens = count_tokens(F.col("content"))
    return rows.select("doc_id", F.col("pos").alias("first_pos"), F.col("part").alias("rank"), "content", F.col("kind").alias("unit_type"), F.lit("atomic").alias("strategy"), reason.alias("reason"), "heading_path", *_no_time(), tokens.cast("long").alias("n_tokens"), (tokens > settings.max_chunk_tokens).alias("overflow"), "has_caption", "members")


def _sheets(elements: DataFrame, own: Settings) -> DataFrame:
    """A card for each sheet and its row groups with the header."""
    rows = elements.filter("kind = 'table' and grid is not null").withColumn("caption", F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    by = ["doc_id", "pos", "place_of", "name"]
    body = rows.select("doc_id", "pos", "header_row", F.posexplode(body_rows(F.col("grid"), F.col("header_row"))).alias("place", "cells"))
    cells = body.select("doc_id", "pos", "place", "cells", F.posexplode("header_row").alias("place_of", "name"))
    cells = stored(cells.select(*by, "place", F.coalesce(F.get("cells", F.col("place_of")), F.lit("")).alias("value")))
    columns = tables.describe(tables.with_examples(tables.profile_columns(cells, by), cells, by))
    lines = columns.groupBy("doc_id", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place_of", "line"))), lambda x: F.concat(F.lit("  - "), x["line"])), "\n").alias("lines"))
    bare = F.array_join(F.transform("header_row", lambda h: F.concat(F.lit("  - "), h, F.lit(" (empty)"))), "\n")  # of a sheet without rows
    where = F.concat(F.col("doc_id").cast("string"), F.when(F.col("sheet").isNotNull(), F.concat(F.lit(" · sheet “"), F.col("sheet"), F.lit("”"))).otherwise(""))
    rows = rows.join(lines, ["doc_id", "pos"], "left")
    card = F.concat(F.lit("Dataset: "), where, F.lit("\n"), F.format_number(F.size(body_rows(F.col("grid"), F.col("header_row"))), 0), F.lit(" rows × "), F.size("header_row").cast("string"), F.lit(" columns\n\nColumns:\n"), F.coalesce("lines", bare))
    cards = rows.select("doc_id", F.col("pos").alias("first_pos"), F.lit(-1).alias("rank"), card.alias("content"), F.lit("schema_card").alias("unit_type"), F.lit("tabular").alias("strategy"), F.lit("card of the sheet's columns").alias("reason"))
    parts = chunking.split_floats(rows, own.tabular_target_tokens, own.tabular_max_tokens)
    groups = parts.select("doc_id", F.col("pos").alias("first_pos"), F.col("part").alias("rank"), "content", F.lit("row_group").alias("unit_type"), F.lit("tabular").alias("strategy"), F.format_string("rows in group %d of %d, header repeated", F.col("part") + 1, "parts").alias("reason"))
    tokens = count_tokens(F.col("content"))
    return cards.unionByName(groups).select("*", none.alias("heading_path"), *_no_time(), tokens.cast("long").alias("n_tokens"), (tokens > own.tabular_max_tokens).alias("overflow"), F.lit(True).alias("has_caption"), F.array(F.col("first_pos")).alias("members"))


def _turns(segments: DataFrame) -> DataFrame:
    """Turns of one speaker: short ones absorbed, long ones split at their widest gaps."""
    rows = turns.split_long(turns.absorb_short(turns.speaker_runs(segments)))
    units = turns.turn_units(rows, ["turn", "part"])
    places = rows.groupBy("doc_id", "turn", "part").agg(F.sort_array(F.collect_list("pos")).alias("members"))
    types = turns.conversational_type(rows, ["doc_id", "turn", "part"]).select("doc_id", "turn", "part", "type")
    several = F.max("part").over(Window.partitionBy("doc_id", "turn")) > 0
    units = units.join(places, ["doc_id", "turn", "part"]).join(types, ["doc_id", "turn", "part"])
    reason = F.when(several, F.format_string("part %d of a long turn, cut at its widest pause", F.col("part") + 1)).otherwise(F.format_string("turn of %d segments", "segments"))
    return units.select("doc_id", F.element_at("members", 1).alias("first_pos"), F.lit(1).alias("rank"), "content", F.col("type").alias("unit_type"), F.lit("temporal").alias("strategy"), reason.alias("reason"), F.array().cast("array<string>").alias("heading_path"), "speaker", "start_s", "end_s", F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(False).alias("overflow"), F.lit(True).alias("has_caption"), "members")


def _events(elements: DataFrame, edges: DataFrame, settings: Settings) -> DataFrame:
    """Windows of speech and pictures."""
    rows = elements.withColumn("region", F.lit(0))
    found = candidates(rows, edges, ["region"])
    scored = found.select("doc_id", "pos", score(F.col("tokens_before"), F.col("loss"), settings.target_chunk_tokens, settings).alias("score"), "vetoed", "loss", F.col("multimodal_consensus").alias("consensus"))
    windows = event_windows(rows, scored, settings.speaker_boundary_threshold)
    own = windows.groupBy("doc_id", F.col("window").alias("unit_id")).agg(F.sort_array(F.collect_list("pos")).alias("places"))
    units = chunking.event_units(windows).join(own, ["doc_id", "unit_id"])
    return units.select("doc_id", F.element_at("places", 1).alias("first_pos"), F.lit(1).alias("rank"), "content", "unit_type", F.lit("temporal").alias("strategy"), F.format_string("window of %d elements, speech and pictures agree: %s", F.size("places"), "agreement").alias("reason"), F.array().cast("array<string>").alias("heading_path"), "speaker", "start_s", "end_s", count_tokens(F.col("content")).cast("long").alias("n_tokens"), F.lit(False).alias("overflow"), F.lit(True).alias("has_caption"), F.col("places").alias("members"))


def semantic_regions(elements: DataFrame) -> DataFrame:
    """doc_id, pos, region, several of the elements of documents whose elements have vectors: a region is a group of neighbours that are
    about the same; an element without a vector belongs to the group before it. ``several``: whether its document has more
    than one."""
    every, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("pos")
    v = F.col("embedding")
    rows = elements.select("doc_id", "pos", "embedding").withColumn("sim", F.round(dot(v, F.last(v, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))), 6))
    rows = rows.select("doc_id", "pos", "sim", v.isNotNull().alias("known"))
    rows = rows.withColumns({"n": F.count_if("known").over(every), "least": F.round(F.avg("sim").over(every) - F.stddev_pop("sim").over(every), 6)}).filter("n > 0")
    cut = F.coalesce((F.col("n") >= 4) & (F.col("sim") < F.col("least")), F.lit(False))  # as semantic_groups, in the one order by document
    rows = rows.withColumn("region", F.count_if(cut).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("doc_id", "pos", "region", (F.max("region").over(every) > 0).alias("several"))


def chunk(elements: DataFrame, clean: bool = True, own: Settings | None = None) -> DataFrame:
    """The units of documents (elements: doc_id, pos, kind, text, n_tokens and any of OPTIONAL): doc_id, unit_id (in reading
    order), content, unit_type, strategy, reason, heading_path, flags, speaker, start_s, end_s, n_tokens, overflow, route,
    members (positions of its elements), references (units it refers to), previous_id, next_id, parent_id, completeness.

    Elements with an ``embedding`` have their semantic shifts among the signals of a cut, and flat prose is cut where its subject
    changes, before its parts are packed. Every element is in a unit; one of a table that is split counts for all its parts. An empty table gives an empty result.
    Budgets and weights are those of ``own``, by default what the session's configuration says.
    """
    own = own or settings(elements.sparkSession)
    rows = with_optional(elements)
    drift = None
    if "embedding" in rows.columns:
        drift = stored(semantic_regions(rows))
        rows = rows.drop("semantic_shift").join(semantic_shifts(rows), ["doc_id", "pos"], "left").drop("embedding")
    rows = graph.heading_paths(clean_elements(rows) if clean else rows)
    rows = stored(rows.drop("section"), by_document=True)
    edges = stored(all_edges(rows), by_document=True)
    profiles = profile.profile(rows)
    if drift is not None:
        profiles = profiles.join(drift.groupBy("doc_id").agg(F.lit(True).alias("embedded")), "doc_id", "left")
    embedded = F.coalesce("embedded", F.lit(False)) if drift is not None else None
    routes = stored(profile.route(profiles, embedded).select("doc_id", "route", F.col("reason").alias("route_reason")))
    rows = rows.join(routes, "doc_id")
    captions = edges.filter("type = 'captions'")
    sheets, others = rows.filter("route = 'tabular'"), rows.filter("route != 'tabular'")
    floats = bool(rows.filter(F.col("kind").isin("table", "figure")).head(1))  # without any, no texts are moved for them
    stream = chunking.without_atomic(others, captions) if floats else others
    seen = F.max((F.col("kind") == "visual_event").cast("int")).over(Window.partitionBy("doc_id")) == 1
    timed = stream.filter("route = 'temporal'").withColumn("seen", seen)
    flat = stream.filter(F.col("route").isin("semantic", "paragraph_fallback"))
    if drift is not None:
        flat = flat.join(drift, ["doc_id", "pos"], "left").withColumns({"several": F.coalesce("several", F.lit(False)), "region": F.coalesce("region", F.lit(0).cast("long"))})
    else:
        flat = flat.withColumns({"several": F.lit(False), "region": F.lit(0).cast("long")})
    present = {r.route for r in routes.select("route").distinct().collect()}
    parts = [
        _atomic(others, captions, own),
        _sheets(sheets, own) if "tabular" in present else None,
        _regions(chunking.sections(stream.filter("route = 'structural'")), edges, "section", "structural", own),
        _regions(flat.filter("not several").withColumn("region", F.lit(0).cast("long")), edges, "region", "paragraph_fallback", own),
        _turns(timed.filter(~F.col("seen"))),
        _events(timed.filter("seen"), edges, own),
        _regions(flat.filter("several"), edges, "region", "semantic", own),
    ]
    used = {0: present - {"tabular"}, 1: present & {"tabular"}, 2: present & {"structural"}, 3: present & {"semantic", "paragraph_fallback"}, 4: present & {"temporal"}, 5: present & {"temporal"}, 6: present & {"semantic"}}
    own_parts = [p.select(*UNIT) for k, p in enumerate(parts) if p is not None and used[k] and (k or floats)] or [parts[0].select(*UNIT)]
    units = own_parts[0]
    for p in own_parts[1:]:
        units = units.unionByName(p)
    whole = stored(units, by_document=True)
    units = whole.drop("content")  # what follows by document moves no texts
    order = Window.partitionBy("doc_id").orderBy("first_pos", "rank", "strategy")
    units = units.withColumn("unit_id", F.row_number().over(order) - 1).join(routes, "doc_id")
    where = units.select("doc_id", F.explode("members").alias("pos"), "unit_id")
    links = chunking.projected_relations(edges, where).groupBy("doc_id", "unit_id").agg(F.sort_array(F.collect_list("target_id")).alias("references"))
    units = chunking.hierarchy(chunking.linked_units(units.join(links, ["doc_id", "unit_id"], "left").withColumn("references", F.coalesce("references", F.array().cast("array<int>")))))
    place = ["doc_id", "first_pos", "rank", "strategy"]
    units = whole.select(*place, "content").join(units, place)
    kind = F.when(F.col("unit_type").isin("table", "figure"), F.col("unit_type")).otherwise("text")
    flags = escalation_flags(anaphora_rate(F.col("content")), F.col("heading_path"), F.when(F.col("strategy") == "tabular", "atomic").otherwise(F.col("strategy")), kind, F.col("has_caption"))
    units = units.withColumn("flags", flags)
    time = F.col("start_s").isNotNull()
    checked = units.withColumns({"modality": F.when(time, "audio").otherwise("document"), "element_kind": F.col("unit_type"), "has_schema": F.lit(True), "has_columns": F.lit(True), "has_context": F.lit(False), "has_relations": F.size("references") > 0, "timed": time, "has_visual": F.col("unit_type") == "video_event"})
    return quality.completeness(checked).select("doc_id", "unit_id", "content", "unit_type", "strategy", "reason", "heading_path", "flags", "speaker", "start_s", "end_s", "n_tokens", "overflow", "route", "route_reason", "members", "references", "previous_id", "next_id", "parent_id", "completeness")
