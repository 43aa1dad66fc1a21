"""The relationship graph: edges (doc_id, src, dst, type, confidence, importance) between elements by position.

At most one edge goes from one element to another. Producers tag their edges with a rank; the highest wins, and a pair
of ``explains`` and ``illustrated_by`` goes as a whole if the elements are already linked. All shuffles are by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Importance of an edge's type, and the rank by which edges between the same elements replace each other.
IMPORTANCE = {
    "captions": 1.0, "captioned_by": 1.0, "parent": 0.95, "has_schema": 0.90, "schema_of": 0.90, "answered_by": 0.90,
    "question_for": 0.90, "explains": 0.85, "illustrated_by": 0.85, "occurs_during": 0.80, "occurs_in_scene": 0.80,
    "slide_content_of": 0.80, "references": 0.75, "next": 0.05,
}
RANK = {"occurs_during": 70, "answered_by": 60, "question_for": 60, "illustrated_by": 55, "captions": 50, "captioned_by": 50, "parent": 40, "references": 30, "explains": 20, "next": 10}
QUESTION = r"(?i)^(who|what|where|when|why|how|can|could|would|should|is|are|do|does|did)\b.*\?"
REFERENCE = r"(?i)\b(Table|Figure|Fig\.?)\s+(\d+)"
#: The number of a heading's section: up to four digits, then two by dots. A longer one is an account, an amount or a year's date, and four
#: parts of which one is over 30 are a network address.
NUMBERED = r"^\s*(?!(?=[\d.]*(?:3[1-9]|[4-9]\d|\d{3}))\d{1,3}(?:\.\d{1,3}){3}[.\s])(\d{1,4}(?:\.\d{1,2})*)\.?\s+\S"
CAPTION_GAP = 60.0
DEFAULT_IMPORTANCE = 0.5


def _by_doc():
    return Window.partitionBy("doc_id").orderBy("pos")


def _edges(rows: DataFrame, kind: str, confidence: float, src: str = "src", dst: str = "dst") -> DataFrame:
    return rows.select("doc_id", F.col(src).cast("int").alias("src"), F.col(dst).cast("int").alias("dst"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))


def parent_edges(elements: DataFrame) -> DataFrame:
    """``parent_pos``: the position of an element's parent."""
    return _edges(elements.filter("parent_pos is not null"), "parent", 1.0, "parent_pos", "pos")


def next_edges(elements: DataFrame) -> DataFrame:
    return _edges(elements.withColumn("dst", F.lead("pos").over(_by_doc())).filter("dst is not null"), "next", 1.0, "pos")


def question_edges(elements: DataFrame) -> DataFrame:
    """A question and the speech segment or paragraph after it, in both directions."""
    text = F.rtrim("text")
    rows = elements.select("doc_id", "pos", "kind", (text.endswith("?") | text.rlike(QUESTION)).alias("asks"))  # no texts in the order by document
    rows = rows.withColumns({"dst": F.lead("pos").over(_by_doc()), "after": F.lead("kind").over(_by_doc())})
    rows = rows.filter(F.col("asks") & F.col("after").isin("speech_segment", "paragraph"))
    return _edges(rows, "answered_by", 0.9, "pos").union(_edges(rows, "question_for", 0.9, "dst", "pos"))


def declared_captions(elements: DataFrame) -> DataFrame:
    """Edges of the captions that tables and figures name in ``caption_ids`` (ids in ``el_id``)."""
    floats = elements.filter(F.col("kind").isin("table", "figure")).select("doc_id", "pos", F.explode("caption_ids").alias("el_id"))
    rows = floats.join(elements.select("doc_id", "el_id", F.col("pos").alias("caption")), ["doc_id", "el_id"])
    return _edges(rows, "captions", 1.0, "caption", "pos").union(_edges(rows, "captioned_by", 1.0, "pos", "caption"))


def adjacent_captions(elements: DataFrame) -> DataFrame:
    """Edges to floats without a caption from the nearest free caption on their page: at most CAPTION_GAP points above
    or below, overlapping sideways. Floats choose one after the other, which only the few of a page with several need."""
    some = elements.filter("bbox is not null")
    named = F.coalesce(F.size("caption_ids"), F.lit(0)) > 0
    floats = some.filter(F.col("kind").isin("table", "figure") & ~named).select("doc_id", "page", F.col("pos").alias("float"), F.col("bbox").alias("f"))
    taken = declared_captions(elements).filter("type = 'captions'").select("doc_id", F.col("src").alias("caption"))
    captions = some.filter("kind = 'caption'").select("doc_id", "page", F.col("pos").alias("caption"), F.col("bbox").alias("c")).join(taken, ["doc_id", "caption"], "left_anti")
    gap = F.greatest(F.greatest(F.col("c")[1] - F.col("f")[3], F.col("f")[1] - F.col("c")[3]), F.lit(0.0))
    over = F.least(F.col("c")[2], F.col("f")[2]) - F.greatest(F.col("c")[0], F.col("f")[0])
    near = floats.join(captions, ["doc_id", "page"]).withColumn("gap", gap).filter((over > 0) & (F.col("gap") <= CAPTION_GAP))
    offers = near.groupBy("doc_id", "page", "float").agg(F.sort_array(F.collect_list(F.struct("gap", "caption"))).alias("offers"))
    queue = offers.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("float", "offers"))).alias("queue"))
    start = F.array().cast("array<struct<float: int, caption: int>>")

    def choose(done, x):
        free = F.filter(x["offers"], lambda o: ~F.exists(done, lambda d: d["caption"] == o["caption"]))
        pick = F.array(F.struct(x["float"].cast("int").alias("float"), F.get(free, F.lit(0))["caption"].cast("int").alias("caption")))
        return F.when(F.size(free) > 0, F.concat(done, pick)).otherwise(done)

    rows = queue.select("doc_id", F.explode(F.aggregate("queue", start, choose)).alias("x")).select("doc_id", "x.float", "x.caption")
    return _edges(rows, "captions", 0.8, "caption", "float").union(_edges(rows, "captioned_by", 0.8, "float", "caption"))


def reference_edges(elements: DataFrame, captions: DataFrame) -> DataFrame:
    """From texts that name a numbered table or figure to it: the first float with that label in a caption, else the
    float of that kind with that number. ``captions``: edges of type ``captions``."""
    prose = elements.filter(F.col("kind").isin("paragraph", "list_item", "caption"))
    found = prose.select("doc_id", "pos", F.explode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0))).alias("label"))
    what = lambda c: F.when(F.lower(c).startswith("t"), "table").otherwise("figure")
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("int")
    found = found.select("doc_id", "pos", what(F.col("label")).alias("what"), number(F.col("label")).alias("number"))
    floats = elements.filter(F.col("kind").isin("table", "figure")).select("doc_id", F.col("pos").alias("float"), "kind")
    place = Window.partitionBy("doc_id", "kind").orderBy("float")
    by_place = floats.select("doc_id", F.col("kind").alias("what"), F.row_number().over(place).alias("number"), F.col("float").alias("placed"))
    text = elements.select("doc_id", F.col("pos").alias("src"), "text")
    labels = captions.filter("type = 'captions'").join(text, ["doc_id", "src"]).select("doc_id", F.col("dst").alias("float"), F.explode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0))).alias("label"))
    by_label = labels.groupBy("doc_id", what(F.col("label")).alias("what"), number(F.col("label")).alias("number")).agg(F.min("float").alias("labelled"))
    keys = ["doc_id", "what", "number"]
    rows = found.join(by_label, keys, "left").join(by_place, keys, "left").withColumn("dst", F.coalesce("labelled", "placed"))
    return _edges(rows.filter("dst is not null and dst != pos").select("doc_id", "pos", "dst").distinct(), "references", 0.9, "pos")


def explaining_edges(elements: DataFrame) -> DataFrame:
    """A paragraph or list item of over 20 characters just before a table or figure explains it."""
    rows = elements.select("doc_id", "pos", "kind", (F.length("text") > 20).alias("long"))
    rows = rows.withColumns({"before": F.lag("pos").over(_by_doc()), "what": F.lag("kind").over(_by_doc()), "said": F.lag("long").over(_by_doc())})
    rows = rows.filter(F.col("kind").isin("table", "figure") & F.col("what").isin("paragraph", "list_item") & F.col("said"))
    return _edges(rows, "explains", 0.85, "before", "pos").union(_edges(rows, "illustrated_by", 0.85, "pos", "before"))


def overlap_edges(speech: DataFrame, visual: DataFrame, t0: str = "t0", t1: str = "t1", bucket: float = 60.0) -> DataFrame:
    """Speech and visual events of a document that overlap in time: an interval join on the time slots they touch, each
    pair taken in the first slot they share."""
    slots = lambda df, name: df.select("doc_id", F.col("pos").alias(name), F.col(t0).alias(f"{name}0"), F.col(t1).alias(f"{name}1"), F.explode(F.sequence(F.floor(F.col(t0) / bucket), F.floor(F.col(t1) / bucket))).alias("slot"))
    rows = slots(speech, "s").join(slots(visual, "v"), ["doc_id", "slot"])
    start = F.greatest("s0", "v0")
    rows = rows.filter((F.least("s1", "v1") - start > 0) & (F.col("slot") == F.floor(start / bucket)))
    return _edges(rows, "occurs_during", 0.85, "s", "v")


def resolve(edges: DataFrame) -> DataFrame:
    """One edge from one element to another, with its importance: by rank, the pair of an explanation together."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    firm = edges.filter(F.col("type").isin("parent", "captions", "captioned_by", "references")).select("doc_id", "src", "dst").distinct()
    pairs, others = edges.filter(F.col("type").isin("explains", "illustrated_by")), edges.filter(~F.col("type").isin("explains", "illustrated_by"))
    tied = firm.select("doc_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    a = F.when(F.col("type") == "explains", F.col("src")).otherwise(F.col("dst"))
    b = F.when(F.col("type") == "explains", F.col("dst")).otherwise(F.col("src"))
    pairs = pairs.withColumns({"a": a, "b": b}).join(tied, ["doc_id", "a", "b"], "left_anti").drop("a", "b")
    best = F.max_by(F.struct("type", "confidence"), F.struct(rank[F.col("type")], "confidence", "type"))
    kept = others.unionByName(pairs).groupBy("doc_id", "src", "dst").agg(best.alias("e"))
    weight = F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv])
    return kept.select("doc_id", "src", "dst", "e.type", "e.confidence", F.coalesce(weight[F.col("e.type")], F.lit(DEFAULT_IMPORTANCE)).alias("importance"))


def heading_paths(elements: DataFrame) -> DataFrame:
    """parent_pos, level and heading_path (texts from the root) of each element, by folds over a document's headings.

    A title (level 1 given) starts anew. A numbered heading (1, 1.2, ...) stands below the nearest open one whose number
    is the beginning of its own, its level follows from the dots. Another closes unnumbered ones, the title too, has one
    level more than what is open or 2, and is open only if nothing else is. So only titles and numbers are folded, from one title or
    number without a dot to the next; what stands between them looks at the last of them alone.
    """
    seen = elements.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    heads = seen.filter("kind = 'heading'").select("doc_id", "section", "pos", "text", *(["level"] if "level" in elements.columns else []))

    given = F.col("level") if "level" in heads.columns else F.lit(None).cast("int")
    number = F.nullif(F.regexp_extract("text", NUMBERED, 1), F.lit(""))
    title, along = F.coalesce(given == 1, F.lit(False)), Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    heads = heads.select("doc_id", "section", F.col("pos").cast("int").alias("pos"), "text", title.alias("title"), number.alias("number")).withColumn("firm", F.col("title") | F.col("number").isNotNull())
    root = F.col("title") | F.coalesce(~F.contains("number", F.lit(".")), F.lit(False))
    heads = heads.withColumns({"chapter": F.sum(root.cast("int")).over(along), "under": F.last(F.when(F.col("firm"), F.col("section")), ignorenulls=True).over(along)})
    lists = heads.filter("firm").groupBy("doc_id", "chapter").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "number", "text", "section"))).alias("heads"))
    open_kind = "array<struct<pos: int, number: string, level: int, text: string>>"
    none = F.array().cast(open_kind)

    def up_to_last(stack, wanted):
        """The open headings up to the last that is ``wanted``."""
        places = F.transform(stack, lambda x, k: F.when(wanted(x), k + 1).otherwise(0))
        return F.slice(stack, F.lit(1), F.coalesce(F.array_max(places), F.lit(0)))

    def step(state, x):
        stack, is_number = state["stack"], x["number"].isNotNull()
        below = up_to_last(stack, lambda s: s["number"].isNotNull() & x["number"].startswith(F.concat(s["number"], F.lit("."))))
        rest = F.when(x["title"], none).when(is_number, below).otherwise(up_to_last(stack, lambda s: s["number"].isNotNull()))
        top = F.try_element_at(rest, F.lit(-1))
        dots = F.length(x["number"]) - F.length(F.replace(x["number"], F.lit("."))) + 2
        level = F.when(x["title"], 1).when(is_number, dots).otherwise(F.coalesce(top["level"] + 1, F.lit(2))).cast("int")
        own = F.array(F.struct(x["pos"].alias("pos"), F.when(~x["title"], x["number"]).alias("number"), level.alias("level"), x["text"].alias("text")))
        after = F.when(x["title"] | is_number | (F.size(rest) == 0), F.concat(rest, own)).otherwise(rest)
        row = F.struct(x["section"].alias("section"), top["pos"].alias("parent_pos"), level.alias("level"), F.transform(rest, lambda s: s["text"]).alias("above"), F.try_element_at(after, F.lit(-1))["pos"].alias("top"), F.transform(after, lambda s: s["text"]).alias("path"))
        return F.struct(after.cast(open_kind).alias("stack"), F.concat(state["rows"], F.array(row)).cast(row_kind).alias("rows"))

    row_kind = "array<struct<section: bigint, parent_pos: int, level: int, above: array<string>, top: int, path: array<string>>>"
    start = F.struct(none.alias("stack"), F.array().cast(row_kind).alias("rows"))
    folded = lists.select("doc_id", F.explode(F.aggregate("heads", start, step, lambda state: state["rows"])).alias("r")).select("doc_id", "r.*")
    folded = folded.select("doc_id", F.col("section").alias("under"), F.struct("parent_pos", "level", "above", "top", "path").alias("f"))
    below = F.coalesce(F.col("f.level") > 1, F.lit(False))  # a number; a title has level 1
    own = lambda firm, numbered, alone: F.when(F.col("firm"), firm).when(below, numbered).otherwise(alone)
    none_above = F.array().cast("array<string>")
    found = heads.join(folded, ["doc_id", "under"], "left").select(
        "doc_id", "section",
        own(F.col("f.parent_pos"), F.col("f.top"), F.lit(None).cast("int")).alias("parent_pos"),
        own(F.col("f.level"), F.col("f.level") + 1, F.lit(2)).cast("int").alias("level"),
        own(F.col("f.above"), F.col("f.path"), none_above).alias("above"),
        own(F.col("f.top"), F.col("f.top"), F.col("pos")).alias("top"),
        own(F.col("f.path"), F.col("f.path"), F.array("text")).alias("path"),
    )
    rows = seen.drop("level", "parent_pos").join(found, ["doc_id", "section"], "left")
    is_head = F.col("kind") == "heading"
    path = F.coalesce(F.when(is_head, F.col("above")).otherwise(F.col("path")), F.array().cast("array<string>"))
    parent = F.when(is_head, F.col("parent_pos")).otherwise(F.col("top"))
    return rows.withColumns({"heading_path": path, "parent_pos": parent, "level": F.when(is_head, F.col("level"))}).drop("above", "top", "path")


def surrounding_text(elements: DataFrame, min_chars: int = 40, max_chars: int = 320) -> DataFrame:
    """leading and trailing: the nearest paragraphs or list items of over ``min_chars`` before and after, up to a heading."""
    rows = elements.withColumn("section", F.sum((F.col("kind") == "heading").cast("int")).over(_by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    prose = F.when(F.col("kind").isin("paragraph", "list_item") & (F.length("text") > min_chars), F.substring("text", 1, max_chars))
    island = Window.partitionBy("doc_id", "section").orderBy("pos")
    before = F.last(prose, ignorenulls=True).over(island.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(prose, ignorenulls=True).over(island.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumns({"leading": before, "trailing": after})


def relationship_loss(edges: DataFrame) -> DataFrame:
    """doc_id, cut, loss: what a cut before each element severs; an edge adds its importance to the cuts it spans by
    differences at its ends, summed up along the document."""
    real = edges.filter("type != 'next' and src != dst")
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    deltas = real.select("doc_id", F.explode(F.array(F.struct((low + 1).alias("cut"), F.col("importance").alias("d")), F.struct((high + 1).alias("cut"), (-F.col("importance")).alias("d")))).alias("x"))
    sums = deltas.groupBy("doc_id", F.col("x.cut").alias("cut")).agg(F.sum("x.d").alias("d"))
    run = Window.partitionBy("doc_id").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("doc_id", "cut", F.round(F.sum("d").over(run), 6).alias("loss"))


def separation(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (doc_id, a, b, path_a, path_b) with their ``separation``: 0.1 if linked, 0.95 across headings, else 0.5."""
    real = edges.filter("type != 'next'")
    links = real.select("doc_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct().withColumn("linked", F.lit(True))
    rows = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(links, ["doc_id", "lo", "hi"], "left")
    score = F.when(F.col("linked"), 0.1).when(F.col("path_a") != F.col("path_b"), 0.95).otherwise(0.5)
    return rows.withColumn("separation", score).drop("lo", "hi", "linked")
