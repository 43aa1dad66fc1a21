"""Cut candidates between elements with their signals, their score, and the cuts of an oversized region."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.graph import QUESTION
from strandline.settings import Settings

DEFAULTS = Settings()

# Weights of the signals in a candidate's score, tokens of a unit, and the loss that forbids a cut.
WEIGHTS = {"structural_strength": 1.2, "semantic_shift": 1.0, "speaker_change": 1.0, "temporal_gap": 1.0, "pause_strength": 1.0, "visual_change": 0.9, "scene_change": 0.9, "ocr_change": 0.8, "graph_separation": 0.8, "multimodal_consensus": 1.1}
LOSS_WEIGHT, DEVIATION_WEIGHT, LIST_PENALTY = 1.5, 0.6, 0.5
TARGET_TOKENS, MAX_TOKENS, MAX_LOSS = 500, 700, 1.0
OPTIONAL = {"level": "int", "t0": "double", "t1": "double", "speaker": "string", "visual_summary": "string", "scene": "string", "visual_change_type": "string", "ocr_text": "string", "semantic_shift": "double", "heading_path": "array<string>"}


def candidates(elements: DataFrame, edges: DataFrame, region: list[str]) -> DataFrame:
    """A row for each place before an element but a region's first: ``pos``, signals, ``loss`` of edges that the cut
    severs within the region, and ``vetoed`` (after a heading, or inside a caption's pair)."""
    for name, kind in OPTIONAL.items():
        if name not in elements.columns:
            elements = elements.withColumn(name, F.lit(None).cast(kind))
    order = Window.partitionBy("doc_id", *region).orderBy("pos")
    fields = ["pos", "kind", "asks", *OPTIONAL]
    said = F.trim("text") if "text" in elements.columns else F.lit("")
    rows = elements.withColumn("asks", said.endswith("?") | said.rlike(QUESTION)).withColumn("b", F.lag(F.struct(*fields)).over(order))
    rows = rows.withColumns({"before": F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), "first": F.min("pos").over(Window.partitionBy("doc_id", *region)), "last": F.max("pos").over(Window.partitionBy("doc_id", *region))})
    rows = rows.filter("b is not null")
    linked = edges.filter("type != 'next'").select("doc_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "type").groupBy("doc_id", "lo", "hi").agg(F.bool_or(F.col("type").isin("captions", "captioned_by")).alias("captioned"))
    rows = rows.withColumns({"lo": F.col("b.pos"), "hi": F.col("pos")}).join(linked, ["doc_id", "lo", "hi"], "left").drop("lo", "hi")

    at, b = F.col, lambda c: F.col(f"b.{c}")
    gap = F.greatest(F.lit(0.0), at("t0") - b("t1"))
    change = b("speaker").isNotNull() & at("speaker").isNotNull() & (b("speaker") != at("speaker"))
    visual, seen = F.coalesce(at("visual_change_type"), b("visual_change_type")), lambda c: F.coalesce(c("visual_summary"), c("scene"))
    differs = lambda x, y: x.isNotNull() & y.isNotNull() & (x != y)
    zero = F.lit(0.0)
    floats = lambda c: c("kind").isin("table", "figure")
    pair = F.coalesce(F.col("captioned"), F.lit(False)) & ((b("kind") == "caption") & floats(at) | floats(b) & (at("kind") == "caption"))
    signals = {
        "structural_strength": F.when(at("kind") == "heading", F.greatest(F.lit(0.6), 1 - 0.15 * (F.coalesce(at("level"), F.lit(1)) - 1))).otherwise(zero),
        "list_continuation": F.when((at("kind") == "list_item") & (b("kind") == "list_item"), 1.0).otherwise(zero),
        "temporal_gap": F.coalesce(F.least(F.lit(1.0), gap / 3), zero),
        "speaker_change": F.when(change, 1.0).otherwise(zero),
        "pause_strength": F.when(~change & (gap >= 2), F.least(F.lit(1.0), gap / 5)).otherwise(zero),
        "visual_change": F.when(visual == "shot", 0.35).when(visual.isNotNull() | differs(seen(at), seen(b)), 0.85).otherwise(zero),
        "scene_change": F.when(at("kind") == "visual_event", 0.95).otherwise(zero),
        "ocr_change": F.when(differs(at("ocr_text"), b("ocr_text")), 0.8).otherwise(zero),
        "qa_transition": F.when(b("asks"), 0.9).otherwise(zero),
        "graph_separation": F.when(F.col("captioned").isNotNull(), 0.1).when(~at("heading_path").eqNullSafe(b("heading_path")), 0.95).otherwise(F.lit(0.5)),
        "semantic_shift": F.coalesce(at("semantic_shift"), zero),
    }
    rows = rows.withColumns({"vetoed": (b("kind") == "heading") | pair, **{f"s_{k}": v for k, v in signals.items()}})
    seen_change = F.when(F.col("s_visual_change") > 0, F.col("s_visual_change")).otherwise(F.col("s_scene_change"))  # one sign, whichever it is
    own = [F.col(f"s_{k}") for k in ("structural_strength", "semantic_shift", "speaker_change", "temporal_gap", "pause_strength", "ocr_change")]
    strong = sum(((s > 0.5).cast("int") for s in (*own, seen_change)), F.lit(0))
    rows = rows.withColumn("s_multimodal_consensus", F.when(strong >= 2, F.least(F.lit(1.0), 0.4 + 0.2 * strong)).otherwise(zero))
    losses = _losses(elements.select("doc_id", *region, "pos"), edges, region)
    rows = rows.join(losses, ["doc_id", *region, "pos"], "left").withColumn("loss", F.coalesce("loss", zero))
    return rows.select("doc_id", *region, "pos", F.col("before").alias("tokens_before"), "vetoed", "loss", *[F.col(f"s_{k}").alias(k) for k in (*signals, "multimodal_consensus")])


def _losses(places: DataFrame, edges: DataFrame, region: list[str]) -> DataFrame:
    """Importance severed by a cut before each element: running sums of differences at the ends of edges in a region."""
    real = edges.filter("type != 'next' and src != dst").select("doc_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "importance")
    lo, hi = places.withColumnRenamed("pos", "lo"), places.withColumnRenamed("pos", "hi")
    inside = real.join(lo, ["doc_id", "lo"]).join(hi, ["doc_id", *region, "hi"])
    ends = inside.select("doc_id", *region, F.explode(F.array(F.struct((F.col("lo") + 1).alias("pos"), F.col("importance").alias("d")), F.struct((F.col("hi") + 1).alias("pos"), (-F.col("importance")).alias("d")))).alias("x"))
    deltas = ends.select("doc_id", *region, "x.pos", "x.d").unionByName(places.withColumn("d", F.lit(0.0))).groupBy("doc_id", *region, "pos").agg(F.sum("d").alias("d"))
    run = Window.partitionBy("doc_id", *region).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("loss", F.round(F.sum("d").over(run), 6)).drop("d")


def weights(own: Settings) -> dict[str, float]:
    """The signals' weights by the settings; by default WEIGHTS."""
    time, seen = own.weight_temporal, own.weight_visual
    return {"structural_strength": own.weight_structure, "semantic_shift": own.weight_semantic, "speaker_change": time, "temporal_gap": time, "pause_strength": time, "visual_change": seen, "scene_change": seen, "ocr_change": own.weight_ocr, "graph_separation": own.weight_graph, "multimodal_consensus": own.weight_consensus}


def score(tokens_before: Column, loss: Column, target: int = TARGET_TOKENS, own: Settings = DEFAULTS) -> Column:
    weighted = sum((w * F.col(k) for k, w in weights(own).items()), F.lit(0.0))
    deviation = F.abs(tokens_before - target) / max(1, target)
    return weighted - own.weight_relationship_loss * loss - own.weight_fragmentation * deviation - F.when(F.col("list_continuation") > 0, LIST_PENALTY).otherwise(0.0)


def choose_cut(scored: DataFrame, region: list[str], target: int = TARGET_TOKENS) -> DataFrame:
    """The best legal place to cut each region once: the highest score, of equal ones the first. None if all are forbidden."""
    rows = scored.withColumn("score", score(F.col("tokens_before"), F.col("loss"), target)).filter(~F.col("vetoed") & (F.col("loss") < MAX_LOSS))
    return rows.groupBy("doc_id", *region).agg(F.max_by(F.struct("pos", "score"), F.struct("score", -F.col("pos"))).alias("c")).select("doc_id", *region, "c.pos", "c.score")


def cut_regions(elements: DataFrame, edges: DataFrame, region: list[str], target: int = TARGET_TOKENS, most: int = MAX_TOKENS, settings: Settings = DEFAULTS) -> DataFrame:
    """``elements`` with ``part`` and ``overflow``: a region of over ``most`` tokens is cut at its best place, what is left
    of the cut stays as it is, what is right is cut again while it is too large; without a legal cut it overflows.

    Most regions fit and never leave the built-in operators. Of the others, only numbers go to the sequential step:
    the edges' losses within what is right of the last cut are the region's less those of edges that begin before it.
    """
    sizes = elements.groupBy("doc_id", *region).agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("size") > most).select("doc_id", *region)
    own = elements.join(large, ["doc_id", *region], "left_semi")
    found = candidates(own, edges, region)
    loss_weight, deviation_weight = settings.weight_relationship_loss, settings.weight_fragmentation
    base = score(F.lit(0), F.lit(0.0), target, settings) + deviation_weight * abs(0 - target) / max(1, target)
    slim = own.select("doc_id", *region, "pos", "n_tokens").join(found.select("doc_id", *region, "pos", "vetoed", base.alias("base")), ["doc_id", *region, "pos"], "left")
    lo, hi = own.select("doc_id", *region, F.col("pos").alias("lo")), own.select("doc_id", *region, F.col("pos").alias("hi"))
    real = edges.filter("type != 'next' and src != dst").select("doc_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "importance")
    ties = real.join(lo, ["doc_id", "lo"]).join(hi, ["doc_id", *region, "hi"]).groupBy("doc_id", *region, F.col("lo").alias("pos")).agg(F.collect_list(F.struct("hi", "importance")).alias("ties"))
    slim = slim.join(ties, ["doc_id", *region, "pos"], "left")

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos, veto = rows.column("pos").to_pylist(), rows.column("vetoed").to_pylist()
        at = {p: k for k, p in enumerate(pos)}
        ties = [[(at[t["hi"]], t["importance"]) for t in x or []] for x in rows.column("ties").to_pylist()]
        tokens, base = ([math.nan if x is None else x for x in rows.column(c).to_pylist()] for c in ("n_tokens", "base"))
        start, part, parts, over, n = 0, 0, [0] * len(pos), [False] * len(pos), len(pos)
        rest = list(accumulate(reversed(tokens)))[::-1]
        highest = list(accumulate((-math.inf if math.isnan(x) else x for x in reversed(base)), max))[::-1]  # of what is right of a place
        falling = loss_weight >= 0 and deviation_weight > 0 and all(weight >= 0 for x in ties for _, weight in x)
        while start < n:
            left, best, change, loss = rest[start], None, defaultdict(float), 0.0
            end = n
            if left > most:
                before = 0
                for k in range(start, n):
                    if k > start:
                        loss += change.pop(k, 0.0)
                        value = base[k] - loss_weight * loss - deviation_weight * abs(before - target) / max(1, target)
                        if not veto[k] and round(loss, 6) < MAX_LOSS and (best is None or value > best[0] + 1e-12):
                            best = value, k
                        # no place further on can be better, as what is left of it only grows
                        if falling and best and before > target and highest[k] - deviation_weight * (before - target) / max(1, target) < best[0] - 1e-9:
                            break
                    before += tokens[k]
                    for to, weight in ties[k]:
                        loss_at = k + 1
                        change[loss_at] += weight
                        change[to + 1] -= weight
                if best is None:
                    over[start:] = [True] * (n - start)
                else:
                    end = best[1]
            parts[start:end] = [part] * (end - start)
            start, part = end, part + 1
        return rows.select(["doc_id", *region, "pos"]).append_column("part", pa.array(parts, pa.int32())).append_column("overflow", pa.array(over, pa.bool_()))

    kinds = dict(elements.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *region, "pos")) + ", part int, overflow boolean"
    done = slim.groupBy("doc_id", *region).applyInArrow(cut, schema)
    rows = elements.join(done, ["doc_id", *region, "pos"], "left")
    return rows.withColumns({"part": F.coalesce("part", F.lit(0)), "overflow": F.coalesce("overflow", F.lit(False))})
