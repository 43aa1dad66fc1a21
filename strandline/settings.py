"""The engine's settings, from Spark's configuration under ``strandline.``, checked when they are read."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "strandline."


@dataclass(frozen=True, slots=True)
class Settings:
    llm: str = ""
    enrich_batch: int = 6
    enrich_doc_chars: int = 24_000
    target_chunk_tokens: int = 500
    max_chunk_tokens: int = 700
    min_chunk_tokens: int = 80
    tabular_target_tokens: int = 900
    tabular_max_tokens: int = 1200
    completeness_threshold: float = 0.7
    weight_semantic: float = 1.0
    weight_structure: float = 1.2
    weight_temporal: float = 1.0
    weight_visual: float = 0.9
    weight_ocr: float = 0.8
    weight_graph: float = 0.8
    weight_consensus: float = 1.1
    weight_relationship_loss: float = 1.5
    weight_fragmentation: float = 0.6
    weight_shot_change: float = 0.35
    speaker_boundary_threshold: float = 0.55
    offline_fallback: bool = True
    allow_synthetic_fallback: bool = True
    evaluation_mode: bool = False


# The least that a number may be, and the kinds of model providers.
LEAST = {"enrich_batch": 1, "enrich_doc_chars": 500, "target_chunk_tokens": 50, "max_chunk_tokens": 100, "min_chunk_tokens": 10, "tabular_target_tokens": 100, "tabular_max_tokens": 150, "completeness_threshold": 0.0}
PROVIDERS = ("", "none", "ollama", "gemini")


def settings(spark: SparkSession) -> Settings:
    """What the session's configuration says; a value that can't be used raises ValueError with its name."""
    own = {}
    for f in fields(Settings):
        raw = spark.conf.get(PREFIX + f.name, None)
        if raw is None:
            continue
        kind = type(f.default)
        try:
            own[f.name] = raw.lower() not in ("0", "false", "no") if kind is bool else kind(raw)
        except ValueError:
            raise ValueError(f"{PREFIX}{f.name}={raw!r} is not a {kind.__name__}") from None
        if f.name in LEAST and own[f.name] < LEAST[f.name]:
            raise ValueError(f"{PREFIX}{f.name}={raw} is below {LEAST[f.name]}")
    found = Settings(**own)
    if found.llm not in PROVIDERS:
        raise ValueError(f"{PREFIX}llm={found.llm!r} is not one of {', '.join(p for p in PROVIDERS if p)}")
    return found
