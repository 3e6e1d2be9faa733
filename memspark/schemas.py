"""Enumerations, defaults and column shapes of the memory engine."""

from __future__ import annotations

from dataclasses import dataclass

# The engine's types, and what other spellings of them mean.
NETWORKS = ("world", "experience", "observation", "opinion")
FACT_TYPES = {"world": "world", "experience": "experience", "opinion": "experience", "observation": "experience"}
LINK_TYPES = ("temporal", "semantic", "entity", "causal")
CHANNELS = ("semantic", "keyword", "graph", "temporal")

FACTS = "fact_id bigint, bank_id bigint, content string, fact_type string, network string, entity_ids array<bigint>, evidence_ids array<bigint>, temporal_start timestamp_ntz, temporal_end timestamp_ntz, embedding array<float>, confidence double, source_turn_id bigint, created_at timestamp_ntz, updated_at timestamp_ntz, consolidated_at timestamp_ntz"
ENTITIES = "entity_id bigint, bank_id bigint, name string, entity_type string, aliases array<string>"
LINKS = "source_id bigint, target_id bigint, link_type string, weight double"
SOURCES = "source_id bigint, bank_id bigint, content string, context string, speaker string, rendered_input string, timestamp timestamp_ntz, created_at timestamp_ntz"
FACT_SOURCES = "fact_id bigint, source_id bigint"
BANKS = "bank_id bigint, name string, mission string, directives array<string>, skepticism int, literalism int, empathy int, bias_strength double, embedding_model string, embedding_dims int"


@dataclass(frozen=True)
class RecallConfig:
    """Knobs of a recall; the defaults are the engine's."""

    channel_limit: int = 40
    max_facts: int = 50
    token_budget: int = 4096
    rrf_k: float = 60.0
    hops: int = 3
    decay: float = 0.7
    threshold: float = 0.1
    seeds: int = 10
    graph_limit: int = 50
    causal_boost: float = 1.5


@dataclass(frozen=True)
class LinkConfig:
    """Knobs of the link builders."""

    semantic: float = 0.7
    days: int = 30
    causal_cap: int = 10
