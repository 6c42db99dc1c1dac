"""Written defaults of the retrieval and index settings.

The numbers are fixed values: results depend on them, so they are stated as they are.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalSettings:
    top_k: int = 8
    per_shard_top_k: int = 25
    oversample: int = 6
    category_oversample: int = 2
    phrase_group_factor: int = 2
    distance_match: float = 0.85
    distance_both: float = 0.90
    distance_other: float = 1.0
    rank_match: float = 1.15
    rank_both: float = 1.10
    rank_other: float = 1.0
    exact_distance_factor: float = 0.65
    phrase_distance_factor: float = 0.82
    keyword_exact_bonus: float = 1.25
    keyword_phrase_bonus: float = 0.35
    summary_exact_bonus: float = 0.80
    summary_phrase_bonus: float = 0.25
    vector_weight: float = 0.45
    keyword_weight: float = 0.25
    summary_weight: float = 0.30
    extra_signal_bonus: float = 0.15
    exact_bonus: float = 0.20
    phrase_bonus: float = 0.08
    auto_pick_ratio: float = 999.0
    auto_pick_gap: float = 999.0
    top2_ratio: float = 1.5
    keep_ratio: float = 0.8
    min_candidates: int = 2
    max_candidates: int = 10
    rerank_window: int = 5
    tie_margin: float = 0.08
    tie_topk: int = 2
    rescore_families: bool = True
    group_size: int = 5
    small_pool: int = 10
    snippet_chars: int = 800
    # A paragraph over passage_chars gives passages of that length, one every passage_step characters.
    passage_chars: int = 600
    passage_step: int = 350


@dataclass(frozen=True)
class IndexSettings:
    shard_size: int = 200
    sample_size: int = 250
    max_content_chars: int = 100_000
    vector_dim: int = 64
    ivf_lists: int = 100
    ivf_probes: int = 10


RETRIEVAL = RetrievalSettings()
INDEX = IndexSettings()

# Weight of a token by the label of the field it was found in.
LABEL_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

# Label of every searchable field.
KEYWORD_LABELS = {
    "specific": "A",
    "generic": "B",
    "usecase": "B",
    "acronym": "C",
    "entity": "D",
}
TOPIC_LABEL = "B"
SUMMARY_LABELS = {
    "primary_intent": "A",
    "query_triggers": "A",
    "summary": "A",
    "content": "B",
    "secondary_mentions": "D",
}
