"""Parameters of indexing and retrieval, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Defaults that results depend on.
    chunk_tokens: int = 1200
    chunk_overlap: int = 100
    search_window: float = 0.2
    unit_percentile: float = 60.0
    unit_min_words: int = 20
    unit_max_words: int = 200
    merge_cosine: float = 0.90
    merge_name_similarity: float = 0.72
    top_k: int = 5
    max_hops: int = 3
    hop_top_k: int = 15
    hop_decay: float = 0.5
    conductance_floor: float = 0.5
    conductance_gamma: float = 1.0
    steering_alpha: float = 0.7
    steering_top_k: int = 3
    rerank_candidates: int = 30
    # 0.7 is what the benchmark runs are made with; a library default of 0.5 is common as well.
    scoring_lambda: float = 0.7
    # Off, as the default reranker is a stand-in without a model; switch it on with one.
    rerank: bool = False
    # Own choices.
    chunk_semantic: bool = True
    question_prefix: str = ""  # text.QUESTION_PREFIX for models that want it
    gate: str = "question"
    fallback: str = "dense"
    unit_passage: str = "last"
    embed_dim: int = 256
