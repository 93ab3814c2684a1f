"""Run-time parameters, passed explicitly to every transform that needs them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults of the retrieval contract.
    chunk_size: int = 500
    chunk_overlap: int = 80
    retrieval_top_k: int = 10
    answer_top_k: int = 5
    follow_up_top_k: int = 20
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    hash_dim: int = 384
    history_limit: int = 8
    # Corpus-specific wording rules on or off (the ablation switch).
    adaptations: bool = True
    # "hash" uses feature-hash vectors, "none" is lexical retrieval only.
    vector_mode: str = "hash"
    # Questions and question tokens that one scan of the corpus serves; larger
    # sets are served in as many blocks as it takes, each in the same way.
    block_questions: int = 256
    block_tokens: int = 16_384

    def __post_init__(self) -> None:
        if self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be in [0, chunk_size)")
        if self.rrf_k < 0:
            raise ValueError("rrf_k must not be negative")
        if self.hash_dim <= 0:
            raise ValueError("hash_dim must be positive")
        if self.block_questions <= 0 or self.block_tokens <= 0:
            raise ValueError("question blocks must not be empty")


DEFAULT_SETTINGS = Settings()
