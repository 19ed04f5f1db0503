"""Settings of the pipeline, passed to the operators that need them."""

from __future__ import annotations

from dataclasses import dataclass


# The defaults of all settings.


@dataclass(frozen=True)
class ChunkConfig:
    heading_max_chars: int = 120
    heading_max_words: int = 12
    title_ratio_tenths: int = 6
    min_section_words: int = 10
    max_words: int = 150
    overlap_words: int = 30
    min_chunks: int = 3


@dataclass(frozen=True)
class RetrievalConfig:
    final_k: int = 3
    noise_k: int = 2
    mmr_lambda: float = 0.5
    dimensions: int = 96

    def __post_init__(self) -> None:
        if not 0 <= self.mmr_lambda <= 1:
            raise ValueError("mmr_lambda must lie between 0 and 1")
        if self.final_k <= 0 or self.noise_k < 0:
            raise ValueError("final_k must be positive and noise_k not negative")


@dataclass(frozen=True)
class NoiseConfig:
    pool_limit: int = 500
    seed: int = 42
    strict_exclusion: bool = True
    shuffle: bool = True


@dataclass(frozen=True)
class PromptConfig:
    tokens_each: int = 256
    token_budget: int = 1200
    max_contexts: int = 3
    max_input_length: int = 1536
    task_prefix: str = "summarize"


# The query templates.
QUERY_TEMPLATES = (
    "Summarize the main contribution of this paper",
    "Summarize the proposed method and main findings of this paper",
    "What problem does this paper address and how does it solve it?",
)
NOISE_MODES = ("cross_doc_easy", "cross_doc_hard", "cross_document")
