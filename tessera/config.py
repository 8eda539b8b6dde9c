"""Engine settings with their bounds."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size_tokens: int = 400
    chunk_overlap_tokens: int = 80
    min_chunk_chars: int = 80
    retrieval_candidates: int = 40
    retrieval_top_k: int = 6
    rrf_k: int = 60
    rrf_rank_base: int = 1
    embedding_dim: int = 768
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    llm_temperature: float = 0.1
    #: Chunks that an ingest embeds and stores at a time; a broken run goes on behind the last such slice.
    commit_chunks: int = 50_000

    def __post_init__(self) -> None:
        bounds = {
            "chunk_size_tokens": (64, 4096), "chunk_overlap_tokens": (0, 2048), "min_chunk_chars": (0, None), "retrieval_candidates": (1, 500),
            "retrieval_top_k": (1, 100), "rrf_k": (1, None), "embedding_dim": (1, None), "commit_chunks": (1, None), "llm_temperature": (0, 2),
        }
        for name, (low, high) in bounds.items():
            value = getattr(self, name)
            if value < low or (high is not None and value > high):
                raise ValueError(f"{name} is {value}; it must lie in {low}..{high if high is not None else ''}")
        if self.chunk_overlap_tokens >= self.chunk_size_tokens:
            raise ValueError("chunk_overlap_tokens must be smaller than chunk_size_tokens")

    def snapshot(self) -> dict[str, str]:
        """The settings as a map to store beside an evaluation run."""
        return {k: str(v) for k, v in asdict(self).items()}
