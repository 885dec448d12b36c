"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Where notes and index live, and how texts are cut, embedded and searched."""

    vault_dir: str
    store_dir: str
    chunk_tokens: int = 700
    overlap_tokens: int = 100
    dim: int = 768
    pool: int = 30
    k_rrf: int = 60

    @property
    def chunk_chars(self) -> int:
        return self.chunk_tokens * 4

    @property
    def overlap_chars(self) -> int:
        return self.overlap_tokens * 4
