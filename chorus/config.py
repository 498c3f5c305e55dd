"""Defaults of the library, one immutable record per area."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TfidfConfig:
    max_features: int = 10_000
    ngram_min: int = 1
    ngram_max: int = 3
    min_df: int = 5
    max_df: float = 0.95


@dataclass(frozen=True)
class LogRegConfig:
    """Inverse regularisation, iterations at most, and the gain at which training ends."""

    c: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-4


@dataclass(frozen=True)
class ForestConfig:
    """Spark caps tree depth at 30; deeper trees are not available."""

    trees: int = 100
    max_depth: int = 30
    min_leaf: int = 4
    seed: int = 42


@dataclass(frozen=True)
class BoostConfig:
    """Nodes of fewer than ``min_split`` rows stay leaves; at most ``bins`` edges a feature."""

    rounds: int = 100
    step: float = 0.1
    max_depth: int = 5
    min_split: int = 10
    min_leaf: int = 1
    bins: int = 32


@dataclass(frozen=True)
class SvmConfig:
    """As for logistic regression."""

    c: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-4


@dataclass(frozen=True)
class Word2VecConfig:
    vector_size: int = 300
    window: int = 5
    min_count: int = 5
    epochs: int = 10
    seed: int = 42
    negatives: int = 5
    step: float = 0.025


@dataclass(frozen=True)
class RequestConfig:
    """Limits a scoring request must keep."""

    max_chars: int = 5000
    max_batch: int = 100


@dataclass(frozen=True)
class CommentConfig:
    """How a fetched comment becomes a post."""

    min_chars: int = 20
    max_chars: int = 1000
    source: str = "youtube"
    key_prefix: str = "youtube_"
    location: str = "India"
    default_author: str = "Unknown"
    url_prefix: str = "https://www.youtube.com/watch?v="
