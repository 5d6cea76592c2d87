"""Engine settings, profiles and the parsing of settings from text."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EngineConfig:
    """Everything that shapes a graph and a retrieval; checked on creation.

    The limits max_candidates, max_paths_per_pair and max_graph_size are None for no limit."""

    k: int = 10
    sim_threshold: float = 0.7
    decay_rate: float = 0.8
    prune_thresh: float = 0.1
    metric: str = "cosine"
    n_clusters: int = 50
    intra_k: int = 5
    inter_k: int = 3
    inter_centroid: float = 0.5
    inter_chunk: float = 0.6
    inter_members: int = 3
    sample_ratio: float = 0.1
    lsh_planes: int = 128
    seed: int = 42
    max_candidates: int | None = 100
    max_paths_per_pair: int | None = 10
    max_graph_size: int | None = 100_000
    batch_size: int = 1000
    max_workers: int = 4
    cache_size: int = 100
    max_memory_gb: int = 4

    def __post_init__(self):
        if not 0 < self.decay_rate <= 1:
            raise ValueError("decay_rate must be in (0, 1]")
        if self.prune_thresh < 0:
            raise ValueError("prune_thresh must not be negative")
        if not 0 <= self.sim_threshold <= 1:
            raise ValueError("sim_threshold must be in [0, 1]")
        if self.batch_size < 1 or self.max_workers < 1 or self.k < 1:
            raise ValueError("batch_size, max_workers and k must be at least 1")
        if self.metric not in ("cosine", "dot"):
            raise ValueError("metric must be cosine or dot")


#: Fixed values of the profiles.
PROFILES = {
    "development": EngineConfig(max_workers=2, batch_size=500, cache_size=100, max_memory_gb=2, max_graph_size=10_000, decay_rate=0.8, prune_thresh=0.5, sim_threshold=0.7),
    "production": EngineConfig(max_workers=8, batch_size=2000, cache_size=1000, max_memory_gb=16, max_graph_size=100_000, decay_rate=0.9, prune_thresh=0.6, sim_threshold=0.75),
    "memory": EngineConfig(max_workers=2, batch_size=200, cache_size=50, max_memory_gb=1, max_graph_size=5_000, decay_rate=0.7, prune_thresh=0.4, sim_threshold=0.65),
}


def profile(name: str, **changes) -> EngineConfig:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(PROFILES)}")
    return replace(PROFILES[name], **changes)


#: The words of consent and of refusal.
TRUE_WORDS = ("1", "true", "yes", "on", "y", "t")
FALSE_WORDS = ("0", "false", "no", "off", "n", "f")


def parse_bool(value: Column) -> Column:
    """True for the words of consent, false for those of refusal, whatever their case; null for any other text."""
    word = F.lower(F.regexp_replace(value, r"(?U)\A\s+|\s+\z", ""))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_list(value: Column) -> Column:
    """The non-empty parts between commas, trimmed."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
