"""Driver-side helpers: metrics, a retrieval cache that knows graph versions, and the checkpoint policy."""

from __future__ import annotations

import time
from collections import OrderedDict
from contextlib import contextmanager
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import Scratch

#: The names that metrics may have.
METRICS = ("graph_build_time", "retrieval_time", "path_pruning_time", "nodes_processed", "edges_created", "paths_pruned", "cache_hits", "cache_misses")


@dataclass
class Metrics:
    """Named counters that several threads may change; an unknown name is an error."""

    values: dict[str, float] = field(default_factory=lambda: dict.fromkeys(METRICS, 0))
    lock: Lock = field(default_factory=Lock, repr=False)

    def add(self, name: str, by: float = 1) -> None:
        with self.lock:
            self.values[self._known(name)] += by

    def put(self, name: str, value: float) -> None:
        with self.lock:
            self.values[self._known(name)] = value

    def report(self) -> dict[str, float]:
        with self.lock:
            return dict(self.values)

    def _known(self, name: str) -> str:
        if name not in self.values:
            raise KeyError(f"unknown metric {name!r}")
        return name

    @contextmanager
    def timed(self, name: str):
        """Adds the seconds of a block to a metric, however it ends."""
        self._known(name)
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add(name, time.perf_counter() - began)

    def observe(self, rows: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, Observation]:
        """The rows with a count (of rows, if nothing else is asked) that their own job takes, so that no job is run for
        it; ``take`` adds it."""
        seen = Observation(self._known(name))
        return rows.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")), seen

    def take(self, seen: Observation, name: str) -> None:
        self.add(name, seen.get["n"])


class RetrievalCache:
    """Ranked ids by graph, its version, query and top_k; the oldest entry goes first. A new version misses."""

    def __init__(self, most: int = 100, seconds: float = 3600, metrics: Metrics | None = None):
        self.most, self.seconds, self.metrics = most, seconds, metrics or Metrics()
        self.entries: OrderedDict[tuple, tuple[float, list[int]]] = OrderedDict()

    def get(self, graph_id: str, version: int, query: str, top_k: int) -> list[int] | None:
        found = self.entries.get((graph_id, version, query, top_k))
        if found is None or time.monotonic() - found[0] > self.seconds:
            self.metrics.add("cache_misses")
            return None
        self.metrics.add("cache_hits")
        return found[1]

    def put(self, graph_id: str, version: int, query: str, top_k: int, ids: list[int]) -> None:
        self.entries[graph_id, version, query, top_k] = (time.monotonic(), ids)
        while len(self.entries) > self.most:
            self.entries.popitem(last=False)


@dataclass
class CheckpointPolicy:
    """A checkpoint is due after so many items or minutes since the last."""

    every: int = 1000
    minutes: float = 10
    last: int = 0
    at: float = field(default_factory=time.monotonic)

    def due(self, processed: int) -> bool:
        return processed - self.last >= self.every or (time.monotonic() - self.at) / 60 >= self.minutes

    def done(self, processed: int) -> None:
        self.last, self.at = processed, time.monotonic()


@contextmanager
def session(cache: RetrievalCache | None = None, *frames: DataFrame, scratch: Scratch | None = None):
    """A block after which the cache is empty, the frames are no longer kept and the scratch tables are gone."""
    try:
        yield
    finally:
        if cache is not None:
            cache.entries.clear()
        for f in frames:
            f.unpersist()
        if scratch is not None:
            scratch.close()


def checkpoint(store, graph_id: str, nodes: DataFrame, edges: DataFrame, processed: int, policy: CheckpointPolicy, reason: str = "auto") -> int | None:
    """Saves the graph as a new version if the policy says so; the version, or none."""
    if not policy.due(processed):
        return None
    version = store.save(graph_id, nodes, edges, reason=reason)
    policy.done(processed)
    return version
