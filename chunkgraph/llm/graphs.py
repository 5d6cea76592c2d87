"""Connected components and id filters that never gather links or ids of all documents in one place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: Ids that a semi or anti join may broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def by_id(df: DataFrame, ids: DataFrame, how: str, on: str = "doc_id") -> DataFrame:
    """A ``left_semi`` or ``left_anti`` join that broadcasts the ids only if they are at most ``BROADCAST_IDS``."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("shuffle_merge"), on, how)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's greater neighbours, tied to the least of the node and its neighbours."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours, tied to the least of these; edges must point down."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").filter("u <> v").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as edges to the least node of each of its components."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, component) for every node of ``edges`` (u long, v long) but the components' own least nodes.

    Alternates large and small stars until every edge points at the least node of its component. A hub's edges are
    joined to one row with its minimum, so a skewed join can be split; no node's neighbours are gathered.
    """
    step, label = 0, f"{name}-0"
    rows = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v")
    current = scratch.write(rows.mapInArrow(_forest, "u long, v long").filter("u <> v"), label)
    while True:
        # done once no node has two roots or is both below one and a root
        below = current.select("u").distinct()
        torn = current.groupBy("u").agg(F.count_distinct("v").alias("k")).filter("k > 1").select("u").union(current.select(F.col("v").alias("u")).join(below, "u", "left_semi"))
        if torn.isEmpty():
            return current.select("u", F.col("v").alias("component")).distinct()
        step += 1
        raised = scratch.write(_large_star(current), f"{name}-raised-{step}")
        current = scratch.write(_small_star(raised), f"{name}-{step}")
        scratch.drop(label, f"{name}-raised-{step}")
        label = f"{name}-{step}"
