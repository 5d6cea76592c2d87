"""Similarity joins whose sides are both larger than what a task holds."""

import numpy as np
import pytest

from chunkgraph.config import EngineConfig
from chunkgraph.functions import vectors
from chunkgraph.operators import graphs


@pytest.fixture
def few_held(monkeypatch):
    monkeypatch.setattr(vectors, "HELD", 16)
    monkeypatch.setattr(vectors, "BLOCK", 16)


def unit_vectors(n, size, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, size))
    return v / np.linalg.norm(v, axis=1)[:, None]


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node_id long, emb array<double>")


def test_codes_of_two_large_sides(spark, few_held):
    v = unit_vectors(60, 8)
    bits = v @ graphs.plane_signs(8, 128, 42) >= 0
    far = (bits[:, None] != bits[None]).sum(axis=2)
    expected = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (far[i, j], j))[:10] if v[i] @ v[j] > 0.3}
    assert {(r.src, r.dst) for r in graphs.lsh(frame(spark, v), EngineConfig(sim_threshold=0.3, k=10)).collect()} == expected


@pytest.mark.parametrize("k, distinct, threshold, scale", [(None, True, 0.3, 1.0), (3, True, 0.2, 1.0), (3, False, float("-inf"), 1e3), (70, True, -1.0, 1.0), (None, False, 0.0, 1e25)])
def test_grid_of_blocks(spark, few_held, monkeypatch, k, distinct, threshold, scale):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1)
    monkeypatch.setattr(vectors, "BLOB_BYTES", 512)
    monkeypatch.setattr(vectors, "CELLS_SHARE", 0.0)
    v = np.concatenate([unit_vectors(60, 8), unit_vectors(9, 8)[:5]]) * scale  # five twice
    s = np.round(v @ v.T, 12)
    expected = set()
    for i in range(len(v)):
        good = sorted((j for j in range(len(v)) if s[i, j] >= threshold and (i != j or not distinct)), key=lambda j: (-s[i, j], j))
        expected |= {(i, j) for j in good[:k]}
    found = vectors.similarity_join(frame(spark, v), frame(spark, v), threshold, inclusive=True, k=k, distinct=distinct).collect()
    assert len(found) == len(expected)
    assert {(r.src, r.dst) for r in found} == expected
    assert all(abs(r.weight - s[r.src, r.dst]) <= 1e-9 * scale**2 for r in found)


@pytest.mark.parametrize("size, k, threshold, inclusive", [(16, 3, -128.0, True), (16, None, 0.0, False), (3, 4, 2.0, True), (40, 80, float("-inf"), True), (2, 2, float("inf"), True)])
def test_codes_are_compared_as_they_are_packed(monkeypatch, size, k, threshold, inclusive):
    """In tiles of bounded size, in several goes, with many ties; a product is the bits less twice the distance."""
    monkeypatch.setattr(vectors, "CODE_COLUMNS", 16)
    monkeypatch.setattr(vectors, "CODE_PAIRS", 100)
    rng = np.random.default_rng(5)
    x, m = (rng.integers(0, 256, (n, size), dtype=np.uint8) for n in (40, 70))
    m[:40], m[50:60] = x, x[0]
    own, other = np.arange(40) * 3 % 41, np.arange(70) + 100
    other[:40] = own
    s = (np.unpackbits(x, axis=1) * 2.0 - 1) @ (np.unpackbits(m, axis=1) * 2.0 - 1).T
    expected = []
    for i in range(40):
        good = sorted((j for j in range(70) if own[i] != other[j] and (s[i, j] >= threshold if inclusive else s[i, j] > threshold)), key=lambda j: (-s[i, j], other[j]))
        expected += [(i, other[j], s[i, j]) for j in good[:k]]
    found = vectors._Found(k, 40)
    found.kept = 60
    pairs = []
    for part in (slice(0, 30), slice(30, 70)):
        for row in vectors._pairs(own, x, other[part], m[part], threshold, inclusive, k, True, found.low, found.last):
            pairs.extend(zip(*row)) if k is None else found.put(*row)
    if k is not None and found.held:
        pairs = list(zip(*found.best()[:3]))
    assert sorted(pairs) == sorted(expected)
