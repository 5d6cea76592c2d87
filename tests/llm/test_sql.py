"""Every query of the subpackage that has SQL gives the rows, and the columns, of its SQL."""

import os

import pytest

from chunkgraph.llm import registry

DATA = "/root/testdata/sf0.001"


def rows(found, names, order):
    at = [names.index(n) for n in order]
    return sorted(tuple("" if r[i] is None else f"{r[i]:.5f}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in found)


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, db, name):
    ours = registry.QUERIES[name](spark, DATA)
    theirs = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    order = sorted(names)
    assert order == sorted(ours.columns)
    assert rows(ours.collect(), ours.columns, order) == rows(theirs.fetchall(), names, order)
