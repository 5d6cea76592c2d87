"""Tables, and graphs as versioned folders."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.runtime import Metrics
from ..operators.stats import graph_metrics
from ..scratch import Scratch
from .readers import identifier


def create(spark: SparkSession, name: str, schema: str | None = None) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {identifier(name)} ({schema or schemas.STORES[name]}) USING parquet")


def append(rows: DataFrame, name: str) -> None:
    """Adds rows in one job; columns that the rows lack are null."""
    spark = rows.sparkSession
    create(spark, name)
    fields = spark.table(name).schema.fields
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.mode("append").insertInto(name)


def clear(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {identifier(name)}")


def reset(spark: SparkSession, erase_all: bool = False, chunks: bool = False, embeddings: bool = False, chat: bool = False) -> list[str]:
    """Empties the asked stores; their names."""
    names = [n for n, asked in (("chunks", chunks), ("embed_vector", embeddings), ("chatbot", chat)) if asked or erase_all]
    if not names:
        raise ValueError("nothing to reset")
    for n in names:
        create(spark, n)
        clear(spark, n)
    return names


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows but those whose key comes again, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_batches(rows: DataFrame, name: str, prepare: Callable[[DataFrame], DataFrame] = lambda batch: batch, batches: int = 10, key: str | None = None) -> DataFrame:
    """Adds rows batch by batch, and tells (batch, status, error) of each; an error only if all fail.

    Rows are dealt to batches by a hash (of ``key``, or of the whole row) and written to the shared folder once; a batch then is prepared and
    appended by a job of its own, which reads no other, and a batch that fails leaves nothing behind."""
    if batches < 1:
        raise ValueError("there must be a batch")
    spark = rows.sparkSession
    with Scratch(spark, "batches") as scratch:
        dealt = rows.withColumn("batch_", F.pmod(F.xxhash64(*([key] if key else rows.columns)), F.lit(batches)).cast("int"))
        dealt.repartition("batch_").write.partitionBy("batch_").parquet(f"{scratch.path}/rows")
        held = scratch.read("rows", dealt.schema)
        known = sorted(r.batch_ for r in held.select("batch_").distinct().collect())
        outcomes = []
        for b in known:
            try:
                append(prepare(held.filter(F.col("batch_") == b).drop("batch_")), name)
                outcomes.append((b, "success", None))
            except Exception as e:  # the batch's outcome; the others go on
                outcomes.append((b, "failed", str(e).partition("\n")[0]))
    if outcomes and all(o[1] == "failed" for o in outcomes):
        raise RuntimeError(f"all {len(outcomes)} batches failed: {outcomes[0][2]}")
    return spark.createDataFrame(outcomes, "batch int, status string, error string")


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str, compress: bool = True) -> None:
    """A graph as one node-link document: nodes {id, text, emb}, links {source, target, weight}, in the order in which
    a path search follows them. One task writes it, row by row."""
    n = nodes.select(F.lit(1).alias("part"), F.col("node_id").alias("a"), F.lit(0).alias("b"), F.to_json(F.struct("text", "emb", F.col("node_id").alias("id"))).alias("value"))
    rank = F.col("nbr_rank").cast("int") if "nbr_rank" in edges.columns else F.lit(0)
    e = edges.select(F.lit(3).alias("part"), F.col("src").alias("a"), rank.alias("b"), F.to_json(F.struct("weight", F.col("src").alias("source"), F.col("dst").alias("target"))).alias("value"))
    marks = [(0, None, None, '{"directed": true, "multigraph": false, "graph": {}, "nodes": ['), (2, None, None, '], "links": ['), (4, None, None, "]}")]
    frame = nodes.sparkSession.createDataFrame(marks, "part int, a long, b int, value string")
    rows = n.union(e).union(frame)
    order = Window.partitionBy("part").orderBy("a", "b", "value")
    lines = rows.repartition(1).withColumn("comma", F.when((F.row_number().over(order) > 1) & (F.col("part") % 2 == 1), ",").otherwise(""))
    lines = lines.sortWithinPartitions("part", "a", "b", "value").select(F.concat("comma", "value").alias("value"))
    lines.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def graph_json(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node-link records as JSON lines: {id, text, emb} and {source, target, weight}."""
    n = nodes.select(F.to_json(F.struct(F.col("node_id").alias("id"), "text", "emb")).alias("value"))
    e = edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight")).alias("value"))
    return n, e


class GraphStore:
    """Graphs by id; each save is a new version, so a reader never sees a half-written graph."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, graph_id: str, version: int) -> str:
        return f"{self.path}/graph_id={graph_id}/version={version}"

    def versions(self, graph_id: str) -> list[int]:
        """The versions that were written to their end, ascending."""
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{self.path}/graph_id={graph_id}")
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        found = [s.getPath() for s in fs.listStatus(base)]
        return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/meta/_SUCCESS")))

    def save(self, graph_id: str, nodes: DataFrame, edges: DataFrame, method: str = "", reason: str = "manual", fmt: str = "parquet", compress: bool = True, metrics: Metrics | None = None) -> int:
        """The version that nodes and edges become. With metrics, their numbers and the time to make them are taken from
        the jobs that write them."""
        if metrics is not None:
            (nodes, n), (edges, e) = metrics.observe(nodes, "nodes_processed"), metrics.observe(edges, "edges_created")
            with metrics.timed("graph_build_time"):
                version = self._save(graph_id, nodes, edges, method, reason, fmt, compress)
            metrics.take(n, "nodes_processed")
            metrics.take(e, "edges_created")
            return version
        return self._save(graph_id, nodes, edges, method, reason, fmt, compress)

    def _save(self, graph_id: str, nodes: DataFrame, edges: DataFrame, method: str, reason: str, fmt: str, compress: bool) -> int:
        if fmt not in ("parquet", "json"):
            raise ValueError("format must be parquet or json")
        version = max(self.versions(graph_id), default=0) + 1
        at, codec = self._at(graph_id, version), "gzip" if compress else "none"
        if fmt == "json":
            for rows, name in zip(graph_json(nodes, edges), ("nodes", "edges")):
                rows.write.mode("overwrite").option("compression", codec).text(f"{at}/{name}")
        else:
            nodes.write.mode("overwrite").option("compression", codec).parquet(f"{at}/nodes")
            edges.write.mode("overwrite").option("compression", codec).parquet(f"{at}/edges")
        # counted on what has been written
        meta = graph_metrics(*self._tables(at, fmt)).select(F.lit(graph_id).alias("graph_id"), F.lit(version).alias("version"), F.lit(method).alias("method"), "*", F.lit(datetime.now(timezone.utc)).cast("timestamp").alias("built_at"), F.lit(reason).alias("reason"), F.lit(fmt).alias("format"))
        meta.write.mode("overwrite").json(f"{at}/meta")
        return version

    def load(self, graph_id: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of a version, the last by default."""
        known = self.versions(graph_id)
        if not known or (version is not None and version not in known):
            raise ValueError(f"no such graph: {graph_id!r}, version {version}")
        at = self._at(graph_id, version or known[-1])
        return self._tables(at, self.meta(graph_id, version or known[-1]).first()["format"])

    def _tables(self, at: str, fmt: str) -> tuple[DataFrame, DataFrame]:
        if fmt == "parquet":
            return self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/edges")
        nodes = self.spark.read.schema("id long, text string, emb array<double>").json(f"{at}/nodes")
        edges = self.spark.read.schema("source long, target long, weight double").json(f"{at}/edges")
        return nodes.select(F.col("id").alias("node_id"), "text", "emb"), edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight")

    def meta(self, graph_id: str, version: int) -> DataFrame:
        return self.spark.read.json(f"{self._at(graph_id, version)}/meta")
