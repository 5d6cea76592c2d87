"""Counts, summaries and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("data_name").agg(F.count("*").alias("n_chunks"), F.sum("size").alias("total_size"), F.avg("size").alias("avg_size"))


def graph_metrics(nodes: DataFrame, edges: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """One row: nodes, distinct edges, edges as they were added (also those that another method had added before),
    mean of in and out degree."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count_distinct("src", "dst").alias("n_edges"))
    a = (edges if added is None else added).agg(F.count("*").alias("edges_added"))
    return n.join(F.broadcast(e)).join(F.broadcast(a)).withColumn("avg_degree", F.when(F.col("n_nodes") > 0, 2.0 * F.col("n_edges") / F.col("n_nodes")).otherwise(0.0))


def outcome_counts(rows: DataFrame, status: str = "status", *by: str) -> DataFrame:
    """Rows, successes and failures, as a whole or by columns; anything but ``success`` has failed."""
    ok = F.coalesce(F.col(status) == "success", F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failed_count"))


def insert_report(counts: DataFrame) -> DataFrame:
    """Adds the message of an insert run to outcome counts."""
    none = F.col("total") == 0
    return counts.withColumn("message", F.when(none, "No chunks generated from the input path.").otherwise(F.format_string("Chunking complete: %d inserted, %d failed.", F.col("success_count"), F.col("failed_count"))))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, degree): edges in and out; nodes without one too."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))  # edges are computed once
    return nodes.select("node_id").join(ends.groupBy("node_id").agg(F.count("*").alias("degree")), "node_id", "left").fillna(0, ["degree"])


def top_degree(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.col("degree").desc(), "node_id").limit(k)


def display_edges(edges: DataFrame, least: float) -> DataFrame:
    return edges.filter(F.col("weight").isNotNull() & (F.col("weight") >= least))


#: Marker colours by label, and that of any other.
COLOURS = {"chunk": "blue", "concept": "green", "query": "red"}
OTHER_COLOUR = "gray"


def display_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with degree (1 at least), marker size, colour by label, and hover text: the text's beginning, or the label."""
    d = degrees(nodes, edges)
    most = d.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    rows = nodes.join(d, "node_id").join(F.broadcast(most))
    label = F.coalesce(F.col("label"), F.lit("unknown")) if "label" in nodes.columns else F.lit("chunk")
    hover = F.when(F.length("text") > 120, F.concat(F.substring("text", 1, 120), F.lit("…"))).when(F.length("text") > 0, F.col("text")).otherwise(label)
    colours = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    degree = F.greatest("degree", F.lit(1))
    return rows.select("node_id", label.alias("label"), degree.alias("degree"), F.least(6 + 14.0 * degree / F.col("most"), F.lit(24.0)).alias("marker"), F.coalesce(colours[label], F.lit(OTHER_COLOUR)).alias("colour"), hover.alias("hover"))


def node_lookup(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    """One node with its numbers of edges in and out."""
    own = edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id))
    counts = own.agg(F.count_if(F.col("src") == node_id).alias("out_degree"), F.count_if(F.col("dst") == node_id).alias("in_degree"))
    return nodes.filter(F.col("node_id") == node_id).select("node_id", "text").join(F.broadcast(counts))


def health(metrics: DataFrame, memory_gb: Column, config: EngineConfig) -> DataFrame:
    """Issues of a metrics row, and a status: none healthy, one or two a warning, more critical. There are two kinds of
    issues so far, so nothing is critical yet."""
    many = F.lit(False) if config.max_graph_size is None else F.col("n_nodes") > 0.9 * config.max_graph_size
    issues = F.array_compact(F.array(F.when(memory_gb > 0.8 * config.max_memory_gb, F.lit("memory")), F.when(many, F.lit("nodes"))))
    n = F.size(issues)
    return metrics.select("*", n.alias("n_issues"), F.array_join(issues, ",").alias("issues"), F.when(n == 0, "healthy").when(n < 3, "warning").otherwise("critical").alias("status"))


def evaluation_summary(records: DataFrame) -> DataFrame:
    """Totals, success rates in per cent and mean figures over successes: of all, by category and by language.

    Graphics figures are means over the successes that have a use of the graphics unit other than zero."""
    ok = F.col("status") == "success"
    on_gpu = ok & (F.col("gpu_percent") != 0)
    good = lambda c, which=ok: F.avg(F.when(which, F.col(c)))
    whole = records.groupingSets([[], ["category"], ["language"]], "category", "language")
    return whole.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"), F.round(100.0 * F.count_if(ok) / F.count("*"), 2).alias("success_rate"),
        F.round(good("response_time"), 3).alias("avg_response_time"), F.round(good("ram_gb"), 3).alias("avg_ram_gb"), F.round(good("cpu_percent"), 2).alias("avg_cpu_percent"),
        F.round(good("gpu_percent", on_gpu), 2).alias("avg_gpu_percent"), F.round(good("gpu_memory_mb", on_gpu), 2).alias("avg_gpu_memory_mb"),
    )


def latency_mean(runs: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row: how many retrievals there were and their mean time."""
    return runs.agg(F.count(seconds).alias("retrievals"), F.avg(seconds).alias("avg_seconds"))


def ocr_join(boxes: DataFrame, least: float) -> DataFrame:
    """(image, engine, text, confidence): accepted boxes in order, and their mean confidence of 100, 0 for none."""
    good = F.col("confidence") > least
    listed = F.array_sort(F.collect_list(F.when(good, F.struct("pos", "text"))))
    return boxes.groupBy("image", "engine").agg(F.array_join(F.transform(listed, lambda s: s["text"]), " ").alias("text"), F.coalesce(F.avg(F.when(good, F.col("confidence"))) * 100, F.lit(0.0)).alias("confidence"))


def ocr_cascade(results: DataFrame, primary: str, order: list[str], first: float = 30.0, other: float = 20.0) -> DataFrame:
    """One result for each image: the primary engine's above ``first``, else the first other's above ``other``, else
    the last engine's whatever it is."""
    place = F.create_map(*[F.lit(x) for i, e in enumerate([primary, *[e for e in order if e != primary]]) for x in (e, i)])
    at = place[F.col("engine")]
    accepted = F.when(F.col("engine") == primary, F.col("confidence") > first).otherwise(F.col("confidence") > other)
    rows = results.withColumn("at_", at).withColumn("ok_", accepted).filter("at_ is not null")
    pick = F.coalesce(F.min_by(F.struct("engine", "text", "confidence"), F.when(F.col("ok_"), F.col("at_"))), F.max_by(F.struct("engine", "text", "confidence"), "at_"))
    best = rows.groupBy("image").agg(pick.alias("r"), F.max("ok_").alias("accepted"))
    return best.select("image", "r.engine", "r.text", "r.confidence", "accepted")


def engine_usage(results: DataFrame) -> DataFrame:
    return results.groupBy("engine").agg(F.count("*").alias("images"), F.sum(F.length("text")).alias("chars"), F.avg(F.length("text")).alias("avg_chars"))


#: The share of use from which a resource is in alarm.
LIMITS = {"cpu": 0.85, "memory": 0.90, "disk": 0.85, "gpu": 0.90}


def resource_alerts(samples: DataFrame) -> DataFrame:
    """Samples (resource, usage from 0 to 1) with the limit of their resource and whether they exceed it."""
    limits = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])
    return samples.withColumn("limit", limits[F.col("resource")]).withColumn("alert", F.coalesce(F.col("usage") > F.col("limit"), F.lit(False)))


def progress(processed: Column, total: Column) -> Column:
    return F.when((total > 0) & (processed >= 0), processed / total * 100)


def checkpoint_due(processed: Column, last: Column, minutes: Column, every: int = 1000, every_minutes: float = 10) -> Column:
    return (processed - last >= every) | (minutes >= every_minutes)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    return reduce(DataFrame.unionAll, [t.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows")) for name, t in sorted(tables.items())])


def catalog_inventory(spark: SparkSession) -> DataFrame:
    return inventory({t.name: spark.table(t.name) for t in spark.catalog.listTables()})
