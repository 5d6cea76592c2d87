"""Tables whose rows are replaced by key, in commits that a reader sees whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import delete


class KeyedTable:
    """Rows by key in a folder of versions.

    A commit writes all rows of the next version beside the present one and then renames a small file that names the
    version; renaming is atomic, so readers see the rows before or after, and a writer that fails changes nothing. A
    plan that reads the table may be what is written to it. Two writers that start from one version both name the
    next; the second finds it named and fails, and may try again. ``keep`` versions stay for readers that still read them."""

    POINTER = "version-%012d"

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], keep: int = 3):
        if keep < 1:
            raise ValueError("keep at least the present version")
        self.spark, self.path, self.schema, self.keys, self.keep = spark, path.rstrip("/"), schema, keys, keep
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("rows").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions that were committed and are kept, ascending."""
        top = self._at("commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(n.partition("-")[2]) for n in names if n.startswith("version-"))

    def _folder(self, version: int) -> str:
        """The folder that a commit names."""
        stream = self._fs.open(self._at("commits/" + self.POINTER % version))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default; no rows before the first commit."""
        known = self.versions()
        if not known and version is None:
            return self.spark.createDataFrame([], self.schema)
        if version is not None and version not in known:
            raise ValueError(f"no such version: {version}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._folder(known[-1] if version is None else version)}")

    def commit(self, rows: DataFrame, base: int | None = None) -> int:
        """Makes rows the whole table, as the version after ``base`` (the last); that version."""
        base = max(self.versions(), default=0) if base is None else base
        name = f"rows/{base + 1:012d}-{uuid.uuid4().hex}"
        named = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], self.schema).schema.fields]
        try:
            rows.select(*named).write.parquet(f"{self.path}/{name}")
            draft, goal = self._at(f"commits/draft-{uuid.uuid4().hex}"), self._at("commits/" + self.POINTER % (base + 1))
            stream = self._fs.create(draft, False)
            stream.write(bytearray(name.encode()))
            stream.close()
            # without the flag to overwrite, renaming to a name that exists fails
            context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
            options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(goal), options)
        except Exception:
            delete(self.spark, f"{self.path}/{name}")
            raise
        for old in self.versions()[: -self.keep]:
            folder = self._folder(old)
            delete(self.spark, f"{self.path}/commits/{self.POINTER % old}")
            delete(self.spark, f"{self.path}/{folder}")
        return base + 1

    def replace(self, new: DataFrame) -> int:
        """Rows whose key is among the new ones go, the new ones come; a key that comes several times keeps all its rows."""
        base = max(self.versions(), default=0)
        old = self.read()
        matched = [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in self.keys]
        keys = new.select(*[F.col(k).alias(f"new_{k}") for k in self.keys]).distinct()
        condition: Column = matched[0]
        for m in matched[1:]:
            condition = condition & m
        return self.commit(old.join(keys, condition, "left_anti").unionByName(new.select(*old.columns)), base)

    def remove(self, which: Column) -> int:
        """Rows for which the condition holds go."""
        base = max(self.versions(), default=0)
        return self.commit(self.read().filter(~F.coalesce(which, F.lit(False))), base)


PATHS = "array<struct<src:bigint,dst:bigint,path:array<bigint>,rank_path:array<int>,weight_prod:double,hops:int,n_nodes:int,score:double>>"


class RetrievalTable(KeyedTable):
    """Found paths by graph, its version, the query, top_k and max_hops, for so many seconds.

    A query is known by a digest of its text and vector. One whose search found no path is kept as well. A new version of
    the graph misses; ``compact`` takes out what is too old or of other versions."""

    KEYS = ["graph_id", "version", "digest", "top_k", "max_hops"]

    def __init__(self, spark: SparkSession, path: str, seconds: float = 3600, keep: int = 3):
        super().__init__(spark, path, f"graph_id string, version bigint, digest string, top_k int, max_hops int, cached_at timestamp, paths {PATHS}", self.KEYS, keep)
        self.seconds = seconds

    @staticmethod
    def digest() -> Column:
        return F.sha2(F.concat_ws("|", F.coalesce("query", F.lit("")), F.to_json(F.struct("emb"))), 256)

    def _fresh(self) -> Column:
        return F.col("cached_at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(self.seconds)))

    def known(self, graph_id: str, version: int, top_k: int, max_hops: int) -> DataFrame:
        """(digest, paths) that may be used."""
        same = (F.col("graph_id") == graph_id) & (F.col("version") == version) & (F.col("top_k") == top_k) & (F.col("max_hops") == max_hops)
        return self.read().filter(same & self._fresh()).groupBy("digest").agg(F.max_by("paths", "cached_at").alias("paths"))

    def put(self, graph_id: str, version: int, top_k: int, max_hops: int, asked: DataFrame, found: DataFrame) -> int:
        """Keeps the paths found for (query_id, digest); those of a query are at most top_k² times the limit of a pair."""
        fields = ["src", "dst", "path", "rank_path", "weight_prod", "hops", "n_nodes", "score"]
        lists = found.groupBy("query_id").agg(F.collect_list(F.struct(*fields)).alias("paths"))
        rows = asked.select("query_id", "digest").join(lists, "query_id", "left").groupBy("digest").agg(F.first("paths").alias("paths"))
        told = rows.select(F.lit(graph_id).alias("graph_id"), F.lit(version).alias("version"), "digest", F.lit(top_k).alias("top_k"), F.lit(max_hops).alias("max_hops"), F.current_timestamp().alias("cached_at"), F.coalesce("paths", F.expr(f"cast(array() as {PATHS})")).alias("paths"))
        return self.replace(told)

    def compact(self, graph_id: str | None = None, version: int | None = None) -> int:
        """Takes out what is too old, and what a graph has of other versions."""
        stale = ~self._fresh()
        if graph_id is not None:
            stale = stale | ((F.col("graph_id") == graph_id) & (F.col("version") != version))
        return self.remove(stale)
