"""Readers and writers of the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with the hash of their content, one row per content: the latest path stays."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    hashed = files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"))
    return latest(hashed, ["sha256"], [F.desc("modificationTime"), F.asc("path")])


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row per key in the given order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def live(df: DataFrame, now: int) -> DataFrame:
    """Cache rows that have not expired at ``now`` (epoch seconds); rows without an expiry never do."""
    return df.where(F.col("expires_at").isNull() | F.isnan(F.col("expires_at").cast("double")) | (F.col("expires_at") >= now))


def upsert(current: DataFrame, fresh: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Rows of both tables, the highest ``seq`` per key; ties go to the fresh table."""
    both = current.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return latest(both, key, [F.desc_nulls_last(seq), F.desc("_new")]).drop("_new")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as two Parquet folders; arrays and timestamps come back as they were."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, current: tuple[DataFrame, DataFrame] | None = None, node_key: str = "node") -> tuple[DataFrame, DataFrame]:
    """The saved graph; with ``current`` both are merged, saved attributes win where they are not null."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if current is None:
        return nodes, edges
    return compose(current[0], nodes, [node_key]), compose(current[1], edges, ["src", "dst"])


def save_checkpoint(visited: DataFrame, path: str, crawled: int) -> None:
    """The state of a crawl: visited addresses and the count, for ``load_checkpoint``."""
    visited.select("url", F.lit(crawled).cast("bigint").alias("crawled")).write.mode("overwrite").parquet(f"{path}/visited")


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, int] | None:
    """Visited addresses and the count, or None where there is no checkpoint."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/visited")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    saved = spark.read.parquet(f"{path}/visited")
    first = saved.agg(F.max("crawled")).first()
    return saved.select("url"), int(first[0] or 0)


def scan_paths(base: str, folder: str, stamp: str | None = None) -> dict[str, str]:
    """Where a scan keeps its tables; ``folder`` is the query's path name, ``stamp`` parts scans of one query."""
    root = f"{base.rstrip('/')}/{folder}" + (f"_{stamp}" if stamp else "")
    return {"scan": root, **{k: f"{root}/{k}" for k in ("cache", "graph", "checkpoint", "view", "log")}}


def list_scans(spark: SparkSession, base: str) -> list[tuple[str, int]]:
    """(folder, modified) of the scans below ``base``, newest first."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    found = [(s.getPath().getName(), s.getModificationTime()) for s in files.listStatus(target) if s.isDirectory()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table of files: parquet, orc, json or csv; csv and json are read by their schema rather than by a scan for one."""
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def compose(current: DataFrame, loaded: DataFrame, key: list[str]) -> DataFrame:
    """Union of two node or edge tables by key; loaded attributes win where they are not null."""
    a, b = current.alias("a"), loaded.alias("b")
    values = [c for c in current.columns if c not in key]
    joined = a.join(b, key, "full_outer")
    return joined.select(*key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in values])
