"""Session helpers: table access, shipping the package to executors, cutting lineage, spreading small inputs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def load(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """One Parquet table of a data folder, pruned to ``cols`` when they are given."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="weftgraph-"), "weftgraph.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("weftgraph", os.path.relpath(path, root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; where it is unset, a folder of this process in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        folder = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL[sc.applicationId] = f"file://{folder}"
    return _LOCAL[sc.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return a reader of it.

    It ends the lineage, so a lost executor costs one re-read, and the reader prunes columns and
    knows its size, which lets the planner choose joins by measured bytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remember(spark: SparkSession, path: str) -> None:
    _WRITTEN.append(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written so far, and return how many; for long sessions, once their results are stored."""
    n = len(_WRITTEN)
    for path in _WRITTEN:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.clear()
    return n


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition an input that has fewer partitions than the cluster has cores; larger inputs pass unshuffled."""
    want = least or df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df.repartition(want) if have * 2 <= want else df


def host(url):
    """Lower-case host of a URL column without user, port and one leading ``www.``; null where there is none.

    Works on strings with or without a scheme and never fails on malformed input.
    """
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*:(//)?|^//", "")
    net = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#\\]*)", 1), r"^.*@", "")
    name = F.regexp_replace(F.regexp_replace(F.lower(net), r":\d*$", ""), r"^www\.", "")
    return F.when(name != "", name)
