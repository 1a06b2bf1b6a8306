"""The steps that finish a graph of evidence before it is shown: by label, relevance, year, file, protocol and confidence.

Evidence is a table (src, dst, text, source_url, confidence, seq) with one row for each piece; an edge
lives as long as a row of its own does. Every step returns evidence, so steps compose in any order.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import real_url
from weftgraph.operators import graph
from weftgraph.runtime import cut

#: Suffixes of images and files, and patterns of local paths and of addresses that are no web pages.
FILE_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".webp", ".ico", ".tiff", ".tif", ".raw", ".heic", ".heif", ".pdf"]
LOCAL_PATHS = [r"[a-zA-Z]:\\", r"^/[a-zA-Z]/", r"file://", r"\\\\"]
YEAR = r"(?i)^(AD\s*|BC\s*)?\d{4}(s)?(\s*(AD|BC))?$"


def edges_of(evidence: DataFrame) -> DataFrame:
    return evidence.select("src", "dst").distinct()


def without_nodes(evidence: DataFrame, gone: DataFrame) -> DataFrame:
    """Evidence whose ends are both not in ``gone`` (node)."""
    for end in ("src", "dst"):
        evidence = evidence.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return evidence


def drop_labels(evidence: DataFrame, nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Without the nodes of ``nodes`` (node, label) that have one of the labels, in any case."""
    return without_nodes(evidence, nodes.where(F.lower("label").isin(*[x.lower() for x in labels])).select("node").distinct())


def _named(name: Column, terms: list[str], both_ways: bool = False) -> Column:
    low = F.lower(name)
    hits = [F.contains(low, F.lit(t.lower())) for t in terms]
    if both_ways:
        hits += [F.contains(F.lit(t.lower()), low) for t in terms]
    return reduce(or_, hits, F.lit(False))


def node_relevance(evidence: DataFrame, terms: list[str]) -> DataFrame:
    """node and relevance: 1 where its name holds a term, else the share of terms among its words, else half the share of its neighbours that hold one."""
    ends = graph.ends(edges_of(evidence))
    words = F.split(F.replace(F.lower("node"), F.lit("_"), F.lit(" ")), r"\s+")
    near = ends.groupBy("node").agg(F.avg(_named(F.col("other"), terms).cast("double")).alias("near"))
    asked = F.array(*[F.lit(t.lower()) for t in dict.fromkeys(terms)])
    shared = F.size(F.array_intersect(asked, words))
    return near.select("node", F.when(_named(F.col("node"), terms), 1.0).when(shared > 0, shared / F.size(asked)).otherwise(0.5 * F.col("near")).alias("relevance"))


def drop_irrelevant(evidence: DataFrame, terms: list[str], least: float = 0.0) -> DataFrame:
    """Without the nodes whose relevance is not above ``least``."""
    return without_nodes(evidence, node_relevance(evidence, terms).where(F.col("relevance") <= least).select("node"))


def keep_relevant(evidence: DataFrame, terms: list[str], least: float) -> DataFrame:
    """Only nodes that hold a term in their name, or of whose neighbours at least the share ``least`` does."""
    ends = graph.ends(edges_of(evidence))
    share = ends.groupBy("node").agg(F.avg(_named(F.col("other"), terms).cast("double")).alias("share"))
    return without_nodes(evidence, share.where(~_named(F.col("node"), terms) & (F.col("share") < least)).select("node"))


def drop_years(evidence: DataFrame, terms: list[str]) -> DataFrame:
    """Without the nodes that are bare years, unless a neighbour's name holds a term or stands in one."""
    ends = graph.ends(edges_of(evidence)).where(F.trim("node").rlike(YEAR))
    return without_nodes(evidence, ends.groupBy("node").agg(F.max(_named(F.col("other"), terms, both_ways=True)).alias("kept")).where("not kept").select("node"))


def is_file(name: Column) -> Column:
    """Whether a name or text holds the suffix of an image or file, or a local path."""
    return F.lower(name).rlike("|".join(s.replace(".", r"\.") for s in FILE_SUFFIXES)) | name.rlike("|".join(LOCAL_PATHS))


def drop_files(evidence: DataFrame) -> DataFrame:
    """Without nodes and pieces of evidence that name images, files or local paths."""
    return evidence.where(~is_file(F.col("src")) & ~is_file(F.col("dst")) & ~F.coalesce(is_file(F.col("text")), F.lit(False)))


def drop_local(evidence: DataFrame) -> DataFrame:
    """Only evidence from web pages; malformed addresses are mended first, a null source counts as none."""
    mended = evidence.withColumn("source_url", real_url(F.trim("source_url")))
    return mended.where(F.col("source_url").rlike("(?i)^https?://"))


def drop_weak(evidence: DataFrame, least: float, most_nodes: int | None = None) -> DataFrame:
    """Only edges whose mean confidence (0 without any) is at least ``least``, then only the ``most_nodes`` nodes of the highest degree."""
    strong = evidence.groupBy("src", "dst").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean")).where(F.col("mean") >= least)
    kept = evidence.join(strong.select("src", "dst"), ["src", "dst"], "left_semi")
    if most_nodes is None:
        return kept
    top = graph.degrees(edges_of(kept)).orderBy(F.desc("degree"), "node").limit(most_nodes).select("node")
    for end in ("src", "dst"):
        kept = kept.join(top.select(F.col("node").alias(end)), end, "left_semi")
    return kept


def finish(evidence: DataFrame, terms: list[str], nodes: DataFrame | None = None, labels: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """The whole chain: web evidence only, no files, no unrelated years, no unwanted labels, no weak edges.

    What the row-wise steps leave is written once, since the steps on nodes read it several times.
    """
    out = drop_years(cut(drop_files(drop_local(evidence))), terms)
    if nodes is not None and labels:
        out = drop_labels(out, nodes, labels)
    return drop_weak(out, least)
