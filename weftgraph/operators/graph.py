"""Graph operators over an edge table (src, dst) of an undirected simple graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.runtime import cut


def undirected(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges with src < dst; self-loops and nulls are dropped."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def ends(edges: DataFrame) -> DataFrame:
    """Every edge from both ends: node, other."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e")).select("e.node", "e.other")


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node").agg(F.count("*").alias("degree"))


def neighbors_ranked(edges: DataFrame, top: int) -> DataFrame:
    """The ``top`` neighbours of every node by degree, ties by name."""
    ranked = ends(edges).join(degrees(edges).select(F.col("node").alias("other"), "degree"), "other")
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("degree"), "other"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= top).select("node", "other", "degree", "rank")


def node_sizes(edges: DataFrame, least: float = 12.0, most: float = 34.0) -> DataFrame:
    """Degree scaled to [least, most]; equal degrees give the mean."""
    d = degrees(edges)
    span = d.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), (least + most) / 2).otherwise(least + (most - least) * (F.col("degree") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return d.join(F.broadcast(span)).select("node", "degree", scaled.alias("size"))  # one row


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node and component, the smallest node of its component, by alternating large-star and small-star steps; an error if they do not settle in ``rounds``.

    Nodes are numbered once, so the rounds move pairs of numbers whatever the names are. Each step is one
    aggregation; labels collapse in about log(n) rounds. A hub's neighbours are never gathered: the minimum
    combines before the shuffle.
    """
    simple = cut(undirected(edges, "src", "dst"))
    numbered = cut(ends(simple).select("node").distinct().withColumn("id", F.monotonically_increasing_id()))
    a, b = numbered.select(F.col("node").alias("src"), F.col("id").alias("a")), numbered.select(F.col("node").alias("dst"), F.col("id").alias("b"))
    current = cut(simple.join(a, "src").join(b, "dst").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))
    before = None
    for _ in range(rounds):
        both = ends(current)
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("m"))
        large = cut(both.join(least, "node").where(F.col("other") > F.col("node")).select(F.col("m").alias("src"), F.col("other").alias("dst")).where("src <> dst").distinct())
        joined = large.join(large.groupBy("dst").agg(F.min("src").alias("m")), "dst")
        pair = F.explode(F.array(F.struct(F.col("m").alias("src"), F.col("src").alias("dst")), F.struct(F.col("m").alias("src"), F.col("dst").alias("dst"))))
        current = cut(joined.select(pair.alias("p")).select("p.src", "p.dst").where("src <> dst").distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    label = current.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("c"))
    labelled = numbered.join(label, "id", "left").select("node", F.coalesce("c", "id").alias("c"))
    names = labelled.groupBy("c").agg(F.min("node").alias("component"))
    return labelled.join(names, "c").select("node", "component")


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """node and distance of the nodes at most ``hops`` edges from the nodes of ``start`` (node); each round joins the frontier only."""
    both = ends(edges)
    seen = start.select("node").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for k in range(1, hops + 1):
        reached = both.join(frontier.select("node"), "node").select(F.col("other").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def keep_components(edges: DataFrame, core: DataFrame) -> DataFrame:
    """Nodes of the components that hold a node of ``core`` (node); without a core node in the graph, all nodes."""
    labelled = cut(components(edges))
    kept = labelled.join(core.select("node").distinct(), "node", "left_semi").select("component").distinct()
    if kept.isEmpty():
        return labelled
    return labelled.join(kept, "component", "left_semi").select("node", "component")


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with nodes replaced by ``mapping`` (node, into), evidence counts (n) added up, self-loops dropped."""
    a = mapping.select(F.col("node").alias("src"), F.col("into").alias("src_into"))
    b = mapping.select(F.col("node").alias("dst"), F.col("into").alias("dst_into"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("src_into", "src").alias("a"), F.coalesce("dst_into", "dst").alias("b"), "n")
    return moved.where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("n").alias("n"))


def partial_names(df: DataFrame, name: str) -> DataFrame:
    """(partial, full_name): single-word names that are a word of a longer name; an equi join on the word, so no pair of names is compared."""
    names = df.where(F.col(name) != "").select(F.col(name).alias("full_name")).distinct()
    words = names.where("contains(full_name, ' ')").select("full_name", F.explode(F.array_distinct(F.split(F.lower("full_name"), " "))).alias("word"))
    single = names.where("not contains(full_name, ' ')").select(F.col("full_name").alias("partial"), F.lower("full_name").alias("word"))
    return single.join(words, "word").select("partial", "full_name")
