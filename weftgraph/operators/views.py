"""Tables of a graph's view: sizes, widths, search texts, previews and the order of components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.operators import graph


def nodes(edges: DataFrame, shown: int = 5) -> DataFrame:
    """node, degree, size (10 to 40 by degree), search text and a hover text with the first ``shown`` neighbours by name.

    Only those neighbours are gathered, so a hub's row stays short.
    """
    both = graph.ends(edges)
    degree = both.groupBy("node").agg(F.count("*").alias("degree"))
    most = degree.agg(F.max("degree").alias("most"))
    first = both.withColumn("k", F.row_number().over(W.partitionBy("node").orderBy("other"))).where(F.col("k") <= shown)
    names = first.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("names"))
    more = F.when(F.col("degree") > shown, F.concat(F.lit(" ... and "), (F.col("degree") - shown).cast("string"), F.lit(" more"))).otherwise("")
    out = degree.join(names, "node").join(F.broadcast(most))  # one row
    return out.select("node", "degree", (10 + 30.0 * F.col("degree") / F.col("most")).alias("size"), F.lower("node").alias("search_text"), F.concat("names", more).alias("hover"))


def edges(evidence: DataFrame, least: float = 1.0, most: float = 6.0, preview: int = 80) -> DataFrame:
    """src, dst, number of pieces, width by mean confidence within 0 and 1, the first text's start and a search text."""
    c = F.nanvl("confidence", F.lit(None).cast("double"))
    k = evidence.groupBy("src", "dst").agg(F.count("*").alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).alias("c"), F.min(F.substring("text", 1, preview)).alias("preview"))
    width = least + (most - least) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c")))
    return k.select("src", "dst", "n", width.alias("width"), "preview", F.lower(F.concat_ws(" ", "src", "dst", "preview")).alias("search_text"))


def component_places(labelled: DataFrame) -> DataFrame:
    """component, its size and its place by size, for colours; sizes are counted before the single ordering, a row for each component."""
    s = labelled.groupBy("component").agg(F.count("*").alias("n"))
    return s.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "component")).cast("bigint") - 1)
