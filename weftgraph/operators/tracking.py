"""Entities followed through texts, relevance by vectors, and ranked candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.constants import KEYWORD_STOP
from weftgraph.functions.urls import dedupe_key


def tracked(df: DataFrame, name: str, query: str | None = None) -> DataFrame:
    """(entity, from_query): distinct names of more than two characters in lower case; those that hold the query's words are its own."""
    e = df.select(F.lower(F.trim(name)).alias("entity")).where(F.length("entity") > 2).distinct()
    own = F.col("entity").rlike(r"\Q" + query.lower() + r"\E") if query else F.lit(False)
    return e.select("entity", own.alias("from_query"))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def tracked_in(df: DataFrame, key: str, text: str, entities: DataFrame) -> DataFrame:
    """(key, n): how many tracked entities a text names, whatever stands between their words.

    Texts and names meet on a name's first word and its length in words, so no text is compared with all names:
    each text is cut into its runs of as many words as some name has.
    """
    names = entities.select(F.trim(_plain(F.col("entity"))).alias("form"), "entity").where("form <> ''").distinct().withColumn("len", F.size(F.split("form", " ")))
    sizes = [r["len"] for r in names.select("len").distinct().collect()]  # lengths of names in words, a handful
    words = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.split(F.trim(_plain(F.col(text))), " ").alias("w"))
    runs = []
    for n in sorted(sizes):
        runs.append(F.expr(f"transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> array_join(slice(w, i, {n}), ' '))"))
    if not runs:
        return words.select(F.col("key").alias(key), F.lit(0).cast("bigint").alias("n")).limit(0)
    found = words.select("key", F.explode(F.array_distinct(F.concat(*runs))).alias("form")).join(names, "form").select("key", "entity").distinct()
    return found.groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n"))


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def content_relevance(df: DataFrame, key: str, text: str, vectors: DataFrame, vec_key: str, vec: str, term: str) -> DataFrame:
    """(key, relevance): 0.6 of the cosine to the first vector, at least 0, and 0.4 where the text holds the term."""
    q = vectors.orderBy(vec_key).limit(1).select(F.col(vec).alias("q"))  # one row
    cosine = vectors.join(F.broadcast(q)).select(F.col(vec_key).alias(key), F.greatest(F.lit(0.0), _dot(vec, "q") / F.sqrt(_dot(vec, vec) * _dot("q", "q"))).alias("c"))
    return df.join(cosine, key).select(key, (0.6 * F.col("c") + 0.4 * F.contains(F.lower(text), F.lit(term)).cast("int")).alias("relevance"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int, least: float) -> DataFrame:
    """(query, neighbour, cosine, rank): the ``k`` nearest vectors of every query above ``least``.

    A stated query set against all rows: the queries are sent in blocks of about BLOCK rows, parted by hash, so
    what is broadcast does not grow with their number.
    """
    norm = lambda df: df.select(F.col(key).alias("id"), F.transform(vec, lambda x: x).alias("v"), F.sqrt(_dot(vec, vec)).alias("n"))
    v, q = norm(vectors), norm(queries).select(F.col("id").alias("query"), F.col("v").alias("qv"), F.col("n").alias("qn"))
    n_blocks = int(queries.count() // BLOCK) + 1
    blocks = q.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_blocks)))
    parts = []
    for b in range(n_blocks):
        pairs = v.join(F.broadcast(blocks.where(F.col("block") == b).drop("block")), F.col("id") != F.col("query"))
        scored = pairs.select("query", F.col("id").alias("neighbour"), F.round(_dot("v", "qv") / (F.col("n") * F.col("qn")), 6).alias("cosine")).where(F.col("cosine") > least)
        parts.append(scored)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


#: Query vectors that are sent at once.
BLOCK = 2000


def deep_dive(degree: DataFrame, labels: DataFrame, query: list[str], most: int, least: int = 2) -> DataFrame:
    """Persons and organisations of at least ``least`` relations, none of the query's own, the best connected first."""
    own = reduce(lambda a, b: a | b, [F.contains(F.lower("name"), F.lit(t)) for t in query], F.lit(False))
    rows = degree.where(F.col("degree") >= least).join(labels.where("label in ('PERSON', 'ORG')"), "name").where(~own)
    return rows.orderBy(F.desc("degree"), "name").limit(most).select("name", "label", "degree")


def first_distinct(df: DataFrame, url: str, seq: str, most: int) -> DataFrame:
    """The first ``most`` addresses, equal ones once: a limit on downloads."""
    once = df.where(F.col(url).isNotNull()).groupBy(dedupe_key(F.col(url)).alias("url_key")).agg(F.min(seq).alias("seq"))
    return once.orderBy("seq", "url_key").limit(most)


def weighted_keywords(df: DataFrame, title: str) -> DataFrame:
    """(keyword, weight): names of several capitalised words count three, other words of four letters one; stop words none."""
    names = F.transform(F.regexp_extract_all(F.col(title), F.lit("[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)+"), F.lit(0)), lambda x: F.struct(F.lower(x).alias("k"), F.lit(3).alias("w")))
    words = F.filter(F.regexp_extract_all(F.lower(F.col(title)), F.lit(r"[\p{L}]{4,}"), F.lit(0)), lambda x: ~x.isin(*KEYWORD_STOP))
    both = F.concat(names, F.transform(words, lambda x: F.struct(x.alias("k"), F.lit(1).alias("w"))))
    return df.where(F.col(title).isNotNull()).select(F.explode(both).alias("x")).groupBy(F.col("x.k").alias("keyword")).agg(F.sum("x.w").cast("bigint").alias("weight"))


def contextual_links(df: DataFrame, query: str, url: str, anchor: str) -> DataFrame:
    """(url, query) of the links whose anchor and address hold all plain words of the query as whole words."""
    asked = F.array_distinct(F.filter(F.split(F.lower(query), " "), lambda w: (F.length(w) > 2) & w.rlike("^[a-z0-9]+$")))
    held = F.split(F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", anchor, url)), "[^a-z0-9]+", " ")), " ")
    return df.where((F.size(asked) > 0) & (F.size(F.array_except(asked, held)) == 0)).select(F.col(url).alias("url"), F.col(query).alias("query")).distinct()


def context_keywords(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(key, keywords): the ``most`` most frequent words of five letters of a text, ties by first place."""
    words = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}]{5,}"), F.lit(0))).alias("at", "x"))
    counts = words.groupBy(key, "x").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    top = counts.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "at"))).where(F.col("k") <= most)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]), ",").alias("keywords"))


def all_urls(parts: list[DataFrame], url: str) -> DataFrame:
    """Every address of several results once, up to case and trailing slashes."""
    return reduce(DataFrame.unionByName, [p.select(dedupe_key(F.col(url)).alias("url")) for p in parts]).where("url is not null").distinct()


def top_mentions(df: DataFrame, entity: str, most: int, query: list[str] | None = None, least: int = 3) -> DataFrame:
    """(entity, n, high_value): the most mentioned entities, without those that hold a query term; three mentions make a high value."""
    low = F.lower(F.trim(entity))
    own = reduce(lambda a, b: a | b, [F.contains("entity", F.lit(t.lower())) for t in query or []], F.lit(False))
    counts = df.select(low.alias("entity")).where(F.length("entity") > 2).where(~own).groupBy("entity").agg(F.count("*").alias("n"))
    return counts.withColumn("high_value", F.col("n") >= least).orderBy(F.desc("n"), "entity").limit(most)


def downloads_of(hits: DataFrame, kinds: list[str]) -> DataFrame:
    """(query, url_key, extension, seq): results that are files of the given extensions, each query's first of equal addresses."""
    from weftgraph.functions.urls import extension

    files = hits.where(F.col("url").isNotNull()).withColumn("extension", extension(F.col("url"))).where(F.col("extension").isin(*kinds))
    return files.groupBy("query", dedupe_key(F.col("url")).alias("url_key")).agg(F.first("extension").alias("extension"), F.min("seq").alias("seq"))


def reseed_frontier(hits: DataFrame, seen: DataFrame, tries: int = 3, slots: int = 10) -> DataFrame:
    """(query, url_key, score, rank): addresses not seen yet for every query asked again, at most ``tries`` a query and three times ``slots`` in all, by the better of address and search score."""
    from weftgraph.functions.urls import url_relevance
    from weftgraph.operators.ranking import search_score

    rows = hits.where(F.col("url").isNotNull() & F.col("query").isNotNull()).withColumn("url_key", dedupe_key(F.col("url")))
    fresh = rows.join(seen.select(dedupe_key(F.col("url")).alias("url_key")), "url_key", "left_anti")
    score = F.greatest(url_relevance(F.col("url"), F.col("query")), 10 * F.coalesce(search_score(F.col("query"), F.col("url"), F.col("title")), F.lit(0.0)))
    best = fresh.groupBy("query", "url_key").agg(F.max(F.round(score, 6)).alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "url_key"))).where(F.col("rank") <= tries)
    return ranked.orderBy(F.desc("score"), "url_key", "query").limit(3 * slots)
