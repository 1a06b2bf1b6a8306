"""Relevance scores, keyword counts, ranked frontiers and query generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.constants import KEYWORD_STOP, RELATION_PATTERNS, RELATION_TYPES, SEARCH_STOP
from weftgraph.functions.urls import dedupe_key
from weftgraph.operators.builders import PERSON_DORKS


def _list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def query_tokens(query: Column) -> Column:
    """Distinct tokens of at least three characters that are no search stop words."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_-]+"), F.lit(0))
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3), _list(SEARCH_STOP))


def search_score(query: Column, url: Column, title: Column) -> Column:
    """Score of a search result; null when no token stands in the title. Without tokens 1."""
    q, u, t = F.lower(F.coalesce(query, F.lit(""))), F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    tokens = query_tokens(q)
    in_title, in_url = F.size(F.filter(tokens, lambda x: F.contains(t, x))), F.size(F.filter(tokens, lambda x: F.contains(u, x)))
    n = F.size(tokens)
    raw = F.when(F.contains(t, q), 6.0).otherwise(0.0) + F.when(F.contains(u, q), 3.0).otherwise(0.0) + 2.0 * in_title + in_url
    return F.when(n == 0, F.lit(1.0)).when(in_title > 0, F.least(F.lit(1.0), raw / (9.0 + 3.0 * n)))


def iterative_score(query: Column, url: Column, title: Column) -> Column:
    """Score of the iterative search: at least 0.15; null for no match of more than two tokens."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    tokens = query_tokens(F.coalesce(query, F.lit("")))
    n = F.size(tokens)
    hit_t, hit_u = F.size(F.filter(tokens, lambda x: F.contains(t, x))), F.size(F.filter(tokens, lambda x: F.contains(u, x)))
    score = F.greatest(F.lit(0.15), (2.0 * hit_t + hit_u) / F.greatest(1.5 * n, F.lit(1.0)))
    return F.when(n == 0, F.lit(1.0)).when((hit_t + hit_u > 0) | (n <= 2), F.least(F.lit(1.0), score))


def quick_relevance(text: Column, terms: list[str]) -> Column:
    """1 for the full query, else the share of its terms plus 0.2 when there is any."""
    low = F.lower(text)
    words = [t for t in terms if len(t) > 2]
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in words), F.lit(0))
    return F.when(F.contains(low, F.lit(" ".join(terms))), 1.0).when(hits > 0, F.least(F.lit(1.0), hits / float(max(1, len(words))) + 0.2)).otherwise(0.0)


def document_relevance(text: Column, terms: list[str]) -> Column:
    """0.5 for the full query and 0.1 for each word of more than two characters."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit(" ".join(terms))), 0.5).otherwise(0.0) + sum((F.contains(low, F.lit(t)).cast("int") * 0.1 for t in terms if len(t) > 2), F.lit(0.0))


def keyword_counts(df: DataFrame, title: str, least: int = 4) -> DataFrame:
    """Words of titles with their counts: split at blanks and delimiters, edge marks stripped, stop words dropped."""
    words = F.split(F.regexp_replace(F.col(title), r"[|:\-]", " "), r"[ \t\n\r\f]+")
    clean = F.lower(F.regexp_replace(F.col("w"), r"^[.,!?()\[\]{}]+|[.,!?()\[\]{}]+$", ""))
    return df.select(F.explode(words).alias("w")).select(clean.alias("keyword")).where((F.length("keyword") >= least) & ~F.col("keyword").isin(*KEYWORD_STOP)).groupBy("keyword").agg(F.count("*").alias("n"))


def first_per_url(df: DataFrame) -> DataFrame:
    """The first hit of every query and URL, by seq; URLs that differ in case or trailing slashes are one."""
    keyed = df.where("url is not null").withColumn("url_key", dedupe_key(F.col("url")))
    best = keyed.groupBy("query", "url_key").agg(F.min(F.struct("seq", "url", "source")).alias("first"), F.count("*").alias("n_hits"))
    return best.select("query", "url_key", "first.seq", "first.url", "first.source", "n_hits")


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def classify_relations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, relation, score) of the best relation type: 3 for a verb, 2 for a noun, 1 for a preposition; a verb or noun is needed; ties go to the earlier type.

    The words of a text meet the fixed word list, which has about 200 rows and is broadcast.
    """
    listed = [(w, name, k, c) for k, (name, parts) in enumerate(RELATION_TYPES.items()) for c, words in zip((3, 2, 1), parts, strict=True) for w in words]
    table = F.broadcast(df.sparkSession.createDataFrame(listed, "word string, relation string, place int, points int"))
    plain = F.lower(F.regexp_replace(text, "[^A-Za-z-]+", " "))
    phrases = F.array_compact(F.array(*[F.when(F.contains(F.concat(F.lit(" "), plain, F.lit(" ")), F.lit(f" {w} ")), F.lit(w)) for w in sorted({w for w, *_ in listed if " " in w})]))
    words = F.array_distinct(F.concat(F.split(plain, " "), phrases))
    hits = df.select(key, F.explode(words).alias("word")).join(table, "word").select(key, "relation", "place", "points").distinct()
    scored = hits.groupBy(key, "relation", "place").agg(F.sum("points").alias("score"), F.max("points").alias("top")).where("top > 1")
    return scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("place")).alias("p"), "relation")).alias("r")).select(key, "r.relation", "r.score")


def pattern_relations(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pattern_no, relation) for every relation pattern that a text matches; the patterns are a fixed list inside the plan."""
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), F.struct(F.lit(k).alias("pattern_no"), F.lit(r).alias("relation"))) for k, (r, _, p, _) in enumerate(RELATION_PATTERNS)]))
    return df.select(key, F.explode(hits).alias("h")).select(key, "h.pattern_no", "h.relation")


def person_dorks(df: DataFrame, name: str) -> DataFrame:
    """Search queries for every distinct name."""
    built = F.array(*[F.struct(F.lit(k).alias("template"), F.replace(F.lit(t), F.lit("{n}"), F.col(name)).alias("dork")) for k, t in enumerate(PERSON_DORKS)])
    return df.where(F.col(name).isNotNull()).select(name).distinct().select(name, F.explode(built).alias("q")).select(name, "q.template", "q.dork")


def ordered_pairs(df: DataFrame, key: str, items: str) -> DataFrame:
    """(key, src, dst, gap) of the items of a list, i before j, self-pairs dropped; the list's length bounds the pairs."""
    a = df.select(key, items, F.posexplode(items).alias("i", "src"))
    rest = F.expr(f"slice({items}, i + 2, size({items}))")
    b = a.where(F.size(items) > F.col("i") + 1).select(key, "i", "src", F.posexplode(rest).alias("g", "dst"))
    return b.where("src <> dst").select(key, "src", "dst", (F.col("g") + 1).alias("gap"))
