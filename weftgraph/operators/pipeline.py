"""The stages of a page's way into the graph, and the loops around them.

Stages are transforms of a table of items; loops are rounds over written tables, so a lost executor repeats
one round's work at most and every round's plan stays short.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions import clean, predicates, urls
from weftgraph.functions import text as tx
from weftgraph.operators import ranking
from weftgraph.runtime import cut

Search = Callable[[DataFrame], DataFrame]


def enqueue(df: DataFrame, url: str, content: str, content_type: str, source: str) -> DataFrame:
    """Items (url, site, kind, text) of fetched rows: texts cleaned, null and empty ones dropped; the site is that of the source, else of the page."""
    from weftgraph.operators.pages import document_kind

    rows = df.withColumn("_text", clean.pipeline_clean(F.col(content))).where("_text is not null and _text <> ''")
    return rows.select(F.col(url).alias("url"), urls.site_key(F.coalesce(source, url)).alias("site"), document_kind(F.col(url), F.col(content_type)).alias("kind"), F.col("_text").alias("text"))


def judge(items: DataFrame, terms: list[str], least: float = 0.25) -> DataFrame:
    """Items with relevance, quality, error and ``kept``: relevant enough and no error page."""
    t = F.col("text")
    out = items.withColumn("relevance", ranking.quick_relevance(t, terms)).withColumn("quality", tx.is_quality(t)).withColumn("error", predicates.error_page(F.lit(None).cast("string"), t))
    return out.withColumn("kept", (F.col("relevance") >= least) & ~F.col("error"))


def split(items: DataFrame, terms: list[str], least: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Relevant and irrelevant items."""
    judged = judge(items, terms, least)
    return judged.where("kept"), judged.where("not kept")


def stats(judged: DataFrame) -> DataFrame:
    """Counters of the pipeline in one row: items, kept, irrelevant, errors, of quality, sites."""
    return judged.agg(
        F.count("*").alias("n_items"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept") & ~F.col("error")).alias("n_irrelevant"), F.count_if("error").alias("n_errors"), F.count_if("quality").alias("n_quality"), F.countDistinct("site").alias("n_sites")
    )


def by_site(judged: DataFrame) -> DataFrame:
    """One row for each site: items, kept items, distinct pages, characters; sums combine before their shuffle, so a large site is no large group."""
    return judged.groupBy("site").agg(F.count("*").alias("n_items"), F.count_if("kept").alias("n_kept"), F.countDistinct("url").alias("n_pages"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


def merged_entities(df: DataFrame, entity: str, label: str, seq: str) -> DataFrame:
    """Entities of several pages as one table: the last label of a cleaned name stays, names that are none are dropped."""
    rows = df.select(tx.clean_name(F.col(entity)).alias("entity"), F.col(label).alias("label"), F.col(seq).alias("seq")).where("entity is not null")
    return rows.groupBy("entity").agg(F.max(F.struct("seq", "label"))["label"].alias("label"), F.count("*").alias("n"))


def origin(sentences: DataFrame, text: str, url: str, pages: DataFrame, least: int = 40) -> DataFrame:
    """Sentences with ``origin``: copied, original (in its source page, in full or by its first or last 40 to 100 characters) or unverified; ``confidence`` tells how much of it was found.

    Pages with equal texts count once, so a front page that was fetched often is looked through once.
    """
    own = sentences.withColumn("_s", F.lower(F.trim(text)))
    texts = pages.where("page is not null").select("url", F.lower("page").alias("page")).distinct()
    j = own.join(texts, own[url] == texts["url"], "left").drop(texts["url"])
    n = F.length("_s")
    parts = [(F.lit(True), F.col("_s"), 1.0)] + [(n > k, f, c) for k, c in ((100, 0.9), (80, 0.8), (40, 0.7)) for f in (F.expr(f"left(_s, {k})"), F.expr(f"right(_s, {k})"))]
    found = F.coalesce(*[F.when(cond & F.contains("page", f), c) for cond, f, c in parts], F.lit(0.0))
    best = j.withColumn("_c", F.when(n >= least, found).otherwise(0.0)).groupBy(*sentences.columns).agg(F.max("_c").alias("confidence"))
    kind = F.when(predicates.copied_text(F.col(text)), "copied").when(F.col("confidence") > 0.6, "original").otherwise("unverified")
    return best.withColumn("origin", F.coalesce(kind, F.lit("unverified")))


def crawl(links: DataFrame, seeds: DataFrame, terms: list[str], per_round: int = 20, most: int = 200, blocked: list[str] | None = None) -> DataFrame:
    """(url, depth, score, round) of the pages that a crawl visits, best first: links is (src, dst), seeds is (url).

    Every round visits the ``per_round`` best waiting pages, ties by address, and adds their links that are
    crawlable, not blocked and new; it ends at ``most`` pages or when none waits. Both numbers are the crawl's own limits.
    """
    query = " ".join(terms)

    def scored(df: DataFrame, depth: int) -> DataFrame:
        good = df.where(predicates.crawlable(F.col("url")) & ~predicates.site_listed(F.col("url"), blocked or []))
        return good.select("url", F.lit(depth).alias("depth"), F.round(urls.url_relevance(F.col("url"), F.lit(query)), 6).alias("score"))

    waiting = cut(scored(seeds.select(urls.normalize(F.col("url")).alias("url")).where("url is not null").distinct(), 0))
    plain = links.select(urls.normalize(F.col("src")).alias("src"), urls.normalize(F.col("dst")).alias("dst")).where("src <> dst").distinct()
    rounds: list[DataFrame] = []
    left, k = most, 0
    while left > 0:
        batch = cut(waiting.orderBy(F.desc("score"), "url").limit(min(per_round, left)).withColumn("round", F.lit(k)))
        n = batch.count()
        if not n:
            break
        rounds.append(batch)
        left -= n
        known = waiting.select("url").unionByName(reduce(DataFrame.unionByName, rounds).select("url")).distinct()
        fresh = plain.join(batch.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct().join(known, "url", "left_anti")
        waiting = cut(waiting.join(batch.select("url"), "url", "left_anti").unionByName(scored(fresh, k + 1)))
        k += 1
    return reduce(DataFrame.unionByName, rounds) if rounds else waiting.withColumn("round", F.lit(0))


def autonomous(start: DataFrame, search: Search, iterations: int = 5, enough: int = 50, keywords: int = 10) -> DataFrame:
    """(query, url, title, iteration): results of a search that asks on with the keywords of its own results.

    ``search`` turns queries (query) into results (query, url, title). Each iteration asks the new queries,
    keeps the addresses not seen yet, and makes the most frequent words of their titles the next queries;
    it ends with more than ``enough`` addresses, without new keywords, or after ``iterations``.
    """
    asked = cut(start.select("query").distinct())
    frontier, parts, total = asked, [], 0
    for k in range(iterations):
        hits = search(frontier).where("url is not null").withColumn("_u", urls.dedupe_key(F.col("url")))
        if parts:
            seen = reduce(DataFrame.unionByName, parts).select(urls.dedupe_key(F.col("url")).alias("_u"))
            hits = hits.join(seen, "_u", "left_anti")
        fresh = cut(hits.groupBy("_u").agg(F.min(F.struct("query", "url", "title")).alias("f")).select("f.*", F.lit(k).alias("iteration")))
        parts.append(fresh)
        total += fresh.count()
        if total > enough:
            break
        words = ranking.keyword_counts(fresh, "title").withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "keyword"))).where(F.col("rank") <= keywords).select(F.col("keyword").alias("query"))
        frontier = cut(words.join(asked, "query", "left_anti"))
        if frontier.isEmpty():
            break
        asked = cut(asked.unionByName(frontier))
    return reduce(DataFrame.unionByName, parts)
