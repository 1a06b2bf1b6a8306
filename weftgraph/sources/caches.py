"""Keyed caches and the download manifest: lookups as joins, writes as keep-latest unions.

A cache is a table (cache_key, payload, created_at, expires_at, hit_count); times are epoch seconds. A lookup
reads unexpired rows only; a row without an expiry never expires. Keys are hashes of all that the answer
depends on, so equal texts from different pages have different keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.urls import manifest_form
from weftgraph.sources.tables import latest, live

DAY = 86_400
#: Days that answers of a kind stay valid.
TTL_DAYS = {"page": 1, "nlp": 7, "translation": 90, "wikidata": 180, "wikidata_negative": 30, "generic": 7}


def page_key(url: Column) -> Column:
    return F.concat(F.lit("page:"), F.md5(url))


def nlp_key(text: Column, url: Column) -> Column:
    """The key of an extraction; it names the page too, so evidence keeps its own source."""
    return F.concat(F.lit("nlp:"), F.md5(F.concat(text, F.lit("\0"), F.coalesce(url, F.lit("")))))


def translation_key(text: Column, source: Column, target: Column, provider: Column, site: Column) -> Column:
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("|", F.lit("translation"), some(site), text, some(source), some(target), some(provider)), 256)


def link_key(name: Column) -> Column:
    return F.sha2(F.concat(F.lit("wikidata|"), F.lower(F.trim(name))), 256)


def generic_key(kind: Column, params: Column) -> Column:
    """The key of a request: its kind and its parameters (a map) in order of their names."""
    ordered = F.array_sort(F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return F.sha2(F.concat(kind, F.lit("|"), F.array_join(ordered, "&")), 256)


def get(asked: DataFrame, key: str, cache: DataFrame, now: int, keep: list[str]) -> DataFrame:
    """``asked`` with the cache's columns ``keep`` and ``hit``; of several live rows of a key the latest answers. Null keys and misses have no answer."""
    best = latest(live(cache, now), ["cache_key"], [F.desc_nulls_last("created_at"), *[F.desc_nulls_last(c) for c in keep]])
    rows = best.select(F.col("cache_key").alias("_k"), *keep, F.lit(True).alias("hit"))
    return asked.join(rows, asked[key] == F.col("_k"), "left").drop("_k").withColumn("hit", F.coalesce("hit", F.lit(False)))


def put(cache: DataFrame, fresh: DataFrame, now: int, kind: str) -> DataFrame:
    """The cache after writing ``fresh`` (cache_key and payload columns): valid for the kind's time, the new row of a key wins, its hits start anew."""
    rows = fresh.withColumn("created_at", F.lit(now).cast("bigint")).withColumn("expires_at", F.lit(now + TTL_DAYS[kind] * DAY).cast("bigint")).withColumn("hit_count", F.lit(0))
    both = cache.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, ["cache_key"], [F.desc("_new"), F.desc_nulls_last("created_at")]).drop("_new")


def counted(cache: DataFrame, used: DataFrame) -> DataFrame:
    """The cache with a hit more for every use of a key in ``used`` (cache_key)."""
    n = used.groupBy("cache_key").agg(F.count("*").alias("_n"))
    return cache.join(n, "cache_key", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def expired(cache: DataFrame, now: int) -> DataFrame:
    """The rows that a cleanup at ``now`` removes."""
    return cache.where(F.col("expires_at").isNotNull() & ~F.isnan(F.col("expires_at").cast("double")) & (F.col("expires_at") < now))


def cleared(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def manifest_lookup(asked: DataFrame, url: str, content_hash: str, manifest: DataFrame) -> DataFrame:
    """``asked`` with the manifest's path by normalised URL, else by content hash."""
    by_url = latest(manifest.withColumn("_u", manifest_form(F.col("url"))), ["_u"], [F.desc_nulls_last("created_at"), F.asc("path")]).select("_u", F.col("path").alias("_p1"))
    by_hash = latest(manifest.where("sha256 is not null"), ["sha256"], [F.desc_nulls_last("created_at"), F.asc("path")]).select(F.col("sha256").alias("_h"), F.col("path").alias("_p2"))
    out = asked.withColumn("_u", manifest_form(F.col(url))).join(by_url, "_u", "left").join(by_hash, F.col(content_hash) == F.col("_h"), "left")
    return out.select(*asked.columns, F.coalesce("_p1", "_p2").alias("path"), F.when(F.col("_p1").isNotNull(), "url").when(F.col("_p2").isNotNull(), "hash").alias("found_by"))


def manifest_upsert(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """The manifest (url, sha256, path, created_at) with one row for each normalised URL, the latest."""
    both = manifest.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1))).withColumn("_u", manifest_form(F.col("url")))
    return latest(both, ["_u"], [F.desc_nulls_last("created_at"), F.desc("_new"), F.asc("path")]).drop("_new", "_u")
