"""Queries of the query builders, caches, manifest, pipeline stages and loops, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import builders, pipeline
from weftgraph.plans.registry import host_sql, query
from weftgraph.runtime import load
from weftgraph.sources import caches

NOW = 1735689600
TERMS = ["public", "harbour", "inquiry"]


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _targets(spark, d):
    """Entities as targets: their kind by type, a domain where there is an identifier, the description as context."""
    w = load(spark, d, "wikidata_cache", "entity_text", "metadata", "qid", "description").where("entity_text is not null")
    kind = F.get_json_object("metadata", "$.type")
    return w.select(F.col("entity_text").alias("name"), F.when(kind == "PERSON", "person").when(kind == "ORG", "company").when(kind == "GPE", "org").otherwise("auto").alias("kind"), F.when(F.col("qid").isNotNull(), F.concat(F.lower("qid"), F.lit(".example"))).alias("domain"), F.col("description").alias("context"))


def _template_rows() -> str:
    rows = []
    for k, templates in builders.DORKS.items():
        for i, (t, s) in enumerate(templates):
            rows.append(f"('{k}', {i}, {_lit(t)}, {'true' if s else 'false'})")
    return ", ".join(rows)


_DORKS = rf"""WITH t(kind, place, t, opt) AS (VALUES {_template_rows()}), w AS (SELECT DISTINCT entity_text AS name, CASE json_extract_string(metadata, '$.type') WHEN 'PERSON' THEN 'person' WHEN 'ORG' THEN 'company' WHEN 'GPE' THEN 'org' ELSE 'auto' END AS kind, CASE WHEN qid IS NOT NULL THEN lower(qid) || '.example' END AS d, description AS c FROM wikidata_cache WHERE entity_text IS NOT NULL),
 f AS (SELECT name, w.kind, place, opt, d, replace(replace(replace(t, '{{n}}', name), '{{d}}', coalesce(d, '{{d}}')), '{{c}}', coalesce(c, '{{c}}')) AS q, t FROM w JOIN t ON w.kind = t.kind WHERE (d IS NOT NULL OR NOT (contains(t, '{{d}}') OR opt)) AND ((c IS NOT NULL AND c <> '') OR NOT contains(t, '{{c}}')))
 SELECT name, kind, CASE WHEN opt THEN '(' || q || ' site:' || d || ') OR (' || q || ')' ELSE q END AS query, min(place)::INT AS place FROM f GROUP BY ALL"""


@query(_DORKS)
def dork_queries(spark, d):
    return builders.dorks(_targets(spark, d), "name", "kind", "domain", "context")


@query(f"WITH q AS ({_DORKS}) SELECT name, kind, query, place FROM q QUALIFY row_number() OVER (PARTITION BY name ORDER BY place, query) <= 5")
def dork_queries_capped(spark, d):
    return builders.capped(dork_queries(spark, d), 5)


_SEARCHES = ", ".join(f"('{k}', {i}, {_lit(t)})" for k, v in builders.SEARCHES.items() for i, t in enumerate(v))


@query(rf"""WITH t(label, place, t) AS (VALUES {_SEARCHES}), w AS (SELECT DISTINCT entity_text AS name, description AS c, CASE coalesce(json_extract_string(metadata, '$.type'), 'OTHER') WHEN 'PERSON' THEN 'PERSON' WHEN 'ORG' THEN 'ORG' WHEN 'EVENT' THEN 'EVENT' WHEN 'GPE' THEN 'GPE' WHEN 'LOC' THEN 'GPE' WHEN 'DOCUMENT' THEN 'DOCUMENT' ELSE 'OTHER' END AS label FROM wikidata_cache WHERE entity_text IS NOT NULL)
 SELECT name, w.label, place, replace(replace(t, '{{n}}', name), '{{c}}', coalesce(c, '')) AS query FROM w JOIN t ON w.label = t.label WHERE (c IS NOT NULL AND c <> '') OR NOT contains(t, '{{c}}')""")
def entity_searches(spark, d):
    w = load(spark, d, "wikidata_cache", "entity_text", "metadata", "description").where("entity_text is not null").withColumn("label", F.get_json_object("metadata", "$.type"))
    return builders.searches(w, "entity_text", "label", "description")


def _lists(spark, d):
    h = load(spark, d, "search_hits", "query", "url").where("query is not null").distinct()
    related = h.join(load(spark, d, "content_item", "url", "entities"), "url").select(F.col("query").alias("name"), F.explode("entities").alias("entity")).where("entity is not null")
    return h.select(F.col("query").alias("name")), related, h.select(F.col("query").alias("name"), F.col("url").alias("site")).where("site is not null")


@query(rf"""WITH h AS (SELECT DISTINCT query, url FROM search_hits WHERE query IS NOT NULL), n AS (SELECT DISTINCT trim(query) AS name FROM h WHERE trim(query) <> ''), e0 AS (SELECT trim(query) AS name, trim(e) AS e FROM (SELECT query, unnest(entities) AS e FROM h JOIN content_item c ON h.url = c.url)), e AS (SELECT name, min(e) AS e FROM e0 WHERE e <> '' AND lower(e) <> lower(name) GROUP BY name, lower(e)),
 s AS (SELECT DISTINCT trim(query) AS name, {host_sql('url')} AS s FROM h WHERE url IS NOT NULL AND {host_sql('url')} IS NOT NULL)
 SELECT name, '"' || name || '" + "' || e || '"' AS query FROM e UNION SELECT name, '"' || name || '" "' || e || '"' FROM e UNION SELECT name, '"' || name || '" "' || e || '" relationship OR connection' FROM e
 UNION SELECT name, '("' || name || '" site:' || s || ') OR ("' || name || '")' FROM s UNION SELECT e.name, '("' || e.name || '" "' || e || '" site:' || s || ') OR ("' || e.name || '" "' || e || '")' FROM e JOIN s ON e.name = s.name""")
def contextual_queries(spark, d):
    return builders.contextual(*_lists(spark, d))


@query(r"""WITH n AS (SELECT DISTINCT query AS name FROM search_hits WHERE query IS NOT NULL), k AS (SELECT DISTINCT query AS name, keyword FROM (SELECT query, lower(unnest(string_split(title, ' '))) AS keyword FROM search_hits WHERE query IS NOT NULL AND title IS NOT NULL) WHERE regexp_matches(keyword, '^[a-z]{9,}$')), r AS (SELECT DISTINCT h.query AS name, unnest(entities) AS e FROM search_hits h JOIN content_item c ON h.url = c.url WHERE query IS NOT NULL)
 SELECT name, name || ' ' || keyword || ' filetype:pdf' AS query FROM k UNION SELECT name, name || ' ' || keyword || ' intitle:"' || keyword || '"' FROM k UNION SELECT name, name || ' ' || e || ' "' || name || ' ' || e || '"' FROM r WHERE e IS NOT NULL""")
def follow_up_queries(spark, d):
    names, related, _ = _lists(spark, d)
    h = load(spark, d, "search_hits", F.col("query").alias("name"), "title").where("name is not null and title is not null")
    words = h.select("name", F.explode(F.split("title", " ")).alias("w")).select("name", F.lower("w").alias("keyword")).where(F.col("keyword").rlike("^[a-z]{9,}$")).distinct()
    return builders.follow_up(names, words, related.distinct())


@query(r"""WITH n AS (SELECT DISTINCT entities[1] AS n, entities[2] AS a, entities[3] AS b, entities[4] AS c FROM content_item WHERE len(entities) > 0)
 SELECT n AS name, q AS query FROM (SELECT n, unnest([CASE WHEN a IS NOT NULL THEN '"' || n || '" "' || a || '" relationship "' || n || '" "' || a || '"' END, '"' || n || '" official reports OR analysis "' || n || '" filetype:pdf', CASE WHEN b IS NOT NULL THEN '"' || n || '" influence on "' || b || '" "' || n || '" "' || b || '"' END, CASE WHEN c IS NOT NULL THEN '"' || n || '" influence on "' || c || '" "' || n || '" "' || c || '"' END]) AS q FROM n) WHERE q IS NOT NULL GROUP BY ALL""")
def initial_queries(spark, d):
    at = lambda i: F.try_element_at("entities", F.lit(i))
    c = load(spark, d, "content_item", "entities").where("size(entities) > 0").select(at(1).alias("name"), at(2).alias("a"), at(3).alias("b"), at(4).alias("c")).distinct()
    return c.select("name", F.explode(builders.initial(F.col("name"), F.col("a"), F.col("b"), F.col("c"))).alias("query")).distinct()


@query(r"""WITH c AS (SELECT query AS base, 0 AS place, query FROM (SELECT DISTINCT query FROM search_hits WHERE query IS NOT NULL) UNION ALL SELECT query, 1, e FROM (SELECT h.query, unnest(c.entities) AS e FROM (SELECT DISTINCT query, url FROM search_hits) h JOIN content_item c ON h.url = c.url) WHERE query IS NOT NULL AND e IS NOT NULL),
 o AS (SELECT base, lower(trim(query)) AS k, min({'p': place, 'q': trim(query)}) AS f FROM c WHERE trim(query) <> '' GROUP BY ALL) SELECT base, row_number() OVER (PARTITION BY base ORDER BY f.p, f.q)::INT AS place, f.q AS query FROM o QUALIFY place <= 6""")
def reseed_queries(spark, d):
    h = load(spark, d, "search_hits", "query", "url").where("query is not null").distinct()
    near = h.join(load(spark, d, "content_item", "url", "entities"), "url").select(F.col("query").alias("base"), F.lit(1).alias("place"), F.explode("entities").alias("query")).where("query is not null")
    base = h.select(F.col("query").alias("base"), F.lit(0).alias("place"), "query").distinct()
    return builders.reseed(base.unionByName(near))


# ---- caches and manifest


@query(f"""WITH l AS (SELECT * FROM translation_cache WHERE expires_at IS NULL OR isnan(expires_at::DOUBLE) OR expires_at >= {NOW}), b AS (SELECT cache_key, translated_text FROM l QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC NULLS LAST, translated_text DESC NULLS LAST) = 1), a AS (SELECT DISTINCT cache_key, source_text FROM translation_cache UNION SELECT 'none', 'missing')
 SELECT a.cache_key, a.source_text, b.translated_text, b.cache_key IS NOT NULL AS hit FROM a LEFT JOIN b ON a.cache_key = b.cache_key""")
def translation_lookup(spark, d):
    c = load(spark, d, "translation_cache", "cache_key", "source_text", "translated_text", "created_at", "expires_at")
    asked = c.select("cache_key", "source_text").unionByName(spark.createDataFrame([("none", "missing")], "cache_key string, source_text string")).distinct().withColumnRenamed("cache_key", "asked_key")
    return caches.get(asked, "asked_key", c, NOW, ["translated_text"]).withColumnRenamed("asked_key", "cache_key")


@query(r"""WITH p AS (SELECT url, raw_content, floor(epoch(crawled_at))::BIGINT AS t, item_id FROM content_item WHERE url IS NOT NULL AND crawled_at IS NOT NULL), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY t DESC, item_id DESC) = 1), m AS (SELECT max(t) AS now FROM p)
 SELECT 'page:' || md5(url) AS cache_key, item_id, t + 86400 AS expires_at, t + 86400 >= m.now - 86400 * 30 AS fresh FROM l, m""")
def page_cache(spark, d):
    from weftgraph.sources.tables import latest

    c = load(spark, d, "content_item", "url", "crawled_at", "item_id").where("url is not null and crawled_at is not null")
    rows = c.select(caches.page_key(F.col("url")).alias("cache_key"), F.unix_timestamp("crawled_at").alias("t"), "item_id")
    once = latest(rows, ["cache_key"], [F.desc("t"), F.desc("item_id")])
    now = rows.agg(F.max("t").alias("now"))
    return once.join(F.broadcast(now)).select("cache_key", "item_id", (F.col("t") + caches.DAY).alias("expires_at"), (F.col("t") + caches.DAY >= F.col("now") - 30 * caches.DAY).alias("fresh"))  # one row


@query(r"""SELECT DISTINCT 'nlp:' || md5(text || chr(0) || coalesce(source_url, '')) AS nlp_key, sha256('translation||' || text || '|en|ro|local') AS translation_key FROM provenance WHERE text IS NOT NULL AND NOT contains(text, chr(0))""")
def cache_lookup_keys(spark, d):
    p = load(spark, d, "provenance", "text", "source_url").where("text is not null")
    none = F.lit(None).cast("string")
    return p.select(caches.nlp_key(F.col("text"), F.col("source_url")).alias("nlp_key"), caches.translation_key(F.col("text"), F.lit("en"), F.lit("ro"), F.lit("local"), none).alias("translation_key")).distinct()


@query(f"""SELECT cache_key, count(*) AS n FROM wikidata_cache WHERE expires_at IS NOT NULL AND NOT isnan(expires_at::DOUBLE) AND expires_at < {NOW} GROUP BY 1""")
def expired_entries(spark, d):
    return caches.expired(load(spark, d, "wikidata_cache", "cache_key", "expires_at"), NOW).groupBy("cache_key").agg(F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT cache_key, max(qid) AS qid FROM wikidata_cache WHERE cache_key < '8' GROUP BY 1), n AS (SELECT cache_key, max(qid) AS qid FROM wikidata_cache WHERE cache_key >= '4' GROUP BY 1)
 SELECT coalesce(n.cache_key, o.cache_key) AS cache_key, CASE WHEN n.cache_key IS NOT NULL THEN n.qid ELSE o.qid END AS qid, CASE WHEN n.cache_key IS NOT NULL THEN {NOW + 180 * 86400} END AS expires_at FROM o FULL JOIN n ON o.cache_key = n.cache_key""")
def cache_after_put(spark, d):
    w = load(spark, d, "wikidata_cache", "cache_key", "qid").groupBy("cache_key").agg(F.max("qid").alias("qid"))
    none = F.lit(None).cast("bigint")
    old = w.where("cache_key < '8'").select("cache_key", "qid", none.alias("created_at"), none.alias("expires_at"), F.lit(0).alias("hit_count"))
    return caches.put(old, w.where("cache_key >= '4'"), NOW, "wikidata").select("cache_key", "qid", "expires_at")


_MF = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) = '/' THEN '/' ELSE regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/+$', '') END || CASE WHEN regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) = '?' THEN '' ELSE regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) END"


@query(rf"""WITH c AS (SELECT url, sha256(raw_content) AS h, item_id AS id, 'files/' || item_id AS path FROM content_item WHERE url IS NOT NULL AND raw_content IS NOT NULL), u AS (SELECT {_MF} AS u, path, h, id FROM c), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY u ORDER BY id DESC) = 1) SELECT u AS manifest_url, h AS sha256, path FROM l""")
def manifest(spark, d):
    from weftgraph.functions.urls import manifest_form

    c = load(spark, d, "content_item", "url", "raw_content", "item_id").where("url is not null and raw_content is not null")
    rows = c.select("url", F.sha2("raw_content", 256).alias("sha256"), F.concat(F.lit("files/"), "item_id").alias("path"), F.col("item_id").alias("created_at"))
    half = caches.manifest_upsert(rows.where("created_at % 2 = 0"), rows.where("created_at % 2 = 1"))
    return half.select(manifest_form(F.col("url")).alias("manifest_url"), "sha256", "path")


@query(rf"""WITH c AS (SELECT url, sha256(raw_content) AS h, item_id AS id, 'files/' || item_id AS path FROM content_item WHERE url IS NOT NULL AND raw_content IS NOT NULL AND content_type = 'webpage'), m AS (SELECT {_MF} AS u, path, h, id FROM c), a AS (SELECT item_id, {_MF} AS u, sha256(raw_content) AS h FROM content_item),
 lu AS (SELECT u, path FROM m QUALIFY row_number() OVER (PARTITION BY u ORDER BY id DESC) = 1), lh AS (SELECT h, path FROM m QUALIFY row_number() OVER (PARTITION BY h ORDER BY id DESC) = 1)
 SELECT item_id, coalesce(lu.path, lh.path) AS path, CASE WHEN lu.path IS NOT NULL THEN 'url' WHEN lh.path IS NOT NULL THEN 'hash' END AS found_by FROM a LEFT JOIN lu ON a.u = lu.u LEFT JOIN lh ON a.h = lh.h""")
def manifest_lookup(spark, d):
    c = load(spark, d, "content_item", "item_id", "url", "raw_content", "content_type")
    known = c.where("url is not null and raw_content is not null and content_type = 'webpage'").select("url", F.sha2("raw_content", 256).alias("sha256"), F.concat(F.lit("files/"), "item_id").alias("path"), F.col("item_id").alias("created_at"))
    asked = c.select("item_id", "url", F.sha2("raw_content", 256).alias("h"))
    return caches.manifest_lookup(asked, "url", "h", known).select("item_id", "path", "found_by")


# ---- pipeline


def _judged(spark, d):
    c = load(spark, d, "content_item", "url", "raw_content", "content_type", "source_url")
    return pipeline.judge(pipeline.enqueue(c, "url", "raw_content", "content_type", "source_url"), TERMS)


_ITEMS = rf"""i AS (SELECT url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_content, '^\d+([A-Z])', '\1'), '^[^\p{{L}}\p{{N}}_\s]+', ''), '^[.,;:!?\-_''"\\/@#$%^&*()\[\]{{}}|<> \t\n\r]+', ''), '[.,;:!?\-_''"\\/@#$%^&*()\[\]{{}}|<> \t\n\r]+$', ''), '\s+', ' ', 'g')) AS t,
 {host_sql('coalesce(source_url, url)')} AS site FROM content_item WHERE raw_content IS NOT NULL), f AS (SELECT *, lower(t) AS l FROM i WHERE t <> ''), h AS (SELECT *, contains(l, 'public')::INT + contains(l, 'harbour')::INT + contains(l, 'inquiry')::INT AS n FROM f), r AS (SELECT *, CASE WHEN contains(l, 'public harbour inquiry') THEN 1.0 WHEN n > 0 THEN least(1.0, n / 3.0 + 0.2) ELSE 0 END AS relevance,
 list_bool_or(list_transform(['404 - page not found','error 404','404 not found','the page you are looking for','this page does not exist','page cannot be found','pagina nu poate fi gasita','aceasta pagina nu exista'], lambda w: contains(lower(substr(t, 1, 500)), w))) OR length(trim(t)) < 100 AS error FROM h), k AS (SELECT *, relevance >= 0.25 AND NOT error AS kept FROM r)"""


@query(f"WITH {_ITEMS} SELECT site, count(*) AS n_items, count(*) FILTER (kept) AS n_kept, count(DISTINCT url) AS n_pages, sum(length(t))::BIGINT AS n_chars FROM k WHERE site IS NOT NULL GROUP BY 1")
def site_batches(spark, d):
    return pipeline.by_site(_judged(spark, d)).where("site is not null")


@query(f"WITH {_ITEMS} SELECT count(*) AS n_items, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept AND NOT error) AS n_irrelevant, count(*) FILTER (error) AS n_errors FROM k")
def pipeline_stats(spark, d):
    return pipeline.stats(_judged(spark, d)).select("n_items", "n_kept", "n_irrelevant", "n_errors")


@query(r"""WITH p AS (SELECT prov_id, text, source_url, lower(trim(text)) AS s FROM provenance WHERE text IS NOT NULL), g AS (SELECT DISTINCT url, lower(raw_content) AS page FROM content_item WHERE raw_content IS NOT NULL),
 j AS (SELECT prov_id, text, CASE WHEN length(s) < 40 THEN 0 WHEN contains(page, s) THEN 1.0 WHEN length(s) > 100 AND contains(page, left(s, 100)) THEN 0.9 WHEN length(s) > 100 AND contains(page, right(s, 100)) THEN 0.9 WHEN length(s) > 80 AND (contains(page, left(s, 80)) OR contains(page, right(s, 80))) THEN 0.8 WHEN length(s) > 40 AND (contains(page, left(s, 40)) OR contains(page, right(s, 40))) THEN 0.7 ELSE 0 END AS c FROM p LEFT JOIN g ON g.url = p.source_url),
 b AS (SELECT prov_id, any_value(text) AS text, max(c) AS c FROM j GROUP BY 1)
 SELECT prov_id, round(c, 6)::DOUBLE AS confidence, CASE WHEN regexp_matches(text, '(?i)Reference This article used a translation|↑\s+[A-Z]+,\s+[A-Z]|\(\s*Romanian\s*\)\s*-\s*↑|Jump to:\s*a\s+b\s+c|^\s*\(\s*[A-Z]{2}\s*\)') THEN 'copied' WHEN c > 0.6 THEN 'original' ELSE 'unverified' END AS origin FROM b""")
def evidence_origin(spark, d):
    p = load(spark, d, "provenance", "prov_id", "text", "source_url").where("text is not null")
    pages = load(spark, d, "content_item", "url", F.col("raw_content").alias("page"))
    return pipeline.origin(p, "text", "source_url", pages).select("prov_id", "confidence", "origin")


@query()
def crawl_order(spark, d):
    c = load(spark, d, "content_item", F.col("source_url").alias("src"), F.col("url").alias("dst")).where("src is not null and dst is not null")
    h = load(spark, d, "search_hits", "url").where("url is not null")
    return pipeline.crawl(c, h.select("url").unionByName(c.select(F.col("src").alias("url"))), ["public", "harbour"], per_round=50, most=200)


@query()
def autonomous_search(spark, d):
    hits = load(spark, d, "search_hits", "query", "url", "title").distinct()

    def search(asked):
        """Results whose query or title holds the asked words."""
        words = asked.select("query", F.lower("query").alias("w"))
        tokens = hits.select("url", "title", F.explode(F.array_distinct(F.concat(F.array(F.lower("query")), F.split(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}]+")))).alias("w"))
        return words.join(tokens, "w").select("query", "url", "title")

    first = hits.where("query is not null").groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(1)
    return pipeline.autonomous(first, search, iterations=3, enough=500)
