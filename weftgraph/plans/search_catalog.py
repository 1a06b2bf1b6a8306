"""Queries of relevance by vectors, keywords, tracked entities and ranked candidates, each beside hand-written SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.operators import graph, tracking
from weftgraph.plans.graph_catalog import evidence_graph
from weftgraph.plans.registry import query
from weftgraph.runtime import load


@query(r"""WITH n AS (SELECT coalesce(source_url, '') AS s, relation_type AS r FROM provenance WHERE relation_type IS NOT NULL) SELECT relation_type, n, n_sources FROM (SELECT r AS relation_type, count(*) AS n, count(DISTINCT s) AS n_sources FROM n GROUP BY ROLLUP (r))""")
def relation_type_stats(spark, d):
    p = load(spark, d, "provenance", F.coalesce("source_url", F.lit("")).alias("s"), "relation_type").where("relation_type is not null")
    return p.rollup("relation_type").agg(F.count("*").alias("n"), F.countDistinct("s").alias("n_sources"))


@query(r"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)), v AS (SELECT vec_id, greatest(0, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])) AS c FROM embeddings, q)
 SELECT doc_id, round(0.6 * c + 0.4 * contains(lower(text), 'harbour')::INT, 4) AS relevance, 0.6 * c + 0.4 * contains(lower(text), 'harbour')::INT >= 0.1 AS relevant FROM documents JOIN v ON doc_id = vec_id WHERE text IS NOT NULL""")
def content_relevance(spark, d):
    e = load(spark, d, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    docs = load(spark, d, "documents", "doc_id", "text").where("text is not null")
    return tracking.content_relevance(docs, "doc_id", "text", e, "vec_id", "v", "harbour").select("doc_id", F.round("relevance", 4).alias("relevance"), (F.col("relevance") >= 0.1).alias("relevant"))


@query(r"""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS neighbour, round(list_cosine_similarity(a, embedding::DOUBLE[]), 6) AS cosine FROM q JOIN embeddings ON vec_id <> query)
 SELECT query, neighbour, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, neighbour)::INT AS rank FROM s WHERE cosine > 0.2 QUALIFY rank <= 5""")
def query_expansion(spark, d):
    e = load(spark, d, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return tracking.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "v", 5, 0.2)


@query(r"""WITH e AS (SELECT DISTINCT 'q:' || query AS src, 'u:' || url AS dst FROM search_hits WHERE query IS NOT NULL AND url IS NOT NULL), g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), l AS (SELECT entity_text AS name, max(json_extract_string(metadata, '$.type')) AS label FROM wikidata_cache WHERE entity_text IS NOT NULL GROUP BY 1)
 SELECT substr(node, 3) AS name, coalesce(label, 'PERSON') AS label, degree FROM g LEFT JOIN l ON g.node = 'q:' || l.name WHERE node LIKE 'q:%' AND degree >= 2 AND coalesce(label, 'PERSON') IN ('PERSON', 'ORG') AND NOT contains(lower(node), 'katherine') ORDER BY degree DESC, name LIMIT 20""")
def deep_dive_candidates(spark, d):
    h = load(spark, d, "search_hits", "query", "url").where("query is not null and url is not null")
    e = graph.undirected(h.select(F.concat(F.lit("q:"), "query").alias("a"), F.concat(F.lit("u:"), "url").alias("b")), "a", "b")
    labels = load(spark, d, "wikidata_cache", "entity_text", "metadata").where("entity_text is not null").groupBy(F.col("entity_text").alias("name")).agg(F.max(F.get_json_object("metadata", "$.type")).alias("label"))
    degree = graph.degrees(e).where("node like 'q:%'").select(F.expr("substring(node, 3)").alias("name"), "degree")
    labels = degree.select("name").join(labels, "name", "left").withColumn("label", F.coalesce("label", F.lit("PERSON")))  # who is asked for counts as a person
    return tracking.deep_dive(degree, labels, ["katherine"], 20)


@query(r"""WITH u AS (SELECT regexp_replace(lower(url), '/+$', '') AS url_key, min(seq) AS seq FROM search_hits WHERE url IS NOT NULL AND lower(url) LIKE '%.pdf' GROUP BY 1) SELECT url_key, seq FROM u ORDER BY seq, url_key LIMIT 20""")
def pdf_downloads(spark, d):
    h = load(spark, d, "search_hits", "url", "seq").where(F.lower("url").endswith(".pdf"))
    return tracking.first_distinct(h, "url", "seq", 20)


@query(r"""WITH t AS (SELECT title FROM search_hits WHERE title IS NOT NULL), r AS (SELECT lower(x) AS k, 3 AS w FROM (SELECT unnest(regexp_extract_all(title, '[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)+')) AS x FROM t) UNION ALL SELECT x, 1 FROM (SELECT unnest(regexp_extract_all(lower(title), '[\p{L}]{4,}')) AS x FROM t) WHERE x NOT IN ('the','and','for','with','from','about','this','that','what','when','where','how'))
 SELECT k AS keyword, sum(w)::BIGINT AS weight FROM r GROUP BY 1""")
def weighted_keywords(spark, d):
    return tracking.weighted_keywords(load(spark, d, "search_hits", "title"), "title")


@query(r"""WITH e AS (SELECT DISTINCT lower(trim(x)) AS name FROM (SELECT unnest(entities) AS x FROM content_item) WHERE length(trim(x)) > 2), w AS (SELECT name, string_split(regexp_replace(name, '[_ -]+', ' ', 'g'), ' ')[1] AS first FROM e), p AS (SELECT prov_id, ' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') || ' ' AS t FROM provenance WHERE text IS NOT NULL)
 SELECT prov_id, count(*) AS n FROM (SELECT DISTINCT prov_id, name FROM p JOIN w ON trim(regexp_replace(name, '[^\p{L}\p{N}]+', ' ', 'g')) <> '' AND contains(t, ' ' || trim(regexp_replace(name, '[^\p{L}\p{N}]+', ' ', 'g')) || ' ')) GROUP BY 1""")
def tracked_mentions(spark, d):
    names = load(spark, d, "content_item", F.explode("entities").alias("name"))
    return tracking.tracked_in(load(spark, d, "provenance", "prov_id", "text"), "prov_id", "text", tracking.tracked(names, "name"))


@query(r"""WITH e AS (SELECT DISTINCT lower(trim(x)) AS entity FROM (SELECT unnest(entities) AS x FROM content_item) WHERE length(trim(x)) > 2) SELECT entity, regexp_matches(entity, 'katherine') AS from_query FROM e""")
def tracked_entities(spark, d):
    return tracking.tracked(load(spark, d, "content_item", F.explode("entities").alias("name")), "name", "katherine")


@query(r"""SELECT DISTINCT url, query FROM search_hits WHERE query IS NOT NULL AND url IS NOT NULL AND title IS NOT NULL AND list_bool_and(list_transform(list_distinct(list_filter(string_split(lower(query), ' '), lambda w: length(w) > 2 AND regexp_matches(w, '^[a-z0-9]+$'))), lambda w: contains(' ' || regexp_replace(lower(title || ' ' || url), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || w || ' '))) AND len(list_filter(string_split(lower(query), ' '), lambda w: length(w) > 2 AND regexp_matches(w, '^[a-z0-9]+$'))) > 0""")
def contextual_links(spark, d):
    h = load(spark, d, "search_hits", "query", "url", "title").where("query is not null and url is not null and title is not null")
    return tracking.contextual_links(h, "query", "url", "title")


@query(r"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, x, min(i) AS pos, count(*) AS n FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[\p{L}]{5,}') AS l FROM d)) GROUP BY 1, 2), k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) <= 20)
 SELECT doc_id, string_agg(x, ',' ORDER BY n DESC, pos) AS keywords FROM k GROUP BY 1""")
def context_keywords(spark, d):
    return tracking.context_keywords(load(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 20)


@query(r"""WITH v AS (SELECT source_url AS a, unnest(list_distinct(list_concat(CASE WHEN relation_type IS NULL THEN [] ELSE [relation_type] END, list_transform(list_filter(coalesce(dates, []), lambda x: regexp_matches(x, '^\d{4}')), lambda x: substr(x, 1, 4))))) AS b, text, prov_id AS seq FROM provenance WHERE source_url IS NOT NULL), e AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, text, seq FROM v WHERE a <> b),
 r AS (SELECT src, dst, text, row_number() OVER (PARTITION BY src, dst ORDER BY seq) AS k, count(*) OVER (PARTITION BY src, dst) AS n FROM e WHERE text IS NOT NULL) SELECT src, dst, max(n) AS n, string_agg(left(text, 60), ' | ' ORDER BY k) AS hover FROM r WHERE k <= 3 GROUP BY 1, 2""")
def edge_hover(spark, d):
    e = evidence_graph(spark, d).where("text is not null")
    k = F.row_number().over(W.partitionBy("src", "dst").orderBy("seq"))
    n = e.groupBy("src", "dst").agg(F.count("*").alias("n"))
    first = e.withColumn("k", k).where("k <= 3").groupBy("src", "dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, 60).alias("t")))), lambda x: x["t"]), " | ").alias("hover"))  # three at most
    return first.join(n, ["src", "dst"])


@query(r"""SELECT DISTINCT regexp_replace(lower(u), '/+$', '') AS url FROM (SELECT url AS u FROM search_hits UNION ALL SELECT url FROM content_item UNION ALL SELECT source_url FROM provenance) WHERE u IS NOT NULL""")
def discovered_urls(spark, d):
    parts = [load(spark, d, "search_hits", "url"), load(spark, d, "content_item", "url"), load(spark, d, "provenance", F.col("source_url").alias("url"))]
    return tracking.all_urls(parts, "url")


@query(r"""SELECT entity, count(*) AS n, count(*) >= 3 AS high_value FROM (SELECT lower(trim(unnest(entities))) AS entity FROM content_item) WHERE length(entity) > 2 AND NOT contains(entity, 'katherine') GROUP BY 1 ORDER BY n DESC, entity LIMIT 50""")
def top_mentions(spark, d):
    return tracking.top_mentions(load(spark, d, "content_item", F.explode("entities").alias("e")), "e", 50, ["Katherine"])


@query(r"""SELECT query, regexp_replace(lower(url), '/+$', '') AS url_key, any_value(e) AS extension, min(seq) AS seq FROM (SELECT query, url, seq, regexp_extract(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')), '(\.[^./]{1,4})$', 1) AS e FROM search_hits WHERE url IS NOT NULL) WHERE e IN ('.pdf', '.doc', '.docx', '.ppt', '.pptx', '.xls', '.xlsx') GROUP BY 1, 2""")
def search_downloads(spark, d):
    return tracking.downloads_of(load(spark, d, "search_hits", "query", "url", "seq"), [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx"])


@query()
def reseed_frontier(spark, d):
    return tracking.reseed_frontier(load(spark, d, "search_hits", "query", "url", "title").distinct(), load(spark, d, "provenance", F.col("source_url").alias("url")).where("url is not null"))


@query(r"""WITH e AS (SELECT item_id, unnest(entities) AS x FROM content_item), w AS (SELECT DISTINCT x FROM e WHERE x IS NOT NULL AND regexp_matches(x, '^\p{Lu}\p{L}+( \p{Lu}\p{L}+){1,3}$') AND NOT regexp_matches(lower(x), '^the ')) SELECT w.x AS entity, 'page ' || max(item_id) AS label, count(*) AS n FROM e JOIN w ON e.x = w.x GROUP BY 1""")
def merged_entities(spark, d):
    from weftgraph.operators import pipeline

    e = load(spark, d, "content_item", "item_id", F.explode("entities").alias("x")).where(F.col("x").rlike(r"^\p{Lu}\p{L}+( \p{Lu}\p{L}+){1,3}$") & ~F.lower("x").rlike("^the "))
    return pipeline.merged_entities(e.withColumn("label", F.concat(F.lit("page "), "item_id")), "x", "label", "item_id")


@query(r"""WITH c AS (SELECT item_id, url, lower(coalesce(content_type, '')) AS c, regexp_extract(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')), '(\.[^./]{1,4})$', 1) AS e FROM content_item)
 SELECT item_id, CASE WHEN e = '.pdf' OR contains(c, 'pdf') THEN 'pdf' WHEN e IN ('.doc', '.docx', '.odt', '.rtf', '.txt') OR contains(c, 'word') THEN 'text' WHEN e IN ('.xls', '.xlsx', '.ods', '.csv') OR contains(c, 'sheet') THEN 'sheet' WHEN e IN ('.ppt', '.pptx') THEN 'slides' WHEN e IN ('.png', '.jpg', '.jpeg', '.gif', '.bmp', '.tiff') OR starts_with(c, 'image') THEN 'image' ELSE 'page' END AS kind FROM c""")
def document_kinds(spark, d):
    from weftgraph.operators import pages

    return load(spark, d, "content_item", "item_id", "url", "content_type").select("item_id", pages.document_kind(F.col("url"), F.col("content_type")).alias("kind"))


@query(r"""WITH p AS (SELECT item_id, trim(regexp_replace(regexp_replace(raw_content, '<[^>]*>', ' ', 'g'), '[\s\x{a0}]+', ' ', 'g')) AS t FROM content_item WHERE raw_content IS NOT NULL AND NOT regexp_matches(raw_content, '&(nbsp|lt|gt|quot|#39|amp);') AND NOT contains(raw_content, '<!--') AND NOT regexp_matches(raw_content, '(?i)<(script|style|noscript|template|title)'))
 SELECT item_id, 'Page ' || item_id AS title, 'Page ' || item_id || ' ' || t AS text FROM p WHERE length('Page ' || item_id || ' ' || t) >= 100 AND NOT regexp_matches('page ' || item_id, '404|403|500') AND NOT list_bool_or(list_transform(['404 - page not found','error 404','404 not found','the page you are looking for','this page does not exist','page cannot be found','pagina nu poate fi gasita','aceasta pagina nu exista'], lambda w: contains(lower(substr('Page ' || item_id || ' ' || t, 1, 500)), w)))""")
def page_contents(spark, d):
    from weftgraph.operators import pages

    r = F.col("raw_content")
    c = load(spark, d, "content_item", "item_id", "raw_content").where(~r.rlike("&(nbsp|lt|gt|quot|#39|amp);") & ~F.contains(r, F.lit("<!--")) & ~r.rlike("(?i)<(script|style|noscript|template|title)"))
    html = F.concat(F.lit("<html><head><title>Page "), "item_id", F.lit("</title></head><body><div>"), r, F.lit("</div></body></html>"))
    return pages.page_content(c.withColumn("html", html), "item_id", "html")
