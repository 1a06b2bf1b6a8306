"""The registered queries of the core, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.constants import COMMON_WORDS, INVALID_WORDS, LABEL_PRIORITY, NAV_WORDS, RELATION_PATTERNS, RELATION_TYPES, SOURCE_PRIORITY
from weftgraph.functions import text as tx
from weftgraph.functions import urls
from weftgraph.operators import contacts, evidence, graph, ranking, temporal
from weftgraph.operators.builders import PERSON_DORKS
from weftgraph.plans.registry import QUERIES as _QUERIES
from weftgraph.plans.registry import SQL as _SQL
from weftgraph.plans.registry import Query
from weftgraph.plans.registry import host_sql as _host
from weftgraph.plans.registry import path_sql as _path
from weftgraph.plans.registry import query as _query
from weftgraph.plans.registry import quoted as _quoted
from weftgraph.runtime import load
from weftgraph.sources import tables

#: Terms of the relevance queries and the moment of the cache queries.
TERMS, NOW = ["public", "harbour", "inquiry"], 1735689600


# ---- URLs


@_query(rf"""SELECT item_id, CASE WHEN regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/$') THEN b ELSE regexp_replace(b, '/+$', '') END AS normalized, h AS host, coalesce(h, nullif({_path('url')}, ''), url) AS site_key,
  list_filter(string_split(h, '.'), lambda x: x NOT IN ('www', 'm'))[1] AS source_token,
  CASE WHEN contains(h, 'wikipedia') THEN 'wikipedia' WHEN contains(h, 'wikidata') THEN 'wikidata' WHEN contains(h, 'dbpedia') THEN 'dbpedia' ELSE string_split(h, '.')[1] END AS source_tag
  FROM (SELECT item_id, url, regexp_replace(url, '#.*$', '') AS b, {_host('url')} AS h FROM content_item)""")
def url_parts(spark, d):
    u = F.col("url")
    return load(spark, d, "content_item", "item_id", "url").select("item_id", urls.normalize(u).alias("normalized"), urls.host(u).alias("host"), urls.site_key(u).alias("site_key"), urls.source_token(u).alias("source_token"), urls.source_tag(u).alias("source_tag"))


@_query(rf"""SELECT item_id, e AS extension, e IN ('.pdf', '.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx', '.odt', '.ods', '.rtf', '.csv', '.txt') AS is_document,
  lower({_path('url')}) LIKE '%.pdf' OR lower(regexp_extract(url, '\?([^#]*)', 1)) LIKE '%pdf' AS is_pdf, regexp_matches(url, '^https?://[^\s/?#]+\.[^\s/?#]+') AS is_http
  FROM (SELECT item_id, url, regexp_extract(lower({_path('url')}), '(\.[^./]{{1,4}})$', 1) AS e FROM content_item)""")
def url_kinds(spark, d):
    u = F.col("url")
    return load(spark, d, "content_item", "item_id", "url").select("item_id", urls.extension(u).alias("extension"), urls.is_document(u).alias("is_document"), urls.is_pdf(u).alias("is_pdf"), urls.is_http(u).alias("is_http"))


@_query()
def url_relevance(spark, d):
    hits = load(spark, d, "search_hits", "query", "url").where("query is not null and url is not null").distinct()
    return hits.select("query", "url", F.round(urls.url_relevance(F.col("url"), F.col("query")), 6).alias("score"))


@_query(f"""SELECT {_host('coalesce(source_url, url)')} AS site, count(*) AS n_rows, count(*) FILTER (is_relevant) AS n_relevant, count(raw_content) AS n_texts, count(DISTINCT url) AS n_urls, round(avg(relevance_score), 6) AS avg_score FROM content_item GROUP BY 1""")
def site_stats(spark, d):
    c = load(spark, d, "content_item", "url", "source_url", "raw_content", "is_relevant", "relevance_score")
    return c.groupBy(urls.host(F.coalesce("source_url", "url")).alias("site")).agg(
        F.count("*").alias("n_rows"), F.count_if("is_relevant").alias("n_relevant"), F.count("raw_content").alias("n_texts"), F.countDistinct("url").alias("n_urls"), F.round(F.avg("relevance_score"), 6).alias("avg_score")
    )


# ---- text


@_query(rf"""WITH n AS (SELECT DISTINCT entity_text FROM wikidata_cache WHERE entity_text IS NOT NULL),
 a AS (SELECT entity_text, regexp_replace(regexp_replace(entity_text, '^[Tt][Hh][Ee][ \t]+', ''), '[''’`´]s$', '') AS x FROM n),
 b AS (SELECT entity_text, regexp_replace(regexp_replace(regexp_replace(x, '\([^()]*\)', '', 'g'), '\[[^\[\]]*\]', '', 'g'), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS x FROM a),
 c AS (SELECT entity_text, regexp_replace(regexp_replace(regexp_replace(x, '[ ]*[''`´’][ ]*[A-Za-z0-9_]+$', ''), '\[[A-Za-z0-9_]+$', ''), '^[A-Za-z0-9_]+\]', '') AS x FROM b),
 e AS (SELECT entity_text, regexp_replace(regexp_replace(x, '[ \t\n\r\f]+', ' ', 'g'), '^ +| +$', '', 'g') AS x FROM c)
 SELECT entity_text, CASE WHEN length(x) >= 2 AND len(string_split(lower(x), ' ')) <= 8 AND len(list_filter(string_split(lower(x), ' '), lambda w: w NOT IN ({_quoted(INVALID_WORDS)}))) > 0
   AND NOT regexp_matches(x, '[?!]|\.\.\.') AND regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN x END AS name FROM e""")
def clean_names(spark, d):
    return load(spark, d, "wikidata_cache", "entity_text").where("entity_text is not null").distinct().select("entity_text", tx.clean_name(F.col("entity_text")).alias("name"))


def _key(x: str) -> str:
    return f"regexp_replace(strip_accents(replace(replace(replace(lower({x}), 'ø', 'o'), 'ß', 'ss'), 'æ', 'ae')), '[^a-z0-9]', '', 'g')"


@_query(f"""SELECT {_key('entity_text')} AS key, count(DISTINCT entity_text) AS n_names, min(entity_text) AS first_name FROM wikidata_cache WHERE entity_text IS NOT NULL GROUP BY 1""")
def unify_keys(spark, d):
    return load(spark, d, "wikidata_cache", "entity_text").where("entity_text is not null").groupBy(tx.unification_key(F.col("entity_text")).alias("key")).agg(F.countDistinct("entity_text").alias("n_names"), F.min("entity_text").alias("first_name"))


@_query(r"""WITH n AS (SELECT DISTINCT entity_text AS name, trim(regexp_replace(lower(entity_text), '[ \t\n\r\f]+', ' ', 'g')) AS l FROM wikidata_cache WHERE entity_text IS NOT NULL),
 k AS (SELECT name, array_to_string(list_sort(string_split(l, ' ')), ' ') AS key, length(string_split(l, ' ')[1]) AS first_len FROM n)
 SELECT key, arg_min(name, (first_len, name)) AS name, count(*) AS n_forms FROM k GROUP BY key""")
def sorted_word_merge(spark, d):
    n = load(spark, d, "wikidata_cache", "entity_text").where("entity_text is not null").distinct().withColumnRenamed("entity_text", "name")
    first = F.length(F.element_at(F.split(tx.squeeze(F.lower("name")), " "), 1))
    return n.groupBy(tx.sorted_words(F.col("name")).alias("key")).agg(F.min_by("name", F.struct(first, "name")).alias("name"), F.count("*").alias("n_forms"))


@_query(rf"""WITH w AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g'), '^ +| +$', '', 'g'), ' ') AS ws FROM documents WHERE text <> '')
 SELECT doc_id, round(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(text), 6) AS alpha_ratio,
  round(len(list_filter(ws, lambda x: regexp_replace(x, '^[.,!?()\[\]{{}}]+|[.,!?()\[\]{{}}]+$', '', 'g') IN ({_quoted(COMMON_WORDS)}))) / len(ws), 6) AS common_ratio FROM w""")
def text_quality(spark, d):
    alpha, common = tx.quality_ratios(F.col("text"))
    return load(spark, d, "documents", "doc_id", "text").where("text <> ''").select("doc_id", F.round(alpha, 6).alias("alpha_ratio"), F.round(common, 6).alias("common_ratio"))


@_query(rf"""WITH b AS (SELECT item_id, unnest(string_split(raw_content, chr(10) || chr(10))) AS raw FROM content_item WHERE raw_content IS NOT NULL),
 s AS (SELECT item_id, regexp_replace(raw, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS b FROM b),
 g AS (SELECT item_id, b FROM s WHERE length(b) >= 40 AND length(b) - length(regexp_replace(b, '[\[\]{{}}()©®™|→←↑↓•·»«]', '', 'g')) <= 0.15 * length(b)
  AND NOT ((length(b) - length(replace(b, '@', '')) > 10 OR length(lower(b)) - length(replace(lower(b), 'http', '')) > 40) AND length(b) - length(regexp_replace(b, '\p{{L}}', '', 'g')) < 30)
  AND length(b) - length(regexp_replace(b, '\p{{Nd}}', '', 'g')) <= 0.4 * length(b) AND length(b) - length(regexp_replace(b, '[.,;:!?–—-]', '', 'g')) <= 2 * len(string_split(trim(regexp_replace(b, '[ \t\n\r\f]+', ' ', 'g')), ' '))
  AND NOT {' AND NOT '.join("contains(lower(b), '" + w.replace("'", "''") + "')" for w in NAV_WORDS)})
 SELECT item_id, count(*) AS n_blocks, sum(length(b))::BIGINT AS n_chars FROM g GROUP BY item_id""")
def block_filter(spark, d):
    c = tx.good_blocks(load(spark, d, "content_item", "item_id", "raw_content"), "item_id", "raw_content")
    return c.groupBy("item_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("b").cast("bigint")).alias("n_chars"))


@_query()
def ascii_names(spark, d):
    return load(spark, d, "wikidata_cache", "entity_text").where("entity_text is not null").distinct().select("entity_text", tx.ascii_fold("entity_text").alias("ascii"))


@_query()
def text_chunks(spark, d):
    return load(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(tx.chunks("text")).alias("chunk", "text"))


@_query()
def label_similarity(spark, d):
    w = load(spark, d, "wikidata_cache", "cache_key", "entity_text", "label").where("label is not null").distinct()
    return w.select("cache_key", "entity_text", "label", F.round(tx.name_similarity("entity_text", "label"), 6).alias("similarity"))


@_query("""SELECT cache_key, entity_text, label, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard
 FROM (SELECT DISTINCT cache_key, entity_text, label, string_split(lower(entity_text), '') AS a, string_split(lower(label), '') AS b FROM wikidata_cache WHERE entity_text <> '' AND label <> '')""")
def char_jaccard(spark, d):
    w = load(spark, d, "wikidata_cache", "cache_key", "entity_text", "label").where("entity_text <> '' and label <> ''").distinct()
    a, b = F.split(F.lower("entity_text"), ""), F.split(F.lower("label"), "")
    return w.select("cache_key", "entity_text", "label", F.round(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), 6).alias("jaccard"))


# ---- contacts


@_query(r"""WITH s AS (SELECT hit_id, sentence FROM contact_hit WHERE sentence IS NOT NULL),
 e AS (SELECT hit_id, 'EMAIL' AS kind, unnest(regexp_extract_all(sentence, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}')) AS v FROM s
  UNION ALL SELECT hit_id, 'PHONE', unnest(regexp_extract_all(sentence, '\+?\d[\d\s().-]{6,}\d')) FROM s
  UNION ALL SELECT hit_id, 'SOCIAL', unnest(regexp_extract_all(sentence, 'https?://(?:www\.)?(?:linkedin\.com/(?:in|company)/|x\.com/|twitter\.com/|facebook\.com/|instagram\.com/|github\.com/)[^\s\]\[)(<>"'']{2,}')) FROM s)
 SELECT hit_id, kind, CASE kind WHEN 'EMAIL' THEN lower(v) WHEN 'PHONE' THEN (CASE WHEN v LIKE '+%' THEN '+' ELSE '' END) || regexp_replace(v, '[^0-9]', '', 'g') ELSE regexp_replace(regexp_replace(regexp_replace(v, '[.,;:]+$', ''), '\?.*$', ''), '/+$', '') END AS value
 FROM e WHERE kind <> 'PHONE' OR (length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7 AND NOT regexp_matches(v, '^(?:(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d{2}|(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])|(?:19|20)\d{2}\s*[-/]\s*(?:19|20)\d{2}|(?:19|20)\d{2}(?:19|20)\d{2})$'))""")
def contact_hits(spark, d):
    return contacts.contact_hits(load(spark, d, "contact_hit", "hit_id", "sentence"), "hit_id", "sentence")


@_query("""SELECT coalesce(kind, 'NONE') AS kind, count(*) AS n_hits, count(DISTINCT value) AS n_values, count(DISTINCT source_url) AS n_sources FROM contact_hit GROUP BY 1""")
def contact_counts(spark, d):
    return load(spark, d, "contact_hit").groupBy(F.coalesce("kind", F.lit("NONE")).alias("kind")).agg(F.count("*").alias("n_hits"), F.countDistinct("value").alias("n_values"), F.countDistinct("source_url").alias("n_sources"))


# ---- provenance and edges


@_query("""WITH p AS (SELECT lower(trim(coalesce(text, ''))) AS t, lower(trim(coalesce(source_url, ''))) AS u, prov_id, CASE WHEN isnan(confidence) THEN NULL ELSE greatest(0.0, least(1.0, confidence)) END AS c, dates FROM provenance)
 SELECT t AS text_key, u AS url_key, min(prov_id) AS prov_id, round(max(c), 6) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(coalesce(dates, []))))), ',') AS dates, count(*) AS n_records FROM p GROUP BY 1, 2""")
def provenance_dedupe(spark, d):
    out = evidence.dedupe_provenance(load(spark, d, "provenance", "prov_id", "text", "source_url", "confidence", "dates"))
    return out.withColumn("confidence", F.round("confidence", 6)).withColumn("dates", F.array_join("dates", ","))


@_query(r"""WITH p AS (SELECT relation_type, trim(lower(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')))) AS reason, source_url FROM provenance WHERE relation_type IS NOT NULL)
 SELECT relation_type, reason, coalesce(array_to_string(list_sort(list_distinct(list(source_url) FILTER (source_url IS NOT NULL))), '|||'), '') AS urls, count(*) AS n FROM p WHERE reason <> '' GROUP BY 1, 2""")
def reason_merge(spark, d):
    p = load(spark, d, "provenance", "relation_type", "text", "source_url").where("relation_type is not null")
    return evidence.merge_reasons(p, ["relation_type"], "text", "source_url")


@_query("""SELECT prov_id, text, coalesce(nullif(source_url, ''), 'unknown') AS url, CASE WHEN isnan(confidence) OR confidence < 0 OR confidence > 1 THEN NULL ELSE abs(round(confidence, 3)) END AS confidence, CASE WHEN len(dates) > 0 THEN array_to_string(dates, ',') END AS dates
 FROM provenance WHERE text IS NOT NULL""")
def legacy_round_trip(spark, d):
    p = load(spark, d, "provenance", "prov_id", "text", "source_url", "confidence", "dates").where("text is not null")
    c = F.when(F.nanvl("confidence", F.lit(-1.0)).between(0, 1), F.abs("confidence"))
    back = p.select("prov_id", evidence.decode_legacy(evidence.encode_legacy(F.col("text"), F.col("source_url"), c, F.col("dates"))).alias("r"))
    return back.select("prov_id", "r.text", "r.url", "r.confidence", F.array_join("r.dates", ",").alias("dates"))


def _trade(spark, d):
    li = load(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    return li.select(F.concat(F.lit("S"), "l_suppkey").alias("a"), F.concat(F.lit("P"), "l_partkey").alias("b"), (1 - F.col("l_discount")).alias("c"), F.concat("l_returnflag", "l_linestatus").alias("k"), F.to_date("l_shipdate").cast("string").alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("s"))


@_query("""WITH e AS (SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, 1 - l_discount AS c, l_returnflag || l_linestatus AS k, strftime(l_shipdate, '%Y-%m-%d') AS d, l_orderkey * 10 + l_linenumber AS s FROM lineitem),
 k AS (SELECT src, dst, k, count(*) AS n, min(s) AS f FROM e GROUP BY ALL), b AS (SELECT src, dst, arg_max(k, (n, -f)) AS relation_type FROM k GROUP BY ALL)
 SELECT e.src, e.dst, count(*) AS n_evidence, round(avg(c), 6) AS confidence, any_value(relation_type) AS relation_type, min(d) AS first_date, max(d) AS last_date FROM e JOIN b ON e.src = b.src AND e.dst = b.dst GROUP BY ALL""")
def edge_aggregate(spark, d):
    e = evidence.aggregate_edges(_trade(spark, d), "a", "b", "c", "k", "d", "s")
    return e.withColumn("n_evidence", F.col("n_evidence").cast("bigint")).withColumn("confidence", F.round("confidence", 6))


@_query("""SELECT o_custkey, round(list_reduce(list((o_orderkey % 97)::DOUBLE / 97 ORDER BY o_orderkey), lambda x, y: (x + y) / 2), 8) AS confidence FROM orders GROUP BY 1""")
def edge_confidence_fold(spark, d):
    o = load(spark, d, "orders", "o_custkey", "o_orderkey").withColumn("c", (F.col("o_orderkey") % 97) / F.lit(97.0))
    return evidence.folded_confidence(o, "o_custkey", "c", "o_orderkey").withColumn("confidence", F.round("confidence", 8))


@_query("""WITH k AS (SELECT source_url, relation_type, count(*) AS n, min(prov_id) AS f FROM provenance WHERE relation_type IS NOT NULL GROUP BY ALL)
 SELECT source_url, relation_type, n FROM k QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY n DESC, f) = 1""")
def primary_relation_type(spark, d):
    return evidence.most_common(load(spark, d, "provenance", "source_url", "relation_type", "prov_id"), "source_url", "relation_type", "prov_id")


@_query(f"""WITH t AS (SELECT entity_text, json_extract_string(metadata, '$.type') AS label, created_at FROM wikidata_cache WHERE entity_text IS NOT NULL), p AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in LABEL_PRIORITY.items())}) v(label, prio))
 SELECT entity_text, coalesce(arg_max(t.label, (coalesce(prio, 0), created_at, t.label)) FILTER (t.label IS NOT NULL), 'UNKNOWN') AS label, count(*) AS n_rows FROM t LEFT JOIN p ON t.label = p.label GROUP BY 1""")
def label_priority(spark, d):
    w = load(spark, d, "wikidata_cache", "entity_text", "metadata", "created_at").where("entity_text is not null")
    label = F.get_json_object("metadata", "$.type")
    prio = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_PRIORITY.items() for x in kv]), label), F.lit(0))
    best = F.max(F.when(label.isNotNull(), F.struct(prio.alias("p"), "created_at", label.alias("l"))))["l"]
    return w.groupBy("entity_text").agg(F.coalesce(best, F.lit("UNKNOWN")).alias("label"), F.count("*").alias("n_rows"))


@_query("""WITH a AS (SELECT qid, unnest(from_json(aliases, '["VARCHAR"]')) AS alias FROM wikidata_cache WHERE qid IS NOT NULL AND aliases LIKE '[%' UNION ALL SELECT qid, entity_text FROM wikidata_cache WHERE qid IS NOT NULL AND entity_text IS NOT NULL)
 SELECT qid, count(DISTINCT alias) AS n_aliases, array_to_string(list_sort(list_distinct(list(alias))), '|') AS aliases FROM a GROUP BY qid""")
def node_aliases(spark, d):
    w = load(spark, d, "wikidata_cache", "qid", "entity_text", "aliases").where("qid is not null")
    a = w.select("qid", F.explode(F.from_json("aliases", "array<string>")).alias("alias")).unionByName(w.where("entity_text is not null").select("qid", F.col("entity_text").alias("alias")))
    return a.distinct().groupBy("qid").agg(F.count("*").alias("n_aliases"), F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("aliases"))


# ---- graph


def _search_edges(spark, d):
    h = load(spark, d, "search_hits", "query", "url").where("query is not null and url is not null")
    return graph.undirected(h.select(F.concat(F.lit("q:"), "query").alias("a"), F.concat(F.lit("u:"), "url").alias("b")), "a", "b")


_EDGES = "e AS (SELECT DISTINCT 'q:' || query AS src, 'u:' || url AS dst FROM search_hits WHERE query IS NOT NULL AND url IS NOT NULL), x AS (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e), dg AS (SELECT node, count(*) AS degree FROM x GROUP BY 1)"


@_query(f"WITH {_EDGES} SELECT node, degree FROM dg")
def degree(spark, d):
    return graph.degrees(_search_edges(spark, d))


@_query(f"WITH {_EDGES} SELECT node, degree FROM dg WHERE degree >= 2")
def degree_filter(spark, d):
    return graph.degrees(_search_edges(spark, d)).where("degree >= 2")


@_query(f"WITH {_EDGES} SELECT node, degree FROM dg ORDER BY degree DESC, node LIMIT 200")
def top_nodes(spark, d):
    return graph.degrees(_search_edges(spark, d)).orderBy(F.desc("degree"), "node").limit(200)


@_query(f"WITH {_EDGES} SELECT x.node, x.other, dg.degree, row_number() OVER (PARTITION BY x.node ORDER BY dg.degree DESC, x.other) AS rank FROM x JOIN dg ON x.other = dg.node QUALIFY rank <= 5")
def neighbors_ranked(spark, d):
    return graph.neighbors_ranked(_search_edges(spark, d), 5).withColumn("rank", F.col("rank").cast("bigint"))


@_query(f"WITH {_EDGES} SELECT node, degree, round(CASE WHEN hi = lo THEN 23.0 ELSE 12 + 22.0 * (degree - lo) / (hi - lo) END, 6)::DOUBLE AS size FROM dg, (SELECT min(degree) AS lo, max(degree) AS hi FROM dg)")
def node_sizes(spark, d):
    return graph.node_sizes(_search_edges(spark, d)).withColumn("size", F.round("size", 6))


@_query("""SELECT url FROM (SELECT DISTINCT url FROM content_item WHERE url IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM provenance p WHERE p.source_url = c.url)""")
def isolated_pages(spark, d):
    return load(spark, d, "content_item", "url").where("url is not null").distinct().join(load(spark, d, "provenance", "source_url"), F.col("url") == F.col("source_url"), "left_anti")


_REACH = "r AS (SELECT node, node AS other FROM dg UNION SELECT r.node, x.other FROM r JOIN x ON r.other = x.node)"


@_query(f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT node, min(other) AS component FROM r GROUP BY node")
def components(spark, d):
    return graph.components(_search_edges(spark, d))


@_query(f"WITH RECURSIVE {_EDGES}, {_REACH}, c AS (SELECT node, min(other) AS component FROM r GROUP BY node) SELECT node, component FROM c WHERE component IN (SELECT component FROM c WHERE node LIKE 'q:%Katherine%')")
def component_filter(spark, d):
    e = _search_edges(spark, d)
    return graph.keep_components(e, graph.ends(e).select("node").where("node like 'q:%Katherine%'"))


@_query(f"""WITH {_EDGES}, s AS (SELECT node FROM dg WHERE node LIKE 'q:%Katherine%'), h1 AS (SELECT DISTINCT x.other AS node FROM x JOIN s ON x.node = s.node WHERE x.other NOT IN (SELECT node FROM s)),
 h2 AS (SELECT DISTINCT x.other AS node FROM x JOIN h1 ON x.node = h1.node WHERE x.other NOT IN (SELECT node FROM s UNION SELECT node FROM h1)) SELECT node, 0 AS distance FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def k_hop(spark, d):
    e = _search_edges(spark, d)
    return graph.within_hops(e, graph.ends(e).select("node").where("node like 'q:%Katherine%'"), 2)


@_query(f"""WITH e AS (SELECT query AS a, {_key('query')} AS ka, {_host('url')} AS b FROM search_hits WHERE query IS NOT NULL AND {_host('url')} IS NOT NULL) SELECT least(ka, b) AS src, greatest(ka, b) AS dst, count(*)::BIGINT AS n FROM e WHERE ka <> b GROUP BY ALL""")
def node_contraction(spark, d):
    h = load(spark, d, "search_hits", "query", "url").select(F.col("query").alias("src"), urls.host(F.col("url")).alias("dst")).where("src is not null and dst is not null")
    edges = h.groupBy("src", "dst").agg(F.count("*").alias("n"))
    mapping = h.select(F.col("src").alias("node")).distinct().withColumn("into", tx.unification_key(F.col("node")))
    return graph.contract(edges, mapping)


@_query("""WITH a AS (SELECT DISTINCT e AS name FROM (SELECT unnest(entities) AS e FROM content_item) WHERE e <> ''), s AS (SELECT DISTINCT string_split(name, ' ')[-1] AS name FROM a WHERE contains(name, ' ')), w AS (SELECT name, unnest(list_distinct(string_split(lower(name), ' '))) AS word FROM a WHERE contains(name, ' '))
 SELECT s.name AS partial, w.name AS full_name FROM s JOIN w ON w.word = lower(s.name)""")
def partial_names(spark, d):
    a = load(spark, d, "content_item", F.explode("entities").alias("name")).where("name <> '' and contains(name, ' ')").distinct()
    return graph.partial_names(a.select(F.element_at(F.split("name", " "), -1).alias("name")).unionByName(a), "name")


@_query("""SELECT coalesce(a.url, b.url) AS url, coalesce(b.n, a.n) AS n FROM (SELECT url, count(*) AS n FROM content_item WHERE url IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT source_url AS url, count(*) AS n FROM provenance WHERE source_url IS NOT NULL GROUP BY 1) b ON a.url = b.url""")
def graph_compose(spark, d):
    a = load(spark, d, "content_item", "url").where("url is not null").groupBy("url").agg(F.count("*").alias("n"))
    b = load(spark, d, "provenance", "source_url").where("source_url is not null").groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n"))
    return tables.compose(a, b, ["url"])


@_query(f"""WITH {_EDGES} SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT query) FROM search_hits) AS entities, (SELECT count(*) FROM search_hits) AS relations""")
def graph_stats(spark, d):
    e, h = _search_edges(spark, d), load(spark, d, "search_hits", "query")
    counts = graph.degrees(e).agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("bigint").alias("edges"))
    return counts.join(F.broadcast(h.agg(F.countDistinct("query").alias("entities"), F.count("*").alias("relations"))))  # one row each


@_query("""SELECT coalesce(json_extract_string(metadata, '$.type'), 'UNKNOWN') AS label, count(*) AS n, count(DISTINCT entity_text) AS n_names FROM wikidata_cache GROUP BY 1""")
def entity_type_counts(spark, d):
    return load(spark, d, "wikidata_cache", "metadata", "entity_text").groupBy(F.coalesce(F.get_json_object("metadata", "$.type"), F.lit("UNKNOWN")).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("entity_text").alias("n_names"))


@_query("""SELECT entity, count(*) AS n_pages FROM (SELECT item_id, unnest(list_distinct(entities)) AS entity FROM content_item) WHERE length(entity) >= 3 GROUP BY 1 HAVING count(*) >= 3""")
def mention_high_value(spark, d):
    return load(spark, d, "content_item", "item_id", "entities").select(F.explode(F.array_distinct("entities")).alias("entity")).where(F.length("entity") >= 3).groupBy("entity").agg(F.count("*").alias("n_pages")).where("n_pages >= 3")


@_query("""WITH c AS (SELECT item_id, entities AS e FROM content_item), a AS (SELECT item_id, e, unnest(range(1, len(e) + 1)) AS i FROM c), p AS (SELECT item_id, e[i] AS s, i, unnest(range(i + 1, len(e) + 1)) AS j, e FROM a)
 SELECT least(s, e[j]) AS src, greatest(s, e[j]) AS dst, count(*) AS n, min(j - i)::INT AS least_gap FROM p WHERE s <> e[j] GROUP BY ALL""")
def cooccurrence_edges(spark, d):
    p = ranking.ordered_pairs(load(spark, d, "content_item", "item_id", "entities"), "item_id", "entities")
    return p.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("n"), F.min("gap").cast("int").alias("least_gap"))


@_query(f"""SELECT url, {_host('url')} AS host FROM (SELECT DISTINCT url FROM content_item WHERE url IS NOT NULL) WHERE NOT regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif|bmp|svg|webp|tiff|ico|raw|pdf)') AND regexp_matches(url, '^https?://')""")
def page_urls_without_files(spark, d):
    u = load(spark, d, "content_item", "url").where("url is not null").distinct()
    return u.where(~F.lower("url").rlike(r"\.(jpg|jpeg|png|gif|bmp|svg|webp|tiff|ico|raw|pdf)") & F.col("url").rlike("^https?://")).select("url", urls.host(F.col("url")).alias("host"))


# ---- relations


@_query(f"""SELECT prov_id, p.pattern_no, p.relation FROM provenance v JOIN (VALUES {', '.join(f"({k}, '{r}', '{x}')" for k, (r, _, x, _) in enumerate(RELATION_PATTERNS))}) p(pattern_no, relation, pattern) ON regexp_matches(lower(v.text), p.pattern)""")
def pattern_relations(spark, d):
    return ranking.pattern_relations(load(spark, d, "provenance", "prov_id", "text"), "prov_id", "text")


_RELATION_WORDS = ", ".join(f"('{w}', '{name}', {k}, {c})" for k, (name, parts) in enumerate(RELATION_TYPES.items()) for c, words in zip((3, 2, 1), parts, strict=True) for w in words)


@_query(f"""WITH t(word, relation, place, points) AS (VALUES {_RELATION_WORDS}), q AS (SELECT prov_id, lower(regexp_replace(text, '[^A-Za-z-]+', ' ', 'g')) AS x FROM provenance WHERE text IS NOT NULL),
 w AS (SELECT DISTINCT prov_id, unnest(string_split(x, ' ')) AS word FROM q UNION SELECT prov_id, t.word FROM q JOIN t ON contains(t.word, ' ') AND contains(' ' || x || ' ', ' ' || t.word || ' ')),
 h AS (SELECT DISTINCT prov_id, relation, place, points FROM w JOIN t ON w.word = t.word), s AS (SELECT prov_id, relation, place, sum(points)::BIGINT AS score, max(points) AS top FROM h GROUP BY ALL)
 SELECT prov_id, arg_max(relation, (score, -place)) AS relation, max(score) AS score FROM s WHERE top > 1 GROUP BY prov_id""")
def relation_types(spark, d):
    return ranking.classify_relations(load(spark, d, "provenance", "prov_id", "text").where("text is not null"), "prov_id", "text")


# ---- relevance and ranking


@_query()
def search_scores(spark, d):
    h = load(spark, d, "search_hits", "query", "url", "title", "source").distinct()
    s = h.withColumn("score", F.round(ranking.search_score(F.col("query"), F.col("url"), F.col("title")), 6)).withColumn("iterative", F.round(ranking.iterative_score(F.col("query"), F.col("url"), F.col("title")), 6))
    return s.where("score >= 0.3 or iterative is not null")


@_query("""WITH h AS (SELECT query, regexp_replace(lower(url), '/+$', '') AS url_key, seq, url, source FROM search_hits WHERE url IS NOT NULL)
 SELECT query, url_key, min(seq) AS seq, first(url ORDER BY seq, url) AS url, first(source ORDER BY seq, url) AS source, count(*) AS n_hits FROM h GROUP BY 1, 2""")
def union_distinct_ranked(spark, d):
    return ranking.first_per_url(load(spark, d, "search_hits", "query", "url", "source", "seq"))


@_query("""SELECT DISTINCT url FROM content_item c WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM search_hits h WHERE h.url = c.url)""")
def seen_difference(spark, d):
    return load(spark, d, "content_item", "url").where("url is not null").distinct().join(load(spark, d, "search_hits", F.col("url").alias("u")), F.col("url") == F.col("u"), "left_anti")


@_query(r"""WITH w AS (SELECT unnest(regexp_split_to_array(regexp_replace(title, '[|:\-]', ' ', 'g'), '[ \t\n\r\f]+')) AS w FROM search_hits WHERE title IS NOT NULL), k AS (SELECT lower(regexp_replace(w, '^[.,!?()\[\]{}]+|[.,!?()\[\]{}]+$', '', 'g')) AS keyword FROM w)
 SELECT keyword, count(*) AS n FROM k WHERE length(keyword) >= 4 AND keyword NOT IN ('the','and','for','with','from','about','this','that','what','when','where','how') GROUP BY 1 ORDER BY n DESC, keyword LIMIT 10""")
def top_keywords(spark, d):
    return ranking.keyword_counts(load(spark, d, "search_hits", "title"), "title").orderBy(F.desc("n"), "keyword").limit(10)


def _frontier(spark, d):
    best = ranking.first_per_url(load(spark, d, "search_hits", "query", "url", "source", "seq"))
    prio = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv]), F.col("source")), F.lit(999))
    return ranking.top_per_group(best.withColumn("priority", prio), "query", [F.asc("priority"), F.desc("n_hits"), F.asc("seq"), F.asc("url_key")], 3)


@_query("""WITH h AS (SELECT query, regexp_replace(lower(url), '/+$', '') AS url_key, seq, url, source FROM search_hits WHERE url IS NOT NULL), b AS (SELECT query, url_key, min(seq) AS seq, first(source ORDER BY seq, url) AS source, count(*) AS n_hits FROM h GROUP BY 1, 2)
 SELECT query, url_key, CASE source WHEN 'seed' THEN 0 WHEN 'google' THEN 1 WHEN 'bing' THEN 2 WHEN 'ddg' THEN 3 ELSE 999 END AS priority, row_number() OVER (PARTITION BY query ORDER BY priority, n_hits DESC, seq, url_key)::INT AS rank FROM b QUALIFY rank <= 3""")
def frontier_top(spark, d):
    return _frontier(spark, d).select("query", "url_key", "priority", "rank")


@_query("""SELECT item_id, round(CASE WHEN contains(t, 'public harbour inquiry') THEN 1.0 WHEN h > 0 THEN least(1.0, h / 3.0 + 0.2) ELSE 0.0 END, 6)::DOUBLE AS quick, round((CASE WHEN contains(t, 'public harbour inquiry') THEN 0.5 ELSE 0.0 END) + 0.1 * h, 6)::DOUBLE AS document
 FROM (SELECT item_id, lower(raw_content) AS t, contains(lower(raw_content), 'public')::INT + contains(lower(raw_content), 'harbour')::INT + contains(lower(raw_content), 'inquiry')::INT AS h FROM content_item WHERE raw_content IS NOT NULL)""")
def text_relevance(spark, d):
    t = F.col("raw_content")
    return load(spark, d, "content_item", "item_id", "raw_content").where("raw_content is not null").select("item_id", F.round(ranking.quick_relevance(t, TERMS), 6).alias("quick"), F.round(ranking.document_relevance(t, TERMS), 6).alias("document"))


@_query("""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4) AS cosine FROM embeddings, q""")
def cosine_relevance(spark, d):
    e = load(spark, d, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.orderBy("vec_id").limit(1).select(F.col("v").alias("q"))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return e.join(F.broadcast(q)).select("vec_id", F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 4).alias("cosine"))


@_query(f"""WITH n AS (SELECT DISTINCT query AS name FROM search_hits WHERE query IS NOT NULL), t(template, t) AS (VALUES {', '.join(f"({k}, '{x}')" for k, x in enumerate(PERSON_DORKS))}) SELECT name, template, replace(t, '{{n}}', name) AS dork FROM n, t""")
def person_dorks(spark, d):
    return ranking.person_dorks(load(spark, d, "search_hits", F.col("query").alias("name")), "name")


# ---- time, caches, sources


@_query(r"""SELECT prov_id, unnest(regexp_extract_all(lower(text), '\b(?:since|from|in|during|on)\s+(\d{4})\b', 1)) || '-01-01' AS iso FROM provenance WHERE text IS NOT NULL""")
def text_dates(spark, d):
    return load(spark, d, "provenance", "prov_id", "text").where("text is not null").select("prov_id", F.explode(temporal.years_in(F.col("text"))).alias("y")).select("prov_id", temporal.normalize_date(F.col("y")).alias("iso"))


_MONTH = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(l, 1, 3))"


@_query(rf"""WITH y AS (SELECT DISTINCT unnest(dates) AS raw FROM provenance), x AS (SELECT raw FROM y UNION SELECT 'from ' || substr(raw, 1, 4) || ' to ' || substr(raw, 1, 4) FROM y WHERE regexp_matches(raw, '^\d{{4}}') UNION SELECT 'March ' || substr(raw, 1, 4) FROM y WHERE regexp_matches(raw, '^\d{{4}}')),
 l AS (SELECT raw, lower(trim(raw)) AS l FROM x WHERE raw IS NOT NULL), n AS (SELECT raw, CASE WHEN regexp_matches(l, '^(?:between |from )?(\d{{4}}) (?:to|and|-) (\d{{4}})$') THEN regexp_extract(l, '(\d{{4}}) (?:to|and|-)', 1) || '-01-01/' || regexp_extract(l, '(\d{{4}})$', 1) || '-12-31'
  WHEN regexp_matches(l, '^\d{{4}}[-/]\d{{2}}[-/]\d{{2}}$') THEN replace(l, '/', '-') WHEN regexp_matches(l, '^[a-z]{{3,9}}\.? \d{{4}}$') AND {_MONTH} > 0 THEN right(l, 4) || '-' || lpad({_MONTH}::VARCHAR, 2, '0') || '-01' WHEN regexp_matches(l, '^\d{{4}}$') THEN l || '-01-01' END AS iso FROM l)
 SELECT raw, iso, CASE WHEN contains(iso, '/') THEN 'range' WHEN iso LIKE '%-01-01' THEN 'year_only' WHEN iso LIKE '%-01' THEN 'month_year' WHEN iso IS NOT NULL THEN 'full_date' END AS kind FROM n""")
def date_kinds(spark, d):
    y = load(spark, d, "provenance", "dates").select(F.explode("dates").alias("raw")).where("raw is not null")
    years = y.where(F.col("raw").rlike(r"^\d{4}")).select(F.substring("raw", 1, 4).alias("y"))
    x = y.unionByName(years.select(F.concat(F.lit("from "), "y", F.lit(" to "), "y").alias("raw"))).unionByName(years.select(F.concat(F.lit("March "), "y").alias("raw"))).distinct()
    iso = temporal.normalize_date(F.col("raw"))
    return x.select("raw", iso.alias("iso"), temporal.date_type(iso).alias("kind"))


@_query("""SELECT prov_id, source_url, sentence_offset, distance FROM (SELECT prov_id, source_url, sentence_offset, least(sentence_offset - lag(sentence_offset) OVER w, lead(sentence_offset) OVER w - sentence_offset) AS distance FROM provenance WHERE sentence_offset IS NOT NULL AND source_url IS NOT NULL WINDOW w AS (PARTITION BY source_url ORDER BY sentence_offset, prov_id)) WHERE distance <= 50""")
def evidence_nearby(spark, d):
    return temporal.nearest_within(load(spark, d, "provenance", "prov_id", "source_url", "sentence_offset"), "source_url", "sentence_offset", "prov_id", 50)


@_query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS antecedent FROM events""")
def antecedent_asof(spark, d):
    e = load(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    return temporal.antecedent(e, "user_id", ["ts", "event_id"], "event_id", F.col("event_type") == "click").select("event_id", "user_id", F.coalesce("antecedent", F.lit(0)).alias("antecedent"))


@_query(f"""SELECT 'translation' AS cache_type, count(*) AS n, sum(coalesce(hit_count, 0))::BIGINT AS hits, count(*) FILTER (expires_at IS NULL OR isnan(expires_at::DOUBLE) OR expires_at >= {NOW}) AS n_live FROM translation_cache
 UNION ALL SELECT 'wikidata', count(*), sum(coalesce(hit_count, 0))::BIGINT, count(*) FILTER (expires_at IS NULL OR isnan(expires_at::DOUBLE) OR expires_at >= {NOW}) FROM wikidata_cache""")
def cache_stats(spark, d):
    def one(name, table):
        c = load(spark, d, table, "hit_count", "expires_at")
        alive = F.col("expires_at").isNull() | F.isnan(F.col("expires_at").cast("double")) | (F.col("expires_at") >= NOW)
        return c.agg(F.count("*").alias("n"), F.sum(F.coalesce("hit_count", F.lit(0))).cast("bigint").alias("hits"), F.count_if(alive).alias("n_live")).select(F.lit(name).alias("cache_type"), "n", "hits", "n_live")

    return one("translation", "translation_cache").unionByName(one("wikidata", "wikidata_cache"))


@_query(f"""SELECT cache_key, max(entity_text) AS entity_text, max(hit_count)::BIGINT AS hit_count, max(qid) IS NULL AS unresolved FROM wikidata_cache WHERE expires_at IS NULL OR isnan(expires_at::DOUBLE) OR expires_at >= {NOW} GROUP BY 1""")
def cache_live(spark, d):
    live = tables.live(load(spark, d, "wikidata_cache", "cache_key", "entity_text", "qid", "expires_at", "hit_count"), NOW)
    return live.groupBy("cache_key").agg(F.max("entity_text").alias("entity_text"), F.max("hit_count").cast("bigint").alias("hit_count"), F.max("qid").isNull().alias("unresolved"))


@_query(f"""WITH n AS (SELECT DISTINCT lower(trim(entity_text)) AS k FROM wikidata_cache WHERE entity_text IS NOT NULL) SELECT k AS name, sha256('wikidata|' || k) AS lookup_key FROM n""")
def cache_keys(spark, d):
    n = load(spark, d, "wikidata_cache", "entity_text").where("entity_text is not null").select(F.lower(F.trim("entity_text")).alias("name")).distinct()
    return n.select("name", F.sha2(F.concat(F.lit("wikidata|"), "name"), 256).alias("lookup_key"))


@_query("""SELECT url, max(item_id) FILTER (true) AS n_dummy, arg_max(item_id, (crawled_at, item_id)) AS item_id, count(*) AS n_fetches FROM content_item WHERE url IS NOT NULL AND crawled_at IS NOT NULL GROUP BY url""".replace("max(item_id) FILTER (true) AS n_dummy, ", ""))
def latest_fetch(spark, d):
    c = load(spark, d, "content_item", "url", "item_id", "crawled_at").where("url is not null and crawled_at is not null")
    return c.groupBy("url").agg(F.max(F.struct("crawled_at", "item_id"))["item_id"].alias("item_id"), F.count("*").alias("n_fetches"))


@_query("""SELECT sha256(raw_content) AS content_hash, min(item_id) AS item_id, count(*) AS n FROM content_item WHERE raw_content IS NOT NULL GROUP BY 1""")
def content_hashes(spark, d):
    return load(spark, d, "content_item", "item_id", "raw_content").where("raw_content is not null").groupBy(F.sha2("raw_content", 256).alias("content_hash")).agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))


@_query("""SELECT date_diff('day', crawled_at::DATE, ingested_at::DATE) AS days_late, count(*) AS n FROM content_item WHERE crawled_at IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1""")
def late_rows(spark, d):
    c = load(spark, d, "content_item", "crawled_at", "ingested_at").where("crawled_at is not null and ingested_at is not null")
    return c.groupBy(F.datediff("ingested_at", "crawled_at").cast("bigint").alias("days_late")).agg(F.count("*").alias("n"))


@_query("""SELECT p.prov_id, count(*) AS n_pages, count(*) FILTER (contains(lower(c.raw_content), lower(p.text))) AS n_full, count(*) FILTER (contains(lower(c.raw_content), lower(substr(p.text, 1, 40)))) AS n_prefix
 FROM provenance p JOIN content_item c ON c.url = p.source_url WHERE length(p.text) >= 40 AND c.raw_content IS NOT NULL GROUP BY 1""")
def sentence_in_source(spark, d):
    p = load(spark, d, "provenance", "prov_id", "text", "source_url").where("length(text) >= 40")
    # a page that was fetched often with one text is looked through once
    c = load(spark, d, "content_item", "url", F.lower("raw_content").alias("page")).where("page is not null and url is not null").groupBy("url", "page").agg(F.count("*").alias("n"))
    j = p.join(c, F.col("url") == F.col("source_url"))
    hits = lambda x: F.sum(F.when(F.contains("page", F.lower(x)), F.col("n")).otherwise(0))
    return j.groupBy("prov_id").agg(F.sum("n").alias("n_pages"), hits(F.col("text")).alias("n_full"), hits(F.substring("text", 1, 40)).alias("n_prefix"))


@_query("""SELECT source_url AS url, count(*) AS n_evidence, coalesce(array_to_string(list_sort(list_distinct(list(relation_type) FILTER (relation_type IS NOT NULL))), ','), '') AS relations FROM provenance WHERE lower(source_url) LIKE '%.pdf' GROUP BY 1""")
def documents_index(spark, d):
    p = load(spark, d, "provenance", "source_url", "relation_type").where(F.lower("source_url").endswith(".pdf"))
    return p.groupBy(F.col("source_url").alias("url")).agg(F.count("*").alias("n_evidence"), F.array_join(F.array_sort(F.collect_set("relation_type")), ",").alias("relations"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated evidence as a graph of sites and relation types, ranked by degree."""
    once = evidence.dedupe_provenance(load(spark, sf_dir, "provenance", "prov_id", "text", "source_url", "confidence", "dates"))
    kinds = load(spark, sf_dir, "provenance", "prov_id", "relation_type").where("relation_type is not null")
    edges = once.join(kinds, "prov_id").select(urls.host(F.col("url_key")).alias("src"), F.col("relation_type").alias("dst"), "confidence").where("src is not null")
    merged = edges.groupBy("src", "dst").agg(F.count("*").alias("n_evidence"), F.avg("confidence").alias("confidence"))
    degree_ = graph.degrees(merged).select(F.col("node").alias("src"), "degree")
    return merged.join(degree_, "src").withColumn("rank", F.dense_rank().over(W.partitionBy("dst").orderBy(F.desc("n_evidence"), "src")))


from weftgraph.plans import extract_catalog as _extract  # noqa: E402, F401
from weftgraph.plans import flow_catalog as _flow  # noqa: E402, F401
from weftgraph.plans import graph_catalog as _graph  # noqa: E402, F401  these register their queries
from weftgraph.plans import search_catalog as _search  # noqa: E402, F401
from weftgraph.plans import text_catalog as _text  # noqa: E402, F401


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
