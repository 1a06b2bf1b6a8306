"""Queries of the graph's finishing, canonical entities and view tables, each beside hand-written SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import canonical, finishing, graph, views
from weftgraph.plans.registry import query
from weftgraph.runtime import load

TERMS = ["elverin", "2014"]


def evidence_graph(spark, d):
    """Evidence of provenance between a source page and its relation types and years."""
    p = load(spark, d, "provenance", "prov_id", "text", "source_url", "confidence", "dates", "relation_type").where("source_url is not null")
    years = F.transform(F.filter(F.coalesce("dates", F.array().cast("array<string>")), lambda x: x.rlike(r"^\d{4}")), lambda x: F.substring(x, 1, 4))
    ends = F.array_distinct(F.concat(F.array_compact(F.array("relation_type")), years))
    e = p.select(F.col("source_url").alias("a"), F.explode(ends).alias("b"), "text", "source_url", "confidence", F.col("prov_id").alias("seq"))
    return e.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "text", "source_url", "confidence", "seq")


_E = r"""v AS (SELECT source_url AS a, unnest(list_distinct(list_concat(CASE WHEN relation_type IS NULL THEN [] ELSE [relation_type] END, list_transform(list_filter(coalesce(dates, []), lambda x: regexp_matches(x, '^\d{4}')), lambda x: substr(x, 1, 4))))) AS b, text, source_url, confidence, prov_id AS seq FROM provenance WHERE source_url IS NOT NULL),
 e AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, text, source_url, confidence, seq FROM v WHERE a <> b), x AS (SELECT DISTINCT src AS node, dst AS other FROM e UNION SELECT dst, src FROM e)"""
_KEPT = "SELECT src, dst, count(*) AS n FROM e WHERE src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone) GROUP BY ALL"


def _edges(e):
    return e.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(rf"""WITH {_E}, gone AS (SELECT DISTINCT relation_type AS node FROM provenance WHERE lower(relation_type) IN ('employment', 'owns')) {_KEPT}""")
def without_labels(spark, d):
    kinds = load(spark, d, "provenance", F.col("relation_type").alias("node")).where("node is not null").distinct().withColumn("label", F.upper("node"))
    return _edges(finishing.drop_labels(evidence_graph(spark, d), kinds, ["Employment", "owns"]))


_HOLDS = "(contains(lower({c}), 'elverin') OR contains(lower({c}), '2014'))"


@query(rf"""WITH {_E}, r AS (SELECT node, avg({_HOLDS.replace('{c}', 'other')}::INT::DOUBLE) AS near FROM x GROUP BY 1)
 SELECT node, round(CASE WHEN {_HOLDS.replace('{c}', 'node')} THEN 1.0 WHEN len(list_intersect(['elverin', '2014'], regexp_split_to_array(replace(lower(node), '_', ' '), '\s+'))) > 0 THEN len(list_intersect(['elverin', '2014'], regexp_split_to_array(replace(lower(node), '_', ' '), '\s+'))) / 2 ELSE 0.5 * near END, 6)::DOUBLE AS relevance FROM r""")
def node_relevance(spark, d):
    return finishing.node_relevance(evidence_graph(spark, d), TERMS).withColumn("relevance", F.round("relevance", 6))


@query(rf"""WITH {_E}, r AS (SELECT node, avg({_HOLDS.replace('{c}', 'other')}::INT::DOUBLE) AS near FROM x GROUP BY 1), gone AS (SELECT node FROM r WHERE NOT {_HOLDS.replace('{c}', 'node')} AND NOT list_has_any(['elverin', '2014'], regexp_split_to_array(replace(lower(node), '_', ' '), '\s+')) AND 0.5 * near <= 0.02) {_KEPT}""")
def relevant_graph(spark, d):
    return _edges(finishing.drop_irrelevant(evidence_graph(spark, d), TERMS, 0.02))


@query(rf"""WITH {_E}, r AS (SELECT node, avg({_HOLDS.replace('{c}', 'other')}::INT::DOUBLE) AS near FROM x GROUP BY 1), gone AS (SELECT node FROM r WHERE NOT {_HOLDS.replace('{c}', 'node')} AND near < 0.05) {_KEPT}""")
def term_graph(spark, d):
    return _edges(finishing.keep_relevant(evidence_graph(spark, d), TERMS, 0.05))


@query(rf"""WITH {_E}, y AS (SELECT node, bool_or({_HOLDS.replace('{c}', 'other')} OR contains('elverin', lower(other)) OR contains('2014', lower(other))) AS kept FROM x WHERE regexp_matches(trim(node), '(?i)^(AD\s*|BC\s*)?\d{{4}}(s)?(\s*(AD|BC))?$') GROUP BY 1), gone AS (SELECT node FROM y WHERE NOT kept) {_KEPT}""")
def without_years(spark, d):
    return _edges(finishing.drop_years(evidence_graph(spark, d), TERMS))


_FILE = r"(regexp_matches(lower({c}), '\.jpg|\.jpeg|\.png|\.gif|\.bmp|\.svg|\.webp|\.ico|\.tiff|\.tif|\.raw|\.heic|\.heif|\.pdf') OR regexp_matches({c}, '[a-zA-Z]:\\|^/[a-zA-Z]/|file://|\\\\'))"


@query(rf"""WITH {_E} SELECT src, dst, count(*) AS n FROM e WHERE NOT {_FILE.replace('{c}', 'src')} AND NOT {_FILE.replace('{c}', 'dst')} AND NOT coalesce({_FILE.replace('{c}', 'text')}, false) GROUP BY ALL""")
def without_files(spark, d):
    return _edges(finishing.drop_files(evidence_graph(spark, d)))


@query(rf"""WITH {_E} SELECT src, dst, count(*) AS n FROM e WHERE regexp_matches(trim(source_url), '(?i)^https?://') GROUP BY ALL""")
def web_evidence(spark, d):
    e = evidence_graph(spark, d)
    hurt = e.withColumn("source_url", F.when(F.col("source_url").rlike(r"^https?://[a-zA-Z0-9\-._~:/?=&]+$"), F.concat(F.lit("file:///D:/cache/%7C"), "source_url")).otherwise(F.col("source_url")))
    return _edges(finishing.drop_local(hurt))


@query(rf"""WITH {_E}, s AS (SELECT src, dst FROM e GROUP BY ALL HAVING coalesce(avg(confidence), 0) >= 0.7), k AS (SELECT e.* FROM e JOIN s ON e.src = s.src AND e.dst = s.dst), y AS (SELECT src AS node, dst AS other FROM k UNION SELECT dst, src FROM k), t AS (SELECT node FROM y GROUP BY 1 ORDER BY count(*) DESC, node LIMIT 100)
 SELECT src, dst, count(*) AS n FROM k WHERE src IN (FROM t) AND dst IN (FROM t) GROUP BY ALL""")
def strong_graph(spark, d):
    return _edges(finishing.drop_weak(evidence_graph(spark, d), 0.7, 100))


@query(rf"""WITH {_E}, w AS (SELECT * FROM e WHERE regexp_matches(trim(source_url), '(?i)^https?://') AND NOT {_FILE.replace('{c}', 'src')} AND NOT {_FILE.replace('{c}', 'dst')} AND NOT coalesce({_FILE.replace('{c}', 'text')}, false)),
 z AS (SELECT src AS node, dst AS other FROM w UNION SELECT dst, src FROM w), y AS (SELECT node, bool_or({_HOLDS.replace('{c}', 'other')} OR contains('elverin', lower(other)) OR contains('2014', lower(other))) AS kept FROM z WHERE regexp_matches(trim(node), '(?i)^(AD\s*|BC\s*)?\d{{4}}(s)?(\s*(AD|BC))?$') GROUP BY 1),
 k AS (SELECT * FROM w WHERE src NOT IN (SELECT node FROM y WHERE NOT kept) AND dst NOT IN (SELECT node FROM y WHERE NOT kept))
 SELECT src, dst, count(*) AS n FROM k GROUP BY ALL HAVING coalesce(avg(confidence), 0) >= 0.5""")
def finished_graph(spark, d):
    return _edges(finishing.finish(evidence_graph(spark, d), TERMS, least=0.5))


# ---- canonical entities

_NORM = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(strip_accents(lower({c})), 'ø','o'),'œ','oe'),'æ','ae'),'ß','ss'),'ł','l'),'đ','d'), '\s+', ' ', 'g'))"
_REG = rf"""r AS (SELECT qid, unnest(list_distinct(list_concat([entity_text, label], coalesce(CASE WHEN aliases LIKE '[%' THEN from_json(aliases, '["VARCHAR"]') END, []::VARCHAR[])))) AS name FROM wikidata_cache WHERE qid IS NOT NULL),
 g0 AS (SELECT {_NORM.replace('{c}', 'name')} AS alias, qid FROM r WHERE name IS NOT NULL), g AS (SELECT alias, qid, count(*) AS n FROM g0 WHERE alias <> '' GROUP BY alias, qid), t AS (SELECT alias, qid FROM g QUALIFY row_number() OVER (PARTITION BY alias ORDER BY n DESC, qid) = 1)"""


def _registered(spark, d):
    w = load(spark, d, "wikidata_cache", "qid", "entity_text", "label", F.from_json("aliases", "array<string>").alias("known"))
    return canonical.register(w, "qid", ["entity_text", "label"], "known")


@query(f"WITH {_REG} SELECT alias, qid, n FROM g")
def alias_register(spark, d):
    return _registered(spark, d)


@query(f"WITH {_REG} SELECT count(*) AS n_aliases, (SELECT count(DISTINCT qid) FROM g) AS n_entities, (SELECT count(*) FROM (SELECT alias FROM g GROUP BY 1 HAVING count(*) > 1)) AS n_ambiguous FROM t")
def alias_stats(spark, d):
    g = _registered(spark, d)
    per = g.groupBy("alias").agg(F.count("*").alias("k")).agg(F.count("*").alias("n_aliases"), F.count_if(F.col("k") > 1).alias("n_ambiguous"))
    return per.join(F.broadcast(g.agg(F.countDistinct("qid").alias("n_entities"))))  # one row each


@query(rf"""WITH {_REG}, n AS (SELECT DISTINCT entity_text AS name, {_NORM.replace('{c}', 'entity_text')} AS a FROM wikidata_cache WHERE entity_text IS NOT NULL),
 b AS (SELECT name, a, regexp_replace(regexp_replace(regexp_replace(a, '\s*[-–—|]\s*.*$', ''), '\s*\([^)]*\)', '', 'g'), '\s*\[[^\]]*\]', '', 'g') AS x FROM n),
 c AS (SELECT name, a, regexp_replace(regexp_replace(x, '\b(mr|mrs|ms|miss|dr|prof|professor|sir|lord|lady|rev|father|sister|brother)\b\.?\s*', '', 'gi'), ',?\s*\b(phd|md|esq|jr|sr|ii|iii|iv|ceo|cto|cfo|president|director)\b\.?', '', 'gi') AS x FROM b),
 f AS (SELECT name, a, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '''s\b', '', 'g'), '^["'']', ''), '["'']$', ''), '^[.,;:!?]+', ''), '[.,;:!?]+$', ''), '\s+', ' ', 'g')), ''), a) AS b FROM c)
 SELECT name, coalesce(t1.qid, t2.qid) AS canonical FROM f LEFT JOIN t t1 ON f.a = t1.alias LEFT JOIN t t2 ON {_NORM.replace('{c}', 'f.b')} = t2.alias""")
def canonical_names(spark, d):
    names = load(spark, d, "wikidata_cache", F.col("entity_text").alias("name")).where("name is not null").distinct()
    return canonical.canonicalize(names, "name", canonical.alias_table(_registered(spark, d)))


@query(r"""SELECT DISTINCT cache_key, CASE WHEN (label IS NOT NULL) AND length(label) >= length(entity_text) THEN label WHEN label IS NOT NULL AND qid IS NOT NULL THEN label ELSE entity_text END AS name FROM wikidata_cache WHERE entity_text IS NOT NULL""")
def merged_names(spark, d):
    w = load(spark, d, "wikidata_cache", "cache_key", "entity_text", "label", "qid").where("entity_text is not null").distinct()
    name = canonical.merge_names(F.col("label"), F.col("qid").isNotNull() & F.col("label").isNotNull(), F.col("entity_text"), F.lit(False))
    return w.select("cache_key", F.when(F.col("label").isNull(), F.col("entity_text")).otherwise(name).alias("name")).distinct()


@query(rf"""WITH w AS (SELECT cache_key, coalesce(qid, {_NORM.replace('{c}', 'entity_text')}) AS node, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.type') END AS label, label AS display, entity_text, created_at AS seq FROM wikidata_cache WHERE entity_text IS NOT NULL),
 p AS (SELECT node, label, display, seq, entity_text, CASE label WHEN 'PERSON' THEN 5 WHEN 'ORG' THEN 4 WHEN 'GPE' THEN 3 WHEN 'LOC' THEN 3 WHEN 'EVENT' THEN 2 WHEN 'WORK_OF_ART' THEN 2 WHEN 'PRODUCT' THEN 2 WHEN 'DATE' THEN 1 WHEN 'EMAIL' THEN 1 WHEN 'PHONE' THEN 1 WHEN 'SOCIAL' THEN 1 WHEN 'DOCUMENT' THEN 1 ELSE 0 END AS prio FROM w)
 SELECT node, coalesce(arg_max(label, (prio, seq, label)) FILTER (label IS NOT NULL AND label <> 'UNKNOWN'), 'UNKNOWN') AS label, arg_min(display, (seq, display)) FILTER (display IS NOT NULL) AS display, array_to_string(list_sort(list_distinct(list(entity_text))), '|') AS aliases FROM p GROUP BY node""")
def upserted_nodes(spark, d):
    w = load(spark, d, "wikidata_cache", "cache_key", "qid", "label", "metadata", "entity_text", "created_at").where("entity_text is not null")
    from weftgraph.functions.clean import normalize_name

    rows = w.select(F.coalesce("qid", normalize_name(F.col("entity_text"))).alias("node"), F.get_json_object("metadata", "$.type").alias("label"), F.col("label").alias("display"), F.array("entity_text").alias("aliases"), F.col("created_at").alias("seq"), "cache_key")
    old, new = rows.where("cache_key < '8'").drop("cache_key"), rows.where("cache_key >= '8'").drop("cache_key")
    return canonical.upsert_nodes(old, new).select("node", "label", "display", F.array_join("aliases", "|").alias("aliases"))


def _parts(spark, d):
    e = evidence_graph(spark, d).withColumn("date", F.lit(None).cast("string"))
    none = e.where("false").select("src", "dst", F.lit(0).cast("bigint").alias("n"), "confidence", F.col("date").alias("first_date"), F.col("date").alias("last_date"))
    return none, e.where("seq < '8'"), e.where("seq >= '8'")


@query(rf"""WITH {_E} SELECT src, dst, count(*) AS n, round(avg(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END), 7) AS confidence FROM e GROUP BY ALL""")
def upserted_edges(spark, d):
    none, first, second = _parts(spark, d)
    scored = lambda e: e.withColumn("confidence", F.nanvl("confidence", F.lit(None).cast("double")))
    # rows without a confidence must not weigh in the mean: batches are split so that they carry theirs
    both = scored(first).unionByName(scored(second))
    return canonical.upsert_edges(none, both).select("src", "dst", "n", F.round("confidence", 7).alias("confidence"))


@query(rf"""WITH {_E}, a AS (SELECT src, dst, avg(confidence) AS c FROM e WHERE seq < '8' AND confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL), b AS (SELECT src, dst, avg(confidence) AS c FROM e WHERE seq >= '8' AND confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY ALL)
 SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, round(CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN (a.c + b.c) / 2 ELSE coalesce(a.c, b.c) END, 5) AS confidence FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst""")
def batch_merged_edges(spark, d):
    none, first, second = _parts(spark, d)
    good = "confidence is not null and not isnan(confidence)"
    once = canonical.upsert_edges(none, first.where(good), compat=True)
    return canonical.upsert_edges(once, second.where(good), compat=True).select("src", "dst", F.round("confidence", 5).alias("confidence"))


_WORDS = "array_to_string(list_sort(string_split(trim(regexp_replace(lower({c}), '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ')), ' ')"


@query(rf"""WITH l AS (SELECT entities FROM content_item WHERE len(entities) > 1), c AS (SELECT DISTINCT array_to_string(list_reverse(string_split(upper(entities[1]), ' ')), ' ') AS src, unnest(entities[2:]) AS dst FROM l), n AS (SELECT DISTINCT unnest(entities) AS name FROM content_item),
 x AS (SELECT lower(trim(name)) AS k, min(name) AS t FROM n GROUP BY 1), y AS (SELECT {_WORDS.replace('{c}', 'name')} AS k, min(name) AS t FROM n GROUP BY 1),
 m AS (SELECT coalesce(x1.t, y1.t) AS src, coalesce(x2.t, y2.t) AS dst FROM c LEFT JOIN x x1 ON lower(trim(src)) = x1.k LEFT JOIN y y1 ON {_WORDS.replace('{c}', 'src')} = y1.k LEFT JOIN x x2 ON lower(trim(dst)) = x2.k LEFT JOIN y y2 ON {_WORDS.replace('{c}', 'dst')} = y2.k)
 SELECT src, dst, count(*) AS n FROM m WHERE src <> dst GROUP BY ALL""")
def remapped_relations(spark, d):
    c = load(spark, d, "content_item", "entities")
    turned = F.array_join(F.reverse(F.split(F.upper(F.col("entities")[0]), " ")), " ")
    pairs = c.where(F.size("entities") > 1).select(turned.alias("src"), F.explode(F.expr("slice(entities, 2, size(entities))")).alias("dst")).where("dst is not null").distinct()
    names = c.select(F.explode("entities").alias("name")).where("name is not null").distinct()
    return canonical.remap(pairs, names).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(r"""WITH e AS (SELECT DISTINCT entity_text AS src, coalesce(qid, cache_key) AS dst FROM wikidata_cache WHERE entity_text IS NOT NULL), x AS (SELECT src AS node, dst AS other FROM e UNION SELECT dst, src FROM e), g AS (SELECT node, count(*) AS degree, regexp_replace(strip_accents(replace(replace(lower(node), 'ø', 'o'), 'ß', 'ss')), '[^a-z0-9]', '', 'g') AS key FROM x GROUP BY 1)
 SELECT node, first(node) OVER (PARTITION BY key ORDER BY degree DESC, node) AS kept FROM g WHERE key <> '' QUALIFY node <> kept""")
def unified_nodes(spark, d):
    e = load(spark, d, "wikidata_cache", F.col("entity_text").alias("src"), F.coalesce("qid", "cache_key").alias("dst")).where("src is not null and src <> dst").distinct()
    return canonical.unify(e).withColumnRenamed("into", "kept")


@query(r"""WITH e AS (SELECT DISTINCT string_split(e1, ' ')[-1] AS src, e1 AS dst FROM (SELECT unnest(entities) AS e1 FROM content_item) WHERE contains(e1, ' ')), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), w AS (SELECT node, unnest(list_distinct(string_split(lower(node), ' '))) AS word FROM n WHERE contains(node, ' '))
 SELECT p.node, min(w.node) AS kept FROM n p JOIN w ON w.word = lower(p.node) WHERE NOT contains(p.node, ' ') GROUP BY 1""")
def consolidated_nodes(spark, d):
    a = load(spark, d, "content_item", F.explode("entities").alias("dst")).where("contains(dst, ' ')").distinct()
    return canonical.consolidate(a.select(F.element_at(F.split("dst", " "), -1).alias("src"), "dst").where("src <> dst")).withColumnRenamed("into", "kept")


@query()
def duplicate_groups(spark, d):
    names = load(spark, d, "wikidata_cache", F.col("label").alias("name"), "created_at").where("name is not null").groupBy("name").agg(F.min(F.struct("created_at", "name")).alias("seq"))
    return canonical.duplicate_groups(names, "name", "seq").withColumn("similarity", F.round("similarity", 6))


# ---- tables of the view


@query(rf"""WITH {_E}, g AS (SELECT node, count(*) AS degree FROM x GROUP BY 1) SELECT node, degree, round(10 + 30.0 * degree / (SELECT max(degree) FROM g), 6)::DOUBLE AS size, lower(node) AS search_text,
 (SELECT string_agg(o, ', ' ORDER BY o) FROM (SELECT other AS o FROM x WHERE x.node = g.node ORDER BY other LIMIT 5)) || CASE WHEN degree > 5 THEN ' ... and ' || (degree - 5) || ' more' ELSE '' END AS hover FROM g""")
def node_view(spark, d):
    v = views.nodes(finishing.edges_of(evidence_graph(spark, d)))
    return v.withColumn("size", F.round("size", 6))


@query(rf"""WITH {_E}, k AS (SELECT src, dst, count(*) AS n, coalesce(avg(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END), 0) AS c, min(left(text, 80)) FILTER (text IS NOT NULL) AS preview FROM e GROUP BY ALL)
 SELECT src, dst, n, round(1 + 5 * least(1, greatest(0, c)), 5)::DOUBLE AS width, preview, lower(concat_ws(' ', src, dst, preview)) AS search_text FROM k""")
def edge_view(spark, d):
    return views.edges(evidence_graph(spark, d)).withColumn("width", F.round("width", 5))


@query(r"""WITH RECURSIVE e AS (SELECT DISTINCT 'q:' || query AS src, 'u:' || url AS dst FROM search_hits WHERE query IS NOT NULL AND url IS NOT NULL), x AS (SELECT src AS node, dst AS other FROM e UNION ALL SELECT dst, src FROM e), r AS (SELECT DISTINCT node, node AS other FROM x UNION SELECT r.node, x.other FROM r JOIN x ON r.other = x.node),
 c AS (SELECT node, min(other) AS component FROM r GROUP BY node), s AS (SELECT component, count(*) AS n FROM c GROUP BY 1) SELECT component, n, row_number() OVER (ORDER BY n DESC, component) - 1 AS place FROM s""")
def component_sizes(spark, d):
    h = load(spark, d, "search_hits", "query", "url").where("query is not null and url is not null")
    e = graph.undirected(h.select(F.concat(F.lit("q:"), "query").alias("a"), F.concat(F.lit("u:"), "url").alias("b")), "a", "b")
    return views.component_places(graph.components(e))
