"""Queries of the text, name and URL functions, each beside hand-written SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import clean, predicates, urls
from weftgraph.functions import text as tx
from weftgraph.operators import pages
from weftgraph.plans.registry import host_sql, path_sql, query, quoted
from weftgraph.runtime import load

#: Sites of the list queries.
SITES = ["elverin-courier.example", "wikipedia", "hofenbrornews"]


def _names(spark, d):
    return load(spark, d, "wikidata_cache", "entity_text").where("entity_text is not null").distinct()


@query(r"""SELECT entity_text, strip_accents(lower(entity_text)) AS folded,
 trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(strip_accents(lower(entity_text)), 'ø','o'),'œ','oe'),'æ','ae'),'ß','ss'),'ð','d'),'þ','th'),'ł','l'),'đ','d'),'ı','i'), '\s+', ' ', 'g')) AS normalized
 FROM (SELECT DISTINCT entity_text FROM wikidata_cache WHERE entity_text IS NOT NULL)""")
def folded_names(spark, d):
    n = F.col("entity_text")
    return _names(spark, d).select(n, clean.fold(n).alias("folded"), clean.normalize_name(n).alias("normalized"))


@query(r"""WITH n AS (SELECT DISTINCT entity_text FROM wikidata_cache WHERE entity_text IS NOT NULL AND NOT regexp_matches(entity_text, '[^\x00-\x{17F}’ȘșȚțạȘ̀-ͯ]')),
 s AS (SELECT entity_text, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(entity_text, 'Ø','O'),'ø','o'),'Æ','Ae'),'æ','ae'),'ß','ss'),'ł','l'),'Ł','L'),'đ','d'),'œ','oe'),'’','''') AS x FROM n)
 SELECT entity_text, regexp_replace(strip_accents(x), '[^\x00-\x7F]', '', 'g') AS ascii, trim(regexp_replace(lower(regexp_replace(strip_accents(x), '[^\x00-\x7F]', '', 'g')), '\s+', ' ', 'g')) AS matching FROM s""")
def latin_names_in_ascii(spark, d):
    n = F.col("entity_text")
    latin = ~n.rlike("[^\\x00-\\x{17F}’ȘșȚțạȘ\u0300-\u036f]")
    return _names(spark, d).where(latin).select(n, clean.to_ascii(n).alias("ascii"), clean.matching_key(n).alias("matching"))


@query(r"""WITH t AS (SELECT DISTINCT text AS x FROM provenance WHERE text IS NOT NULL), s AS (SELECT x, regexp_replace(regexp_replace(x, '^\d+([A-Z])', '\1'), '^[^\p{L}\p{N}_\s]+', '') AS p, trim(regexp_replace(trim(x), '(?s)\[[\p{L}\p{N}_]+.*?$', '')) AS b FROM t)
 SELECT md5(x) AS text_hash, trim(regexp_replace(regexp_replace(regexp_replace(p, '^[.,;:!?\-_''"\\/@#$%^&*()\[\]{}|<> \t\n\r]+', ''), '[.,;:!?\-_''"\\/@#$%^&*()\[\]{}|<> \t\n\r]+$', ''), '\s+', ' ', 'g')) AS pipeline,
 trim(regexp_replace(regexp_replace(regexp_replace(b, '^[^\p{L}\p{N}_\s]+', ''), '[^\p{L}\p{N}_\s]+$', ''), '\s+', ' ', 'g')) AS surface, trim(regexp_replace(translate(lower(x), '"''“”‘’', ''), '\s+', ' ', 'g')) AS verifier FROM s""")
def cleaned_evidence(spark, d):
    t = F.col("text")
    return load(spark, d, "provenance", "text").where("text is not null").distinct().select(F.md5("text").alias("text_hash"), clean.pipeline_clean(t).alias("pipeline"), clean.surface(t).alias("surface"), clean.verifier_form(t).alias("verifier"))


@query(r"""WITH n AS (SELECT DISTINCT entity_text AS n FROM wikidata_cache WHERE entity_text IS NOT NULL), a AS (SELECT n, regexp_replace(n, '\s*[-–—|]\s*.*$', '') AS x FROM n),
 b AS (SELECT n, regexp_replace(regexp_replace(x, '\s*\([^)]*\)', '', 'g'), '\s*\[[^\]]*\]', '', 'g') AS x FROM a),
 c AS (SELECT n, regexp_replace(x, '\b(mr|mrs|ms|miss|dr|prof|professor|sir|lord|lady|rev|father|sister|brother)\b\.?\s*', '', 'gi') AS x FROM b),
 e AS (SELECT n, regexp_replace(x, ',?\s*\b(phd|md|esq|jr|sr|ii|iii|iv|ceo|cto|cfo|president|director)\b\.?', '', 'gi') AS x FROM c),
 f AS (SELECT n, regexp_replace(regexp_replace(regexp_replace(x, '''s\b', '', 'g'), '^["'']', ''), '["'']$', '') AS x FROM e)
 SELECT n AS entity_text, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(x, '^[.,;:!?]+', ''), '[.,;:!?]+$', ''), '\s+', ' ', 'g')), ''), trim(n)) AS name FROM f""")
def alias_names(spark, d):
    return _names(spark, d).select("entity_text", clean.alias(F.col("entity_text")).alias("name"))


@query(r"""WITH t AS (SELECT prov_id, regexp_replace(regexp_replace(regexp_replace(text, '\[.*?\]', '', 'g'), '\(\s*\d{4}\s*\)', '', 'g'), '\(\s*citation\s+needed\s*\)', '', 'gi') AS x FROM provenance WHERE text IS NOT NULL),
 p AS (SELECT prov_id, x, unnest(regexp_split_to_array(x, '\s*-\s*\^\s*')) AS p FROM t),
 a AS (SELECT prov_id, x, regexp_replace(regexp_replace(trim(p), '^[\[(]*\d+[\])]*[.:,;\s-]+', ''), '^[\[(]*[a-zA-Z]\s+([a-zA-Z]\s+)?', '') AS p FROM p),
 b AS (SELECT prov_id, x, regexp_replace(regexp_replace(p, '\^+', '', 'g'), '^\s*\b([a-f])\b\s+', '', 'i') AS p FROM a),
 c AS (SELECT prov_id, x, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '\|{2,}', ' | ', 'g'), '\s*\|\s*\|\s*', ' | ', 'g'), '[-_]{3,}', '', 'g'), '^\s*\|\s*', '') AS p FROM b),
 e AS (SELECT prov_id, x, trim(regexp_replace(regexp_replace(regexp_replace(p, '\s*\|\s*$', ''), '\s+([,.;:!?])', '\1', 'g'), '\s{2,}', ' ', 'g')) AS p FROM c),
 f AS (SELECT prov_id, any_value(x) AS x, count(*) FILTER (length(p) > 3) AS n FROM e GROUP BY 1)
 SELECT prov_id, p AS part FROM e WHERE length(p) > 3 UNION ALL SELECT prov_id, trim(regexp_replace(x, '\s{2,}', ' ', 'g')) FROM f WHERE n = 0""")
def evidence_parts(spark, d):
    return load(spark, d, "provenance", "prov_id", "text").where("text is not null").select("prov_id", F.explode(clean.evidence_parts(F.col("text"))).alias("part"))


@query(r"""WITH h AS (SELECT query, count(*) AS n, '| title | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || coalesce(title, '') || ' | ' || seq || ' |', chr(10) ORDER BY seq, title) AS t FROM search_hits WHERE query IS NOT NULL AND coalesce(title, '') NOT LIKE '%|%' AND coalesce(title, '') NOT LIKE '%' || chr(10) || '%' GROUP BY 1)
 SELECT query, 'title • n ' || (SELECT string_agg(CASE WHEN trim(coalesce(s.title, '')) = '' THEN '' ELSE trim(regexp_replace(s.title, '\s{2,}', ' ', 'g')) || ' • ' END || s.seq, ' ' ORDER BY s.seq, s.title) FROM search_hits s WHERE s.query = h.query AND coalesce(s.title, '') NOT LIKE '%|%' AND coalesce(s.title, '') NOT LIKE '%' || chr(10) || '%') AS line FROM h""")
def table_lines(spark, d):
    h = load(spark, d, "search_hits", "query", "title", "seq").where("query is not null and coalesce(title, '') not like '%|%' and not contains(coalesce(title, ''), '\n')")
    row = F.concat(F.lit("| "), F.coalesce("title", F.lit("")), F.lit(" | "), F.col("seq").cast("string"), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seq", "title", row.alias("row")))), lambda x: x["row"])
    tables = h.groupBy("query").agg(F.concat(F.lit("| title | n |\n|---|---|\n"), F.array_join(rows, "\n")).alias("t"))
    return tables.select("query", clean.table_text(F.col("t")).alias("line"))


@query(r"""SELECT query, coalesce(nullif(regexp_replace(substr(x, 1, 50), '_+$', ''), ''), 'query') AS folder FROM (SELECT query, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(query)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s-]+', '_', 'g'), '_+', '_', 'g'), '^_', ''), '_$', '') AS x
 FROM (SELECT DISTINCT query FROM search_hits WHERE query IS NOT NULL))""")
def query_folders(spark, d):
    return load(spark, d, "search_hits", "query").where("query is not null").distinct().select("query", clean.path_name(F.col("query")).alias("folder"))


@query(r"""SELECT DISTINCT cache_key, coalesce(nullif(trim(label), ''), CASE WHEN regexp_matches(coalesce(qid, lower(trim(entity_text))), '^Q\d+$') THEN nullif(trim(entity_text), '') END, coalesce(qid, lower(trim(entity_text)))) AS display FROM wikidata_cache WHERE entity_text IS NOT NULL""")
def display_names(spark, d):
    w = load(spark, d, "wikidata_cache", "cache_key", "label", "qid", "entity_text").where("entity_text is not null")
    node = F.coalesce("qid", F.lower(F.trim("entity_text")))
    return w.select("cache_key", clean.display_name(F.col("label"), F.lit(None).cast("string"), F.col("entity_text"), node).alias("display")).distinct()


@query(f"""WITH w AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', ' ', 'g'), '^ +| +$', '', 'g'), ' ') AS ws FROM documents WHERE text <> '')
 SELECT doc_id, length(text) >= 100 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) >= 0.5 AND len(list_filter(ws, lambda x: regexp_replace(x, '^[.,!?()\\[\\]{{}}]+|[.,!?()\\[\\]{{}}]+$', '', 'g') IN ({quoted(tx.COMMON_WORDS)}))) / len(ws) >= 0.05 AS good FROM w""")
def quality_gate(spark, d):
    return load(spark, d, "documents", "doc_id", "text").where("text <> ''").select("doc_id", tx.is_quality(F.col("text")).alias("good"))


@query(r"""WITH v AS (SELECT DISTINCT trim(value) AS v FROM contact_hit WHERE value IS NOT NULL)
 SELECT v AS value, CASE WHEN regexp_matches(v, '^[^@\s]+@[^@\s]+$') THEN lower(v) ELSE regexp_replace(v, '[.,;:]+$', '') END AS contact_id, regexp_full_match(v, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}') AS email,
 regexp_full_match(v, 'https?://(?:www\.)?(?:linkedin\.com/(?:in|company)/|x\.com/|twitter\.com/|facebook\.com/|instagram\.com/|github\.com/)[^\s\]\[)(<>"'']{2,}') AS profile,
 regexp_full_match(v, '\+?\d[\d\s().-]{6,}\d') AND length(regexp_replace(v, '\D', '', 'g')) >= 7 AND NOT regexp_matches(v, '^(?:(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)\d{2}|(?:19|20)\d{2}[-/.](?:0?[1-9]|1[0-2])|(?:19|20)\d{2}\s*[-/]\s*(?:19|20)\d{2}|(?:19|20)\d{2}(?:19|20)\d{2})$') AS phone FROM v""")
def contact_tests(spark, d):
    v = F.col("value")
    c = load(spark, d, "contact_hit", F.trim("value").alias("value")).where("value is not null").distinct()
    return c.select("value", clean.contact_id(v).alias("contact_id"), predicates.is_email(v).alias("email"), predicates.is_profile(v).alias("profile"), predicates.is_phone(v).alias("phone"))


@query(f"""SELECT entity_text, length(trim(entity_text)) >= 2 AND len(regexp_split_to_array(lower(trim(entity_text)), '\\s+')) <= 8 AND len(list_filter(regexp_split_to_array(lower(trim(entity_text)), '\\s+'), lambda w: w NOT IN ({quoted(predicates.INVALID_WORDS)}))) > 0
 AND NOT regexp_matches(entity_text, '[?!]|\\.\\.\\.') AND regexp_matches(entity_text, '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(trim(entity_text), '^[\\d\\s.,%-]+$') AS valid FROM (SELECT DISTINCT entity_text FROM wikidata_cache WHERE entity_text IS NOT NULL)""")
def entity_tests(spark, d):
    return _names(spark, d).select("entity_text", predicates.is_entity_text(F.col("entity_text")).alias("valid"))


# ---- URLs


def _urls(spark, d):
    a, b, c = load(spark, d, "content_item", "url"), load(spark, d, "search_hits", "url"), load(spark, d, "provenance", F.col("source_url").alias("url"))
    return a.unionByName(b).unionByName(c).where("url is not null").distinct()


_ALL = "u AS (SELECT url FROM content_item WHERE url IS NOT NULL UNION SELECT url FROM search_hits WHERE url IS NOT NULL UNION SELECT source_url FROM provenance WHERE source_url IS NOT NULL)"


@query(rf"""WITH {_ALL}, p AS (SELECT url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS head, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS q FROM u)
 SELECT url, lower(head) || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END || CASE WHEN q = '?' THEN '' ELSE q END AS manifest_url FROM p""")
def manifest_urls(spark, d):
    return _urls(spark, d).select("url", urls.manifest_form(F.col("url")).alias("manifest_url"))


@query(rf"""WITH {_ALL}, p AS (SELECT url, lower(url) AS l, lower({path_sql('url')}) AS p FROM u), s AS (SELECT url, l, p, regexp_extract(p, '(\.[^./]*)$', 1) AS e, p || '?' || regexp_extract(l, '\?([^#]*)', 1) AS r FROM p)
 SELECT url, regexp_matches(url, '^(?i)https?://[^/?#]') AND (e IN ({quoted(predicates.READ_SUFFIXES)}) OR (e NOT IN ({quoted(predicates.SKIPPED_SUFFIXES)}) AND NOT list_bool_or(list_transform([{quoted(predicates.FILE_PAGES)}], lambda w: contains(l, w)))
  AND NOT list_bool_or(list_transform([{quoted(predicates.ACTION_WORDS)}], lambda w: contains(r, w))) AND NOT list_bool_or(list_append(list_transform(string_split(p, '/'), lambda x: regexp_matches(x, '^(year[_-]?)?\d{{4}}$')), false)))) AS crawl FROM s""")
def crawl_filter(spark, d):
    return _urls(spark, d).select("url", predicates.crawlable(F.col("url")).alias("crawl"))


@query(rf"""WITH {_ALL}, m AS (SELECT url, unnest([url, 'file:///D:/cache/%7C' || url, 'C:\page|' || url, 'seen at ' || url, 'mailto:x@y.example']) AS broken, unnest([0, 1, 2, 3, 4]) AS form FROM u WHERE regexp_matches(url, '^https?://[a-zA-Z0-9\-._~:/?=&]+$') AND contains(regexp_extract(url, '^https?://([^/?#]*)', 1), '.'))
 SELECT broken, CASE WHEN form = 4 THEN broken ELSE url END AS fixed, form < 4 AS valid FROM m GROUP BY ALL""")
def rescued_urls(spark, d):
    plain = _urls(spark, d).where(F.col("url").rlike(r"^https?://[a-zA-Z0-9\-._~:/?=&]+$") & F.contains(F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.lit(".")))
    forms = F.array(F.col("url"), F.concat(F.lit("file:///D:/cache/%7C"), "url"), F.concat(F.lit("C:\\page|"), "url"), F.concat(F.lit("seen at "), "url"), F.lit("mailto:x@y.example"))
    broken = plain.select(F.explode(forms).alias("broken")).distinct()
    fixed = predicates.real_url(F.col("broken"))
    return broken.select("broken", fixed.alias("fixed"), predicates.valid_http(fixed).alias("valid"))


_LISTED = " OR ".join(f"{{h}} = '{t}' OR {{h}} LIKE '%.{t}' OR contains('.' || {{h}} || '.', '.{t}.') OR {{g}} = '{t}'" for t in SITES)


@query(rf"""WITH {_ALL}, h AS (SELECT url, {host_sql('url')} AS h FROM u), t AS (SELECT url, h, CASE WHEN contains(h, 'wikipedia') THEN 'wikipedia' WHEN contains(h, 'wikidata') THEN 'wikidata' WHEN contains(h, 'dbpedia') THEN 'dbpedia' ELSE string_split(h, '.')[1] END AS g FROM h)
 SELECT url, coalesce({_LISTED.replace('{h}', 'h').replace('{g}', 'g')}, false) AS listed FROM t""")
def listed_sites(spark, d):
    return _urls(spark, d).select("url", predicates.site_listed(F.col("url"), SITES).alias("listed"))


@query(rf"""WITH s AS (SELECT source_url AS u, min(item_id) AS seq FROM content_item WHERE source_url IS NOT NULL GROUP BY 1), h AS (SELECT {host_sql('u')} AS h, seq FROM s), f AS (SELECT h, min(seq) AS seq FROM h WHERE h IS NOT NULL GROUP BY 1) SELECT string_agg(h, ',' ORDER BY seq, h) AS sites, count(*) AS n FROM f""")
def site_list(spark, d):
    return urls.site_list(load(spark, d, "content_item", "item_id", "source_url"), "source_url", "item_id")


@query(r"""SELECT item_id, list_bool_or(list_transform(['404','not found','page not found','403','forbidden','access denied','500','internal server error','server error','error','unavailable','does not exist','pagina nu a fost gasita','pagină negăsită','eroare 404'], lambda w: contains(lower(string_split(raw_content, chr(10))[1]), w)))
 OR list_bool_or(list_transform(['404 - page not found','error 404','404 not found','the page you are looking for','this page does not exist','page cannot be found','pagina nu poate fi gasita','aceasta pagina nu exista'], lambda w: contains(lower(substr(raw_content, 1, 500)), w))) OR (length(raw_content) > 0 AND length(trim(raw_content)) < 100) AS is_error,
 contains(lower(raw_content), 'captcha') OR contains(lower(raw_content), 'i''m not a robot') OR contains(lower(raw_content), 'unusual traffic') AS robot_check FROM content_item WHERE raw_content IS NOT NULL""")
def error_pages(spark, d):
    c = load(spark, d, "content_item", "item_id", "raw_content").where("raw_content is not null")
    title = F.element_at(F.split("raw_content", "\n"), 1)
    return c.select("item_id", predicates.error_page(title, F.col("raw_content")).alias("is_error"), predicates.robot_check(F.col("raw_content")).alias("robot_check"))


@query(r"""SELECT prov_id, regexp_matches(text, '(?i)Reference This article used a translation') OR regexp_matches(text, '(?i)↑\s+[A-Z]+,\s+[A-Z]') OR regexp_matches(text, '(?i)\(\s*Romanian\s*\)\s*-\s*↑') OR regexp_matches(text, '(?i)Jump to:\s*a\s+b\s+c') OR regexp_matches(text, '(?i)^\s*\(\s*[A-Z]{2}\s*\)') AS copied,
 regexp_matches(lower(text), '(^|[^0-9a-z])council([^0-9a-z]|$)') AS about FROM provenance WHERE text IS NOT NULL""")
def copied_evidence(spark, d):
    p = load(spark, d, "provenance", "prov_id", "text").where("text is not null")
    return p.select("prov_id", predicates.copied_text(F.col("text")).alias("copied"), predicates.whole_words(F.col("text"), ["council"]).alias("about"))


@query(rf"""WITH h AS (SELECT DISTINCT query, url, replace(title, '<', '(') AS title FROM search_hits WHERE query IS NOT NULL AND url IS NOT NULL AND title IS NOT NULL AND NOT contains(url, '"'))
 SELECT query, CASE WHEN regexp_matches(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/$') THEN b ELSE regexp_replace(b, '/+$', '') END AS link, count(*) AS n FROM (SELECT query, url, regexp_replace(url, '#.*$', '') AS b FROM h) GROUP BY ALL""")
def page_links(spark, d):
    h = load(spark, d, "search_hits", "query", "url", F.replace("title", F.lit("<"), F.lit("(")).alias("title")).where("query is not null and url is not null and title is not null and not contains(url, '\"')").distinct()
    html = F.concat(F.lit("<html><body>"), F.concat_ws("", F.collect_list(F.concat(F.lit('<p><a class="x" href="'), "url", F.lit('">'), "title", F.lit("</a></p>")))), F.lit("</body></html>"))
    page = h.groupBy("query").agg(html.alias("html")).withColumn("base", F.lit("https://base.example/"))
    return pages.links(page, "query", "html", "base").groupBy("query", "link").agg(F.count("*").alias("n"))


@query(r"""SELECT query, trim(regexp_replace('Results ' || string_agg(title, ' ' ORDER BY seq, title), '\s+', ' ', 'g')) AS text FROM search_hits WHERE query IS NOT NULL AND title IS NOT NULL AND NOT regexp_matches(title, '[<>&]') GROUP BY 1""")
def page_texts(spark, d):
    h = load(spark, d, "search_hits", "query", "title", "seq").where(F.col("query").isNotNull() & F.col("title").isNotNull() & ~F.col("title").rlike("[<>&]"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda x: F.concat(F.lit("<li>"), x["title"], F.lit("</li>")))
    html = F.concat(F.lit("<html><head><style>p {x}</style><script>var a = '<b>';</script></head><body><h1>Results</h1><ul>"), F.array_join(items, "\n"), F.lit("</ul><!-- end --></body></html>"))
    return h.groupBy("query").agg(html.alias("html")).select("query", pages.visible_text(F.col("html")).alias("text"))


@query(r"""WITH n AS (SELECT DISTINCT entity_text AS e FROM wikidata_cache WHERE entity_text IS NOT NULL)
 SELECT e AS entity, 'wikipedia' AS source, 'https://ro.wikipedia.org/wiki/' || url_encode(replace(e, ' ', '_')) AS url FROM n UNION ALL SELECT e, 'wikipedia', 'https://en.wikipedia.org/wiki/' || url_encode(replace(e, ' ', '_')) FROM n
 UNION ALL SELECT e, 'dbpedia', 'http://dbpedia.org/resource/' || url_encode(replace(e, ' ', '_')) FROM n""")
def template_urls(spark, d):
    return pages.template_urls(_names(spark, d), "entity_text", "ro", blocked=["web"])
