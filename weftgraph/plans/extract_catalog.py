"""Queries of entities, relations, dates and contacts in evidence texts, each beside hand-written SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.constants import RELATION_PATTERNS, STRONG_PAIRS, TYPE_CONFIDENCE
from weftgraph.operators import extract
from weftgraph.plans.registry import query, quoted
from weftgraph.runtime import load

TRUSTED = ["elverin-courier.example"]


def _sents(spark, d):
    return extract.sentences(load(spark, d, "provenance", "prov_id", "text"), "prov_id", "text")


def _found(spark, d):
    sents = _sents(spark, d)
    return extract.mentions(sents), sents


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TYPES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_CONFIDENCE.items())
_M = rf"""s0 AS (SELECT prov_id AS key, regexp_extract_all(text, {_lit(extract.SENTENCE)}) AS l FROM provenance WHERE text IS NOT NULL), s AS (SELECT key, sent, trim(x) AS sentence FROM (SELECT key, unnest(l) AS x, unnest(range(len(l))) AS sent FROM s0) WHERE trim(x) <> ''),
 m0 AS (SELECT key, sent, sentence, regexp_extract_all(sentence, {_lit(extract.RUN)}) AS l FROM s), m1 AS (SELECT key, sent, sentence, unnest(l) AS raw, unnest(range(len(l))) AS ord FROM m0), m2 AS (SELECT key, sent, sentence, raw, row_number() OVER (PARTITION BY key, sent ORDER BY min(ord)) - 1 AS pos FROM m1 GROUP BY key, sent, sentence, raw),
 m3 AS (SELECT *, instr(sentence, raw) - 1 AS start, trim(regexp_replace(trim(raw), '(?s)\[[\p{{L}}\p{{N}}_]+.*?$', '')) AS b FROM m2), m4 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(b, '^[^\p{{L}}\p{{N}}_\s]+', ''), '[^\p{{L}}\p{{N}}_\s]+$', ''), '\s+', ' ', 'g')) AS text FROM m3),
 m5 AS (SELECT *, len(string_split(text, ' ')) AS n, CASE WHEN regexp_matches(text, '^\d{{4}}$') THEN 'DATE' WHEN regexp_matches(text, {_lit(extract.COMPANY)}) THEN 'ORG' WHEN regexp_matches(left(sentence, start), {_lit(extract.PLACE_BEFORE)}) AND len(string_split(text, ' ')) <= 3 THEN 'GPE' WHEN len(string_split(text, ' ')) BETWEEN 2 AND 4 THEN 'PERSON' ELSE 'UNKNOWN' END AS label FROM m4),
 m6 AS (SELECT *, round(least(1.0, CASE WHEN n >= 3 THEN 0.4 WHEN n = 2 THEN 0.3 WHEN length(text) >= 4 THEN 0.2 ELSE 0.1 END + CASE WHEN regexp_matches(text, '^\p{{Lu}}') AND upper(text) <> text THEN 0.15 ELSE 0 END + CASE WHEN start = 0 THEN 0.05 ELSE 0.15 END + CASE label {_TYPES} ELSE 0.1 END), 6)::DOUBLE AS confidence FROM m5),
 m AS (SELECT key, sent, pos, text, label, start::INT AS start, confidence FROM m6 WHERE confidence >= 0.5 AND (label = 'DATE' OR (length(text) >= 2 AND n <= 8 AND len(list_filter(string_split(lower(text), ' '), lambda w: w NOT IN ({quoted(extract.predicates.INVALID_WORDS)}))) > 0 AND NOT regexp_matches(text, '[?!]|\.\.\.') AND regexp_matches(text, '[\p{{L}}\p{{N}}_]') AND NOT regexp_matches(text, '^[\d\s.,%-]+$'))))"""


@query(f"WITH {_M} SELECT key, sent::INT AS sent, pos::INT AS pos, text, label, start, confidence FROM m")
def entity_mentions(spark, d):
    return _found(spark, d)[0]


@query(rf"""WITH {_M}, a AS (SELECT key, regexp_replace(text, '^[Tt]he (.)', '\1') AS text, label, confidence FROM m), w AS (SELECT DISTINCT key, unnest(string_split(lower(text), ' ')) AS word FROM a WHERE contains(text, ' ')),
 k AS (SELECT a.* FROM a LEFT JOIN w ON a.key = w.key AND lower(a.text) = w.word AND NOT contains(a.text, ' ') WHERE w.word IS NULL) SELECT key, text, arg_max(label, (confidence, label)) AS label, count(*) AS n, max(confidence) AS confidence FROM k GROUP BY key, text""")
def entity_table(spark, d):
    return extract.entity_table(_found(spark, d)[0])


def _pair_sql(pairs) -> str:
    return "(" + " OR ".join(f"(l1 = '{a}' AND l2 = '{b}') OR (l1 = '{b}' AND l2 = '{a}')" for a, b in pairs) + ")"


def _has(words) -> str:
    return rf"regexp_matches(between_, '(^|[^a-z])({'|'.join(words)})([^a-z]|$)')"


_P = rf"""p0 AS (SELECT a.key, a.sent, a.text AS src, a.label AS l1, a.start AS s1, b.text AS dst, b.label AS l2, b.start AS s2, s.sentence FROM m a JOIN m b ON a.key = b.key AND a.sent = b.sent AND a.pos < b.pos AND a.text <> b.text JOIN s ON s.key = a.key AND s.sent = a.sent),
 p1 AS (SELECT *, lower(substr(sentence, least(s1, s2) + CASE WHEN s1 <= s2 THEN length(src) ELSE length(dst) END + 1, greatest(greatest(s1, s2) - least(s1, s2) - CASE WHEN s1 <= s2 THEN length(src) ELSE length(dst) END, 0))) AS between_, abs(len(regexp_extract_all(left(sentence, s1), '\S+')) - len(regexp_extract_all(left(sentence, s2), '\S+'))) AS distance FROM p0),
 p AS (SELECT *, {_has(extract.VERBS)} AS verb, {_has(extract.PREPOSITIONS)} AS prep FROM p1)"""


@query(rf"""WITH {_M}, {_P} SELECT key, sent::INT AS sent, src, dst, distance::INT AS distance, verb, prep AS preposition, distance <= 15 AND (verb OR prep) AND ({_pair_sql(STRONG_PAIRS)} OR NOT {_pair_sql(extract.WEAK_PAIRS)} OR (verb AND distance <= 8)) AS related,
 round(greatest(0.0, least(1.0, 0.5 + CASE WHEN distance <= 3 THEN 0.2 WHEN distance <= 6 THEN 0.1 WHEN distance <= 10 THEN 0.05 ELSE -0.1 END + CASE WHEN {_pair_sql(extract.SCORED_PAIRS)} THEN 0.15 ELSE 0 END + CASE WHEN verb THEN 0.15 ELSE 0 END + CASE WHEN prep THEN 0.1 ELSE 0 END + CASE WHEN length(src) + length(dst) > 30 THEN 0.05 ELSE 0 END)), 6)::DOUBLE AS confidence,
 round(greatest(0.0, least(1.0, CASE WHEN distance <= 5 THEN 0.25 WHEN distance <= 10 THEN 0.15 WHEN distance <= 15 THEN 0.05 ELSE 0 END + CASE WHEN verb THEN 0.15 ELSE 0 END + CASE WHEN prep THEN 0.1 ELSE 0 END + CASE WHEN {_pair_sql(extract.COMPATIBLE_PAIRS)} THEN 0.25 ELSE 0.1 END)), 6)::DOUBLE AS by_parts FROM p""")
def relation_scores(spark, d):
    found, sents = _found(spark, d)
    p = extract.pairs(found, sents)
    none = F.lit(None).cast("string")
    return p.select(
        "key", "sent", "src", "dst", F.col("distance").cast("int").alias("distance"), "verb", "preposition", extract.related(p).alias("related"),
        F.round(extract.relation_confidence(none, []), 6).alias("confidence"), F.round(extract.relation_confidence_by_parts(none, [], none), 6).alias("by_parts"),
    )


_TYPED = " UNION ALL ".join(
    f"SELECT key, sent::INT AS sent, src, dst, '{r}' AS relation, {k} AS pattern_no FROM p WHERE ({' OR '.join(f'contains(lower(sentence), {_lit(t)})' for t in triggers)}) AND regexp_matches(lower(sentence), {_lit(pattern)}) AND {_pair_sql(labels)}"
    for k, (r, triggers, pattern, labels) in enumerate(RELATION_PATTERNS)
)


@query(f"WITH {_M}, {_P} {_TYPED}")
def typed_relations(spark, d):
    found, sents = _found(spark, d)
    return extract.typed_relations(extract.pairs(found, sents))


@query(r"""WITH h AS (SELECT prov_id AS key, text AS t, unnest(regexp_extract_all(text, '(?i)\b(?:since|from|in|during|on)\s+(\d{4})\b', 1)) AS raw, 0 AS n FROM provenance WHERE text IS NOT NULL
  UNION ALL SELECT prov_id, text, unnest(regexp_extract_all(text, '(?i)\b((?:between|from)\s+\d{4}\s+(?:and|to)\s+\d{4})\b', 1)), 1 FROM provenance WHERE text IS NOT NULL
  UNION ALL SELECT prov_id, text, unnest(regexp_extract_all(text, '\b([A-Z][a-z]+\.?\s+\d{4})\b', 1)), 2 FROM provenance WHERE text IS NOT NULL UNION ALL SELECT prov_id, text, unnest(regexp_extract_all(text, '\b(\d{4}[-/]\d{2}[-/]\d{2})\b', 1)), 3 FROM provenance WHERE text IS NOT NULL),
 i AS (SELECT key, raw, n, instr(t, raw) - 1 AS start, lower(trim(raw)) AS l FROM h), o AS (SELECT *, CASE WHEN regexp_matches(l, '^(?:between |from )?(\d{4}) (?:to|and|-) (\d{4})$') THEN regexp_extract(l, '(\d{4}) (?:to|and|-)', 1) || '-01-01/' || right(l, 4) || '-12-31' WHEN regexp_matches(l, '^\d{4}[-/]\d{2}[-/]\d{2}$') THEN replace(l, '/', '-')
  WHEN regexp_matches(l, '^[a-z]{3,9}\.? \d{4}$') AND list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(l, 1, 3)) > 0 THEN right(l, 4) || '-' || lpad(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(l, 1, 3))::VARCHAR, 2, '0') || '-01' WHEN regexp_matches(l, '^\d{4}$') THEN l || '-01-01' END AS iso FROM i)
 SELECT key, ['year', 'range', 'month_year', 'full_date'][min(n) + 1] AS kind, raw, iso, min(start)::INT AS start FROM o WHERE iso IS NOT NULL GROUP BY key, raw, iso""")
def date_hits(spark, d):
    return extract.date_hits(load(spark, d, "provenance", "prov_id", "text"), "prov_id", "text")


@query(rf"""WITH {_M}, n AS (SELECT a.key, a.sent, a.text, b.text AS date, abs(b.start + length(b.text) / 2 - a.start - length(a.text) / 2) AS distance FROM m a JOIN m b ON a.key = b.key AND a.sent = b.sent AND b.label = 'DATE' AND a.label <> 'DATE')
 SELECT key, sent::INT AS sent, text, arg_min(date, (distance, date)) AS date, min(distance)::DOUBLE AS distance FROM n WHERE distance <= 50 GROUP BY key, sent, text""")
def dated_entities(spark, d):
    return extract.nearest_dates(_found(spark, d)[0])


@query(rf"""WITH {_M}, w AS (SELECT m.key, m.sent, m.text, lower(substr(s.sentence, greatest(1, m.start - 99), length(m.text) + 200)) AS x FROM m JOIN s ON m.key = s.key AND m.sent = s.sent WHERE label <> 'DATE'), f AS (SELECT unnest(['born', 'founded', 'established', 'died', 'created']) AS fact),
 g AS (SELECT key, sent, text, fact, regexp_extract(trim(CASE fact WHEN 'born' THEN regexp_extract(x, 'born\s+(?:in|on)?\s*([^,\.]+)', 1) WHEN 'founded' THEN regexp_extract(x, 'founded\s+(?:in|on)?\s*([^,\.]+)', 1) WHEN 'established' THEN regexp_extract(x, 'established\s+(?:in|on)?\s*([^,\.]+)', 1) WHEN 'died' THEN regexp_extract(x, 'died\s+(?:in|on)?\s*([^,\.]+)', 1) ELSE regexp_extract(x, 'created\s+(?:in|on)?\s*([^,\.]+)', 1) END), '^(\d{{4}}(?:[-/]\d{{2}}[-/]\d{{2}})?|[a-z]{{3,9}} \d{{4}})', 1) AS l FROM w, f)
 SELECT DISTINCT key, sent::INT AS sent, text, fact, CASE WHEN regexp_matches(l, '^\d{{4}}[-/]') THEN replace(l, '/', '-') WHEN regexp_matches(l, '^\d{{4}}$') THEN l || '-01-01' WHEN list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(l, 1, 3)) > 0 THEN right(l, 4) || '-' || lpad(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(l, 1, 3))::VARCHAR, 2, '0') || '-01' END AS date FROM g WHERE l <> '' AND (regexp_matches(l, '^\d') OR list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], substr(l, 1, 3)) > 0)""")
def temporal_facts(spark, d):
    found, sents = _found(spark, d)
    return extract.temporal_facts(found, sents)


@query(rf"""WITH {_M}, w AS (SELECT key, sent, unnest(regexp_extract_all(lower(sentence), '\p{{L}}+')) AS word FROM s) SELECT key, sent::INT AS sent, word, CASE word WHEN 'while' THEN 'during' WHEN 'when' THEN 'at' ELSE word END AS meaning, count(*) AS n FROM w WHERE word IN ({quoted(extract.TEMPORAL_WORDS)}) GROUP BY key, sent, word""")
def temporal_words(spark, d):
    return extract.temporal_words(_sents(spark, d))


_PRO = "SELECT unnest(['he','him','his','himself','she','her','hers','herself','it','its','itself','they','them','their','theirs','themselves']) AS word, unnest(['person','person','person','person','person','person','person','person','thing','thing','thing','many','many','many','many','many']) AS need"


@query(rf"""WITH {_M}, q AS ({_PRO}), t AS (SELECT DISTINCT key, sent, lower(sentence) AS low, unnest(regexp_extract_all(lower(sentence), '\p{{L}}+')) AS word FROM s),
 pr AS (SELECT t.key, t.sent, t.word, q.need, length(regexp_extract(low, '^(.*?)(?:^|[^\p{{L}}])' || t.word || '(?:[^\p{{L}}]|$)', 1)) + CASE WHEN regexp_matches(low, '^' || t.word || '(?:[^\p{{L}}]|$)') THEN 0 ELSE 1 END AS start FROM t JOIN q ON t.word = q.word),
 r AS (SELECT key, sent, start, text, label, NULL AS word, NULL AS need FROM m WHERE label <> 'DATE' UNION ALL SELECT key, sent, start, NULL, NULL, word, need FROM pr),
 c AS (SELECT *, last_value(CASE WHEN label = 'PERSON' THEN {{'s': sent, 't': text}} END IGNORE NULLS) OVER w AS a1, last_value(CASE WHEN label IN ('ORG', 'GPE') THEN {{'s': sent, 't': text}} END IGNORE NULLS) OVER w AS a2, last_value(CASE WHEN label <> 'PERSON' THEN {{'s': sent, 't': text}} END IGNORE NULLS) OVER w AS a3 FROM r WINDOW w AS (PARTITION BY key ORDER BY sent, start, word IS NOT NULL ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 x AS (SELECT key, sent, word, CASE need WHEN 'person' THEN a1 WHEN 'thing' THEN a3 ELSE a2 END AS a FROM c WHERE word IS NOT NULL) SELECT key, sent::INT AS sent, word AS pronoun, a.t AS antecedent FROM x WHERE a IS NOT NULL AND sent - a.s <= 2""")
def coreferences(spark, d):
    found, sents = _found(spark, d)
    return extract.coreferences(found, sents)


@query()
def contact_relations(spark, d):
    sents = extract.sentences(load(spark, d, "contact_hit", "hit_id", "sentence"), "hit_id", "sentence")
    return extract.contact_relations(extract.mentions(sents), sents)


@query()
def extracted_relations(spark, d):
    p = load(spark, d, "provenance", "prov_id", "text", "source_url")
    return extract.extract(p, "prov_id", "text", "source_url", TRUSTED)[1].withColumn("confidence", F.round("confidence", 6))


@query(r"""WITH e AS (SELECT entity_text AS text, max(json_extract_string(metadata, '$.type')) AS label FROM wikidata_cache WHERE entity_text IS NOT NULL GROUP BY 1), p AS (SELECT query, url FROM search_hits WHERE query IS NOT NULL AND url IS NOT NULL), g AS (SELECT x AS text, count(*) AS degree FROM (SELECT query AS x FROM p UNION ALL SELECT url FROM p) GROUP BY 1),
 f AS (SELECT e.text, e.label, coalesce(degree, 0) AS degree, strip_accents(lower(e.text)) AS n FROM e LEFT JOIN g ON e.text = g.text), r AS (SELECT *, CASE WHEN contains('katherine elverin', n) OR contains(n, 'katherine elverin') THEN 1.0 ELSE len(list_intersect(['katherine', 'elverin'], list_distinct(regexp_split_to_array(n, '\s+')))) / greatest(2, len(list_distinct(regexp_split_to_array(n, '\s+')))) END AS relevance FROM f)
 SELECT text, label, round(relevance, 6)::DOUBLE AS relevance, degree, round(10 * relevance + degree * CASE label WHEN 'PERSON' THEN 3.0 WHEN 'ORG' THEN 2.5 WHEN 'GPE' THEN 2.0 WHEN 'EVENT' THEN 1.8 WHEN 'NORP' THEN 1.5 WHEN 'FAC' THEN 1.2 WHEN 'LOC' THEN 1.0 ELSE 0.5 END + 0.5 * least(len(regexp_split_to_array(text, '\s+')), 3), 6)::DOUBLE AS score FROM r WHERE relevance >= 0.15""")
def discovery_scores(spark, d):
    e = load(spark, d, "wikidata_cache", "entity_text", "metadata").where("entity_text is not null").groupBy(F.col("entity_text").alias("text")).agg(F.max(F.get_json_object("metadata", "$.type")).alias("label"))
    h = load(spark, d, "search_hits", F.col("query").alias("src"), F.col("url").alias("dst")).where("src is not null and dst is not null")
    return extract.discovery_scores(e, h, ["katherine", "elverin"]).withColumn("relevance", F.round("relevance", 6)).withColumn("score", F.round("score", 6))
