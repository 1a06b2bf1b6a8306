"""Entities and relations of texts as table functions.

The default extractor is made of rules inside the plan; any function from sentences to mentions can take
its place, so a model is plugged in as a pandas UDF without a change to what follows it. Mentions are rows
(key, sent, pos, text, label, start, confidence); a name that a sentence repeats counts once, at its first place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.constants import COMPATIBLE_PAIRS, DATE_PATTERNS, DISCOVERY_WEIGHT, FACT_WORDS, PRONOUNS, RELATION_PATTERNS, RELATION_TYPES, SCORED_PAIRS, STRONG_PAIRS, STRONG_RELATIONS, TEMPORAL_WORDS, TYPE_CONFIDENCE, WEAK_PAIRS
from weftgraph.functions import clean, predicates
from weftgraph.operators import contacts
from weftgraph.operators.temporal import normalize_date

#: Sentences, runs of capitalised words with their links, and what makes a run an organisation or a place.
SENTENCE = r"[^.!?\n]+(?:[.!?]+[^\s.!?][^.!?\n]*)*[.!?]*"
RUN = r"(?:\p{Lu}\. )*\p{Lu}[\p{L}'’-]*(?: (?:& |of |for )?\p{Lu}[\p{L}'’-]*)*|\b(?:19|20)\d{2}\b"
COMPANY = r"\b(Ltd|LLC|Inc|Corp|Company|GmbH|AG|Oy|SA|SpA|Srl|SRL|BV|Group|Holdings|International|Foundation|Institute|Agency|University|Bank|Ministry|Council|Sons)\b"
PLACE_BEFORE = r"(^|\s)(in|at|near|din|en|bei|nach|lângă|à)\s$"
VERBS = sorted({v for verbs, _, _ in RELATION_TYPES.values() for v in verbs} | {"was", "has", "met", "paid", "signed", "moved", "left", "joined"})
PREPOSITIONS = ["of", "at", "for", "in", "on", "by", "with", "from", "to", "as", "through", "between"]
Extractor = Callable[[DataFrame], DataFrame]


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent, sentence): the sentences of every text, numbered from 0; null and blank texts have none."""
    found = df.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), F.lit(0))).alias("sent", "s"))
    return found.select("key", "sent", F.trim("s").alias("sentence")).where("sentence <> ''")


def _pair(a: Column, b: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(or_, [((a == x) & (b == y)) | ((a == y) & (b == x)) for x, y in pairs])


def entity_confidence(text: Column, label: Column, first: Column) -> Column:
    """Sum of what a mention's length, capitals, place in the sentence and type speak for it."""
    n = F.size(F.split(text, r"\s+"))
    length = F.when(n >= 3, 0.4).when(n == 2, 0.3).when(F.length(text) >= 4, 0.2).otherwise(0.1)
    case = F.when((F.upper(F.substring(text, 1, 1)) == F.substring(text, 1, 1)) & text.rlike(r"^\p{Lu}") & (F.upper(text) != text), 0.15).otherwise(0.0)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_CONFIDENCE.items() for x in kv]), label), F.lit(0.1))
    return F.least(F.lit(1.0), length + case + F.when(first, 0.05).otherwise(0.15) + kind)


def mentions(sents: DataFrame) -> DataFrame:
    """(key, sent, pos, text, label, start, confidence) by rules: runs of capitals and years; start counts from 0 in the sentence."""
    rows = sents.select("key", "sent", "sentence", F.posexplode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(RUN), F.lit(0)))).alias("pos", "raw"))
    rows = rows.withColumn("start", F.instr("sentence", F.col("raw")) - 1).withColumn("text", clean.surface(F.col("raw")))
    before = F.expr("substring(sentence, 1, start)")
    words = F.size(F.split("text", " "))
    label = (
        F.when(F.col("text").rlike(r"^\d{4}$"), "DATE").when(F.col("text").rlike(COMPANY), "ORG").when(before.rlike(PLACE_BEFORE) & (words <= 3), "GPE").when(words.between(2, 4), "PERSON").otherwise("UNKNOWN")
    )
    out = rows.withColumn("label", label).withColumn("confidence", F.round(entity_confidence(F.col("text"), F.col("label"), F.col("start") == 0), 6))
    good = (F.col("label") == "DATE") | predicates.is_entity_text(F.col("text"))
    return out.where((F.col("confidence") >= 0.5) & good).select("key", "sent", "pos", "text", "label", F.col("start").cast("int").alias("start"), "confidence")


def without_partials(found: DataFrame) -> DataFrame:
    """Mentions without single words that are a word of a longer mention of the same text; a leading article is no part of a name."""
    named = found.withColumn("text", F.regexp_replace("text", "^[Tt]he (?=.)", ""))
    longer = named.where("contains(text, ' ')").select("key", F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    single = ~F.contains("text", F.lit(" "))
    return named.withColumn("word", F.when(single, F.lower("text"))).join(longer, ["key", "word"], "left_anti").drop("word")


def entity_table(found: DataFrame) -> DataFrame:
    """(key, text, label, n, confidence): one row for each entity of a text, with its surest label."""
    best = F.max(F.struct("confidence", "label"))
    return without_partials(found).groupBy("key", "text").agg(best["label"].alias("label"), F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def pairs(found: DataFrame, sents: DataFrame) -> DataFrame:
    """Ordered pairs of mentions of one sentence with the words between them; the sentence bounds the pairs."""
    one = found.groupBy("key", "sent").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "label", "start"))).alias("m"))  # of one sentence
    a = one.select("key", "sent", "m", F.posexplode("m").alias("i", "a"))
    both = a.select("key", "sent", "a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b")).where("a.text <> b.text")
    full = both.join(sents, ["key", "sent"])
    lo, hi = F.least("a.start", "b.start"), F.greatest("a.start", "b.start")
    first = F.when(F.col("a.start") <= F.col("b.start"), F.length("a.text")).otherwise(F.length("b.text"))
    between = F.substring(F.col("sentence"), lo + first + 1, F.greatest(hi - lo - first, F.lit(0)))
    token = lambda c: F.regexp_count(F.substring(F.col("sentence"), F.lit(1), c), F.lit(r"\S+"))
    out = full.select("key", "sent", F.col("a.text").alias("src"), F.col("a.label").alias("src_label"), F.col("b.text").alias("dst"), F.col("b.label").alias("dst_label"), "sentence", F.lower(between).alias("between"), F.abs(token(F.col("a.start")) - token(F.col("b.start"))).alias("distance"))
    return out.withColumn("verb", _has(F.col("between"), VERBS)).withColumn("preposition", _has(F.col("between"), PREPOSITIONS))


def _has(text: Column, words: list[str]) -> Column:
    return text.rlike(r"(^|[^a-z])(" + "|".join(words) + r")([^a-z]|$)")


def related(p: DataFrame) -> Column:
    """Whether a pair is worth a relation: at most 15 words apart, with a connector; pairs of weak types at most 8 words apart."""
    connector = F.col("verb") | F.col("preposition")
    weak = _pair(F.col("src_label"), F.col("dst_label"), WEAK_PAIRS)
    return (F.col("distance") <= 15) & connector & (_pair(F.col("src_label"), F.col("dst_label"), STRONG_PAIRS) | ~weak | (F.col("verb") & (F.col("distance") <= 8)))


def relation_confidence(url: Column, trusted: list[str]) -> Column:
    """0.5, moved by distance, types, connectors, trusted sites and long names, within 0 and 1."""
    d = F.col("distance")
    score = (
        F.lit(0.5)
        + F.when(d <= 3, 0.2).when(d <= 6, 0.1).when(d <= 10, 0.05).otherwise(-0.1)
        + F.when(_pair(F.col("src_label"), F.col("dst_label"), SCORED_PAIRS), 0.15).otherwise(0.0)
        + F.when(F.col("verb"), 0.15).otherwise(0.0)
        + F.when(F.col("preposition"), 0.1).otherwise(0.0)
        + F.when(predicates.site_listed(url, trusted), 0.1).otherwise(0.0)
        + F.when(F.length("src") + F.length("dst") > 30, 0.05).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def relation_confidence_by_parts(url: Column, trusted: list[str], relation: Column) -> Column:
    """The second form: parts for distance, structure, types, source and kind of relation, added up."""
    d = F.col("distance")
    score = (
        F.when(d <= 5, 0.25).when(d <= 10, 0.15).when(d <= 15, 0.05).otherwise(0.0)
        + F.when(F.col("verb"), 0.15).otherwise(0.0)
        + F.when(F.col("preposition"), 0.1).otherwise(0.0)
        + F.when(_pair(F.col("src_label"), F.col("dst_label"), COMPATIBLE_PAIRS), 0.25).otherwise(0.1)
        + F.when(predicates.site_listed(url, trusted), 0.15).otherwise(0.0)
        + F.when(relation.isin(*STRONG_RELATIONS), 0.1).when(relation.isNotNull(), 0.05).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def typed_relations(p: DataFrame) -> DataFrame:
    """(key, sent, src, dst, relation, pattern_no): pairs whose sentence has a trigger and a pattern, and whose labels are a pair of it in any order."""
    low = F.lower("sentence")
    hits = []
    for k, (relation, triggers, pattern, labels) in enumerate(RELATION_PATTERNS):
        fits = reduce(or_, [F.contains(low, F.lit(t)) for t in triggers]) & low.rlike(pattern) & _pair(F.col("src_label"), F.col("dst_label"), labels)
        hits.append(F.when(fits, F.struct(F.lit(k).alias("pattern_no"), F.lit(relation).alias("relation"))))
    return p.select("key", "sent", "src", "dst", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("key", "sent", "src", "dst", "h.relation", "h.pattern_no")


def date_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, raw, iso, start): dates of the four patterns; a date that two patterns find counts for the first; start is that of its first place."""

    def tagged(n: int, kind: str, pattern: str) -> Column:
        raw = F.regexp_extract_all(F.col(text), F.lit(pattern if kind == "month_year" else "(?i)" + pattern), F.lit(1))
        return F.transform(raw, lambda r: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), r.alias("raw")))

    found = F.concat(*[tagged(n, k, p) for n, (k, p) in enumerate(DATE_PATTERNS)])
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("t"), F.explode(F.array_distinct(found)).alias("h"))
    out = rows.select("key", "h.n", "h.kind", "h.raw", normalize_date(F.col("h.raw")).alias("iso"), (F.instr("t", F.col("h.raw")) - 1).alias("start")).where("iso is not null")
    first = F.min(F.struct("n", "kind", "start"))
    return out.groupBy("key", "raw", "iso").agg(first.alias("f")).select("key", "f.kind", "raw", "iso", F.col("f.start").cast("int").alias("start"))


def nearest_dates(found: DataFrame, reach: int = 50) -> DataFrame:
    """(key, sent, text, date, distance): every entity of a sentence with the sentence's nearest date whose centre is at most ``reach`` characters away."""
    dates = found.where("label = 'DATE'").select("key", "sent", F.col("text").alias("date"), (F.col("start") + F.length("text") / 2).alias("at"))
    others = found.where("label <> 'DATE'").select("key", "sent", "text", (F.col("start") + F.length("text") / 2).alias("mid"))
    near = others.join(dates, ["key", "sent"]).withColumn("distance", F.abs(F.col("at") - F.col("mid"))).where(F.col("distance") <= reach)
    return near.groupBy("key", "sent", "text").agg(F.min(F.struct("distance", "date")).alias("d")).select("key", "sent", "text", "d.date", "d.distance")


def temporal_facts(found: DataFrame, sents: DataFrame, reach: int = 100) -> DataFrame:
    """(key, sent, text, fact, date): what happened when, within ``reach`` characters of an entity."""
    near = found.where("label <> 'DATE'").join(sents, ["key", "sent"])
    window = F.lower(F.substring(F.col("sentence"), F.greatest(F.lit(1), F.col("start") + 1 - reach), F.length("text") + 2 * reach))
    facts = F.array(*[F.struct(F.lit(w).alias("fact"), F.trim(F.regexp_extract(window, rf"{w}\s+(?:in|on)?\s*([^,\.]+)", 1)).alias("d")) for w in FACT_WORDS])
    rows = near.select("key", "sent", "text", F.explode(facts).alias("f"))
    return rows.select("key", "sent", "text", "f.fact", normalize_date(F.regexp_extract("f.d", r"^(\d{4}(?:[-/]\d{2}[-/]\d{2})?|[a-z]{3,9} \d{4})", 1)).alias("date")).where("date is not null").distinct()


def temporal_words(sents: DataFrame) -> DataFrame:
    """(key, sent, word, meaning, n): words of time and what they stand for."""
    table = F.create_map(*[F.lit(x) for kv in TEMPORAL_WORDS.items() for x in kv])
    words = sents.select("key", "sent", F.explode(F.regexp_extract_all(F.lower("sentence"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).where(F.col("word").isin(*TEMPORAL_WORDS))
    return words.groupBy("key", "sent", "word").agg(F.count("*").alias("n")).select("key", "sent", "word", F.element_at(table, F.col("word")).alias("meaning"), "n")


def coreferences(found: DataFrame, sents: DataFrame, back: int = 2) -> DataFrame:
    """(key, sent, pronoun, antecedent): every pronoun with the latest entity before it that it can stand for, in its sentence or the ``back`` before.

    Persons for he and she, other entities for it, organisations and places for they; an ordered window over
    one text's mentions and pronouns takes the place of a search.
    """
    kinds = F.create_map(*[F.lit(x) for k, v in PRONOUNS.items() for w in v for x in (w, k)])
    tokens = sents.select("key", "sent", F.posexplode(F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit(r"\p{L}+"), F.lit(0)))).alias("k", "word"), F.lower("sentence").alias("low"))
    pronouns = tokens.where(F.col("word").isin(*[w for v in PRONOUNS.values() for w in v])).select("key", "sent", (F.regexp_instr("low", F.concat(F.lit(r"(?<!\p{L})"), "word", F.lit(r"(?!\p{L})"))) - 1).alias("start"), "word", F.element_at(kinds, F.col("word")).alias("need"))
    none = F.lit(None).cast("string")
    rows = found.where("label <> 'DATE'").select("key", "sent", "start", "text", "label", none.alias("word"), none.alias("need")).unionByName(pronouns.select("key", "sent", "start", none.alias("text"), none.alias("label"), "word", "need"))
    w = W.partitionBy("key").orderBy("sent", "start", F.col("word").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    last = lambda cond: F.last(F.when(cond, F.struct("sent", "text")), ignorenulls=True).over(w)
    person = last(F.col("label") == "PERSON")
    body = last(F.col("label").isin("ORG", "GPE"))
    thing = last(F.col("label") != "PERSON")
    chosen = F.when(F.col("need") == "person", person).when(F.col("need") == "thing", thing).otherwise(body)
    out = rows.withColumn("c", chosen).where(F.col("word").isNotNull() & F.col("c").isNotNull() & (F.col("sent") - F.col("c.sent") <= back))
    return out.select("key", "sent", F.col("word").alias("pronoun"), F.col("c.text").alias("antecedent"))


def expand_coreferences(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Relations (key, sent, src, dst, ...) with pronoun ends replaced by what they stand for; ``coref`` tells which were."""
    out = relations.withColumn("coref", F.lit(False))
    for end in ("src", "dst"):
        r = resolved.select("key", "sent", F.col("pronoun").alias("_p"), F.col("antecedent").alias("_a"))
        out = out.withColumn("_p", F.lower(end)).join(r, ["key", "sent", "_p"], "left").withColumn(end, F.coalesce("_a", end)).withColumn("coref", F.col("coref") | F.col("_a").isNotNull()).drop("_p", "_a")
    return out


def contact_relations(found: DataFrame, sents: DataFrame) -> DataFrame:
    """(key, sent, anchor, value, kind, relation): contacts of a sentence with its persons, else its organisations; without either the anchor is null."""
    hits = contacts.contact_hits(sents.withColumn("id", F.struct("key", "sent")), "id", "sentence").select("id.key", "id.sent", "kind", "value").distinct()
    anchors = found.where("label in ('PERSON', 'ORG')").select("key", "sent", "text", "label").distinct()
    best = anchors.groupBy("key", "sent").agg(F.max(F.col("label") == "PERSON").alias("person"))
    used = anchors.join(best, ["key", "sent"]).where((F.col("label") == "PERSON") == F.col("person")).select("key", "sent", F.col("text").alias("anchor"))
    relation = F.when(F.col("kind") == "EMAIL", "has_email").when(F.col("kind") == "PHONE", "has_phone").otherwise("has_social_profile")
    return hits.join(used, ["key", "sent"], "left").select("key", "sent", "anchor", "value", "kind", F.when(F.col("anchor").isNotNull(), relation).alias("relation"))


def discovery_scores(entities: DataFrame, relations: DataFrame, asked: list[str] | None = None, least: float = 0.15) -> DataFrame:
    """(text, label, relevance, degree, score) of entities (text, label) worth a search of their own.

    Relevance is 1 where name and query hold each other, else the share of common words; it weighs ten times,
    then come relations by the type's weight, then up to three words. Without a query all are relevant.
    """
    ends = relations.select(F.explode(F.array("src", "dst")).alias("text")).groupBy("text").agg(F.count("*").alias("degree"))
    name = clean.fold(F.col("text"))
    if asked:
        query = " ".join(asked).lower()
        words, mine = F.array(*[F.lit(w) for w in dict.fromkeys(query.split())]), F.array_distinct(F.split(name, r"\s+"))
        relevance = F.when(F.contains(F.lit(query), name) | F.contains(name, F.lit(query)), 1.0).otherwise(F.size(F.array_intersect(words, mine)) / F.greatest(F.size(words), F.size(mine)))
    else:
        relevance = F.lit(1.0)
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DISCOVERY_WEIGHT.items() for x in kv]), F.col("label")), F.lit(0.5))
    joined = entities.join(ends, "text", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("relevance", relevance)
    score = 10 * F.col("relevance") + F.col("degree") * weight + 0.5 * F.least(F.size(F.split("text", r"\s+")), F.lit(3))
    return joined.where(F.col("relevance") >= least).select("text", "label", "relevance", "degree", score.alias("score"))


def extract(df: DataFrame, key: str, text: str, url: str, trusted: list[str] | None = None, least: float = 0.25, extractor: Extractor = mentions) -> tuple[DataFrame, DataFrame]:
    """Entities (key, text, label, n, confidence) and relations (key, sent, src, dst, relation, confidence, sentence, source_url) of texts."""
    sents = sentences(df, key, text)
    found = extractor(sents)
    p = pairs(found, sents)
    typed = typed_relations(p).groupBy("key", "sent", "src", "dst").agg(F.min(F.struct("pattern_no", "relation"))["relation"].alias("relation"))
    scored = p.where(related(p)).join(df.select(F.col(key).alias("key"), F.col(url).alias("source_url")), "key").join(typed, ["key", "sent", "src", "dst"], "left")
    relations = scored.withColumn("confidence", relation_confidence(F.col("source_url"), trusted or [])).where(F.col("confidence") >= least)
    return entity_table(found), relations.select("key", "sent", "src", "dst", "relation", "confidence", "sentence", "source_url")
