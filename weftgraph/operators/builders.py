"""Search queries built from tables of templates.

A template is text with ``{n}`` for the name, ``{d}`` for the domain and ``{c}`` for the context; it is used
only where all that it names is given. A template with an optional site gives both forms, with the site and
without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.runtime import host

#: Fixed values: (template, optional site) by the kind of what is searched for, in order.
DORKS = {
    "person": [
        ('"{n}" "email" OR "contact"', "{d}"), ('"*@{d}"', "{d}"), ('"{n}" "email" OR "contact" filetype:pdf', "{d}"), ('intext:"@{d}" "{n}" -site:{d}', None),
        ('"{n}" "phone" OR "tel" OR "mobile" OR "cell"', None), ('"{n}" "address" OR "location" OR "office"', None), ('"{n}" "phone" OR "tel" OR "address"', "{d}"),
        ('"{n}" inurl:in site:linkedin.com', None), ('"{n}" inurl:pub site:linkedin.com', None), ('"{n}" site:x.com', None), ('"{n}" site:twitter.com', None), ('"{n}" site:facebook.com', None),
        ('"{n}" site:github.com', None), ('"{n}" site:instagram.com', None), ('"{n}" CV OR resume OR curriculum filetype:pdf', None), ('"{n}" filetype:pdf', None), ('"{n}" filetype:doc', None),
        ('"{n}" filetype:docx', None), ('"{n}" filetype:xlsx', None), ('"{n}" filetype:csv', None), ('"{n}" filetype:pptx', None), ('"{n}" filetype:ppt', None),
        ('"{n}" "confidential" OR "internal" OR "private" filetype:pdf', None), ('intitle:"index of" "{n}"', None), ('"{n}" "staff" OR "team" OR "directory" OR "employee"', None), ('"{n}" "team" OR "staff" OR "about"', "{d}"),
        ('"{n}" CEO OR CFO OR CTO OR director OR manager OR founder', None), ('"{n}" biography OR profile OR background', None), ('"{n}" "{c}"', None), ('"{n}" site:whitepages.com', None), ('"{n}" site:spokeo.com', None),
        ('"{n}" site:pipl.com', None), ('"{n}" site:pastebin.com', None), ('"{n}" news OR press OR interview after:2022-01-01', None),
    ],
    "company": [
        ('"{n}" "email" OR "contact"', "{d}"), ('"*@{d}"', None), ('intext:"@{d}" -site:{d}', None), ('"email" OR "contact" filetype:pdf', "{d}"), ('"{n}" "phone" OR "tel" OR "address" OR "headquarters"', None),
        ('"phone" OR "tel" OR "contact"', "{d}"), ('"employee" OR "staff" OR "team" filetype:xlsx', "{d}"), ('"employee" OR "staff" filetype:csv', "{d}"), ('"team" OR "leadership" OR "management"', "{d}"),
        ('"{n}" "employee" OR "staff" OR "directory" filetype:xlsx', None), ('"{n}" "employee" OR "staff" filetype:csv', None), ('"{n}" "confidential" OR "internal" filetype:pdf', None), ('"{n}" "confidential" OR "internal" filetype:pptx', None),
        ('intitle:"index of" "{n}"', None), ('intitle:"index of"', "{d}"), ('"{n}" "annual report" filetype:pdf', None), ('"{n}" "investor presentation" filetype:pdf', None), ('"{n}" "financial statement" OR "10-K" OR "10-Q" filetype:pdf', None),
        ('"{n}" "quarterly report" filetype:pdf', None), ('"{n}" "board of directors" OR "management team"', None), ('"{n}" CEO OR CFO OR CTO OR "executive"', None), ('"about" OR "leadership" OR "team" inurl:about', "{d}"),
        ('"{n}" "press release" after:2023-01-01', None), ('"{n}" site:reuters.com', None), ('"{n}" site:bloomberg.com', None), ('"{n}" site:crunchbase.com', None), ('"{n}" inurl:company site:linkedin.com', None),
        ('"{n}" site:glassdoor.com', None), ('"{n}" site:yellowpages.com', None), ('"{n}" site:dnb.com', None), ('"{d}" site:pastebin.com', None),
    ],
    "org": [
        ('"{n}" "email" OR "contact" OR "phone"', None), ('"contact" OR "email"', "{d}"), ('"*@{d}"', None), ('"{n}" "staff" OR "team" OR "board" OR "director"', None), ('"team" OR "staff" OR "about"', "{d}"),
        ('"{n}" filetype:pdf', None), ('"{n}" "annual report" OR "report" filetype:pdf', None), ('"{n}" filetype:xlsx', None), ('"{n}" "internal" OR "confidential" filetype:pdf', None), ('intitle:"index of" "{n}"', None),
        ('"{n}" "public record" OR "filing" OR "registration"', None), ('"{n}" site:linkedin.com', None), ('"{n}" site:facebook.com', None), ('"{n}" site:twitter.com', None),
    ],
    "institution": [
        ('"{n}" "directory" OR "staff" OR "faculty"', None), ('"directory" OR "faculty" OR "staff"', "{d}"), ('"contact" OR "email"', "{d}"), ('"*@{d}"', None), ('"{n}" filetype:pdf', None), ('"{n}" "report" OR "publication" filetype:pdf', None),
        ('"report" OR "publication" filetype:pdf', "{d}"), ('"{n}" "internal" OR "confidential" filetype:pdf', None), ('intitle:"index of" site:{d}', None), ('"{n}" filetype:xlsx', None), ('"{n}" filetype:csv', None),
        ('"{n}" site:linkedin.com', None), ('"{n}" site:facebook.com', None),
    ],
    "role": [
        ('"{n}" "{c}"', None), ('"{n}" "{c}" site:linkedin.com', None), ('"{n}" "{c}" biography OR profile', None), ('"{n}" "{c}" "email" OR "contact" OR "phone"', None), ('"{n}" "contact" OR "email"', "{d}"),
        ('"{n}" "{c}" filetype:pdf', None), ('"{n}" "{c}" "announcement" OR "appointment"', None), ('"{n}" "{c}" news OR interview after:2023-01-01', None),
    ],
    "auto": [
        ('"{n}"', None), ('"{n}" site:linkedin.com', None), ('"{n}" "email" OR "contact" OR "phone"', None), ('"{n}" filetype:pdf', None), ('"{n}" filetype:xlsx', None), ('"{n}" biography OR profile OR about', None),
        ('"{n}" site:{d}', None), ('"*@{d}"', None), ('"{n}" "{c}"', None),
    ],
}
#: Templates of the plain searches, by type of entity.
SEARCHES = {
    "PERSON": ['{n} biography "{n}"', '{n} "{n}" after:2020-01-01', '{n} "{n}" inurl:in site:linkedin.com', '{n} {c} "{n}"', '{n} "{n}" filetype:pdf'],
    "ORG": ['{n} official "{n}"', '{n} "{n}" inurl:about', '{n} annual report "{n}" filetype:pdf', '{n} investor presentation "{n}" filetype:pdf', '{n} press release "{n}" after:2023-01-01', '{n} "{n}" site:crunchbase.com', '{n} {c} "{n}"'],
    "EVENT": ['{n} "{n}"', '{n} news "{n}"', '{n} official "{n}"', '{n} report "{n}" filetype:pdf', '{n} presentation "{n}" filetype:pdf', '{n} presentation "{n}" filetype:ppt', '{n} {c} "{n}"'],
    "GPE": ["{n} information", '{n} news intitle:"{n}"', "{n} economy demographics filetype:pdf"],
    "DOCUMENT": ["{n} filetype:pdf", "{n} report filetype:pdf", "{n} presentation filetype:pdf", "{n} research filetype:pdf site:edu", "{n} filetype:ppt", "{n} report filetype:ppt", "{n} presentation filetype:ppt", "{n} filetype:doc", "{n} report filetype:doc"],
    "OTHER": ["{n}"],
}
#: The person's templates that need no domain and no context.
PERSON_DORKS = [t for t, site in DORKS["person"] if site is None and "{d}" not in t and "{c}" not in t]
_TYPES = {"ORGANIZATION": "ORG", "LOC": "GPE", "LOCATION": "GPE"}


def _filled(template: str, name: Column, domain: Column, context: Column) -> Column:
    out = F.replace(F.lit(template), F.lit("{n}"), name)
    for mark, value in (("{d}", domain), ("{c}", context)):
        if mark in template:
            out = F.when(value.isNotNull() & (value != ""), F.replace(out, F.lit(mark), value))
    return out


def build(words: Column, site: Column | None = None, optional: bool = False) -> Column:
    """A query of its words and a site; an optional site gives both forms."""
    if site is None:
        return words
    with_site = F.concat(words, F.lit(" site:"), site)
    return F.concat(F.lit("("), with_site, F.lit(") OR ("), words, F.lit(")")) if optional else with_site


def _dork(template: str, site: str | None, name: Column, domain: Column, context: Column) -> Column:
    words = _filled(template, name, domain, context)
    return words if site is None else F.when(domain.isNotNull() & (domain != ""), build(words, domain, True))


def dorks(df: DataFrame, name: str, kind: str, domain: str, context: str) -> DataFrame:
    """(name, kind, place, query): the queries of every distinct row (name, kind, domain, context), in the kind's order, equal ones once.

    An unknown kind counts as auto; a role without a context is searched by its name alone.
    """
    rows = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.lower(F.trim(F.coalesce(kind, F.lit("auto")))).alias("kind"), F.col(domain).alias("d"), F.col(context).alias("c")).distinct()
    rows = rows.withColumn("kind", F.when(F.col("kind").isin(*DORKS), F.col("kind")).otherwise("auto"))
    parts = []
    for k, templates in DORKS.items():
        own = [F.struct(F.lit(i).alias("place"), _dork(t, s, F.col("name"), F.col("d"), F.col("c")).alias("query")) for i, (t, s) in enumerate(templates)]
        if k == "role":
            bare = [F.struct(F.lit(i).alias("place"), _dork(t.replace(' "{c}"', ""), s, F.col("name"), F.col("d"), F.col("c")).alias("query")) for i, (t, s) in enumerate(templates)]
            parts.append(F.when(F.col("kind") == k, F.when(F.col("c").isNotNull(), F.array(*own)).otherwise(F.array(*bare))))
        else:
            parts.append(F.when(F.col("kind") == k, F.array(*own)))
    made = rows.select("name", "kind", F.explode(F.coalesce(*parts)).alias("q")).where("q.query is not null")
    return made.groupBy("name", "kind", F.col("q.query").alias("query")).agg(F.min("q.place").alias("place"))


def capped(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` queries of every name by place: a limit on how much is asked, not on rows read."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy("place", "query"))).where(F.col("rank") <= most).drop("rank")


def searches(df: DataFrame, name: str, label: str, context: str | None = None) -> DataFrame:
    """(name, label, place, query): plain searches by the entity's type; types without own templates are searched by name."""
    c = F.col(context) if context else F.lit(None).cast("string")
    label_ = F.upper(F.coalesce(F.col(label), F.lit("OTHER")))
    for a, b in _TYPES.items():
        label_ = F.when(label_ == a, b).otherwise(label_)
    rows = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name"), F.when(label_.isin(*SEARCHES), label_).otherwise("OTHER").alias("label"), c.alias("c")).distinct()
    arrays = [F.when(F.col("label") == k, F.array(*[F.struct(F.lit(i).alias("place"), _filled(t, F.col("name"), F.lit(None).cast("string"), F.col("c")).alias("query")) for i, t in enumerate(v)])) for k, v in SEARCHES.items()]
    return rows.select("name", "label", F.explode(F.coalesce(*arrays)).alias("q")).where("q.query is not null").select("name", "label", "q.place", "q.query")


def wildcard(partial: Column, category: Column) -> Column:
    return F.concat_ws(" ", F.nullif(F.trim(category), F.lit("")), partial)


def contextual(names: DataFrame, related: DataFrame, sites: DataFrame) -> DataFrame:
    """(name, query): every name (name) with its related entities (name, entity) and its sites (name, site): pairs, and each biased towards each site.

    The cross product is that of one name's own lists.
    """
    base = names.where("trim(name) <> ''").select(F.trim("name").alias("name")).distinct()
    ents = related.select(F.trim("name").alias("name"), F.trim("entity").alias("entity")).where("entity <> '' and lower(entity) <> lower(name)")
    ents = base.join(ents.groupBy("name", F.lower("entity").alias("k")).agg(F.min("entity").alias("entity")).drop("k"), "name")
    places = base.join(sites.select(F.trim("name").alias("name"), host(F.col("site")).alias("site")).where("site is not null").distinct(), "name")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    n, e = quoted(F.col("name")), quoted(F.col("entity"))
    pairs = ents.select("name", F.explode(F.array(F.concat(n, F.lit(" + "), e), F.concat(n, F.lit(" "), e), F.concat(n, F.lit(" "), e, F.lit(" relationship OR connection")))).alias("query"))
    alone = places.select("name", build(n, F.col("site"), True).alias("query"))
    both = ents.join(places, "name").select("name", build(F.concat(n, F.lit(" "), e), F.col("site"), True).alias("query"))
    return pairs.unionByName(alone).unionByName(both).distinct()


def follow_up(names: DataFrame, keywords: DataFrame, related: DataFrame) -> DataFrame:
    """(name, query): every name with its new keywords (name, keyword), as document and in titles, and with its related entities (name, entity)."""
    k = names.select("name").distinct().join(keywords, "name")
    both = F.concat_ws(" ", "name", "keyword")
    made = k.select("name", F.explode(F.array(F.concat(both, F.lit(" filetype:pdf")), F.concat(both, F.lit(' intitle:"'), "keyword", F.lit('"')))).alias("query"))
    r = names.select("name").distinct().join(related, "name")
    pair = F.concat_ws(" ", "name", "entity")
    return made.unionByName(r.select("name", F.concat(pair, F.lit(' "'), pair, F.lit('"')).alias("query"))).distinct()


def initial(name: Column, first: Column, second: Column, third: Column) -> Column:
    """Queries that open a search: the relation to the first neighbour, reports, and the influence on the next two."""
    n = F.concat(F.lit('"'), name, F.lit('"'))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    influence = lambda c: F.concat(n, F.lit(" influence on "), q(c), F.lit(" "), n, F.lit(" "), q(c))
    return F.array_compact(F.array(F.concat(n, F.lit(" "), q(first), F.lit(" relationship "), n, F.lit(" "), q(first)), F.concat(n, F.lit(" official reports OR analysis "), n, F.lit(" filetype:pdf")), influence(second), influence(third)))


def reseed(candidates: DataFrame, most: int = 6) -> DataFrame:
    """(base, place, query): of the candidates (base, place, query) of every base query the first ``most``, equal ones up to case once."""
    rows = candidates.select("base", "place", F.trim("query").alias("query")).where("query <> ''")
    once = rows.groupBy("base", F.lower("query").alias("k")).agg(F.min(F.struct("place", "query")).alias("f")).select("base", "f.place", "f.query")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("base").orderBy("place", "query"))).where(F.col("rank") <= most).select("base", F.col("rank").cast("int").alias("place"), "query")
