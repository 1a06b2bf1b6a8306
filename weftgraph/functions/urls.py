"""URL functions as column expressions; null in, null out; malformed input never fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.constants import CORPORATE_WORDS, DOCUMENT_EXTENSIONS, URL_STOP
from weftgraph.runtime import host

__all__ = ["host", "normalize", "path", "site_key", "source_tag", "source_token", "extension", "is_document", "is_pdf", "is_http", "url_relevance", "dedupe_key"]


def normalize(url: Column) -> Column:
    """Without fragment and without trailing slashes, except for a root path."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]+/$"), bare).otherwise(F.regexp_replace(bare, "/+$", ""))


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def site_key(url: Column) -> Column:
    """Host, else path, else the URL itself."""
    return F.coalesce(host(url), F.nullif(path(url), F.lit("")), url)


def source_token(url: Column) -> Column:
    """First label of the host that is neither www nor m."""
    return F.element_at(F.filter(F.split(host(url), r"\."), lambda x: ~x.isin("www", "m")), 1)


def source_tag(url: Column) -> Column:
    h = host(url)
    known = [F.when(F.contains(h, F.lit(x)), F.lit(x)) for x in ("wikipedia", "wikidata", "dbpedia")]
    return F.coalesce(*known, F.element_at(F.split(h, r"\."), 1))


def extension(url: Column) -> Column:
    """Lower-case suffix of the path, at most five characters, else the empty string."""
    return F.regexp_extract(F.lower(path(url)), r"(\.[^./]{1,4})$", 1)


def is_document(url: Column) -> Column:
    return extension(url).isin(*DOCUMENT_EXTENSIONS)


def is_pdf(url: Column) -> Column:
    """A path that ends in .pdf, or pdf at the end of the query string."""
    return F.lower(path(url)).endswith(".pdf") | F.lower(F.regexp_extract(url, r"\?([^#]*)", 1)).endswith("pdf")


def is_http(url: Column) -> Column:
    return url.rlike(r"^https?://[^\s/?#]+\.[^\s/?#]+")


def dedupe_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), "/+$", "")


def url_relevance(url: Column, query: Column) -> Column:
    """Score of a URL for a query: company pages, exact slug, share of words, words of the path, depth."""
    low, q = F.lower(url), F.lower(query)
    drop = F.array(*[F.lit(x) for x in [*URL_STOP, ""]])
    words = F.array_except(F.split(low, r"[-/_.?&=]"), drop)
    asked = F.array_except(F.split(F.trim(q), r"\s+"), drop)
    of_path = F.array_except(F.split(path(low), r"[-/_.?&=]"), drop)
    hit = F.size(F.array_intersect(asked, words))
    slug = F.concat(F.lit("/"), F.replace(q, F.lit(" "), F.lit("-")))
    exact = F.contains(F.concat(low, F.lit("/")), F.concat(slug, F.lit("/"))) | F.contains(low, F.concat(slug, F.lit("-")))
    depth = F.size(F.filter(F.split(path(low), "/"), lambda x: x != ""))
    score = (
        F.when(F.arrays_overlap(words, F.array(*[F.lit(x) for x in CORPORATE_WORDS])), 2.5).otherwise(0.0)
        + F.when(exact, 10.0).otherwise(0.0)
        + F.when(F.size(asked) == 0, 0.0).when(hit == F.size(asked), 5.0).otherwise(2.0 * hit / F.size(asked))
        + F.size(F.array_intersect(asked, of_path))
        - F.when(depth > 3, 0.1 * (depth - 3)).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), score)


def manifest_form(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slashes except for a root path; the query stays."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    p = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    q = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(F.lower(head), F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", "")), F.when(q == "?", "").otherwise(q))


def site_list(df: DataFrame, url: str, seq: str) -> DataFrame:
    """The hosts of a column once each, in order of first sight, in one row; for lists of settings or of sites."""
    first = df.where(F.col(url).isNotNull()).groupBy(host(F.col(url)).alias("h")).agg(F.min(seq).alias("s")).where("h is not null")
    ordered = F.array_sort(F.collect_list(F.struct("s", "h")))  # a row for each site
    return first.agg(F.array_join(F.transform(ordered, lambda x: x["h"]), ",").alias("sites"), F.count("*").alias("n"))
