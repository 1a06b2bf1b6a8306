"""Pages as tables: visible text and links of HTML, template addresses, and the routing of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.constants import DOCUMENT_EXTENSIONS
from weftgraph.functions import predicates, urls

#: HTML entities of running text.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags, entities resolved, single blanks."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for name, mark in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(x, r"[\s\u00a0]+", " "))


def title(html: Column) -> Column:
    """The page's title, null without one."""
    return F.nullif(visible_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def page_content(df: DataFrame, key: str, html: str, least: int = 50) -> DataFrame:
    """(key, title, text) of the pages whose visible text has at least ``least`` characters and that are no error pages."""
    x = df.where(F.col(html).isNotNull()).select(key, title(F.col(html)).alias("title"), visible_text(F.col(html)).alias("text"))
    return x.where((F.length("text") >= least) & ~predicates.error_page(F.col("title"), F.col("text")))


def links(df: DataFrame, key: str, html: str, base: str, terms: list[str] | None = None) -> DataFrame:
    """(key, link, anchor) of the anchors of a page: relative ones resolved, normalised, not the page itself, crawlable addresses only.

    With ``terms`` only links whose anchor or address names all of them.
    """
    anchor = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(2)).alias("inner"))
    rows = df.select(key, F.col(base).alias("_base"), F.explode(pairs).alias("a"))
    href = F.col("a.href")
    root = F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract("_base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    full = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract("_base", "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.concat(root, F.lit("/"))), href))
    )
    out = rows.select(key, "_base", urls.normalize(full).alias("link"), visible_text(F.col("a.inner")).alias("anchor"))
    out = out.where(F.col("link").rlike("^https?://") & (F.col("link") != urls.normalize(F.col("_base"))))
    if terms:
        out = out.where(predicates.whole_words(F.concat_ws(" ", "anchor", "link"), terms))
    return out.drop("_base")


def downloads(df: DataFrame, key: str, html: str, base: str, kinds: list[str] | None = None) -> DataFrame:
    """(key, link, extension) of the links to files of the given extensions, in order of first sight and once each."""
    found = links(df, key, html, base).withColumn("extension", urls.extension(F.col("link")))
    return found.where(F.col("extension").isin(*(kinds or DOCUMENT_EXTENSIONS))).groupBy(key, "link").agg(F.first("extension").alias("extension"))


def template_urls(df: DataFrame, entity: str, lang: str = "en", blocked: list[str] | None = None, sources: tuple[str, ...] = ("wikipedia", "dbpedia", "web")) -> DataFrame:
    """(entity, source, url) of the addresses at which an entity may be described; languages twice in the list count once."""
    name = F.url_encode(F.replace(F.col(entity), F.lit(" "), F.lit("_")))
    forms = [("wikipedia", F.concat(F.lit(f"https://{x}.wikipedia.org/wiki/"), name)) for x in dict.fromkeys([lang, "en"])]
    forms += [("dbpedia", F.concat(F.lit("http://dbpedia.org/resource/"), name)), ("web", F.concat(F.lit("https://duckduckgo.com/?q="), F.url_encode(F.col(entity))))]
    used = [F.struct(F.lit(s).alias("source"), u.alias("url")) for s, u in forms if s in sources and s not in (blocked or [])]
    return df.select(F.col(entity).alias("entity"), F.explode(F.array(*used)).alias("t")).select("entity", "t.source", "t.url")


def document_kind(url: Column, content_type: Column) -> Column:
    """How a fetched document is read: pdf, text, sheet, slides, image or page, by its suffix, else by its content type."""
    e, c = urls.extension(url), F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when((e == ".pdf") | F.contains(c, F.lit("pdf")), "pdf")
        .when(e.isin(".doc", ".docx", ".odt", ".rtf", ".txt") | F.contains(c, F.lit("word")), "text")
        .when(e.isin(".xls", ".xlsx", ".ods", ".csv") | F.contains(c, F.lit("sheet")), "sheet")
        .when(e.isin(".ppt", ".pptx"), "slides")
        .when(e.isin(".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff") | c.startswith("image"), "image")
        .otherwise("page")
    )


def document_text(text: Column, tables: Column, metadata: Column) -> Column:
    """Text, tables' text and a metadata block of a document; missing parts are left out."""
    from weftgraph.functions.clean import tables_text

    block = F.concat(F.lit("PDF_METADATA:\n"), F.array_join(F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"))
    return F.concat_ws("\n\n", F.nullif(text, F.lit("")), F.when(F.size(tables) > 0, tables_text(tables)), F.when(F.size(F.map_keys(metadata)) > 0, block))
