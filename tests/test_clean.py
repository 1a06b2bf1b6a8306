"""Hand-computed cases of the cleaning functions and predicates."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import clean, predicates, urls
from weftgraph.functions import text as tx
from weftgraph.operators import pages


def _apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (clean.fold, {"François Müller": "francois muller", "Ștefan": "stefan", "й": "и", None: None, "": ""}),
        (clean.normalize_name, {"  Øyvind  Straße ": "oyvind strasse", "Łukasz": "lukasz", None: None}),
        (clean.to_ascii, {"François Müller": "Francois Muller", "Щука": "Shchuka", "Ænon": "Aenon", "“a”–b": '"a"-b', "漢": "", None: None}),
        (clean.surface, {"  ~George Simion[edit": "George Simion", '"Ion"': "Ion", None: None, "": ""}),
        (clean.pipeline_clean, {"10George  Simion!": "George Simion", "[tag]Entity": "tag]Entity", None: None, "***": ""}),
        (clean.alias, {"Dr. John Smith (CEO) - profile": "John Smith", "Mr.": "Mr.", "Ann Lee, PhD": "Ann Lee", None: None}),
        (clean.path_name, {"Nicușor Dan": "nicusor_dan", "What is AI?": "what_is_ai", "COVID-19 Info": "covid_19_info", "???": "query", None: None, "a" * 60: "a" * 50}),
        (clean.contact_id, {"A.B@X.example": "a.b@x.example", "+40 700.;": "+40 700", None: None}),
        (tx.unification_key, {"Müller": "muller", "Muller": "muller", "O'Brien": "obrien", "—": "", None: None}),
        (urls.manifest_form, {"HTTP://Ex.com/A/#f": "http://ex.com/A", "http://x.com/": "http://x.com/", "http://x.com/a/?q=1": "http://x.com/a?q=1", None: None, "": ""}),
        (predicates.real_url, {"file:///D:/path/%7Chttp://example.com": "http://example.com", "C:\\p\\f|https://example.com": "https://example.com", "https://a.example/x": "https://a.example/x", "nothing": "nothing", None: None, "%zz|http://a.example": "http://a.example"}),
        (predicates.is_phone, {"+1 (743) 555-3824": True, "2020-01-02": False, "12": False, None: None}),
        (predicates.is_entity_text, {"of": False, "John Doe": True, "12,5": False, "Who?": False, "one two three four five six seven eight nine": False, None: None}),
        (predicates.crawlable, {"https://a.example/contact": False, "https://a.example/news/report": True, "https://a.example/1990": False, "https://a.example/x.pdf": True, "https://a.example/x.svg": False, "mailto:a@b": False, "": False, None: None}),
        (pages.visible_text, {"<p>A&amp;B</p><script>x<y</script> c<!-- z -->": "A&B c", "no tags": "no tags", None: None, "": ""}),
    ],
)
def test_cases(spark, f, cases):
    assert dict(zip(cases, _apply(spark, f, list(cases)), strict=True)) == cases


def test_whole_words_differ_from_parts(spark):
    df = spark.createDataFrame([("https://a.example/contact",), ("https://a.example/edit/1",)], "x string")
    assert [r.y for r in df.select(predicates.crawlable(F.col("x"), whole_words=True).alias("y")).collect()] == [True, False]


def test_evidence_parts(spark):
    got = _apply(spark, clean.evidence_parts, ["Born in 1970[8] (2020) in Oslo - ^ 12. A second source says so", "ab", None, "| a | b |\n|---|---|\n| c | d |"])
    assert got == [["Born in 1970 in Oslo", "second source says so"], ["ab"], None, ["a • b c • d"]]


def test_crowded_blocks(spark):
    crowd = " ".join(["@@@@"] * 5 + ["http"] * 2)
    rows = [(1, "A plain paragraph about the harbour and the council of the town."), (2, crowd + " " + "1" * 5), (3, None), (4, ""), (5, "Subscribe to our newsletter for more news about the harbour town.")]
    got = tx.good_blocks(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    assert [r.k for r in got.collect()] == [1]


def test_links(spark):
    html = '<a href="/b#x">Harbour news</a><a href="https://o.example/c/">Other</a><a href="mailto:x@y.example">m</a><a href="https://a.example/p">self</a>'
    df = spark.createDataFrame([(1, html, "https://a.example/p"), (2, None, "https://a.example/p"), (3, "", None)], "k int, html string, base string")
    assert {(r.link, r.anchor) for r in pages.links(df, "k", "html", "base").collect()} == {("https://a.example/b", "Harbour news"), ("https://o.example/c", "Other")}
    assert [r.link for r in pages.links(df, "k", "html", "base", ["harbour"]).collect()] == ["https://a.example/b"]
    tables = spark.createDataFrame([([[["a", None], ["c", "d"]]],)], "t array<array<array<string>>>")
    assert tables.select(clean.tables_text(F.col("t")).alias("x")).first().x == "=== Table 1 ===\na | \nc | d"
