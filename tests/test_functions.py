from pyspark.sql import functions as F

from weftgraph.functions import text as tx
from weftgraph.functions import urls
from weftgraph.operators import evidence, temporal


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_names(spark):
    cases = {"The Beatles": "Beatles", "Theory": "Theory", "John's": "John", "James": "James", "John Doe (1950-2020)": "John Doe", "of": None, "O'Brien": None, "Conor O'Brien": "Conor O", "": None}
    for given, wanted in cases.items():
        assert one(spark, tx.clean_name, given) == wanted, given
    assert one(spark, tx.clean_name, None) is None


def test_ascii_and_similarity(spark):
    assert one(spark, tx.ascii_fold, "François Müller") == "Francois Muller"
    row = spark.createDataFrame([("Ann Lee", "Lee Ann"), ("Ann", "Ann Lee"), (None, "x")], "a string, b string").select(tx.name_similarity("a", "b").alias("s")).collect()
    assert row[0]["s"] >= 0.88 and row[1]["s"] >= 0.9 and row[2]["s"] is None


def test_urls(spark):
    assert one(spark, urls.normalize, "http://a.b/c/#x") == "http://a.b/c"
    assert one(spark, urls.normalize, "http://a.b/") == "http://a.b/"
    assert one(spark, urls.host, "https://user@WWW.Example.org:80/x?y") == "example.org"
    assert one(spark, urls.host, "") is None and one(spark, urls.host, None) is None
    assert one(spark, urls.source_token, "https://en.wikipedia.org/x") == "en"
    assert one(spark, urls.source_tag, "https://en.wikipedia.org/x") == "wikipedia"
    assert one(spark, urls.extension, "http://a.b/C.PDF?x=1") == ".pdf"
    assert one(spark, urls.is_pdf, "http://a.b/c?f=x.pdf") is True


def test_legacy(spark):
    r = one(spark, evidence.decode_legacy, "Born in|||http://b.com|||confidence:0.9[dates:1972,1980]")
    assert (r.text, r.url, r.confidence, r.dates) == ("Born in", "http://b.com", 0.9, ["1972", "1980"])
    assert one(spark, evidence.decode_legacy, "Only text").url == "unknown"


def test_dates(spark):
    for given, iso, kind in (("from 2020 to 2021", "2020-01-01/2021-12-31", "range"), ("2020", "2020-01-01", "year_only"), ("March 2020", "2020-03-01", "month_year"), ("2020/03/05", "2020-03-05", "full_date"), ("soon", None, None)):
        assert one(spark, temporal.normalize_date, given) == iso
        assert one(spark, lambda c: temporal.date_type(temporal.normalize_date(c)), given) == kind


def test_chunks(spark):
    text = "\n\n".join(["word " * 300, "One. " * 700, "x" * 6000])
    out = one(spark, tx.chunks, text)
    assert all(len(c) <= 2500 for c in out) and one(spark, tx.chunks, "") == [] and one(spark, tx.chunks, None) is None
