import itertools
import random

from pyspark.sql import functions as F

from weftgraph.operators import contacts, evidence, graph, ranking
from weftgraph.sources import tables


def test_tiny_graph(spark):
    edges = graph.undirected(spark.createDataFrame([("A", "B"), ("C", "B"), ("B", "A"), ("D", "E"), ("F", "F"), (None, "A")], "a string, b string"), "a", "b")
    assert {r.node: r.degree for r in graph.degrees(edges).collect()} == {"A": 1, "B": 2, "C": 1, "D": 1, "E": 1}
    assert {r.node: r.component for r in graph.components(edges).collect()} == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D"}
    core = spark.createDataFrame([("A",)], "node string")
    assert {r.node for r in graph.keep_components(edges, core).collect()} == {"A", "B", "C"}
    assert {(r.node, r.distance) for r in graph.within_hops(edges, core, 1).collect()} == {("A", 0), ("B", 1)}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 580)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in graph.components(graph.undirected(spark.createDataFrame(pairs, "a int, b int"), "a", "b")).collect()}
    assert got == {x: find(x) for x in parent}


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    assert graph.components(empty).count() == 0 and graph.degrees(empty).count() == 0


def test_fold_and_ties(spark):
    df = spark.createDataFrame([("e", 0.4, 1), ("e", 0.8, 2), ("e", 1.0, 3), ("n", None, 1)], "k string, c double, s int")
    got = {r.k: r.confidence for r in evidence.folded_confidence(df, "k", "c", "s").collect()}
    assert abs(got["e"] - 0.8) < 1e-12 and got["n"] is None
    kinds = spark.createDataFrame([("e", "b", 1), ("e", "a", 2), ("e", "a", 3), ("e", "b", 4), ("x", None, 1)], "k string, t string, s int")
    assert [(r.k, r.t, r.n) for r in evidence.most_common(kinds, "k", "t", "s").collect()] == [("e", "b", 2)]


def test_edges_do_not_depend_on_order(spark):
    rows = [("A", "B", 0.5, "x", "2020", 1), ("B", "A", 0.7, "y", "2019", 2), ("A", "A", 1.0, "x", "2020", 3), ("A", "B", None, None, None, 4)]
    results = set()
    for order in itertools.islice(itertools.permutations(rows), 4):
        df = spark.createDataFrame(list(order), "a string, b string, c double, k string, d string, s int").repartition(3)
        results.add(tuple(map(tuple, evidence.aggregate_edges(df, "a", "b", "c", "k", "d", "s").collect())))
    assert results == {(("A", "B", 3, 0.6, "x", "2019", "2020"),)}


def test_contacts(spark):
    df = spark.createDataFrame([(1, "tel +1 (743) 555-3824 end, A.B@X.org, 2012-2016, https://x.com/abc?y=1."), (2, None), (3, "")], "id int, t string")
    assert {(r.id, r.kind, r.value) for r in contacts.contact_hits(df, "id", "t").collect()} == {(1, "PHONE", "+17435553824"), (1, "EMAIL", "a.b@x.org"), (1, "SOCIAL", "https://x.com/abc")}


def test_scores(spark):
    df = spark.createDataFrame([("blue harbour", "http://a/blue-harbour", "Blue Harbour news"), ("blue harbour", "u", "nothing"), ("on", "u", "t")], "q string, u string, t string")
    got = [r.s for r in df.select(ranking.search_score(F.col("q"), F.col("u"), F.col("t")).alias("s")).collect()]
    assert abs(got[0] - 12 / 15) < 1e-9 and got[1] is None and got[2] == 1.0


def test_tables(spark):
    a = spark.createDataFrame([(1, "old", 1), (2, "keep", 1)], "k int, v string, s int")
    b = spark.createDataFrame([(1, "new", 2)], "k int, v string, s int")
    assert {(r.k, r.v) for r in tables.upsert(a, b, ["k"], "s").collect()} == {(1, "new"), (2, "keep")}
    assert {(r.k, r.v) for r in tables.compose(a, b, ["k"]).collect()} == {(1, "new"), (2, "keep")}
    c = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, expires_at int")
    assert {r.k for r in tables.live(c, 10).collect()} == {2, 3}
