"""Canonical entities: alias tables, lookups, duplicate groups, upserts of nodes and edges, and remapping of relations."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weftgraph.constants import LABEL_PRIORITY
from weftgraph.functions import clean, nearness
from weftgraph.functions import text as tx
from weftgraph.operators import graph
from weftgraph.runtime import cut, ship


def register(df: DataFrame, qid: str, names: list[str], aliases: str | None = None) -> DataFrame:
    """(alias, qid, n): every spelling of every identified entity in normalised form; ``n`` counts the rows that give it.

    ``names`` are string columns, ``aliases`` an array column. Rows without an identifier register nothing.
    """
    parts = [F.transform(F.array(*names), lambda x: x)] + ([F.coalesce(aliases, F.array().cast("array<string>"))] if aliases else [])
    rows = df.where(F.col(qid).isNotNull()).select(F.col(qid).alias("qid"), F.explode(F.array_distinct(F.concat(*parts))).alias("name"))
    return rows.select(clean.normalize_name(F.col("name")).alias("alias"), "qid").where("alias <> ''").groupBy("alias", "qid").agg(F.count("*").alias("n"))


def alias_table(registered: DataFrame) -> DataFrame:
    """One identifier for each alias: the one that most rows give, ties to the smallest."""
    rank = F.row_number().over(W.partitionBy("alias").orderBy(F.desc("n"), "qid"))
    return registered.withColumn("rank", rank).where("rank = 1").select("alias", "qid")


def canonicalize(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """``df`` with ``canonical``: the identifier of the name as written, else of the name without titles and additions, else null."""
    written = aliases.select(F.col("alias").alias("_a"), F.col("qid").alias("_qa"))
    bare = aliases.select(F.col("alias").alias("_b"), F.col("qid").alias("_qb"))
    keyed = df.withColumn("_a", clean.normalize_name(F.col(name))).withColumn("_b", clean.normalize_name(clean.alias(F.col("_a"))))
    out = keyed.join(written, "_a", "left").join(bare, "_b", "left")
    return out.select(*df.columns, F.coalesce("_qa", "_qb").alias("canonical"))


def node_id(qid: Column, canonical: Column, name: Column) -> Column:
    """Identifier of a node: its own, else the canonical one, else the cleaned name, else the name."""
    return F.coalesce(qid, canonical, tx.clean_name(clean.to_ascii(name)), name)


def merge_names(a: Column, a_known: Column, b: Column, b_known: Column) -> Column:
    """Which of two names stays when they are merged: a canonical one, else the longer, ties to the first."""
    return F.when(a_known & ~b_known, a).when(b_known & ~a_known, b).otherwise(F.when(F.length(b) > F.length(a), b).otherwise(a))


#: What Python takes for blanks.
BLANKS = r"(?U:[\s\x1c-\x1f]+)"
#: Names of a tile that is compared with others, and the least number of tiles before these grow.
TILE, TILES = (1024, 16384), 16
#: Letters of the pieces by which contained names are found.
PIECE = 5


def _ratio_candidates(forms: DataFrame, lengths: list[tuple[int, int]], least: float) -> DataFrame:
    """(f, g) of the forms whose ratio can be ``least`` or more; ``lengths`` has the number of forms of each length.

    Forms of near lengths make up tiles. All tiles meet whose lengths allow that ratio, and in these every pair is
    tried by bounds that lose none, so the work grows as the square of the number of forms, but a pair costs nanoseconds.
    """
    spark = forms.sparkSession
    ship(spark)
    size = min(TILE[1], max(TILE[0], sum(n for _, n in lengths) // TILES))
    bands: list[list[tuple[int, int]]] = []
    for length, n in sorted(lengths):
        if not bands or sum(k for _, k in bands[-1]) >= size:
            bands.append([])
        bands[-1].append((length, n))
    placed, tiles = [], []  # a band's first tile and number of tiles for each length; the lengths of each tile
    for band in bands:
        parts = -(-sum(n for _, n in band) // size)
        placed += [(length, len(tiles), parts) for length, _ in band]
        tiles += [(band[0][0], band[-1][0])] * parts
    # the blocks are no longer than the shorter form
    meets = [(a, b) for b, (low, _) in enumerate(tiles) for a, (_, high) in enumerate(tiles[: b + 1]) if high * (2 - least) >= least * low - 1e-6]
    where = F.broadcast(spark.createDataFrame(placed, "l int, start int, parts int"))  # a row for each length
    held = forms.withColumn("l", F.length("form")).join(where, "l").select((F.col("start") + F.pmod(F.xxhash64("form"), "parts")).alias("tile"), "form")
    held = cut(held.groupBy("tile").agg(F.collect_list("form").alias("forms")))
    both = spark.createDataFrame(meets, "a int, b int").join(held.select(F.col("tile").alias("a"), F.col("forms").alias("x")), "a").join(held.select(F.col("tile").alias("b"), F.col("forms").alias("y")), "b")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b, x, y = (batch.column(c)[k].as_py() for c in ("a", "b", "x", "y"))
                for i, j in nearness.near_pairs(x, y, least):
                    if a == b:
                        once = i < j
                        i, j = i[once], j[once]
                    yield pa.RecordBatch.from_arrays([pa.array([x[p] for p in i], pa.string()), pa.array([y[p] for p in j], pa.string())], names=["f", "g"])

    return both.repartition(max(spark.sparkContext.defaultParallelism * 2, len(meets) // 16)).mapInArrow(run, "f string, g string")


def _part_candidates(forms: DataFrame, lengths: list[tuple[int, int]]) -> DataFrame:
    """(f, g) of the forms f that g contains, as a string or by all of its words: both hold f's rarest piece, or its rarest word."""
    none = F.array().cast("array<string>")
    words = lambda c: F.split(c, BLANKS)
    pieces = lambda n: F.when(F.length("form") >= n, F.transform(F.sequence(F.lit(1), F.length("form") - n + 1), lambda i: F.concat(F.lit("p"), F.substring("form", i, n)))).otherwise(none)
    short = sorted(n for n, _ in lengths if 0 < n < PIECE)  # such forms are pieces as a whole
    keys = F.concat(F.transform(words("form"), lambda w: F.concat(F.lit("w"), w)), *map(pieces, [PIECE, *short]))
    held = cut(forms.where("form <> ''").select("form", F.explode(F.array_distinct(keys)).alias("key")))
    counts = held.groupBy("key").agg(F.count("*").alias("n"))
    # of a form's own pieces those of full length: others stand for shorter forms
    own = held.where(F.col("key").startswith("w") | (F.length("key") - 1 == F.least(F.length("form"), F.lit(PIECE))))
    rarest = own.join(counts, "key").groupBy("form", F.substring("key", 1, 1).alias("kind")).agg(F.min(F.struct("n", "key")).alias("r"))
    rarest = rarest.where("r.n > 1").select(F.col("form").alias("f"), F.col("r.key").alias("key"))  # a key of its own: no other form contains it
    part = F.contains("g", "f") | (F.size(F.array_except(words("f"), words("g"))) == 0)
    return rarest.join(held.select(F.col("form").alias("g"), "key"), "key").where((F.col("f") != F.col("g")) & part).select("f", "g")


def similar_names(df: DataFrame, name: str, seq: str, least: float = 0.85) -> DataFrame:
    """(first, later, similarity) of all names whose similarity is at least ``least``, ``first`` with the smaller ``seq``.

    Distinct forms are compared instead of names. Candidates are all forms that are equal, that one contains, or whose
    letters allow the ratio, so the similarity itself decides about every pair that can reach ``least``.
    """
    form = F.regexp_replace(clean.normalize_name(F.col(name)), f"^{BLANKS}|{BLANKS}$", "")
    rows = cut(df.select(F.col(name).alias("name"), F.col(seq).alias("seq"), form.alias("form")).where("form is not null"))
    forms = cut(rows.groupBy("form").agg(F.count("*").alias("n")))
    lengths = [(r.l, r.n) for r in forms.groupBy(F.length("form").alias("l")).agg(F.count("*").alias("n")).collect()]
    single = forms.select("form")
    some = _ratio_candidates(single, lengths, least).unionByName(_part_candidates(single, lengths))
    met = cut(some.select(F.least("f", "g").alias("f"), F.greatest("f", "g").alias("g")).distinct())
    either = met.unionByName(met.select(F.col("g").alias("f"), F.col("f").alias("g"))).unionByName(forms.where("n > 1").select(F.col("form").alias("f"), F.col("form").alias("g")))
    a, b = rows.select(F.col("name").alias("first"), F.col("seq").alias("s1"), F.col("form").alias("f")), rows.select(F.col("name").alias("later"), F.col("seq").alias("s2"), F.col("form").alias("g"))
    near = either.join(a, "f").join(b, "g").where((F.col("s1") < F.col("s2")) & (F.col("first") != F.col("later")))
    near = near.select("first", "later", "s1", "s2", "f", "g").repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    similarity = tx.name_similarity.func

    def run(batches):  # not a column: Spark would work it out below the join for both orders, and twice
        for batch in batches:
            found = pa.array(similarity(batch.column("f").to_pandas(), batch.column("g").to_pandas()), pa.float64())
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("first", "later", "s1", "s2")), found], names=["first", "later", "s1", "s2", "similarity"])
            yield out.filter(pc.greater_equal(found, least))

    return near.mapInArrow(run, T.StructType([*near.schema.fields[:4], T.StructField("similarity", T.DoubleType())]))


def _absorbed(pairs: DataFrame) -> DataFrame:
    """(name, head, similarity) of the names that others absorb: one pass over the pairs in order of ``s1``, which holds only these names."""

    def run(batches):
        gone = set()
        for batch in batches:
            first, later, similarity = (batch.column(c).to_pylist() for c in ("first", "later", "similarity"))
            out = []
            for f, g, s in zip(first, later, similarity, strict=True):
                if f not in gone and g not in gone:  # all names before f are decided, and so is f
                    gone.add(g)
                    out.append((g, f, s))
            name, head, sim = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(head, pa.string()), pa.array(sim, pa.float64())], names=["name", "head", "similarity"])

    return pairs.coalesce(1).sortWithinPartitions("s1", "first").select("first", "later", "similarity").mapInArrow(run, "name string, head string, similarity double")


def duplicate_groups(df: DataFrame, name: str, seq: str, least: float = 0.85, at_once: int = 2_000_000) -> DataFrame:
    """(name, head, similarity): in order of ``seq`` every name that is not absorbed heads a group and absorbs the later names similar to it.

    While more than ``at_once`` pairs are open, each round finds as heads all names without an earlier open similar one;
    the rounds are as many as the longest chain of such names. One ordered pass settles the rest.
    """
    every = pairs = cut(similar_names(df, name, seq, least))
    names = open_ = cut(df.select(F.col(name).alias("name")).distinct())
    found = []
    while pairs.count() > at_once:
        heads = cut(open_.join(pairs.select(F.col("later").alias("name")).distinct(), "name", "left_anti"))
        gone = pairs.join(heads.select(F.col("name").alias("first")), "first", "left_semi").select(F.col("later").alias("name"))
        open_ = cut(open_.join(heads.unionByName(gone).distinct(), "name", "left_anti"))
        pairs = cut(pairs.join(open_.select(F.col("name").alias("first")), "first", "left_semi").join(open_.select(F.col("name").alias("later")), "later", "left_semi"))
        found.append(heads)
    absorbed = _absorbed(pairs)
    if found:  # a name that left in a round may still belong to an earlier head that was found after it
        heads = reduce(DataFrame.unionByName, found, open_.join(absorbed, "name", "left_anti")).select(F.col("name").alias("first"))
        absorbed = every.join(heads, "first", "left_semi").groupBy(F.col("later").alias("name")).agg(F.min(F.struct("s1", "first", "similarity")).alias("h")).select("name", F.col("h.first").alias("head"), F.col("h.similarity").alias("similarity"))
    return names.join(absorbed, "name", "left").select("name", F.coalesce("head", "name").alias("head"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def priority(label: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_PRIORITY.items() for x in kv]), label), F.lit(0))


def upsert_nodes(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes (node, label, display, aliases, seq) of both tables: the label of the highest priority, later ones win ties, an unknown one never wins;
    the first display name stays; aliases are united. A node without any label is UNKNOWN."""
    both = current.unionByName(fresh)
    known = F.col("label").isNotNull() & (F.col("label") != "UNKNOWN")
    base = both.groupBy("node").agg(
        F.max(F.when(known, F.struct(priority(F.col("label")).alias("p"), "seq", "label")))["label"].alias("label"),
        F.min(F.when(F.col("display").isNotNull(), F.struct("seq", "display")))["display"].alias("display"),
        F.max("seq").alias("seq"),
    )
    names = both.select("node", F.explode("aliases").alias("a")).where("a is not null").distinct().groupBy("node").agg(F.array_sort(F.collect_list("a")).alias("aliases"))
    out = base.join(names, "node", "left")
    return out.select("node", F.coalesce("label", F.lit("UNKNOWN")).alias("label"), "display", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "seq")


def upsert_edges(current: DataFrame, evidence: DataFrame, compat: bool = False) -> DataFrame:
    """Edges (src, dst, n, confidence, first_date, last_date) after a batch of evidence (src, dst, confidence, date).

    The confidence is the mean over all evidence; with ``compat`` it is the mean of the old and the batch's mean, which depends on the batches.
    """
    rows = evidence.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "confidence", "date")
    batch = rows.groupBy("src", "dst").agg(F.count("*").alias("n1"), F.avg("confidence").alias("c1"), F.count("confidence").alias("k1"), F.min("date").alias("d0"), F.max("date").alias("d1"))
    j = current.join(batch, ["src", "dst"], "full_outer")
    n, n1, k1 = (F.coalesce(c, F.lit(0)) for c in ("n", "n1", "k1"))
    mean = (F.coalesce(F.col("confidence") * n, F.lit(0.0)) + F.coalesce(F.col("c1") * k1, F.lit(0.0))) / F.nullif(F.when(F.col("confidence").isNotNull(), n).otherwise(0) + k1, F.lit(0))
    pair = F.when(F.col("confidence").isNotNull() & F.col("c1").isNotNull(), (F.col("confidence") + F.col("c1")) / 2).otherwise(F.coalesce("confidence", "c1"))
    return j.select("src", "dst", (n + n1).alias("n"), (pair if compat else mean).alias("confidence"), F.least("first_date", "d0").alias("first_date"), F.greatest("last_date", "d1").alias("last_date"))


def remap(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (src, dst) with their ends replaced by the entities (name) they mean: equal in lower case, else equal in sorted words.

    Ends that mean no entity and self-loops are dropped; of several entities the first by name is taken.
    """
    exact = entities.where("name is not null").groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("name").alias("to"))
    sorted_ = entities.where("name is not null").groupBy(tx.sorted_words(F.col("name")).alias("k")).agg(F.min("name").alias("to2"))
    out = relations
    for end in ("src", "dst"):
        keyed = out.withColumn("k", F.lower(F.trim(end))).join(exact, "k", "left").drop("k")
        keyed = keyed.withColumn("k", tx.sorted_words(F.col(end))).join(sorted_, "k", "left").drop("k")
        out = keyed.withColumn(end, F.coalesce("to", "to2")).drop("to", "to2").where(F.col(end).isNotNull())
    return out.where("src <> dst")


def unify(evidence: DataFrame) -> DataFrame:
    """(node, into): nodes of one unification key go into the one of the highest degree, ties by name; names without letters and digits stay."""
    d = graph.degrees(evidence.select("src", "dst").distinct()).withColumn("key", tx.unification_key(F.col("node")))
    w = W.partitionBy("key").orderBy(F.desc("degree"), "node")
    return d.where("key <> ''").withColumn("into", F.first("node").over(w)).where("node <> into").select("node", "into")


def consolidate(evidence: DataFrame) -> DataFrame:
    """(node, into): single-word nodes go into the longer node that holds them as a word, the smallest by name of several."""
    partial = graph.partial_names(graph.ends(evidence.select("src", "dst").distinct()).select("node").distinct(), "node")
    return partial.groupBy(F.col("partial").alias("node")).agg(F.min("full_name").alias("into"))


def move(evidence: DataFrame, mapping: DataFrame) -> DataFrame:
    """Evidence with its ends replaced by ``mapping`` (node, into), all of its columns kept, self-loops dropped."""
    a, b = mapping.select(F.col("node").alias("src"), F.col("into").alias("_a")), mapping.select(F.col("node").alias("dst"), F.col("into").alias("_b"))
    out = evidence.join(a, "src", "left").join(b, "dst", "left").withColumn("_s", F.coalesce("_a", "src")).withColumn("_d", F.coalesce("_b", "dst")).where("_s <> _d")
    rest = [c for c in evidence.columns if c not in ("src", "dst")]
    return out.select(F.least("_s", "_d").alias("src"), F.greatest("_s", "_d").alias("dst"), *rest)
