"""Near-duplicate records by weighted-Jaccard signatures, banding and verification.

Signatures are those of BagMinHash: every element of a multiset spawns Poisson processes, one for
each dyadic cell of its weight axis, (0, 1], (1, 2], (2, 4], and so on. A point of a process has a
time, a level inside the cell and a signature place; it counts if its level is at most the
element's weight. A place keeps the identity of its earliest point, so two signatures agree at a
place with the probability of the weighted Jaccard similarity. Points are made in order of time and
a process ends at the latest of the places' times, so an element costs few points however long the
signature is.

Rows with a null text or fewer than the least number of words take part in no pair. Equal multisets
are one class: only its representative (the smallest id) is banded, and members join its pairs at
the end. Candidates are verified on 32-bit hashes of the distinct word runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.linear import Hasher
from weftgraph.runtime import cut, load, ship, spread

#: Words of a run, least words of a text, least share of common runs.
RUN, LEAST_WORDS, SIMILARITY = 3, 50, 0.6
#: Rows of a band and number of bands. A pair of similarity s is a candidate with probability 1 - (1 - s^rows)^bands.
BAND_ROWS, BANDS = 5, 48

#: Standard errors, about 0.4 each, by which a pair's differing bits may exceed the expectation at the least similarity.
SLACK = 1.7

_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the one of SplitMix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def runs(texts: list[str | None], hasher: Hasher, run: int = RUN, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word runs, the row of each, and a mask of the rows with enough words."""
    words = [_WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((hasher[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    flat = mix(flat)
    h = flat.copy()
    for k in range(1, run):
        h[: len(h) - k] = mix(h[: len(h) - k] * _U(0x100000001B3) ^ flat[k:])
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    whole = np.arange(len(flat)) + run <= ends[owner]
    enough = sizes >= max(least, run)
    keep = whole & enough[owner]
    return h[keep], owner[keep], enough


def bag_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n by m) of n multisets given as (element, weight, owner) triples; the owners ascend."""
    best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)  # the time as the upper 32 bits, the point's name as the lower
    latest = np.full(n, np.inf, np.float32)
    cells = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    for cell in range(int(cells.max(initial=-1)) + 1):
        low, width = (0.0, 1.0) if cell == 0 else (2.0 ** (cell - 1), 2.0 ** (cell - 1))
        own = np.flatnonzero(weights > low)
        seed, who, top = mix(elements[own] ^ mix(np.full(1, cell, np.uint64))), owner[own], weights[own]
        partly = top < low + width
        clock = np.zeros(len(own), np.float32)
        while len(seed):
            seed = mix(seed)
            draw = ((seed >> _U(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
            clock = clock - np.log(draw) / np.float32(width)
            live = np.flatnonzero(clock < latest[who])
            if len(live) < len(seed):
                seed, who, clock = seed[live], who[live], clock[live]
                top, partly = top[live], partly[live]
            place = (((seed & _U(0xFFFFFFFF)) * _U(m)) >> _U(32)).astype(np.int64)
            point = (clock.view(np.uint32).astype(np.uint64) << _U(32)) | ((seed * _U(0xD6E8FEB86659FD93)) >> _U(32))
            slot = who * m + place
            if partly.any():
                level = low + width * (mix(seed) >> _U(11)).astype(np.float64) * 2.0**-53
                counted = ~partly | (level <= top)
                slot, point = slot[counted], point[counted]
            np.minimum.at(best, slot, point)
            latest = (best.reshape(n, m).max(axis=1) >> _U(32)).astype(np.uint32).view(np.float32)
            latest = np.where(np.isnan(latest), np.float32(np.inf), latest)
    return (best & _U(0xFFFFFFFF)).reshape(n, m)


def signatures(texts: list[str | None], hasher: Hasher, m: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """For the rows with enough words: their indexes, fingerprints of their multisets, sorted distinct runs, and signatures."""
    h, owner, enough = runs(texts, hasher)
    rows = np.flatnonzero(enough)
    rank = np.cumsum(enough) - 1
    owner = rank[owner]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(first)
    elements, who = h[starts], owner[starts]
    weights = np.diff(np.append(starts, len(h))).astype(np.float64)
    sizes = np.bincount(who, minlength=len(rows))
    names = bag_minhash(elements, weights, who, len(rows), m)
    prints = np.zeros(len(rows), np.uint64)
    np.add.at(prints, who, mix(elements * _U(3) + weights.astype(np.uint64)))
    return rows, prints, np.split(elements, np.cumsum(sizes)[:-1]) if len(rows) else [], names


def band_keys(names: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; bands have different keys."""
    parts = names[:, : rows * bands].reshape(len(names), bands, rows)
    keys = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), (len(names), bands)).copy()
    for k in range(rows):
        keys = mix(keys * _U(31) ^ parts[:, :, k])
    return keys.view(np.int64)


def bit_signature(names: np.ndarray) -> np.ndarray:
    """One bit of every place, as 64-bit words; unequal places agree in half of all cases."""
    bits = (mix(names) & _U(1)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(bits, axis=1).view(np.int64)


def _sketch(rows: int, bands: int):
    schema = pa.schema([("item_id", pa.int64()), ("print", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("runs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                index, prints, elements, names = signatures(batch.column(1).to_pylist(), hasher, rows * bands)
                if not len(index):
                    continue
                keys = band_keys(names, rows, bands)
                sets = [np.unique(e.astype(np.uint32)).view(np.int32) for e in elements]
                sizes = np.fromiter(map(len, sets), np.int32, len(sets))
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), np.concatenate(sets))
                groups = pa.ListArray.from_arrays(np.arange(len(index) + 1, dtype=np.int32) * bands, keys.reshape(-1))
                packed = bit_signature(names)
                bits = pa.ListArray.from_arrays(np.arange(len(index) + 1, dtype=np.int32) * packed.shape[1], packed.reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(prints.view(np.int64)), groups, bits, lists], schema=schema)

    return run


def sketches(df: DataFrame, key: str, text: str, rows: int = BAND_ROWS, bands: int = BANDS) -> DataFrame:
    """Fingerprint, band keys and distinct runs of every row with enough words, written once."""
    ship(df.sparkSession)
    source = spread(df.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()))
    return cut(source.mapInArrow(_sketch(rows, bands), "item_id bigint, print bigint, bands array<bigint>, bits array<bigint>, runs array<int>"))


def classes(sketch: DataFrame) -> DataFrame:
    """item_id and rep, the smallest id with an equal multiset. The minimum combines before the shuffle, so a huge class is no huge group."""
    reps = sketch.groupBy("print").agg(F.min("item_id").alias("rep"), F.count("*").alias("members"))
    return sketch.select("item_id", "print").join(reps, "print").select("item_id", "rep", "members")


def similar_reps(sketch: DataFrame, members: DataFrame, similarity: float = SIMILARITY, places: int = BAND_ROWS * BANDS) -> DataFrame:
    """Verified pairs (rep_a, rep_b, similarity) of class representatives, rep_a < rep_b.

    Candidates whose bit signatures are far from the similarity leave before the runs are joined.
    """
    reps = sketch.join(members.where("item_id = rep").select("item_id"), "item_id", "left_semi")
    keyed = reps.select("item_id", F.explode("bands").alias("band"))
    a, b = keyed.select("band", F.col("item_id").alias("rep_a")), keyed.select("band", F.col("item_id").alias("rep_b"))
    pairs = a.join(b, "band").where("rep_a < rep_b").select("rep_a", "rep_b").distinct()
    bits = sketch.select("item_id", "bits")
    seen = pairs.join(bits.select(F.col("item_id").alias("rep_a"), F.col("bits").alias("bits_a")), "rep_a").join(
        bits.select(F.col("item_id").alias("rep_b"), F.col("bits").alias("bits_b")), "rep_b"
    )
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = cut(seen.where(differ <= places * (0.5 * (1 - similarity) + SLACK / places**0.5)).select("rep_a", "rep_b"))
    # most texts have no candidate: only the others' runs are written and moved to their pairs
    paired = likely.select(F.explode(F.array("rep_a", "rep_b")).alias("item_id")).distinct()
    runs = cut(sketch.select("item_id", "runs").join(paired, "item_id", "left_semi"))
    both = likely.join(runs.select(F.col("item_id").alias("rep_a"), F.col("runs").alias("runs_a")), "rep_a").join(
        runs.select(F.col("item_id").alias("rep_b"), F.col("runs").alias("runs_b")), "rep_b"
    )
    common = F.size(F.array_intersect("runs_a", "runs_b"))
    shared = both.select("rep_a", "rep_b", common.alias("common"), (F.size("runs_a") + F.size("runs_b")).alias("total"))
    ratio = F.col("common") / (F.col("total") - F.col("common"))
    return shared.select("rep_a", "rep_b", ratio.alias("similarity")).where(F.col("similarity") >= similarity)


def near_duplicates(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Verified pairs of representatives, and every row's representative."""
    sketch = sketches(df, key, text)
    members = cut(classes(sketch))
    return similar_reps(sketch, members), members


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rows of content_item of which at least 60 % of the distinct three-word runs are common."""
    pairs, members = near_duplicates(load(spark, sf_dir, "content_item", "item_id", "raw_content"), "item_id", "raw_content")
    own = members.where("item_id = rep and members > 1").select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
    links = pairs.select("rep_a", "rep_b").unionByName(own)
    left = members.select(F.col("rep").alias("rep_a"), F.col("item_id").alias("x"))
    right = members.select(F.col("rep").alias("rep_b"), F.col("item_id").alias("y"))
    return (
        links.join(left, "rep_a")
        .join(right, "rep_b")
        .where((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y")))
        .select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    )


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for every text with enough words: its class of equal texts (the smallest id), the class' size, and its number of links to other rows."""
    pairs, members = near_duplicates(load(spark, sf_dir, "content_item", "item_id", "raw_content"), "item_id", "raw_content")
    sizes = members.where("item_id = rep").select("rep", "members")
    both = pairs.select(F.col("rep_a").alias("rep"), F.col("rep_b").alias("other")).unionByName(pairs.select(F.col("rep_b").alias("rep"), F.col("rep_a").alias("other")))
    links = both.join(sizes.select(F.col("rep").alias("other"), "members"), "other").groupBy("rep").agg(F.sum("members").alias("others"), F.count("*").alias("n_classes"))
    out = members.join(links, "rep", "left")
    return out.select("item_id", "rep", "members", F.coalesce("n_classes", F.lit(0)).alias("n_near_classes"), (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
