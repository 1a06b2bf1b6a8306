"""One mixture of several sources with target shares of all tokens.

The mixture is the largest whose shares equal the weights of the sources that have tokens: its size
is the least supply per weight, where a source supplies its tokens times its allowed repeats; a given
total takes its place, and a source whose supply it exceeds then gives all it may. Within a source,
entropy balancing finds the document rates r = exp(a + b z) of least divergence from equal rates, z
being the document's tokens relative to the source's mean, no rate above the repeats. Two
constraints bind: the source's tokens, and its documents, which are to have the mean length of all
listed documents, so that a text's length does not tell its source; where the supply cannot give that
length, the nearest that it can give with room to spare. Newton iterations with backtracking solve
the convex dual; every iteration is one aggregation of the distributed histogram of token counts.

Rates become copies by one expression a row: the whole part, and one more where a hash of the
document is below the rest plus a shift of the source's. The shift is found by narrowing a range in
aggregations, so that the tokens taken meet the target within one document, and a few documents that
still fit close the gap.

Null repeats count as 1. Null, zero and negative weights, and sources without tokens, take no part
but are reported. Null and empty texts have no tokens and are never copied. Sources that are not
listed take no part. A source listed twice counts with its largest weight and repeats. A document
listed twice counts as two documents with equal copies.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.llm.tokens import RANKS, count_column
from weftgraph.runtime import cut, load

#: Newton iterations at most, and relative tolerance of the constraints.
ITERATIONS, TOLERANCE = 60, 1e-8
#: Share of the way to the shortest or longest possible documents that the length constraint may go.
ROOM = 0.9
#: Parts that a range of shifts is narrowed to in one pass, and passes.
PARTS, PASSES = 256, 4
#: Documents of a source, at most, that close what the shift leaves missing.
CLOSING = 6


@dataclass(frozen=True)
class Source:
    """A source's supply, its targets, and the solution of its dual."""

    tokens: float
    documents: float
    cap: int
    want_tokens: float = 0.0
    want_documents: float = 0.0
    a: float = 0.0
    b: float = 0.0
    shift: float = 0.0
    missing: float = 0.0

    @property
    def mean(self) -> float:
        return self.tokens / self.documents


def targets(spark: SparkSession, sf_dir: str) -> dict[str, tuple[float, int]]:
    """source -> (weight, repeats); the table is a short list of settings."""
    rows = load(spark, sf_dir, "mix_target").where("source is not null").groupBy("source").agg(F.max("weight").alias("w"), F.max("max_repeats").alias("r")).collect()
    return {x["source"]: (max(0.0, x["w"] or 0.0), max(0, 1 if x["r"] is None else x["r"])) for x in rows}


def counted(documents: DataFrame, sources: list[str], ranks_path: str = RANKS) -> DataFrame:
    """doc_id, source and n_tokens of the documents of the sources, written once."""
    own = documents.where(F.col("source").isin(sources)) if sources else documents.limit(0)
    return cut(count_column(own, "text", ["doc_id", "source"], ranks_path=ranks_path).where("n_tokens > 0"))


def histogram(tokens: DataFrame) -> DataFrame:
    return cut(tokens.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))


def _of(sources: dict[str, Source], value) -> Column:
    """A number of the row's source; null for other sources."""
    pairs = [F.lit(x) for s, v in sources.items() for x in (s, float(value(v)))]
    return F.try_element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None).cast("double")


def _rate(sources: dict[str, Source]) -> Column:
    z = F.col("n_tokens") / _of(sources, lambda v: v.mean) - 1
    return F.least(F.exp(_of(sources, lambda v: v.a) + _of(sources, lambda v: v.b) * z), _of(sources, lambda v: v.cap))


def length_bounds(hist: DataFrame, sources: dict[str, Source]) -> dict[str, tuple[float, float]]:
    """(fewest, most) documents that give a source's tokens: longest or shortest first, each up to its cap."""
    # a histogram has a row per source and length, so the windows see lengths, not documents
    supply = (F.col("n") * F.col("n_tokens")).cast("double") * _of(sources, lambda v: v.cap)
    cells = hist.where(_of(sources, lambda v: v.cap).isNotNull()).withColumn("supply", supply)
    out: dict[str, list[float]] = {}
    for order in (F.desc("n_tokens"), F.asc("n_tokens")):


        before = F.coalesce(F.sum("supply").over(W.partitionBy("source").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        left = F.greatest(F.lit(0.0), _of(sources, lambda v: v.want_tokens) - before)
        used = cells.withColumn("used", F.least(F.col("supply"), left)).groupBy("source").agg(F.sum(F.col("used") / F.col("n_tokens")).alias("d"))
        for x in used.collect():
            out.setdefault(x["source"], []).append(x["d"])
    return {s: (v[0], v[1]) for s, v in out.items()}


def balance(hist: DataFrame, sources: dict[str, Source]) -> tuple[dict[str, Source], dict]:
    """The sources with their dual's solution (a, b), and a report of iterations and the largest relative gap left.

    Every source has its own dual, f(a, b) = sum of n g(a + b z) - a D - b (T / mean - D), where g is the
    integral of min(cap, exp); all are stepped together, each with its own backtracking.
    """
    done = {s: replace(v, a=0.0, b=0.0) for s, v in sources.items() if v.want_tokens > 0}
    # an exact start where the source gives all it may: the optimum lies at infinity
    full = {s: replace(v, a=60.0) for s, v in done.items() if v.want_tokens >= (1 - 1e-9) * v.tokens * v.cap}
    now = {s: v for s, v in done.items() if s not in full}
    trial, best, step = dict(now), {}, {}
    gap, rounds, moved = 0.0, 0, 0
    while trial and rounds < ITERATIONS:
        rounds += 1
        mean, a, b, cap = (_of(trial, f) for f in (lambda v: v.mean, lambda v: v.a, lambda v: v.b, lambda v: v.cap))
        z = F.col("n_tokens") / mean - 1
        x, top = a + b * z, F.log(cap)
        rate = F.col("n") * F.exp(F.least(x, top))
        free = F.when(x < top, rate).otherwise(0.0)
        value = rate + F.when(x > top, F.col("n") * cap * (x - top)).otherwise(0.0)
        sums = hist.where(mean.isNotNull()).groupBy("source").agg(
            F.sum(value).alias("f"), F.sum(rate).alias("s0"), F.sum(rate * z).alias("s1"), F.sum(free).alias("h00"), F.sum(free * z).alias("h01"), F.sum(free * z * z).alias("h11")
        )
        fresh: dict[str, Source] = {}
        gap = 0.0
        for r in sums.collect():
            s = r["source"]
            v = trial[s]
            goal = v.want_tokens / v.mean - v.want_documents
            f = r["f"] - v.a * v.want_documents - v.b * goal
            g0, g1 = r["s0"] - v.want_documents, r["s1"] - goal
            off = max(abs(g0) / v.want_documents, abs(g0 + g1) / (v.want_tokens / v.mean))
            if s in best and f > best[s][1] + 1e-12 * abs(best[s][1]) and off > TOLERANCE:
                step[s] = tuple(0.5 * d for d in step[s])  # too far: half the step from the best point
                at = best[s][0]
            else:
                best[s] = (v, f)
                if off <= TOLERANCE:
                    done[s] = v
                    continue
                ridge = 1e-12 * (r["h00"] + r["h11"]) + 1e-12
                h00, h11 = r["h00"] + ridge, r["h11"] + ridge
                det = h00 * h11 - r["h01"] ** 2
                if det <= 1e-12 * h00 * h11:  # one length only: the token constraint alone
                    da, db = -(g0 + g1) / h00, 0.0
                    if abs(da) <= TOLERANCE:
                        done[s] = v
                        continue
                else:
                    da, db = -(h11 * g0 - r["h01"] * g1) / det, -(h00 * g1 - r["h01"] * g0) / det
                shrink = min(1.0, 3.0 / max(abs(da), abs(db), 1e-12))
                step[s], at = (shrink * da, shrink * db), v
                moved += 1
            gap = max(gap, off)
            fresh[s] = replace(at, a=at.a + step[s][0], b=at.b + step[s][1])
            done[s] = fresh[s]
        trial = fresh
    if trial:
        raise RuntimeError(f"entropy balancing did not converge in {ITERATIONS} iterations: relative gap {gap:.2e}")
    return {**done, **full}, {"iterations": rounds, "newton_steps": moved, "gap": gap, "full": len(full)}


def _score() -> Column:
    """A document's place in (0, 1), by a hash of its id."""
    return (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)


def _parts(sources: dict[str, Source]) -> tuple[Column, Column]:
    """Whole copies of a document, and the shift above which it gets no further one."""
    rate = _rate(sources)
    whole = F.floor(rate + 1e-9)
    return whole, F.when(whole < _of(sources, lambda v: v.cap), _score() - (rate - whole)).otherwise(F.lit(9.0))


def rounded(tokens: DataFrame, sources: dict[str, Source]) -> dict[str, Source]:
    """The sources with the shifts at which their copies meet the wanted tokens, and what is missing then."""
    whole, over = _parts(sources)
    scored = tokens.where(_of(sources, lambda v: v.cap).isNotNull()).select("source", "n_tokens", whole.alias("whole"), over.alias("over"))
    base = {r["source"]: float(r["t"]) for r in scored.groupBy("source").agg(F.sum(F.col("whole") * F.col("n_tokens")).alias("t")).collect()}
    low, width = {s: -1.0 for s in sources}, 2.0
    below = dict(base)
    for _ in range(PASSES):
        pairs = [F.lit(x) for s, v in low.items() for x in (s, v)]
        if not pairs:
            break
        part = F.floor((F.col("over") - F.try_element_at(F.create_map(*pairs), F.col("source"))) / (width / PARTS))
        bins = scored.withColumn("part", part).where((F.col("part") >= 0) & (F.col("part") < PARTS)).groupBy("source", "part").agg(F.sum("n_tokens").alias("t"))
        held: dict[str, dict[int, float]] = {}
        for r in bins.collect():  # at most PARTS for each source of the settings
            held.setdefault(r["source"], {})[int(r["part"])] = float(r["t"])
        for s, v in sources.items():
            for k in range(PARTS):
                t = held.get(s, {}).get(k, 0.0)
                if below.get(s, 0.0) + t > v.want_tokens * (1 + 1e-12) or k == PARTS - 1:
                    low[s] += k * width / PARTS
                    break
                below[s] = below.get(s, 0.0) + t
        width /= PARTS
    return {s: replace(v, shift=low[s], missing=max(0.0, v.want_tokens - below.get(s, 0.0))) for s, v in sources.items()}


def mixture(documents: DataFrame, wanted: dict[str, tuple[float, int]], total_tokens: float | None = None, ranks_path: str = RANKS) -> tuple[DataFrame, dict]:
    """doc_id, source, n_tokens and copies (0 for documents left out) of the documents of the listed sources, and the report of the balancing."""
    used = {s: v for s, v in wanted.items() if v[0] > 0 and v[1] > 0}
    tokens = counted(documents, sorted(used), ranks_path)
    hist = histogram(tokens)
    supply = {x["source"]: Source(float(x["t"]), float(x["d"]), used[x["source"]][1]) for x in hist.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("d")).collect()}
    weight = sum(used[s][0] for s in supply) or 1.0
    largest = min((v.tokens * v.cap * weight / used[s][0] for s, v in supply.items()), default=0.0)
    size = largest if total_tokens is None else total_tokens
    supply = {s: replace(v, want_tokens=min(size * used[s][0] / weight, v.tokens * v.cap)) for s, v in supply.items()}
    mean = sum(v.tokens for v in supply.values()) / max(1.0, sum(v.documents for v in supply.values()))
    for s, (fewest, most) in length_bounds(hist, supply).items():
        v = supply[s]
        own = v.want_tokens / v.mean
        wish = min(max(v.want_tokens / max(mean, 1e-9), own - ROOM * (own - fewest)), own + ROOM * (most - own))
        supply[s] = replace(v, want_documents=wish)
    solved, report = balance(hist, supply)
    solved = rounded(tokens, solved)
    whole, over = _parts(solved)
    shift = _of(solved, lambda v: v.shift)
    closing: list[tuple[str, object]] = []
    gaps = {k: v.missing for k, v in solved.items()}
    rest = tokens.withColumn("over", over).where((F.col("over") >= shift) & (F.col("over") < 9.0))
    for _ in range(CLOSING):
        open_ = {k: replace(solved[k], missing=g) for k, g in gaps.items() if g >= 1}
        if not open_:
            break
        fits = rest.where(F.col("n_tokens") <= _of(open_, lambda v: v.missing))
        if closing:
            fits = fits.where(~F.col("doc_id").isin([k for _, k in closing]))
        found = fits.groupBy("source").agg(F.max(F.struct("n_tokens", "doc_id")).alias("top")).collect()
        gaps = {r["source"]: gaps[r["source"]] - r["top"]["n_tokens"] for r in found}
        closing += [(r["source"], r["top"]["doc_id"]) for r in found]
    chosen = F.struct("source", "doc_id").isin([F.struct(F.lit(k).alias("source"), F.lit(i).alias("doc_id")) for k, i in closing]) if closing else F.lit(False)
    copies = whole + F.coalesce((over < shift) | chosen, F.lit(False)).cast("int")
    taken = tokens.select("doc_id", "source", "n_tokens", F.coalesce(copies, F.lit(0)).cast("int").alias("copies"))
    return taken, report | {"sources": solved}


def shares(taken: DataFrame, wanted: dict[str, tuple[float, int]], sources: dict[str, Source]) -> list[tuple]:
    """One row for every listed source: weight, wanted share, repeats, documents, tokens, copies, tokens taken, most repeats, share reached, tilt and mean length taken."""
    by = {
        r["source"]: r
        for r in taken.groupBy("source")
        .agg(F.count("*").alias("d"), F.sum("n_tokens").alias("t"), F.sum("copies").alias("c"), F.sum(F.col("copies") * F.col("n_tokens")).alias("ct"), F.max("copies").alias("m"))
        .collect()
    }
    total, all_taken = sum(w for w, _ in wanted.values()) or 1.0, sum(r["ct"] or 0 for r in by.values()) or 1
    out = []
    for s, (w, repeats) in sorted(wanted.items()):
        r = by.get(s)
        d, t, c, ct, m = (int(r[k] or 0) for k in ("d", "t", "c", "ct", "m")) if r else (0,) * 5
        tilt = sources[s].b if s in sources else 0.0
        out.append((s, w, w / total, repeats, d, t, c, ct, m, ct / all_taken, tilt, ct / c if c else None))
    return out


SHARES = "source string, weight double, wanted_share double, max_repeats int, n_docs bigint, tokens_available bigint, n_copies bigint, tokens_taken bigint, most_repeats bigint, share_reached double, tilt double, mean_length double"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wanted = targets(spark, sf_dir)
    taken, report = mixture(load(spark, sf_dir, "documents", "doc_id", "source", "text"), wanted)
    return taken, spark.createDataFrame(shares(taken, wanted, report["sources"]), SHARES)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every source of mix_target the wanted share, the tokens taken and the share reached."""
    return _both(spark, sf_dir)[1]


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture with its report: every document that stands in it, its copies, and its source's wanted share, tokens taken and share reached."""
    taken, report = _both(spark, sf_dir)
    few = F.broadcast(report.select("source", "wanted_share", "tokens_taken", "share_reached"))  # a row for each setting
    return taken.where("copies > 0").join(few, "source").select("doc_id", "source", "n_tokens", "copies", "wanted_share", "tokens_taken", "share_reached")
