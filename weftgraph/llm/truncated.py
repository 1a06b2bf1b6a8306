"""Texts cut off by field limits or in transfer.

For every source the lengths of its texts, in code points and in bytes, are fitted by maximum
likelihood with a log-normal distribution in which the texts at a candidate limit are
right-censored. The excess of texts at the limit over the fitted density gives the posterior that a
text of that length was censored. The posterior is combined, in log-odds, with the evidence of the
text's ending: marks of a cut, broken markup, an open bracket or comma, a last word that the corpus
does not know or that does not end sentences there, against closed sentences and closing lines
(signatures, places and years, contacts, page numbers, ornaments).

Null and blank texts are never cases, and count as whole in the shares. A null source is a source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.runtime import cut, load, ship, spread

#: Log-odds of endings (a closed one outweighs any limit, since a cut within a sentence leaves none), and the prior log-odds of a cut in transfer.
EVIDENCE = {"mark": 9.0, "open": 4.5, "neutral": -1.5, "closed": -9.0}
PRIOR = -2.9
#: Texts at a limit, at least, and how far they must exceed the fitted density.
LEAST_AT_LIMIT, EXCESS = 5, 6.0
#: A last word ends sentences if at least this share of its occurrences do.
ENDS = 0.02

#: Marks that readers and feeds add at a cut.
_MARK = re.compile(r"\s*(?:\[\+\d+ \w+\]|\[(?:…|\.\.\.)\]|(?:…|\.\.\.)?\s*\((?:more|continued|cont\.|mehr|suite|más|altro|mai mult|ещё)\)|\[(?:truncated|cut|more)\]|(?:…|\.\.\.)\s*(?:Read more|Continue reading)\W*)\s*$", re.I)
_WEAK = re.compile(r"\s*(?:…|\.\.\.)\s*$")
_BROKEN = re.compile(r"(?:&#?\w{0,6}|<[^<>\s][^<>]{0,40}|�|­|[,:;(\[/&@]|\w-)$")
_SUFFIX = re.compile(r"(?:\b(?:S\.A|S\.R\.L|B\.V|S\.p\.A|Inc|Ltd|Co|Dr|Mr|Mrs|St|No|nr|[A-ZÀ-ÞА-Я])|:\s\d+)\.$")
_PAGE = re.compile(r"^\W*(?:(?:page|p|pag|seite|стр)\W{0,2})?\s*\d+\W*(?:(?:of|von|de|sur|di|din|из|/)\s*\d+)?\W*$", re.I)
_CLOSING = re.compile(
    r"^(?:[—–-]\s.*|[*·•~_=\-\s]+|[Tt][Ee][Ll]\W.*|\(.*\)|https?://\S+|[\w.+-]+@[\w.-]+|.*\|.*|(?:1[89]|20)\d\d\s?[–-]\s?(?:1[89]|20)\d\d|[^.!?]{2,40},\s(?:1[89]|20)\d\d|[A-ZÀ-ÞȘȚĂÂÎА-Я][\w.'’-]*(?:\s[A-ZÀ-ÞȘȚĂÂÎА-Я][\w.'’-]*){1,3},\s[A-ZÀ-ÞȘȚĂÂÎА-Я][\w'’-]*(?:[\s-][\w'’-]+){0,2})$"
)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_TOKENS = re.compile(r"[^\W\d_]+[.!?…]?")


def ending(text: str) -> tuple[str, str | None, int, int]:
    """Kind of ending (mark, open, closed, or word: to be looked up), the last word, and lengths without a mark in code points and bytes."""
    base = _MARK.sub("", text)
    if base != text:
        return "mark", None, len(base), len(base.encode("utf-8", "replace"))
    size = len(text), len(text.encode("utf-8", "replace"))
    body = text.rstrip()
    weak = _WEAK.search(body)
    if weak:
        body = body[: weak.start()].rstrip()
        size = len(body), len(body.encode("utf-8", "replace"))
    if not body:
        return "closed", None, *size
    line = body[body.rfind("\n") + 1 :].strip()
    if _BROKEN.search(body) and not (_PAGE.match(line) or _CLOSING.match(line)):
        return "open", None, *size
    if _PAGE.match(line):
        return "closed", None, *size
    last = body[-1]
    if not weak:
        if last in "!?。！？»”\"":
            return "closed", None, *size
        if last == "." and not _SUFFIX.search(body):
            return "closed", None, *size
        if _CLOSING.match(line):
            return "closed", None, *size
    sentence = _SENTENCE.split(line)[-1]
    if sentence.count("(") > sentence.count(")"):
        return "open", None, *size
    if last == ")":
        return "open", None, *size  # a bracket closed inside a sentence; a bracketed line of its own has gone above
    words = _TOKENS.findall(line)
    if last.isalpha() and words:
        return "word", words[-1].lower(), *size
    if last.isdigit() or last == "." or last in "'’%°²":
        return "open", None, *size
    return "closed", None, *size  # emoji, ornaments


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "source", "kind", "word", "chars", "bytes", "n", "n_end"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        ids, sources, texts = (batch.column(k).to_pylist() for k in range(3))
        seen: Counter = Counter()
        rows = []
        for i, s, t in zip(ids, sources, texts, strict=True):
            if not t or not t.strip():
                rows.append((i, s, "closed", None, 0, 0, None, None))
                continue
            rows.append((i, s, *ending(t), None, None))
            found = _TOKENS.findall(t.lower())
            if found and t.rstrip()[-1:].isalpha():
                found.pop()  # the text's own last word is no evidence of itself
            seen.update(found)
        count: dict[str, list[int]] = {}
        for token, n in seen.items():
            end = token[-1] in ".!?…"
            pair = count.setdefault(token[:-1] if end else token, [0, 0])
            pair[0] += n
            pair[1] += n * end
        rows += [(None, None, None, w, None, None, n, e) for w, (n, e) in count.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def censored_lognormal(values: np.ndarray, counts: np.ndarray, limit: float, at: float) -> tuple[float, float]:
    """Location and scale of log-lengths by expectation-maximisation; ``at`` texts are known to be at least ``limit`` long."""
    x, c = np.log(values), counts.astype(float)
    total = c.sum() + at
    mu, sigma = float(np.average(x, weights=c)), float(np.sqrt(np.average((x - np.average(x, weights=c)) ** 2, weights=c)) + 1e-3)
    for _ in range(60):
        z = (np.log(limit) - mu) / sigma
        tail = 0.5 * _erfc(z / np.sqrt(2))
        hazard = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) / max(tail, 1e-12)
        m1 = mu + sigma * hazard
        m2 = mu * mu + sigma * sigma + sigma * (np.log(limit) + mu) * hazard
        mu_new = ((c * x).sum() + at * m1) / total
        sigma = float(np.sqrt(max(((c * x * x).sum() + at * m2) / total - mu_new**2, 1e-4)))
        mu = float(mu_new)
    return mu, sigma


def _erfc(x: float) -> float:
    from math import erfc

    return erfc(x)


def limits_of(lengths: np.ndarray, counts: np.ndarray, slack: int) -> list[tuple[int, float]]:
    """(limit, posterior) of the candidate limits of one source; texts up to ``slack`` below a limit belong to it."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    keep = lengths > 0
    lengths, counts = lengths[keep], counts[keep]
    out = []
    total = counts.sum()
    for c, n in zip(lengths, counts, strict=True):
        if n < LEAST_AT_LIMIT:
            continue
        own = (lengths <= c) & (lengths >= c - slack)
        near = (np.abs(lengths - c) <= 60) & ~((lengths <= c + 3) & (lengths >= c - 3))
        if counts[own].sum() < EXCESS * max(counts[near].sum() / 114 * (slack + 1), 0.3):
            continue
        rest = ~own
        if counts[rest].sum() < 3:
            out.append((int(c), 0.95))
            continue
        mu, sigma = censored_lognormal(lengths[rest], counts[rest], float(c), float(counts[own].sum()))
        density = np.exp(-((np.log(c) - mu) ** 2) / (2 * sigma**2)) / (c * sigma * np.sqrt(2 * np.pi))
        share = 1 - min(1.0, total * density * (slack + 1) / counts[own].sum())
        if share > 0.5:
            out.append((int(c), float(min(share, 0.999))))
    return out


def _fit(key: tuple, hist: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for measure, slack in (("chars", 0), ("bytes", 3)):
        h = hist[hist.measure == measure]
        for c, p in limits_of(h.length.to_numpy(), h.n.to_numpy(), slack):
            rows += [(key[0], measure, c - d, p if measure == "chars" or d == 0 else p * 0.8) for d in range(slack + 1)]
    return pd.DataFrame(rows, columns=["source", "measure", "length", "posterior"])


def judged(df: DataFrame) -> DataFrame:
    """doc_id, source and log-odds that the text was cut, of every row."""
    ship(df.sparkSession)
    scanned = cut(
        spread(df.select(F.col("doc_id").cast("bigint"), "source", "text")).mapInArrow(
            _scan, "doc_id bigint, source string, kind string, word string, chars bigint, bytes bigint, n bigint, n_end bigint"
        )
    )
    docs = scanned.where("kind is not null").select("doc_id", "source", "kind", "word", "chars", "bytes")
    words = scanned.where("kind is null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))
    hist = docs.select("source", F.expr("stack(2, 'chars', chars, 'bytes', bytes) as (measure, length)")).groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    fitted = hist.groupBy("source").applyInPandas(_fit, "source string, measure string, length bigint, posterior double")

    def at(measure: str) -> DataFrame:
        return (
            fitted.where(F.col("measure") == measure)
            .groupBy(F.col("source").alias("s"), F.col("length").alias("l"))
            .agg(F.max("posterior").alias(f"at_{measure}"))
        )

    with_limits = docs.join(at("chars"), docs.source.eqNullSafe(F.col("s")) & (docs.chars == F.col("l")), "left").drop("s", "l")
    with_limits = with_limits.join(at("bytes"), with_limits.source.eqNullSafe(F.col("s")) & (with_limits.bytes == F.col("l")), "left").drop("s", "l")
    # most texts end in no bare word: their null keys are spread, since they meet nothing
    key = F.coalesce("word", F.concat(F.lit("\u0000"), F.col("doc_id").cast("string")))
    known = with_limits.withColumn("key", key).join(words.where("word is not null").withColumnRenamed("word", "key"), "key", "left")
    open_word = (F.length("word") == 1) | F.col("n").isNull() | (F.col("n") <= 1) | (F.col("n_end") < ENDS * F.col("n"))
    kind = F.when(F.col("kind") == "word", F.when(open_word, "open").otherwise("neutral")).otherwise(F.col("kind"))
    table = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])
    p = F.greatest("at_chars", "at_bytes")
    prior = F.when(p.isNotNull(), F.greatest(F.log(p / (1 - p)), F.lit(PRIOR))).otherwise(PRIOR)
    return known.select("doc_id", "source", (prior + table[kind]).alias("log_odds"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return judged(load(spark, sf_dir, "documents", "doc_id", "source", "text")).where("log_odds > 0").select("doc_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many and what share of every source's documents are cut."""
    found = judged(load(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return found.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("log_odds") > 0).alias("n_cut"), F.avg((F.col("log_odds") > 0).cast("double")).alias("share_cut")
    )
