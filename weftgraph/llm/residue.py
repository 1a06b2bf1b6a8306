"""Records that hold template residue, filler, error messages or script notices instead of content.

A record is read as instances: every sentence with a placeholder form, the address if it shows one,
and the whole content. A regularized linear classifier scores each instance by its hashed word
n-grams (placeholders reduced to the name of their form), its length, its title and the address'
path; the record takes the highest probability. No rule decides a record: status lines and set
phrases only make the weak labels of a bounded fitting sample, the labels' noise is cut by dropping
unlabelled rows that folds of other hosts find alike to the labelled ones, and whole hosts are held
out for Platt calibration and for the threshold.

Null and blank contents are never cases by their content; a null address has no address features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import linear
from weftgraph.runtime import host, load, ship, spread

#: Rows that the classifier is fitted on, about, and at most twice as many; code points below which a record is short and sampled more often.
SAMPLE_ROWS, SHORT = 8000, 800
#: Share of hosts held out, host folds of the label cleaning, and the probability at which an unlabelled instance leaves the fit.
HELD_OUT, FOLDS, DOUBTFUL = 0.25, 2, 0.3
#: Labelled instances without which labels are not cleaned.
LEAST_LABELS = 20

#: Forms of placeholders of common template languages, by name.
FORMS = {
    "braces": r"\{\{\{?\s*[\w.]+\s*\}?\}\}",
    "percent": r"<%=?\s*[\w.]+\s*%>",
    "php": r"<\?(?:php)?[^?<>]{0,60}\?>",
    "dollar": r"[$#@]\{[\w.]+\}",
    "square": r"\[\[\s*[A-Za-z][\w.]*\s*\]\]",
    "named": r"%\([\w.]+\)[sdif]",
    "format": r"%s\b|%d\b",
    "merge": r"\*\|[\w.]+\|\*",
    "dunder": r"\b__[A-Z][A-Z_]+__\b",
    "crosses": r"\bX{3,}-[A-Z_]+-X{3,}\b",
    "quoted": r"«[A-Z][A-Z_]{2,}»",
    "todo": r"\b(?:TODO|FIXME|TBD)\b\s*:",
    "ask": r"\[[^\[\]\n]{0,30}\b[A-Z]{3,}(?:_[A-Z]+)*\b[^\[\]\n]{0,20}\]",
    "angle": r"<[A-Z][A-Z_]{2,}>",
    "doubled": r"%%[A-Z_]+%%",
    "block": r"\{%[^%{}\n]{1,60}%\}",
    "number": r"\{\d{1,2}\}",
    "object": r"\[object\s\w+\]",
    "nothing": r"\b(?:undefined undefined|null null|NaN NaN|None None)\b|\b(?:[Bb]y|[Dd]ear|[Tt]ags:|[Pp]osted on|©)\s+(?:undefined|null|NaN|None)\b",
    "brace": r"(?<![{$#@\w])\{[A-Za-z][\w.]*\}(?!\})",
}
_FORM = re.compile("|".join(f"(?P<{k}>{v})" for k, v in FORMS.items()))
EXAMPLES = ["{{name}}", "{{{name}}}", "${name}", "#{name}", "@{name}", "[[name]]", "<%= name %>", "<?php echo $name; ?>", "%(name)s", "%s, %d", "*|NAME|*", "__NAME__", "XXXX-NAME-XXXX", "«NAME»", "TODO: write NAME", "[INSERT NAME HERE]", "<NAME>", "%%NAME%%", "{% block name %}", "{0}", "[object Object]", "undefined undefined", "{name}"]
_HINT = re.compile(r"[{%][{%(sd\w]|%>|\[\[|\[[^\]\n]{0,30}[A-Z]{3}|«[A-Z]{3}|<[%?A-Z]|\*\||__[A-Z]|XXX|TODO|FIXME|TBD|undefined|null|NaN|None|\[object")
#: Pieces of an address that a placeholder or a value never filled in leaves.
_ADDRESS = {
    "braces": r"\{|\}|%7[bBdD]",
    "square": r"\[\w[^\]]*\]|%5[bBdD]",
    "percent": r"%(?:25|20)?[A-Z][A-Z_]+%|(?:%25)[A-Z_]+(?:%25)",
    "angle": r"<[^>]*>|%3[cC].*%3[eE]",
    "nothing": r"(?:(?<=/)|(?<==))(?:undefined|null|NaN|None)(?=[/?#&]|$)|\[object",
}
_SLOT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _ADDRESS.items()))
#: Weak labels. Words of sentences that talk about templates, messages or scripts, status lines, and set phrases of servers, scripts and page builders in our languages. Fixed values.
ABOUT = re.compile(r"\b(?:tutorials?|manuals?|teach(?:es)?|taught|explain(?:s|ed)?|notes? that|heard that|said the|complain(?:s|ed)|reader will|is replaced|stands? for)\b", re.I)
STATUS = re.compile(r"\b(?:HTTP(?:/\d\.\d)?|error|erreur|errore|fehler|eroare|ошибка)\s*:?\s*[45]\d\d\b|^\s*[45]\d\d\s+\w+|\([45]\d\d\)|\bnginx\b|Traceback \(most recent|Fatal error:", re.M | re.I)
PHRASE = re.compile(
    r"page not found|access denied|service (?:temporarily )?unavailable|too many requests|something went wrong|under maintenance|domain is parked|database connection|checking your browser"
    r"|(?:try again|später erneut|réessayer|más tarde|riprovare|reveniți|попробуйте)\W?.{0,30}(?:later|versuchen|plus tard|intentarlo|più tardi|mai târziu|позже)"
    r"|seite (?:wurde )?nicht gefunden|page introuvable|p[áa]gin[aă] (?:no encontrada|non trovata|nu a fost găsită)|страница не найдена"
    r"|(?:enable|requires?|activer|aktivieren sie|active|attivare|activați|включите)\b.{0,20}(?:javascript|scripts)|(?:scripts?|scripting|javascript) (?:is|are) (?:turned off|switched off|disabled|required)|not support scripts"
    r"|lorem ipsum|placeholder (?:copy|text)|your text (?:goes )?here|sample text|blindtext|texte? de remplissage|faux texte|texto de ejemplo|testo segnaposto|text de umplutură|здесь будет ваш текст"
)
#: Words of the usual Latin filler. Fixed values.
LATIN = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum".split())
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
#: Words of a message that a weak label is given to, at most; it bounds labels, not what is found.
LABEL_WORDS = 40
#: Steps of the fit; weight of the calibration's prior.
ROUNDS, PRIOR = 70, 2.0
#: Words around a placeholder that its instance shows.
NEAR = 6


def holders(text: str) -> list[str]:
    """Every sentence with a placeholder's form."""
    if not text or not _HINT.search(text):
        return []
    return [s for s in _SENTENCE.split(text) if _HINT.search(s) and _FORM.search(s)]


def _mark(m: re.Match) -> str:
    return f" placeholder_{m.lastgroup} "


def holder_tokens(sentence: str) -> list[str]:
    """Words around the placeholders of a sentence."""
    tokens = _FORM.sub(_mark, sentence).lower().split()
    near: set[int] = set()
    for i, t in enumerate(tokens):
        if t.startswith("placeholder_"):
            near.update(range(i - NEAR, i + NEAR + 1))
    forms = {t for t in tokens if t.startswith("placeholder_")}
    return ["holder:", *(tokens[i] for i in sorted(near) if 0 <= i < len(tokens)), *(f + "!" for f in sorted(forms)), f"holder:length={len(tokens).bit_length()}"]


def address_tokens(url: str | None) -> list[str] | None:
    """Pieces of an address that shows a placeholder or an unfilled value; None if it shows none."""
    if not url:
        return None
    path = re.sub(r"^\w+://[^/]*", "", url)
    if not _SLOT.search(path):
        return None
    marked = _SLOT.sub(lambda m: f"/slot_{m.lastgroup}/", path)
    return ["address:", *sorted({w for w in re.split(r"[/?&=]+", marked.lower()) if w.startswith("slot_")})]


def body_tokens(text: str, url: str | None) -> list[str]:
    """Words, length, title and path of a whole record."""
    tokens = text.lower().split()
    title = next((x for x in text.split("\n") if x.strip()), "").lower().split()
    path = re.sub(r"^\w+://[^/]*", "", url or "").lower()
    size = f"length={2 * len(tokens).bit_length() + (len(tokens) * 3 >> len(tokens).bit_length() + 1 & 1)}"
    return ["body:", *tokens, size, size + "!", *(f"title:{w}" for w in title), *(f"path:{w}" for w in re.split(r"[/?=&.]+", path)[1:3] if not any(c.isdigit() for c in w))]


def instances(text: str, url: str | None) -> list[tuple[str, list[str], str]]:
    """(kind, tokens, source text) of a record's instances."""
    out = [("holder", holder_tokens(s), s) for s in holders(text)]
    address = address_tokens(url)
    if address:
        out.append(("address", address, url or ""))
    if text.strip():
        out.append(("body", body_tokens(text, url), text))
    return out


def weak_label(kind: str, text: str) -> float:
    """1 for what a status line, a phrase or a placeholder's form marks, else 0."""
    if kind == "address":
        return 1.0
    if kind == "holder":
        return 0.0 if ABOUT.search(text) else 1.0
    words = text.lower().split()
    latin = sum(w.strip(".,;:") in LATIN for w in words)
    if latin >= 8 and latin > 0.5 * len(words):
        return 1.0
    rest = "\n".join(s for s in _SENTENCE.split(text) if not ABOUT.search(s))
    return float(len(words) <= LABEL_WORDS and bool(STATUS.search(rest) or PHRASE.search(rest.lower())))


def _score(x: list[list[str]], hasher: linear.Hasher, w: np.ndarray) -> np.ndarray:
    return linear.score(*linear.ngrams(x, hasher), w) if x else np.zeros(0)


def platt(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate log-odds, by Newton steps on the log-likelihood with smoothed targets and a prior at the identity."""
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = linear.sigmoid(a * z + b)
        h = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((q - t) * z).sum() + PRIOR * (a - 1), (q - t).sum() + PRIOR * b])
        m = np.array([[(h * z * z).sum() + PRIOR, (h * z).sum()], [(h * z).sum(), h.sum() + PRIOR]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 1.0 / abs(step).max())
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(rows: list[tuple[str, str | None, str | None]], hidden: re.Pattern | None = None) -> tuple[np.ndarray, tuple[float, float], float, dict]:
    """Weights, calibration, threshold and report from (text, url, host) rows; whole hosts are held out.

    ``hidden`` hides a part of the phrases from the labels, to measure what the classifier finds beyond them.
    """
    hasher = linear.Hasher()
    x, y, fold, kinds = [], [], [], []
    for text, url, site in rows:
        for kind, tokens, source in instances(text or "", url):
            label = weak_label(kind, source)
            if label and hidden is not None and kind == "body" and hidden.search(source.lower()):
                label = 0.0
            x.append(tokens)
            y.append(label)
            kinds.append(kind)
            fold.append(hasher[f"host:{site}"] % 1000)
    seeds = [holder_tokens(f"{before} {form} {after}") for form in EXAMPLES for before, after in (("dear", ""), ("of the", "and"), ("by", ","), ("", ""))]
    seeds += [["address:", f"slot_{k}"] for k in _ADDRESS for _ in range(3)]
    plain = [["body:"]] * len(seeds)  # what a record without evidence is
    labels, place = np.array(y), np.array(fold, np.int64)
    held = place < 1000 * HELD_OUT
    inside = np.flatnonzero(~held)

    def fit(which: np.ndarray) -> np.ndarray:
        both = np.concatenate([labels[which], np.ones(len(seeds)), np.zeros(len(plain))])
        return linear.fit(*linear.ngrams([x[i] for i in which] + seeds + plain, hasher), both, l2=1e-5, rounds=ROUNDS)

    doubtful = np.zeros(len(x), bool)
    for k in range(FOLDS if labels[inside].sum() >= LEAST_LABELS else 0):
        apart = inside[place[inside] % FOLDS == k]
        p = _score([x[i] for i in apart], hasher, fit(inside[place[inside] % FOLDS != k]))
        doubtful[apart[(labels[apart] == 0) & (p >= DOUBTFUL)]] = True
    w = fit(inside[~doubtful[inside]])
    apart = np.flatnonzero(held)
    p, t = _score([x[i] for i in apart], hasher, w), labels[apart]
    scale = platt(p, t) if len(t) and 0 < t.sum() < len(t) else (1.0, 0.0)
    report = {"rows": len(rows), "instances": len(x), "held_out": int(held.sum()), "left_out": int(doubtful.sum()), "threshold": 0.5, "recall": None, "precision": None}
    if t.sum() >= 5:
        q = calibrated(p, scale)
        grid = np.arange(0.4, 0.81, 0.05)
        quality = [2 * t[q >= g].sum() / max(1.0, t.sum() + (q >= g).sum()) for g in grid]
        report["threshold"] = float(np.median(grid[np.array(quality) >= max(quality) - 1e-12]))  # the middle of the best
        hit = q >= report["threshold"]
        report["recall"], report["precision"] = float(hit[t == 1].mean()), float(t[hit].mean()) if hit.any() else None
    return w.astype(np.float32), scale, report["threshold"], report


def calibrated(p: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    z = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1))
    return linear.sigmoid(scale[0] * z + scale[1])


def probabilities(texts: list[str], urls: list[str | None], w: np.ndarray, scale: tuple[float, float], hasher: linear.Hasher) -> np.ndarray:
    """The highest calibrated probability among every record's instances; 0 without any."""
    x, owner = [], []
    for i, (t, u) in enumerate(zip(texts, urls, strict=True)):
        for _, tokens, _ in instances(t, u):
            x.append(tokens)
            owner.append(i)
    out = np.zeros(len(texts))
    np.maximum.at(out, np.array(owner, np.int64), calibrated(_score(x, hasher, w), scale))
    return out


def _fitted(content: DataFrame, sample_rows: int):
    n = content.count()
    sample = content.where(F.col("raw_content").isNotNull())
    if n > sample_rows:
        rate = F.when(F.length("raw_content") < SHORT, 2.0).otherwise(0.6) * (1_000_000 * sample_rows / n)  # short records differ more
        sample = sample.where(F.pmod(F.xxhash64("item_id"), F.lit(1_000_000)) < rate)
    rows = sample.select("raw_content", "url", host(F.coalesce("source_url", "url")).alias("site")).limit(2 * sample_rows).toArrow().to_pydict()
    return train(list(zip(rows["raw_content"], rows["url"], rows["site"], strict=True)))


def scored(content: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict]:
    """item_id and probability of the rows at or above the threshold, and the report of the fit."""
    spark = content.sparkSession
    ship(spark)
    w, scale, threshold, report = _fitted(content, sample_rows)
    model = spark.sparkContext.broadcast((w, scale, threshold))  # 2^18 weights of four bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, scale_, least = model.value
        hasher = linear.Hasher()
        for batch in batches:
            p = probabilities([t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_pylist(), weights, scale_, hasher)
            keep = np.flatnonzero(p >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(p[keep])], names=["item_id", "probability"])

    return spread(content.select("item_id", "raw_content", "url")).mapInArrow(run, "item_id bigint, probability double"), report


def found(content: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """item_id and probability of the rows of ``content`` that hold no real content or carry template residue."""
    return scored(content, sample_rows)[0]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of content_item with template residue or without real content."""
    return found(load(spark, sf_dir, "content_item", "item_id", "raw_content", "url", "source_url")).select("item_id")


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that stay, by site: how many of each site's records are kept and excluded."""
    content = load(spark, sf_dir, "content_item", "item_id", "raw_content", "url", "source_url")
    bad = found(content).select("item_id", F.lit(True).alias("bad"))
    sites = content.select("item_id", host(F.coalesce("source_url", "url")).alias("site"))
    return (
        sites.join(bad, "item_id", "left")
        .groupBy("site")
        .agg(F.count("*").alias("n_rows"), F.count("bad").alias("n_excluded"))
        .withColumn("n_kept", F.col("n_rows") - F.col("n_excluded"))
    )


def p1_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier's report: rows, held-out hosts' recall and precision on the weak labels, and the threshold."""
    _, report = scored(load(spark, sf_dir, "content_item", "item_id", "raw_content", "url", "source_url"))
    return spark.createDataFrame([tuple(report.values())], "n_rows int, n_instances int, n_held_out int, n_left_out int, threshold double, recall double, precision double")
