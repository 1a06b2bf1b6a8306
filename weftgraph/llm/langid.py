"""Languages of texts and of their segments, by compression.

Each language has a zstandard raw-content dictionary of sentences; a segment belongs to the language
whose dictionary encodes it in the fewest bytes, and to none when the margin to the next is narrow.
The dictionaries come from a bounded sample of labelled texts. Labels can be wrong, so the sample is
classified with the first dictionaries, and texts that contradict their label leave before the
dictionaries are built anew; lists of common words stand in them from the start, so that a language
without samples is still known.

Null, empty and wordless texts have no segments. Equal keys give equal rows once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.runtime import load, ship, spread

LANGUAGES = ["de", "en", "es", "fr", "it", "ro", "ru"]
#: Labelled texts sampled for the dictionaries, at most; bytes of one dictionary, at most; level of compression.
SAMPLE_ROWS, DICTIONARY_BYTES, LEVEL = 4000, 60_000, 6
#: Least margin, in bytes and as a share of the smallest size.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.04
#: Share of the sample held out for the scale of confidences, and sentences that it needs.
HELD_OUT, LEAST_HELD = 0.15, 50
#: Least words of a full sentence.
SENTENCE_WORDS = 4

#: Notations of languages, and words that name none.
NOTATIONS = {
    "de": {"de", "deu", "ger", "german", "deutsch", "allemand"},
    "en": {"en", "eng", "english", "englisch", "anglais"},
    "es": {"es", "spa", "spanish", "español", "espanol", "castellano"},
    "fr": {"fr", "fra", "fre", "french", "français", "francais"},
    "it": {"it", "ita", "italian", "italiano"},
    "ro": {"ro", "ron", "rum", "romanian", "română", "romana"},
    "ru": {"ru", "rus", "russian", "русский"},
}
_CODE = {n: k for k, names in NOTATIONS.items() for n in names}
NO_LANGUAGE = {"", "und", "auto", "unknown", "unk", "none", "null", "n/a", "na", "mul", "mis", "zxx", "xx", "xxx", "other", "nan", "?", "-", "detect", "any"}
#: Common words of each language.
COMMON = {
    "de": "der die das und ist nicht mit von auf für ein eine im den dem des zu wurde hat nach bei aus durch während gegen ohne zwischen weil obwohl dass sich auch als wie über nur noch einer einem wird sind am zum zur laut",
    "en": "the of and to in is that for with was on as by it from at its be are this has had which not or an their after during against without between because although while who were been will would his her she they several many some",
    "es": "el la los las de del y en que un una por con no para se al lo como más pero sus le ha fue durante contra sin entre porque aunque mientras según desde hasta sobre este esta cuando muy también había son su",
    "fr": "le la les de des du et en que un une par avec ne pas pour se au aux ce il elle est sur dans qui plus mais ses été pendant contre sans entre parce alors tandis selon depuis cette sont leur nous vous était avait",
    "it": "il lo la gli le di del della dei delle e che un una per con non si al alla come più ma suo ha è stato durante contro senza tra perché anche mentre secondo dalla nel nella questo sono hanno era dopo prima presso degli",
    "ro": "și de la în cu că nu o un pe din este a fost pentru care sau mai după prin între fără lângă deși pentru că în timp ce iar lui ei al ale sunt avea acest această când unui unei potrivit dintr către până la",
    "ru": "и в не на что с по из за от до как это был была было были для при без между после перед через под над или но его её их когда чтобы потому хотя пока так же уже только все может быть этот эта",
}

_ABBREVIATION = re.compile(r"(?:\b(?:[^\W\d_]\.)+|\b(?:Inc|Ltd|Co|Corp|Dr|Mr|Mrs|Ms|St|No|nr|Str|Prof|Hr|Fr|Sr|Sra|Mme|tel|tél|тел|bl|ap|vs))\.?$", re.I)
_BREAK = re.compile(r"(?<=[.!?…])[»”\"’)]*\s+|\s+[/|–—]\s+|\n+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_MARKS, _NUMBER, _HARD = re.compile("[\u0300-\u036f]+"), re.compile(r"\d+"), re.compile(r"[\n/|–—]")
_TAG = re.compile(r"<[^<>]{0,80}>|&\w{2,6};|https?://\S+|\S+@\S+")


def code_of(label: str | None) -> str | None:
    """The two-letter code of a label; ``other`` for a language that is not among ours; None for no language."""
    text = (label or "").strip().lower()
    if text in NO_LANGUAGE:
        return None
    base = re.split(r"[-_\s]", text)[0]
    found = _CODE.get(text) or _CODE.get(base)
    if found:
        return found
    return "other" if re.fullmatch(r"[^\W\d_]{2,3}", base) and base not in NO_LANGUAGE or len(text) > 3 else None


def folded(text: str) -> str:
    """Lower case without accents, markup and differing digits."""
    plain = text.lower()
    if not plain.isascii():
        plain = _MARKS.sub("", unicodedata.normalize("NFKD", plain))
    return " ".join(_NUMBER.sub("0", plain).split())


def segments(text: str | None) -> list[tuple[int, int]]:
    """Places (start, end) of the sentences of a text; an abbreviation ends none."""
    if not text:
        return []
    out, start = [], 0
    for m in _BREAK.finditer(text):
        piece = text[start : m.start()]
        follows = text[m.end() : m.end() + 1]
        if not _HARD.search(m.group()) and (_ABBREVIATION.search(piece) or follows.islower()):
            continue
        if piece.strip():
            out.append((start, m.start()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def full(piece: str) -> bool:
    """Whether a segment is a sentence of its own rather than some quoted words."""
    words = _WORD.findall(_TAG.sub(" ", piece))
    body = re.sub(r"[\s»”\"’)<>/a-z]*$", "", piece) if piece.rstrip().endswith(">") else piece.rstrip(" »”\"’)")
    quoted = re.fullmatch(r"\W*[(«“\"„].*[)»”\"]\W*", piece.strip()) is not None
    return len(words) >= SENTENCE_WORDS and (body[-1:] in ".!?…" or len(words) >= 2 * SENTENCE_WORDS) and not (quoted and len(words) < 2 * SENTENCE_WORDS)


class Classifier:
    """Compressors with one raw-content dictionary for each language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, scale: float = 0.5):
        self.names = sorted(dictionaries)
        self.scale = scale  # bits of evidence that a byte of difference is worth
        self.tools = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.seen: dict[str, tuple[str | None, float]] = {}

    def __call__(self, piece: str) -> tuple[str | None, float]:
        """Language and confidence; None where the margin is narrow or there are no words."""
        text = folded(_TAG.sub(" ", piece))
        found = self.seen.get(text)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found = self.seen[text] = self._classify(text)
        return found

    def _classify(self, text: str) -> tuple[str | None, float]:
        if not _WORD.search(text):
            return None, 0.0
        data = text.encode("utf-8", "replace")
        sizes = sorted((len(tool.compress(data)), k) for k, tool in enumerate(self.tools))
        best, margin = sizes[0][0], sizes[1][0] - sizes[0][0] if len(sizes) > 1 else 60
        confidence = 1 / sum(2.0 ** (-self.scale * (n - best)) for n, _ in sizes)
        if margin < max(MARGIN_BYTES, MARGIN_SHARE * best):
            return None, confidence
        return self.names[sizes[0][1]], confidence


def _dictionary(language: str, sentences: list[str]) -> bytes:
    text = "\n".join(dict.fromkeys(sentences)).encode()[-DICTIONARY_BYTES:]
    return folded(COMMON[language]).encode() + b"\n" + text


def build(rows: list[tuple[str | None, str | None]]) -> dict[str, bytes]:
    """Dictionaries from (text, label) rows; two rounds remove texts that contradict their label."""
    by: dict[str, list[str]] = {k: [] for k in LANGUAGES}
    for text, label in rows:
        k = code_of(label)
        if k in by:
            by[k] += [s for a, b in segments(text) if full(text[a:b]) and (s := folded(_TAG.sub(" ", text[a:b])))]
    votes = {k: set(folded(v).split()) for k, v in COMMON.items()}

    def vote(sentence: str) -> str:
        words = sentence.split()
        return max(LANGUAGES, key=lambda k: sum(w in votes[k] for w in words))

    clean = {k: [s for s in v if vote(s) == k] for k, v in by.items()}
    judge = Classifier({k: _dictionary(k, v) for k, v in clean.items()})
    pool = {k: [] for k in LANGUAGES}
    for k, v in by.items():
        for s in v:
            found, _ = judge(s)
            if found:
                pool[found].append(s)
    return {k: _dictionary(k, v) for k, v in pool.items()}


def calibrated(dictionaries: dict[str, bytes], rows: list[tuple[str | None, str | None]]) -> float:
    """The scale of confidences that fits held-out (text, label) rows best by likelihood, given that a share of the labels is wrong.

    Labels that are wrong at random speak against no scale, so the share is fitted along with it. 0.5 without held-out sentences.
    """
    judge = Classifier(dictionaries)
    sizes, own = [], []
    for text, label in rows:
        k = code_of(label)
        if k not in dictionaries:
            continue
        for a, b in segments(text):
            if full(text[a:b]):
                data = folded(_TAG.sub(" ", text[a:b])).encode("utf-8", "replace")
                sizes.append([len(tool.compress(data)) for tool in judge.tools])
                own.append(judge.names.index(k))
    if len(own) < LEAST_HELD:
        return judge.scale
    x = np.array(sizes, float)
    x -= x.min(axis=1, keepdims=True)

    def likelihood(scale: float, wrong: float) -> float:
        p = np.exp2(-scale * x)
        return float(np.log((1 - wrong) * (p / p.sum(axis=1, keepdims=True))[np.arange(len(own)), own] + wrong / len(judge.names)).sum())

    grid = [(scale, wrong) for scale in (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0) for wrong in (0.01, 0.03, 0.1, 0.2, 0.3)]
    return max(grid, key=lambda g: likelihood(*g))[0]


def fitted(rows: list[tuple[str | None, str | None]]) -> tuple[dict[str, bytes], float]:
    """Dictionaries from all labelled rows, and the scale of confidences that dictionaries from most of them have on the rest."""
    held = [r for i, r in enumerate(rows) if i % 100 < 100 * HELD_OUT]
    most = build([r for i, r in enumerate(rows) if i % 100 >= 100 * HELD_OUT])
    return build(rows), calibrated(most, held)


def _sample(cache: DataFrame, rows: int) -> list[tuple[str | None, str | None]]:
    n = cache.count()
    few = cache.where(F.col("source_text").isNotNull())
    if n > rows:
        few = few.where(F.pmod(F.xxhash64("cache_key"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    d = few.select("source_text", "source_lang").limit(2 * rows).toArrow().to_pydict()
    return list(zip(d["source_text"], d["source_lang"], strict=True))


def languages(text: str | None, judge: Classifier) -> list[tuple[int, int, str | None, float, bool]]:
    """(start, end, language, confidence, is a full sentence) of every segment; a narrow one takes the language of the whole text when that is clear."""
    out = []
    for a, b in segments(text):
        k, c = judge(text[a:b])
        out.append((a, b, k, c, full(text[a:b])))
    if out and all(k is None for *_, k, _, _ in out):
        k, c = judge(text)
        out = [(a, b, k, c, f) for a, b, _, _, f in out]
    return out


def identified(cache: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per segment: cache_key, source_lang, segment, start_pos, end_pos, lang, confidence, is_full."""
    spark = cache.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fitted(_sample(cache, sample_rows)))  # seven dictionaries of at most DICTIONARY_BYTES
    schema = "cache_key string, source_lang string, segment int, start_pos int, end_pos int, lang string, confidence double, is_full boolean"
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries, scale = shared.value
        judge = Classifier(dictionaries, scale=scale)
        for batch in batches:
            rows = [
                (key, label, n, a, b, k, c, f)
                for key, label, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
                for n, (a, b, k, c, f) in enumerate(languages(text, judge))
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return spread(cache.select("cache_key", "source_lang", "source_text")).mapInArrow(run, schema)


def label_code(column: str):
    """code_of as a column: label notations are few, so they are mapped by expression."""
    text = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    base = F.regexp_extract(text, r"^([^-_\s]*)", 1)
    table = F.create_map(*[F.lit(x) for pair in _CODE.items() for x in pair])
    known = F.coalesce(F.try_element_at(table, text), F.try_element_at(table, base))
    none = text.isin(*NO_LANGUAGE) | base.isin(*NO_LANGUAGE)
    other = base.rlike(r"^\p{L}{2,3}$") | (F.length(text) > 3)
    return F.when(~none, F.coalesce(known, F.when(other, F.lit("other"))))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment with its place, language and confidence."""
    return identified(load(spark, sf_dir, "translation_cache", "cache_key", "source_lang", "source_text")).drop("source_lang").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the entries with a missing or wrong label or with several languages."""
    found = identified(load(spark, sf_dir, "translation_cache", "cache_key", "source_lang", "source_text"))
    sentences = found.where("lang is not null and is_full").select("cache_key", label_code("source_lang").alias("label"), "lang").distinct()
    entries = sentences.groupBy("cache_key", "label").agg(F.collect_set("lang").alias("langs"))  # at most seven
    case = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return entries.where(case).select("cache_key", F.explode("langs").alias("lang")).distinct()
