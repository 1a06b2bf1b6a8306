"""Repair of text extracted from scanned pages.

A row is scanned text if its lines are wrapped at a width, whatever its content type says, or if they
show a scan's marks: form feeds or line ends that break words, and for a row that is labelled as pdf or
image one such mark or page number. Few lines that are longer do not count. Running
headers and footers are short lines whose fuzzy key repeats within the record or that carry a page
number at their edge; page-number lines are those of a rising sequence or of a page-number form.
A line end broke a word if the corpus knows the joined word, or knows neither it nor the hyphenated
one and the rest begins in lower case. A word is misread if undoing common confusions of shapes
gives a word that the corpus holds far more often.

Word counts come from all rows. The frequent words are sent out as a table whose size is bounded by
the inverse of the least relative frequency; they decide most words. What they leave open is joined
with all counts: a word and every word that it may be a misreading of share a key, so each open word
meets its few candidates whatever the corpus' size, and the answers go back to the rows that ask.

Null and blank texts give no lines. Line numbers count every line of the text, blank ones too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.runtime import cut, load, ship, spread

#: Least relative frequency of a word in the sent table, which therefore has at most 1 / RARE entries; least count.
RARE, LEAST_COUNT = 2e-6, 3
#: How much more frequent the corrected word must be.
RATIO = 100
#: Widest wrapped line, share of lines that fill 60 % of the width, least lines.
WIDTH, FILLED, LEAST_LINES = 100, 0.5, 4

#: What a shape is misread as, and the letters it stood for.
CONFUSIONS = [
    ("rn", "m"), ("vv", "w"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("c", "e"), ("o", "a"), ("f", "t"), ("l", "i"), ("1", "l"), ("0", "o"),
    ("5", "s"), ("6", "b"), ("9", "g"), ("8", "b"), ("3", "з"), ("8", "в"), ("0", "о"), ("н", "и"), ("п", "н"), ("m", "rn"), ("d", "cl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("1", "i"), ("6", "б"), ("h", "b"),
]

#: What the letters of a key stand for: both sides of every confusion have one key.
_SINGLE = ("cofl10о59683вбнп", "eatiiaasgbbзbbии")
_PLURAL = [("m", "rri"), ("n", "ri"), ("u", "ii"), ("d", "ei"), ("h", "ii"), ("b", "ii"), ("w", "vv"), ("ﬁ", "ti"), ("ﬂ", "ti")]

_WORD = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
_MIXED = re.compile(r"[^\W\d_][0-9][^\W\d_]|[^\W\d_]{3}[0159]$|^[0159][^\W\d_]{3}")
_BREAK = re.compile(r"[^\W\d_]([-­‐‑¬])\s*$")
_PAGE = re.compile(r"^\W*(?:(?:page|p|pag|pagina|página|seite|s|стр|с)\b\W{0,2})?\s*(\d{1,4})\W*(?:(?:of|von|de|sur|di|din|из)\s*\d{1,4})?\W*$", re.I)
_NUMBER = re.compile(r"^\W*(\d{1,4})\s{2,}|\s{2,}(\d{1,4})\W*$")
#: Canonical letters of a fuzzy key.
_DIGRAPHS = [("rn", "m"), ("vv", "w"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("ﬁ", "fi"), ("ss", "ß")]
_CANON = str.maketrans({"c": "e", "o": "a", "0": "a", "f": "t", "l": "i", "1": "i", "5": "s", "6": "b", "8": "b", "9": "g", "ț": "t", "п": "и", "н": "и", "о": "a", "а": "a", "в": "b", "з": "3", "h": "b"})


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def wrapped(lines: list[str]) -> bool:
    """Whether the lines are wrapped at a width."""
    sizes = [len(x.rstrip()) for x in lines if x.strip()]
    if len(sizes) < LEAST_LINES:
        return False
    widest = width(sizes, 20)
    return widest <= WIDTH and sum(n >= 0.6 * widest for n in sizes) >= FILLED * len(sizes)


def width(sizes: list[int], of: int) -> int:
    """The length that all but one of so many lines do not exceed."""
    return sorted(sizes)[((of - 1) * len(sizes) - 1) // of]


def scanned(lines: list[str], label: str | None) -> bool:
    """Whether the lines of a row with this content type are scanned text."""
    if wrapped(lines):
        return True
    full = [x for x in lines if x.strip()]
    if len(full) < 2 or width([len(x.rstrip()) for x in full], 10) > WIDTH:
        return False
    breaks = sum(_BREAK.search(a) is not None and b.lstrip()[0].islower() for a, b in zip(full, full[1:]))
    feeds = sum("\x0c" in x for x in lines)
    if feeds or breaks > 1:
        return True
    kind = (label or "").lower()
    return ("pdf" in kind or "image" in kind) and (breaks > 0 or any(_PAGE.match(x.strip()) for x in full))


def fuzzy_key(line: str) -> str:
    """A key that a line and its misread copies share; empty for lines without enough letters."""
    text = _NUMBER.sub("", line.strip("\x0c \t")).lower()
    for a, b in _DIGRAPHS:
        text = text.replace(a, b)
    text = "".join(c for c in text.translate(_CANON) if c.isalnum())
    return text if len(text) >= 8 else ""


def confusion_key(word):
    """A key of a word column that a word shares with all that it may be a misreading of."""
    key = F.translate(word, *_SINGLE)
    for a, b in _PLURAL:
        key = F.replace(key, F.lit(a), F.lit(b))
    return key


def usable(word: str) -> bool:
    """Whether a word can be a misreading."""
    return len(word) >= 2 and not word.isdigit()


_SHAPES = str.maketrans(dict(zip(*_SINGLE, strict=True)))


def key_of(word: str) -> str:
    """``confusion_key`` of one word: every letter stands for itself alone, so both sides of any number of confusions share it."""
    key = word.translate(_SHAPES)
    for a, b in _PLURAL:
        key = key.replace(a, b)
    return key


def _variants(word: str, back: bool = False) -> set[str]:
    """The words one confusion away: what ``word`` may be a misreading of, or with ``back`` what it may be misread as."""
    out = set()
    for shape, letters in CONFUSIONS:
        if back:
            shape, letters = letters, shape
        at = word.find(shape)
        while at >= 0:
            out.add(word[:at] + letters + word[at + len(shape) :])
            at = word.find(shape, at + 1)
    return out


def corrected(word: str, known: dict[str, int], alike: list[str], rounds: int = 2) -> str | None:
    """The word that ``word`` is a misreading of, one confusion away, else two; None if there is none that is far more frequent.

    ``alike`` holds the known words of its confusion key, so the search has no bound on a word's length: a word
    two confusions away shares a step between with what it may be misread as.
    """
    least = max(known.get(word, 0) * RATIO, LEAST_COUNT - 1)
    fit = [c for c in alike if c != word and known[c] > least]
    if not fit:
        return None
    ahead = _variants(word)
    near = [c for c in fit if c in ahead]
    if not near and rounds > 1:
        near = [c for c in fit if not ahead.isdisjoint(_variants(c, back=True))]
    return max(near, key=lambda c: (known[c], c), default=None)


class Reader:
    """Finds the damage of records, with a table of word counts.

    ``least`` is the count below which words are missing from the table, 0 if none is. Then ``answers``
    must hold count and correction of the record's ``open_words`` that have any.
    """

    def __init__(self, known: dict[str, int], least: float = 0):
        self.known = known
        self.least = least
        self.alike: dict[str, list[str]] = {}
        for w in known:
            self.alike.setdefault(key_of(w), []).append(w)
        self.memory: dict[str, str | None | bool] = {}
        self.answers: dict[str, tuple[int, str | None]] = {}

    def decided(self, word: str) -> str | None | bool:
        """The correction of a word, or False if words that the table lacks may change it."""
        if word not in self.memory:
            if len(self.memory) > 300_000:
                self.memory.clear()
            if not usable(word):
                right = None
            elif not self.least or word in self.known:
                right = corrected(word, self.known, self.alike.get(key_of(word), []))
            else:
                right = corrected(word, self.known, self.alike.get(key_of(word), []), 1)
                if right is None or self.known[right] < self.least * RATIO:
                    right = False
            self.memory[word] = right
        return self.memory[word]

    def fix(self, word: str) -> str | None:
        right = self.decided(word)
        return self.answers.get(word, (0, None))[1] if right is False else right

    def count(self, word: str) -> int:
        return self.known.get(word) or self.answers.get(word, (0, None))[0]

    def open_words(self, lines: list[str], found: dict[int, str]) -> set[str]:
        """The words that the record asks for and the table cannot decide."""
        if not self.least:
            return set()
        words: set[str] = set()
        counted: set[str] = set()
        body = [i for i, x in enumerate(lines) if i not in found and x.strip()]
        begun: set[str] = set()
        for at, i in enumerate(body):
            line = lines[i]
            words.update(_WORD.findall(line.lower()))
            words.update(w.lower() for w in _WORD.findall(line))
            parts = self.parts(line, lines[body[at + 1]]) if at + 1 < len(body) else None
            if not parts:
                begun = set()
                continue
            a, b, compound = parts
            own = [w.lower() for w in _WORD.findall(line)]
            begun = {a} | ({x + a for x in begun} if len(own) == 1 else set())  # a word broken more than once
            words.update(x + b.lower() for x in begun)
            counted.update((a + b.lower(), a, b.lower(), compound))
        return {w for w in words if self.decided(w) is False} | {w for w in counted if w and w not in self.known}

    def structure(self, lines: list[str]) -> dict[int, str]:
        """Line numbers of headers and page numbers."""
        keys, numbers, pages = {}, {}, {}
        for i, line in enumerate(lines):
            body = line.strip("\x0c \t\r")
            if not body:
                continue
            m = _PAGE.match(body)
            if m:
                pages[i] = int(m.group(1))
                continue
            m = _NUMBER.search(line.strip("\x0c \t\r"))
            if m:
                numbers[i] = int(m.group(1) or m.group(2))
            if i in numbers or not re.search(r"[.!?,;:…]$", body):
                k = fuzzy_key(line)
                if k:
                    keys[i] = k
        counts = Counter(keys.values())
        found = {i: "header" for i, k in keys.items() if counts[k] > 1 or (i in numbers and re.search(r"[^\W\d_]{3}", lines[i]))}
        titles = set(keys[i] for i in found)
        sequence = [(i, n) for i, n in sorted({**pages, **{i: n for i, n in numbers.items() if i in found}}.items())]
        around = {n for _, n in sequence}
        for i, n in pages.items():
            body = lines[i].strip("\x0c \t\r")
            decorated = re.search(r"[^\d]", body) is not None or lines[i][:3] == "   "
            edge = i == 0 or not any(x.strip() for x in lines[i + 1 :])
            beside = any(0 <= j < len(lines) and j in found for j in (i - 1, i + 1))
            if n < 2000 and (decorated or edge or beside or (n - 1) in around or (n + 1) in around):
                found[i] = "page"
        near = [i for i, v in found.items() if v == "page"]
        for i in near:  # a header that stands once, beside a page number
            for j in (i - 1, i + 1):
                if j in keys and j not in found and (lines[j].strip().isupper() or keys[j] in titles):
                    found[j] = "header"
        return found

    def parts(self, line: str, following: str | None) -> tuple[str, str, str] | None:
        """First part, rest and hyphenated form of the word around a hyphen at the line's end; no form where the hyphen can only be a break."""
        m = _BREAK.search(line)
        if not m or following is None:
            return None
        first = re.search(r"[^\W_]+$", line[: m.start(1)])
        rest = re.match(r"\W*([^\W_]+)", following)
        if not first or not rest:
            return None
        a, b = first.group().lower(), rest.group(1)
        if m.group(1) in "­‐¬":
            return a, b, ""
        prefix = re.search(r"(?:[^\W\d_]+-)*[^\W\d_]+$", line[: m.start(1)])
        compound = "-" + (prefix.group().lower() if prefix else a) + "-" + b.lower()
        return a, b, compound

    def broken(self, line: str, following: str | None) -> tuple[str, str] | None:
        """(first part, rest) of a word that the line end broke."""
        parts = self.parts(line, following)
        if not parts:
            return None
        a, b, compound = parts
        if not compound:
            return a, b.lower()
        if not b[0].islower():
            return None
        joined = self.count(a + b.lower())
        own = self.count(compound)
        if own > joined or (not joined and not own and self.count(a) and self.count(b.lower()) and len(a) > 2 and len(b) > 2):
            return None
        return a, b.lower()

    def damage(self, lines: list[str], found: dict[int, str] | None = None) -> list[tuple[int, str]]:
        """(line number, kind) of every damaged line."""
        found = self.structure(lines) if found is None else found
        out = [(i, kind) for i, kind in found.items()]
        body = [i for i, x in enumerate(lines) if i not in found and x.strip()]
        carried: str | None = None
        for at, i in enumerate(body):
            following = lines[body[at + 1]] if at + 1 < len(body) else None
            words = _WORD.findall(lines[i].lower())
            split = self.broken(lines[i], following)
            bad = False
            if carried is not None and words:
                bad = carried == "bad"
                words = words[1:]
            carried = None
            if split and words:
                out.append((i, "hyphen"))
                words = words[:-1]
                whole = "".join(split)
                right = self.fix(whole)
                carried = "fine"
                if right is not None:
                    if not right.startswith(split[0]):
                        bad = True
                    if not right.endswith(split[1]):
                        carried = "bad"
                else:
                    bad = bad or bool(_MIXED.search(split[0]))
                    carried = "bad" if _MIXED.search(split[1]) else "fine"
            if bad or any(self.fix(w) is not None or _MIXED.search(w) for w in words):
                out.append((i, "ocr"))
        return out

    def repair(self, lines: list[str], found: dict[int, str] | None = None) -> str:
        """The text in paragraphs: without headers and page numbers, words joined and read right."""
        found = self.structure(lines) if found is None else found
        parts: list[str] = []
        glue = ""
        body = [i for i in range(len(lines)) if i not in found]
        for at, i in enumerate(body):
            line = lines[i].strip("\x0c\r")
            if not line.strip():
                parts.append("\n\n")
                glue = ""
                continue
            following = next((lines[j] for j in body[at + 1 :] if lines[j].strip()), None)
            split = self.broken(line, following)
            text = line.strip()
            if split:
                text = _BREAK.sub(lambda m: m.group()[0], text)
            indent = line.startswith("   ") and parts and parts[-1] != "\n\n"
            parts.append(("\n\n" if indent else glue) + text)
            glue = "" if split else " "
        text = re.sub(r"\n{3,}", "\n\n", "".join(parts)).strip()

        def right(m: re.Match) -> str:
            fixed = self.fix(m.group().lower())
            if fixed is None:
                return m.group()
            return fixed.upper() if m.group().isupper() else fixed.capitalize() if m.group()[0].isupper() else fixed

        return _WORD.sub(right, text)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: Counter = Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            lines = lines_of(text)
            if not scanned(lines, label):
                words.update(_WORD.findall(text.lower()))
            if "-" in text:
                words.update("-" + w for w in _COMPOUND.findall(text.lower()))
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n, over all texts (raw_content, content_type), of every word that is not below the least count."""
    return cut(spread(texts).mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))


def frequent(counts: DataFrame, rare: float = RARE) -> tuple[dict[str, int], float]:
    """The words of a relative frequency of at least ``rare``, and the count that this is; 0 if the counts hold no other word."""
    total, n = counts.agg(F.sum("n"), F.count("*")).first()
    least = (total or 0) * rare
    table = counts.where(F.col("n") >= least).toArrow().to_pydict()
    return dict(zip(table["word"], table["n"], strict=True)), least if len(table["word"]) < n else 0


def answered(words: DataFrame, counts: DataFrame) -> DataFrame:
    """word, n and right of the distinct ``words`` that have a count or a correction, from all counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words_, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = dict(known)
                alike = list(known)
                for w in words_:
                    right = corrected(w, known, alike) if usable(w) else None
                    if right is not None or w in known:
                        rows.append((w, known.get(w, 0), right))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["word", "n", "right"])

    asked = words.distinct().groupBy(confusion_key(F.col("word")).alias("key")).agg(F.collect_list("word").alias("words"))
    own = counts.groupBy(confusion_key(F.col("word")).alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    return asked.join(own, "key").select("words", "known").mapInArrow(run, "word string, n bigint, right string")


def _read(df: DataFrame, rare: float):
    """Rows of item_id, raw_content, found (line to kind) and answers, and the broadcast table."""
    spark = df.sparkSession
    ship(spark)
    counts = word_counts(df.select("raw_content", "content_type").where(F.col("raw_content").isNotNull()))
    shared = spark.sparkContext.broadcast(frequent(counts, rare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            ids, texts, founds, asked = [], [], [], []
            for key, text, label in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lines = lines_of(text or "")
                if scanned(lines, label):
                    found = reader.structure(lines)
                    ids.append(key)
                    texts.append(text)
                    founds.append(list(found.items()))
                    asked.append(sorted(reader.open_words(lines, found)))
            columns = [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(founds, pa.map_(pa.int32(), pa.string())), pa.array(asked, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "raw_content", "found", "asked"])

    rows = spread(df.select("item_id", "raw_content", "content_type")).mapInArrow(run, "item_id bigint, raw_content string, found map<int,string>, asked array<string>")
    if not shared.value[1]:
        return rows.select("item_id", "raw_content", "found", F.expr("cast(null as array<struct<word:string,n:bigint,right:string>>)").alias("answers")), shared
    rows = cut(rows)
    asked = rows.select("item_id", F.explode("asked").alias("word"))
    answers = cut(answered(asked.select("word"), counts))
    own = asked.join(answers, "word").groupBy("item_id").agg(F.collect_list(F.struct("word", "n", "right")).alias("answers"))
    return rows.select("item_id", "raw_content", "found").join(own, "item_id", "left").select("item_id", "raw_content", "found", "answers"), shared


def _records(batch: pa.RecordBatch, reader: Reader) -> Iterator[tuple[int, list[str], dict[int, str]]]:
    """item_id, lines and found of a batch's rows, with their answers set in the reader."""
    for key, text, found, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        reader.answers = {x["word"]: (x["n"], x["right"]) for x in answers or ()}
        yield key, lines_of(text), dict(found)


def damaged_lines(df: DataFrame, rare: float = RARE) -> DataFrame:
    """item_id, line_no and kind of every damaged line of the scanned rows."""
    rows, shared = _read(df, rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            ids, numbers, kinds = [], [], []
            for key, lines, found in _records(batch, reader):
                for i, kind in reader.damage(lines, found):
                    ids.append(key)
                    numbers.append(i)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string())], names=["item_id", "line_no", "kind"])

    return rows.mapInArrow(run, "item_id bigint, line_no int, kind string")


def repaired(df: DataFrame, rare: float = RARE) -> DataFrame:
    """item_id and the readable text of the scanned rows."""
    rows, shared = _read(df, rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            out = [(key, reader.repair(lines, found)) for key, lines, found in _records(batch, reader)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["item_id", "text"])

    return rows.mapInArrow(run, "item_id bigint, text string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged lines of scanned text in content_item."""
    return damaged_lines(load(spark, sf_dir, "content_item", "item_id", "raw_content", "content_type"))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable texts of the scanned rows of content_item."""
    return repaired(load(spark, sf_dir, "content_item", "item_id", "raw_content", "content_type"))
