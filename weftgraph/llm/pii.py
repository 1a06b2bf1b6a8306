"""Personal information in free text.

Generators with high recall propose spans, which may overlap, of e-mail addresses, phone numbers,
identity numbers, street addresses and names. Boosted trees score every span by its format and its
context; the trees are fitted on the spans of all rows, and on given names, surname endings and
lower-case words that all rows show. Features are small numbers, so the spans of any corpus are few
distinct rows of features with counts. Labels come from one side only and the trees decide from
the other: a number is labelled by the words before it, never by its format, and is fitted a second
time with those words hidden; a name is labelled where a listed given name or a title makes it sure,
and fitted again without the list and without the title. Where the rules abstain only the trees decide. Their
scores are calibrated per kind on held-out rows, and the thresholds apply to calibrated
probabilities. Of overlapping spans that pass, the one that starts first and is longest stays.

Null and empty texts have no spans. Positions are code points from 0.
"""

from __future__ import annotations

import re
import struct
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import trees
from weftgraph.runtime import cut, load, ship, spread

KINDS = ["EMAIL", "PHONE", "ID", "ADDRESS", "NAME"]
EMAIL, PHONE, ID, ADDRESS, NAME = range(5)
#: Share of the rows held out for the thresholds.
HELD_OUT = 0.3
#: Least share of the rows, and least number, that a word stands in lower case in, to be no name.
PLAIN_SHARE, LEAST_PLAIN = 0.00025, 3

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽȘȚА-ЯЁ"
_TOKEN = rf"(?:[{_UP}][^\W\d_]?\.|[{_UP}](?:[^\W\d_]|['’])*(?:-[{_UP}](?:[^\W\d_]|['’])*)*(?![\w]))"
_AT = r"(?:@|\s?\[at\]\s?|\s?\(at\)\s?|\s?\(@\)\s?|\s?\{at\}\s?|\sat\s)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sdot\s)"
_EMAIL = re.compile(rf"https?://\S+|(?P<email>(?<![\w.+\-])[\w][\w.+\-]*{_AT}[\w\-]+(?:{_DOT}[\w\-]+)+)")
_MASTER = re.compile(
    rf"(?P<code>\b(?:[A-Z]{{1,3}}[ -]?\d{{2}}[ ]?\d{{2}}[ ]?\d{{2}}[ ]?[A-Z]|[A-Z]{{2}} ?\d{{4,9}}|\d{{7,8}}[A-Z]|[A-Z]{{6}}\w{{2}}[A-Z]\w{{2}}[A-Z]\w{{3}}[A-Z]|[A-Z]{{1,2}}\d{{6,8}})\b)"
    rf"|(?P<number>(?:\+|\()?\d[\d\s ().\-/]*\d(?:\s?(?:ext\.?|x|int\.?|Durchwahl)\s?\d{{1,5}})?)"
    rf"|(?P<run>(?<!\w){_TOKEN}(?:,? {_TOKEN}){{0,4}})"
)
#: Where a match of these can start; found by one set of characters, so most positions cost little.
_START = re.compile(rf"[\d+({_UP}](?:(?<=[\d+(])|(?<!\w.))")
_NUM = r"\d{1,4}(?:\s?(?:[a-zA-Z]|bis|ter)\b|/[A-Z\d]+)?"
#: Words of streets and units.
_STREET_EN = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Court|Ct\.?|Drive|Dr\.?|Square|Sq\.?|Way|Terrace|Close|Place|Row|Boulevard|Blvd\.?|Crescent|Quay|Gardens|Hill)\b\.?"
_ADDRESS = re.compile(
    rf"(?:(?:Flat|Unit|Apt\.?|Apartment|Suite|Room)\s\w{{1,6}},\s)?{_NUM},?\s(?:[{_UP}][\w'’]+\s){{1,3}}{_STREET_EN}"
    rf"|(?:Flat|Unit|Apt\.?|Apartment|Suite)\s\w{{1,6}},\s(?:{_NUM},?\s)?(?:[{_UP}][\w'’]+\s){{1,3}}{_STREET_EN}"
    rf"|{_NUM},?\s(?:rue|avenue|av\.|boulevard|bd\.?|place|impasse|chemin|quai|allée|cours|square|passage|route)\s[\w'’ \-]{{2,40}}"
    rf"|\b(?:[Ss]trada|[Ss]tr\.|[Bb]d\.|[Bb]ulevardul|[Bb]-dul|[Aa]leea|[Cc]alea|[Pp]iața|[Șș]os\.|[Șș]oseaua|[Ii]ntrarea|[Ss]plaiul)\s[^\d,;]{{2,40}}?,?\s(?:nr\.?\s?)?{_NUM}"
    rf"|\b(?:[Vv]ia|[Vv]iale|[Cc]orso|[Pp]iazza|[Pp]iazzale|[Vv]icolo|[Ll]argo|[Ll]ungomare|[Ss]trada|[Vv]\.le|[Pp]\.za)\s[^\d;]{{2,40}}?,?\s(?:n\.?\s?)?{_NUM}"
    rf"|\b(?:[Cc]alle|[Cc]/|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Cc]tra\.|[Cc]arretera|[Tt]ravesía)\s?[^\d;]{{2,40}}?,?\s(?:n\.?[ºo°]?\s?)?{_NUM}"
    rf"|\b(?:(?:Am|An der|Auf dem|Im|In der|Zum|Zur|Unter den|Alte[rs]?|Neue[rs]?)\s(?:[{_UP}][\wß]+\s){{1,3}}|[{_UP}][\wß\-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|markt|steig|chaussee)\s){_NUM}"
    rf"|\b(?:ул\.|улица|пр\.|проспект|пер\.|переулок|наб\.|набережная|пл\.|площадь|бул\.|бульвар|ш\.|шоссе)\s[^\d;]{{2,40}}?,?\s(?:д\.|дом)?\s?{_NUM}"
)
_UNIT = re.compile(r"(?:Flat|Unit|Apt\.?|Apartment|Suite|Room)\s\w{1,6},\s")
#: Words of which an address has one, and endings of which its street has one.
_ADDRESS_WORDS = set(
    "Street St Road Rd Lane Ln Avenue Ave Court Ct Drive Square Sq Way Terrace Close Place Row Boulevard Blvd Crescent Quay Gardens Hill Flat Unit Apt Apartment Suite rue avenue av boulevard bd place impasse chemin quai allée cours square passage route"
    " Strada strada Str str Bd Bulevardul bulevardul Aleea aleea Calea calea Piața piața Șos șos Șoseaua șoseaua Intrarea intrarea Splaiul splaiul Via via Viale viale Corso corso Piazza piazza Piazzale piazzale Vicolo vicolo Largo largo Lungomare lungomare Calle calle Avenida avenida Avda avda Plaza plaza Paseo paseo Camino camino Ronda ronda Ctra ctra Carretera carretera Travesía travesía"
    " Am An Auf Im In Zum Zur Unter Alte Alter Altes Neue Neuer Neues ул улица пр проспект пер переулок наб набережная пл площадь бул бульвар ш шоссе".split()
)
_STREET_END = re.compile("\\s\\d(?:" + "|".join(rf"(?<={e}\s\d)" for e in r"straße strasse str\. weg gasse platz allee ufer damm ring markt steig chaussee".split()) + ")")
_WORD, _CALLE = re.compile(r"\w+"), re.compile(r"C/\b(?<!\wC/)")
#: Context words.
_CONTEXT = {
    "phone": 1, "tel": 1, "telefon": 1, "téléphone": 1, "tél": 1, "telefono": 1, "teléfono": 1, "телефону": 1, "тел": 1, "call": 1, "calls": 1, "ring": 1, "sunați": 1, "appeler": 1, "llame": 1, "chiamare": 1, "switchboard": 1, "reached": 1, "joignable": 1, "mobile": 1, "fax": 1, "erreichbar": 1,
    "identity": 2, "passport": 2, "cnp": 2, "ausweisnummer": 2, "identité": 2, "identidad": 2, "document": 2, "documento": 2, "паспорта": 2, "tax": 2, "ssn": 2, "nif": 2, "dni": 2, "pașaport": 2, "passeport": 2, "pasaporte": 2, "codice": 2, "инн": 2, "steuernummer": 2, "reisepass": 2,
    "file": 3, "case": 3, "invoice": 3, "lot": 3, "dosarul": 3, "akte": 3, "dossier": 3, "expediente": 3, "fascicolo": 3, "дело": 3, "room": 3, "no": 3, "nr": 3, "ron": 4, "eur": 4, "usd": 4, "$": 4, "€": 4, "£": 4, "for": 8, "xr": 3, "gps": 3, "version": 3,
    "mr": 5, "mrs": 5, "ms": 5, "dr": 5, "herr": 5, "herrn": 5, "frau": 5, "doamna": 5, "domnul": 5, "dl": 5, "dna": 5, "m": 5, "mme": 5, "mlle": 5, "monsieur": 5, "madame": 5, "sr": 5, "sra": 5, "señor": 5, "señora": 5, "signor": 5, "signora": 5, "sig": 5, "г-н": 5, "г-жа": 5, "господин": 5, "госпожа": 5, "prof": 5,
    "of": 7, "&": 7,
    "in": 6, "din": 6, "at": 6, "en": 6, "à": 6, "bei": 6, "near": 6, "nach": 6, "в": 6,
    "lived": 9, "lives": 9, "moved": 9, "parcel": 9, "wohnt": 9, "wohnhaft": 9, "domicilio": 9, "domicilié": 9, "habite": 9, "demeurant": 9, "locuiește": 9, "domiciliat": 9, "residente": 9, "abita": 9, "vive": 9, "проживает": 9, "живёт": 9, "address": 9, "adresse": 9, "indirizzo": 9, "dirección": 9, "adresa": 9,
}
TITLES = {k for k, v in _CONTEXT.items() if v == 5} | {"professor", "sir", "lady", "don", "doña", "dott", "ing", "avv", "av", "me", "pr"}
ORG = set(
    "foundation institute national agency group grp holdings sons media mining timber textiles energy airways pharma foods capital cement software logistics consulting research shipping international intl nat'l ag gmbh oy spa ltd llc inc b.v. s.a. s.r.l. corp company bank university ministry council".split()
)
#: Words of French alone, in which M. is a title.
_FRENCH = set("et est à avec pour selon dans une du qui été par aux chez joindre auprès".split())
#: Context that reaches over a word or two, and marks that end it.
_WIDER, _STOPS = {1, 2, 3, 4, 9}, {",", ".", ";", ":"}
_UNITS = {"t", "km", "m²", "m", "kg", "%", "eur", "usd", "ron", "€", "$", "tonnes", "pages"}
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|[&$€£@%]")
_INSIDE = re.compile(r"\b(?:Foundation|Institute|Agency|Ministry|University|Bank)\b[\w\s]*\b(?:for|of)\s*$")
_SPELLED = re.compile(r"\sdot\s|\(dot\)|\[dot\]")
_DIGIT, _DIGITS, _GLUED = re.compile(r"\d"), re.compile(r"\d+"), re.compile(r"\d,\s$|[A-Z]\d*/?$")
_DATE = re.compile(r"\d{1,2}\.\d{1,2}\.(?:19|20)\d\d|(?:19|20)\d\d-(?:(?:19|20)\d\d|\d\d-\d\d)|\d{1,3}(?: \d{3})+")
_NAMES, _LOCAL = re.compile(r"[^\s,.]+"), re.compile(r"[.+\d_\-]")
_SEPARATORS = re.compile(r"\D+")
N_FEATURES = 22
_OPENER = re.compile(rf"([{_UP}][\w’']+) ([{_UP}][\w’']+)")
_ALPHA = re.compile(r"[^\W\d_]{2,}")

Candidate = tuple[int, int, int, int]  # kind, start, end, format


def _tokens(run: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for w in run.split(" "):
        out.append((at, w.removesuffix(",")))
        at += len(w) + 1
    return out


def hinted(text: str) -> bool:
    """Whether a text has a word or an ending of an address."""
    return not _ADDRESS_WORDS.isdisjoint(_WORD.findall(text)) or _STREET_END.search(text) is not None or _CALLE.search(text) is not None


def candidates(text: str, given: set[str]) -> list[Candidate]:
    """Spans that may be personal information: (kind, start, end, format)."""
    out: list[Candidate] = []
    if _DIGIT.search(text) and hinted(text):
        for m in _ADDRESS.finditer(text):
            out.append((ADDRESS, m.start(), m.end(), 0))
            unit = _UNIT.match(m.group())
            if unit:  # the unit may be no part of it
                out.append((ADDRESS, m.start() + unit.end(), m.end(), 1))
    if "@" in text or "://" in text or " at " in text or "(at)" in text or "[at]" in text or "{at}" in text:
        rest = text
        for m in _EMAIL.finditer(text):
            a, b = m.span()
            if m.lastgroup:
                out.append((EMAIL, a, b, 0 if "@" in m.group() and "(@)" not in m.group() else 1))
            if not m.lastgroup or out[-1][3] == 0 or " at " not in m.group():
                rest = rest[:a] + " " * (b - a) + rest[b:]
        text = rest
    words = text.split(" ")
    if not given.isdisjoint(words):  # names typed in lower case
        at = 0
        for i, w in enumerate(words):
            if w in given and i + 1 < len(words):
                middle = len(words[i + 1]) == 2 and words[i + 1][1] == "." and i + 2 < len(words)
                last = words[i + 1 + middle].rstrip(",.;:()?!")
                if len(last) > 4 and last.isalpha() and last.islower():
                    out.append((NAME, at, at + len(w) + 1 + 3 * middle + len(last), 3))
            at += len(w) + 1
    start = _START.search(text)
    while start:
        a = start.start()
        m = _MASTER.match(text, a)
        if m is None:
            start = _START.search(text, a + 1)
            continue
        kind, b = m.lastgroup, m.end()
        start = _START.search(text, b)
        if kind == "code":
            if _DIGIT.search(text, a, b):
                out.append((ID, a, b, 1))
        elif kind == "number":
            s = m.group()
            if s[0] == "(" and ")" not in s:
                a, s = a + 1, s[1:]
            digits = len(_DIGIT.findall(s))
            if digits >= 7 or digits == 6 and s[0] == "+":
                out.append((PHONE, a, b, 0))
                if s[0].isdigit() and digits >= 8:
                    out.append((ID, a, b, 0))
        else:
            run = m.group()
            if " " not in run:  # one word alone is no name
                continue
            toks = _tokens(run)
            low = [t.lower().rstrip(".") for _, t in toks]
            for k in range(1, len(toks)):
                if _CONTEXT.get(low[k], 0) in (1, 2):
                    toks = toks[:k]
                    break
            first = 0
            while first < len(toks) and low[first] in TITLES:
                if toks[first][1] == "M." and first + 1 < len(toks):  # a title, or the initial of a name
                    out.append((NAME, a + toks[first][0], a + toks[-1][0] + len(toks[-1][1]), 0))
                first += 1
            if first == len(toks):
                continue
            toks, low = toks[first:], low[first:]
            if len(toks) == 1:
                if first:
                    out.append((NAME, a + toks[0][0], a + toks[0][0] + len(toks[0][1]), 2))
                continue
            whole = (a + toks[0][0], a + toks[-1][0] + len(toks[-1][1]))
            out.append((NAME, *whole, 0))
            if len(toks) > 2 and low[0] not in given and len(low[0]) > 1:
                out.append((NAME, a + toks[1][0], whole[1], 1))  # a sentence's first word may stand before
            for k in range(2, len(toks) - 1):  # or a place
                if low[k] in given and low[k - 1] not in given:
                    out.append((NAME, a + toks[k][0], whole[1], 1))
    return out


_PAIR = re.compile(rf"([{_UP}](?<!\w.)(?<![\w&] .)[\w’']+) ([{_UP}][\w’']{{4,}})(?![\w]| &)")
PAIR, WORD, OPENED = range(3)


def shown(texts: list[str]) -> tuple[set[tuple[str, str]], Counter, Counter, set[tuple[str, str]]]:
    """What texts show: pairs of words in capitals, words in lower case and otherwise with their counts, and pairs that texts open with."""
    pairs, lower, upper, opened, words = set(), Counter(), Counter(), set(), Counter()
    for t in texts:
        for first, second in _PAIR.findall(t):
            a, b = first.lower(), second.lower()
            if b not in ORG and a not in ORG and a not in TITLES:
                pairs.add((a, b))
        words.update(_ALPHA.findall(t))
        m = _OPENER.match(t)
        if m:
            opened.add((m.group(1).lower(), m.group(2).lower()))
    for w, n in words.items():
        (lower if w.islower() else upper)[w.lower()] += n
    return pairs, lower, upper, opened


#: What a word of a name shows.
GIVEN, GIVEN_PART, ENDING, ORG_WORD, LETTER, LOW_LETTER, PLAIN = (1 << i for i in range(7))


class Signs(dict):
    """The signs of a name's word by a lexicon, kept for the words of a batch."""

    def __init__(self, lex: Lexicon):
        super().__init__()
        self.lex = lex

    def __missing__(self, word: str) -> int:
        lex, low = self.lex, word.lower()
        parts = low.split("-")
        out = GIVEN if low in lex.given or parts[0] in lex.given else 0
        out |= GIVEN_PART if not lex.given.isdisjoint(parts) else 0
        out |= ENDING if low[-3:] in lex.endings and len(low) > 4 else 0
        out |= ORG_WORD if low in ORG or low + "." in ORG else 0
        out |= (LETTER if len(word) == 1 else 0) | (LOW_LETTER if len(low) == 1 else 0)
        out |= PLAIN if low.strip(".") in lex.plain else 0
        self[word] = out
        return out


class Lexicon:
    """Given names, surname endings and common lower-case words that texts show."""

    def __init__(self, texts: list[str]):
        pairs, lower, upper, openers = shown(texts)
        followers: dict[str, set] = defaultdict(set)
        for first, second in pairs:
            followers[first].add(second)
        endings: Counter = Counter()
        wide = {k: v for k, v in followers.items() if len(v) >= 4}
        for v in wide.values():
            endings.update({x[-3:] for x in v} if len(v) < 40 else [x[-3:] for x in v])
        total = sum(endings.values()) or 1
        self.endings = {e for e, n in endings.items() if n >= max(4, 0.01 * total)}
        self.given = {k for k, v in wide.items() if sum(x[-3:] in self.endings for x in v) >= 0.7 * len(v)}
        least = max(LEAST_PLAIN, PLAIN_SHARE * len(texts))
        self.plain = {w for w, n in lower.items() if n >= least and n > upper[w] and w not in self.given}
        opened: dict[str, set] = defaultdict(set)  # words that sentences open with before a name
        for first, second in openers:
            if second in self.given and first not in self.given:
                opened[first].add(second)
        self.plain |= {w for w, v in opened.items() if len(v) >= 4}

    @classmethod
    def of_rows(cls, rows: DataFrame) -> Lexicon:
        """The same from all rows with a ``text``, by aggregations."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs, lower, upper, opened = shown([t for t in batch.column(0).to_pylist() if t])
                out = [(PAIR, a, b, 0, 0) for a, b in pairs] + [(OPENED, a, b, 0, 0) for a, b in opened]
                out += [(WORD, w, "", lower[w], upper[w]) for w in lower.keys() | upper.keys()]
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["what", "first", "second", "lower", "upper"])

        texts = rows.where("text <> ''").select("text")
        each = spread(texts).mapInArrow(run, "what int, first string, second string, lower bigint, upper bigint")
        seen = cut(each.groupBy("what", "first", "second").agg(F.sum("lower").alias("lower"), F.sum("upper").alias("upper")))
        pairs = seen.where(F.col("what") == PAIR).select("first", F.expr("right(second, 3)").alias("ending"))
        wide = pairs.groupBy("first").agg(F.count("*").alias("total")).where("total >= 4")
        ends = cut(pairs.groupBy("first", "ending").agg(F.count("*").alias("n")).join(wide, "first"))
        endings = ends.groupBy("ending").agg(F.sum(F.when(F.col("total") < 40, 1).otherwise(F.col("n"))).alias("n"))
        total = endings.agg(F.sum("n")).first()[0] or 1
        collected = lambda df: set(df.toArrow().column(0).to_pylist())
        self = cls([])
        self.endings = collected(endings.where(F.col("n") >= max(4, 0.01 * total)).select("ending"))  # at most a hundred
        of_names = F.sum(F.when(F.col("ending").isin(*self.endings), F.col("n")).otherwise(0))
        given = cut(ends.groupBy("first").agg(of_names.alias("n"), F.max("total").alias("total")).where("n >= 0.7 * total").select("first"))
        self.given = collected(given)
        least = max(LEAST_PLAIN, PLAIN_SHARE * texts.count())
        self.plain = collected(seen.where((F.col("what") == WORD) & (F.col("lower") >= least) & (F.col("lower") > F.col("upper"))).select("first")) - self.given
        opened = seen.where(F.col("what") == OPENED).select("first", "second").join(given.withColumnRenamed("first", "second"), "second", "left_semi").join(given, "first", "left_anti")
        self.plain |= collected(opened.groupBy("first").agg(F.count("*").alias("n")).where("n >= 4").select("first"))
        return self


def initial_m(text: str, a: int, b: int, given: set[str]) -> int:
    """For a name with M. as its first token (1, 2) or before it (3, 4): odd where M. is a title, even where it is an initial; else 0."""
    inside = text[a : a + 3] == "M. "
    if not inside and (text[max(0, a - 3) : a] != "M. " or text[max(0, a - 4) : a - 3].isalnum()):
        return 0
    following = _NAMES.search(text, a + 3 if inside else a)
    title = following is not None and following.group().lower().split("-")[0] in given and following.end() < b
    title = title or not _FRENCH.isdisjoint(w.lower() for w in _WORDS.findall(text[max(0, a - 60) : b + 60]))
    return (1 if title else 2) + 2 * (not inside)


def features(text: str, c: Candidate, lex: Lexicon, signs: Signs | None = None) -> list[int]:
    """The features of a candidate, up to the trees' last bin."""
    kind, a, b, form = c
    s = text[a:b]
    near = wider = 0
    before = _WORDS.findall(text[max(0, a - 45) : a].lower())[-3:]
    if before:
        near = wider = _CONTEXT.get(before[-1], 0)
        for w in before[-2::-1]:
            if wider in _WIDER:
                break
            wider = _CONTEXT.get(w, 0)
        if wider not in _WIDER:
            wider = 0
    row = [kind, form, 0, 0, 0, 0, near, wider, 0, min(31, b - a), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
    after = _WORDS.search(text, b, b + 24)
    if after:
        nxt = after.group().lower() if text[b : b + 2].strip()[:1] not in _STOPS else ""
        row[8] = 1 if nxt in _UNITS else 2 if nxt.strip(".") in ORG else 3 if nxt == "&" else 0
    if not row[8] and text[b : b + 1] == "@":
        row[8] = 4
    if kind in (PHONE, ID):
        seps = _SEPARATORS.findall(s)
        row[2] = min(31, len(_DIGIT.findall(s)))
        row[3] = min(31, len(seps))
        row[4] = {"+": 1, "(": 2, "0": 3}.get(s[0], 0)
        kinds = {x.strip()[:1] or " " for x in seps}
        row[5] = 0 if not seps else 6 if len(kinds) > 1 else {" ": 1, ".": 2, "-": 3, "/": 4}.get(next(iter(kinds)), 5)
        row[10] = int(form == 1)
        groups = [len(g) for g in _DIGITS.findall(s)] or [0]
        row[11], row[12], row[13] = min(31, groups[0]), min(31, groups[-1]), min(31, max(groups))
        row[14] = 1 if "," in text[b : b + 1] and text[b + 1 : b + 4].strip()[:1].isdigit() else 2 if _GLUED.search(text[max(0, a - 4) : a]) else 0
        row[15] = int(_DATE.fullmatch(s) is not None)
    elif kind == NAME:
        signs = Signs(lex) if signs is None else signs
        shows = [signs[t] for t in _NAMES.findall(s)]
        first, last, some, inner = shows[0], shows[-1], 0, 0
        for x in shows:
            some |= x
        for x in shows[1:-1]:
            inner |= x
        row[2] = initial_m(text, a, b, lex.given)
        row[3] = len(shows)
        row[4] = 1 if first & GIVEN else 0
        row[5] = 1 if some & GIVEN_PART else 0
        row[10] = 1 if last & ENDING else 0
        row[11] = 1 if first & ENDING else 0
        row[12] = 1 if s.isupper() else 0
        row[13] = 1 if some & ORG_WORD else 0
        row[14] = 1 if some & LETTER else 0
        row[15] = (2 if "," in s else 0) + (1 if first & LOW_LETTER else 0)
        row[16] = 1 if a == 0 else 0
        lead = text[a - 4 : a]
        row[17] = 1 if text[a - 2 : a] == "& " or lead.endswith(("for ", "of ")) and _INSIDE.search(text[max(0, a - 45) : a]) else 0
        row[18] = 1 if text[b : b + 2] == " &" or text[b : b + 4] in (" of ", " for") else 0
        row[19] = (1 if first & PLAIN else 0) + (2 if last & PLAIN else 0)
        row[20] = 1 if inner & PLAIN else 0
    elif kind == EMAIL:
        row[3] = min(31, s.count("."))
        row[10] = int(bool(_LOCAL.search(s.split("@")[0].split(" ")[0])))
        row[11] = int(" at " in s)
        row[12] = int(_SPELLED.search(s) is not None)
        row[13] = int(re.split(r"[@\s\[({]", s)[0].lower() in lex.plain)
    elif kind == ADDRESS:
        row[2] = min(31, len(_DIGIT.findall(s)))
        row[3] = min(31, s.count(" "))
        row[4] = int(s[0].isdigit()) + 2 * int(s[-1].isdigit())
        row[5] = int(_UNIT.match(s) is not None)
        row[10] = int(_UNIT.search(text, max(0, a - 16), a) is not None)
        row[11] = int(re.search(r"(?:18|19|20)\d\d$", s) is not None)
        row[12] = int(text[b : b + 1] == ",")
    return row


def weak_label(text: str, c: Candidate, f: list[int]) -> int | None:
    """1, 0, or None where the rules abstain. Numbers and addresses are labelled by what stands around them only."""
    kind, a, b, form = c
    if kind == EMAIL:
        if f[8] == 4:  # another address goes on behind it
            return 0
        return 1 if not f[11] or f[12] else 0 if f[13] else None
    if kind == ADDRESS:
        return 0 if f[10] else 1 if f[7] == 9 else None
    if kind == PHONE:
        if f[8] == 1 or f[14] or f[7] in (2, 3, 4):
            return 0
        return 1 if f[7] == 1 else None
    if kind == ID:
        if f[7] in (1, 3, 4) or f[14] or f[8] == 1:
            return 0
        return 1 if f[7] == 2 or re.search(r"identi|pass|CNP|usweis|Номер", text[max(0, a - 60) : a]) else None
    if f[13] or f[17] or f[18] or f[8] in (2, 3):  # an organisation
        return 0
    if f[2] in (1, 4):  # the other reading of M. is the name
        return 0
    if f[6] == 6 and not f[5] and not f[10]:  # a place
        return 0
    if f[19] & 1 and form != 1:  # the sentence's first word
        return 0
    if f[6] == 5 and f[10]:  # a title stands before it
        return 1
    if form != 2 and (f[4] and f[10] or f[11] and f[5]):
        return 1
    return 0 if f[5] and not f[4] and not f[11] or f[14] and not f[10] and f[15] % 2 == 0 and not f[11] else None


#: Features that show what stands around a number; one copy of each is fitted without them.
_AROUND = [6, 7, 8, 14]
#: Features of a name that come from the list of given names, and those that show no name at all.
_LISTED, _SIGNS = [4, 5], [8, 13, 17, 18, 19]


def calibration(p: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float = 2.0) -> tuple[float, float]:
    """Slope and offset that calibrate log-odds of rows counted ``w`` times: Newton steps on the log-likelihood with a prior at the identity."""
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))
    a, b = 1.0, 0.0
    for _ in range(40):
        q = trees.sigmoid(a * z + b)
        h = w * np.maximum(q * (1 - q), 1e-9)
        g = np.array([(w * (q - y) * z).sum() + prior * (a - 1), (w * (q - y)).sum() + prior * b])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + prior, (h * z).sum()], [(h * z).sum(), h.sum() + prior]]), g)
        step *= min(1.0, 1.0 / max(1e-12, abs(step).max()))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Calibrated probabilities."""
    p = trees.predict(model["trees"], x)
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))
    a, b = model["calibration"][x[:, 0]].T
    return trees.sigmoid(a * z + b)


#: A candidate as it is written: its place, its weak label (-1 where the rules abstain) and its features, up to the trees' last bin.
_SPAN = np.dtype([("start", "<i4"), ("end", "<i4"), ("label", "i1"), ("features", "u1", (N_FEATURES,))])
_HEAD = struct.Struct("<iib")
_PLACE, _WIDTH = 8, _SPAN.itemsize  # bytes of the place and of all


def measured(texts: list[str | None], lex: Lexicon) -> list[bytes]:
    """For every text its candidates with labels and features, as bytes of ``_SPAN``."""
    signs, out = Signs(lex), []
    for t in texts:
        own = []
        for c in candidates(t, lex.given) if t else ():
            f = features(t, c, lex, signs)
            label = weak_label(t, c, f)
            own += (_HEAD.pack(c[1], c[2], -1 if label is None else label), bytes(f))
        out.append(b"".join(own))
    return out


def fitted(lex: Lexicon, x: np.ndarray, label: np.ndarray, held: np.ndarray, n: np.ndarray) -> dict:
    """Trees, calibration, thresholds, lexicon and report from distinct features and labels, whether they are held out, and how often they stand."""
    sure = label >= 0
    silent = int(n[~sure].sum())
    xs, ys, hs, ws = x[sure].astype(np.int64), label[sure].astype(np.int64), held[sure], n[sure].astype(float)
    blind = xs.copy()
    blind[:, _AROUND] = 0
    again = ~hs & np.isin(xs[:, 0], (PHONE, ID))
    # names whose given name no list holds: what still shows is the ending, the shape and the words around
    unlisted = xs.copy()
    unlisted[:, _LISTED] = 0
    named = ~hs & (xs[:, 0] == NAME) & ((ys == 1) | (xs[:, _SIGNS] > 0).any(axis=1))
    # and names whose title is hidden
    titled = ~hs & (xs[:, 0] == NAME) & (xs[:, 6] == 5)
    untitled = xs.copy()
    untitled[:, 6] = 0
    own = [~hs, again, named, titled]
    x_fit = np.concatenate([xs[~hs], blind[again], unlisted[named], untitled[titled]])
    fit = trees.fit(x_fit, np.concatenate([ys[o] for o in own]), w=np.concatenate([ws[o] for o in own]))
    model = {"trees": fit, "lexicon": lex}
    model["calibration"], model["thresholds"] = np.tile([1.0, 0.0], (len(KINDS), 1)), np.full(len(KINDS), 0.5)
    p = trees.predict(model["trees"], xs[hs]) if hs.any() else np.zeros(0)
    report = {"spans": int(ws.sum()) + silent, "labelled": int(ws.sum()), "silent": silent, "kinds": {}}
    for k in range(len(KINDS)):
        own = xs[hs][:, 0] == k
        t, w = ys[hs][own], ws[hs][own]
        if w.sum() >= 50 and 0 < (w * t).sum() < w.sum():
            model["calibration"][k] = calibration(p[own], t, w)
            q = scores(model, xs[hs][own])
            grid = np.linspace(0.2, 0.8, 13)
            quality = [2 * (w * t * (q >= g)).sum() / max(1, (w * t).sum() + (w * (q >= g)).sum()) for g in grid]
            model["thresholds"][k] = float(np.median(grid[np.array(quality) >= max(quality) - 1e-12]))
            report["kinds"][KINDS[k]] = (int(w.sum()), float(max(quality)))
    model["report"] = report
    return model


def train(texts: list[str]) -> dict:
    """The model of a list of texts."""
    lex = Lexicon(texts)
    found = measured(texts, lex)
    spans_ = np.frombuffer(b"".join(found), _SPAN)
    held = np.repeat(np.arange(len(texts)) % 100 < 100 * HELD_OUT, np.array([len(s) // _WIDTH for s in found], int))
    return fitted(lex, spans_["features"], spans_["label"], held, np.ones(len(spans_)))


def decide(model: dict, known: dict[bytes, tuple[int, float] | None], features_: Iterable[bytes]) -> None:
    """Adds to ``known`` the kind and the negative probability of features that pass, and None of others; each distinct row is scored once."""
    new = list(set(features_) - known.keys())
    if not new:
        return
    x = np.frombuffer(b"".join(new), np.uint8).reshape(-1, N_FEATURES).astype(np.int64)
    p = scores(model, x)
    for f, kind, q, passes in zip(new, x[:, 0].tolist(), p.tolist(), (p >= model["thresholds"][x[:, 0]]).tolist(), strict=True):
        known[f] = (kind, -q) if passes else None


def chosen(found: list[bytes], model: dict, known: dict[bytes, tuple[int, float] | None] | None = None) -> list[list[tuple[int, int, int]]]:
    """For every text's candidates the chosen (kind, start, end), in order. ``known`` keeps decisions from call to call."""
    out: list[list[tuple[int, int, int]]] = []
    known = {} if known is None else known
    head = _HEAD.size
    decide(model, known, (d[i + head : i + _WIDTH] for d in found for i in range(0, len(d), _WIDTH)))
    for d in found:
        own = []
        for i in range(0, len(d), _WIDTH):
            passed = known[d[i + head : i + _WIDTH]]
            if passed:
                (kind, q), (a, b, _) = passed, _HEAD.unpack_from(d, i)
                # a name inside another span gives way
                own.append((1, round(q, 2), a - b, a, i, kind, b) if kind == NAME else (0, a, a - b, q, i, kind, b))
        if len(own) > 1:
            own.sort()
        taken: list[tuple[int, int, int]] = []
        for f in own:
            kind, b = f[5], f[6]
            a = b + f[2]
            if all(b <= s or a >= e for _, s, e in taken):
                taken.append((kind, a, b))
        if len(taken) > 1:
            taken.sort(key=lambda f: f[1])
        out.append(taken)
    return out


def find(texts: list[str | None], model: dict) -> list[list[tuple[int, int, int]]]:
    """For every text the chosen (kind, start, end), in order."""
    return chosen(measured(texts, model["lexicon"]), model)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with a typed placeholder for every span."""
    parts, at = [], 0
    for kind, a, b in found:
        parts += [text[at:a], f"[{KINDS[kind]}]"]
        at = b
    return "".join([*parts, text[at:]])


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = load(spark, sf_dir, "contact_hit").select(F.col("hit_id").alias("row_key"), F.col("sentence").alias("text"))
    evidence = load(spark, sf_dir, "provenance").select(F.col("prov_id").alias("row_key"), "text")
    return hits.unionByName(evidence).where(F.col("text").isNotNull())


def _learned(rows: DataFrame, keep_text: bool = False) -> tuple[DataFrame, dict]:
    """The rows with their candidates, written once (row_key, text if it is kept, spans), and the model of them all."""
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Lexicon.of_rows(rows))
    held_out = F.pmod(F.xxhash64("row_key"), F.lit(100)) < int(100 * HELD_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measured(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=["row_key", "text", "held", "spans"])

    each = spread(rows.select("row_key", "text", held_out.alias("held"))).mapInArrow(run, "row_key string, text string, held boolean, spans binary")
    table = cut(each if keep_text else each.where(F.length("spans") > 0).drop("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for held, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[held].update([data[i + _PLACE : i + _WIDTH] for i in range(0, len(data), _WIDTH)])
            each = [(h, s, n) for h, own in counts.items() for s, n in own.items()]
            columns = zip(*each, strict=True) if each else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.bool_(), pa.binary(), pa.int64()], strict=True)], names=["held", "span", "n"])

    # distinct features and labels: small numbers, so few whatever the corpus' size
    counted = table.select("held", "spans").mapInArrow(count, "held boolean, span binary, n bigint").groupBy("held", "span").agg(F.sum("n").alias("n")).orderBy("span", "held").toArrow()
    held, data, n = (counted.column(i).to_pylist() for i in range(3))
    flat = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 1 + N_FEATURES)
    return table, fitted(shared.value, flat[:, 1:], flat[:, 0].view(np.int8) if len(flat) else np.zeros(0, np.int8), np.array(held, bool), np.array(n, np.int64))


def _model(rows: DataFrame) -> dict:
    return _learned(rows)[1]


def spans(rows: DataFrame) -> DataFrame:
    """row_key, kind, start_pos and end_pos of the personal information in ``rows`` (row_key, text)."""
    table, model = _learned(rows)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # forty small trees and the name lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}  # by distinct features, so small
        for batch in batches:
            keys, kinds, starts, ends = [], [], [], []
            for key, found in zip(batch.column(0).to_pylist(), chosen(batch.column(1).to_pylist(), shared.value, known), strict=True):
                for kind, a, b in found:
                    keys.append(key)
                    kinds.append(KINDS[kind])
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["row_key", "kind", "start_pos", "end_pos"])

    return spread(table.select("row_key", "spans")).mapInArrow(run, "row_key string, kind string, start_pos int, end_pos int")


def redacted(rows: DataFrame) -> DataFrame:
    """row_key and the text with typed placeholders, of every row with a text."""
    table, model = _learned(rows, keep_text=True)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            found = chosen(batch.column(2).to_pylist(), shared.value, known)
            clean = [redact(t, f) for t, f in zip(batch.column(1).to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], names=["row_key", "text"])

    return spread(table.select("row_key", "text", "spans")).mapInArrow(run, "row_key string, text string")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in contact_hit.sentence and provenance.text."""
    return spans(_rows(spark, sf_dir)).select("row_key", "kind", "start_pos").distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables' texts with typed placeholders."""
    return redacted(_rows(spark, sf_dir))


def p7_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees' report: spans of all rows, those that the rules label and those that only the trees decide, and held-out F1 per kind."""
    report = _model(_rows(spark, sf_dir))["report"]
    rows = [(k, report["spans"], report["labelled"], report["silent"], *report["kinds"].get(k, (0, None))) for k in KINDS]
    return spark.createDataFrame(rows, "kind string, n_spans bigint, n_labelled bigint, n_silent bigint, n_held_out bigint, held_out_f1 double")
