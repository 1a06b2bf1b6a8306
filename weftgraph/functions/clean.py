"""Cleaning of names, evidence and table text as column expressions; null in, null out."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that do not decompose, and what they are written as.
SPECIAL_LETTERS = {"ø": "o", "œ": "oe", "æ": "ae", "ß": "ss", "ð": "d", "þ": "th", "ł": "l", "đ": "d", "ı": "i"}
#: Cyrillic letters in ASCII.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "'", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
}
#: Typographic marks in ASCII.
MARKS = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "«": "<<", "»": ">>", "\u00a0": " "}
#: Titles before and suffixes after a name.
TITLES = r"\b(mr|mrs|ms|miss|dr|prof|professor|sir|lord|lady|rev|father|sister|brother)\b\.?\s*"
SUFFIXES = r",?\s*\b(phd|md|esq|jr|sr|ii|iii|iv|ceo|cto|cfo|president|director)\b\.?"


def _decomposed() -> tuple[str, str]:
    """Letters and the base letters they decompose to, by Unicode's own tables."""
    pairs = []
    for point in range(0xC0, 0x2000):
        c = chr(point)
        full = unicodedata.normalize("NFD", c)
        base = "".join(x for x in full if unicodedata.category(x) != "Mn")
        if len(full) > 1 and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _decomposed()


def strip_accents(text: Column) -> Column:
    """Without accents, inside code generation: decomposable letters become their base, combining marks go."""
    return F.regexp_replace(F.translate(text, _FROM, _TO), r"\p{Mn}+", "")


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return strip_accents(F.lower(text))


def _replace_all(text: Column, table: dict[str, str]) -> Column:
    singles = {a: b for a, b in table.items() if len(b) == 1}
    out = F.translate(text, "".join(singles), "".join(singles.values()))
    for a, b in table.items():
        if len(b) != 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize_name(text: Column) -> Column:
    """Lower case without accents, special letters spelled out, single blanks."""
    return F.trim(F.regexp_replace(_replace_all(fold(text), SPECIAL_LETTERS), r"\s+", " "))


def to_ascii(text: Column) -> Column:
    """ASCII spelling: accents dropped, special and Cyrillic letters and marks spelled out, other characters dropped."""
    upper = {a.upper(): b.capitalize() for a, b in {**SPECIAL_LETTERS, **CYRILLIC}.items() if len(a.upper()) == 1 and a.upper() != a and a != "ı"}
    table = {**SPECIAL_LETTERS, **CYRILLIC, **upper, **MARKS}
    # letters of the table first, since some of them decompose too
    return F.regexp_replace(strip_accents(_replace_all(text, table)), r"[^\x00-\x7F]", "")


def matching_key(text: Column) -> Column:
    """ASCII, lower case, single blanks: the form in which names of several languages are compared."""
    return F.trim(F.regexp_replace(F.lower(to_ascii(text)), r"\s+", " "))


def surface(text: Column) -> Column:
    """A mention without a trailing bracket and edge marks, with single blanks."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?s)\[[\p{L}\p{N}_]+.*?$", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^[^\p{L}\p{N}_\s]+", ""), r"[^\p{L}\p{N}_\s]+$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def pipeline_clean(text: Column) -> Column:
    """A text without digits before its first capital, leading symbols and edge marks, with single blanks."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\d+(?=[A-Z])", ""), r"^[^\p{L}\p{N}_\s]+", "")
    marks = r"[.,;:!?\-_'\"\\/@#$%^&*()\[\]{}|<> \t\n\r]+"
    bare = F.regexp_replace(bare, f"^{marks}|{marks}$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def alias(name: Column) -> Column:
    """A name without what follows a dash, brackets, titles, suffixes, possessives and quotes; the name itself where nothing is left."""
    x = F.regexp_replace(name, r"\s*[-–—|]\s*.*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*\([^)]*\)", ""), r"\s*\[[^\]]*\]", "")
    x = F.regexp_replace(F.regexp_replace(x, "(?i)" + TITLES, ""), "(?i)" + SUFFIXES, "")
    x = F.regexp_replace(F.regexp_replace(x, r"'s\b", ""), r"""^["']|["']$""", "")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"^[.,;:!?]+|[.,;:!?]+$", ""), r"\s+", " "))
    return F.coalesce(F.nullif(x, F.lit("")), F.trim(name))


def verifier_form(text: Column) -> Column:
    """Lower case, single blanks, no quotes."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "\"'“”‘’", ""), r"\s+", " "))


def path_name(query: Column) -> Column:
    """A query as a folder name: folded words joined by ``_``, at most 50 characters, ``query`` where none is left."""
    x = F.regexp_replace(F.lower(strip_accents(query)), r"[^\p{L}\p{N}_\s-]", "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[\s-]+", "_"), "_+", "_"), "^_|_$", "")
    x = F.regexp_replace(F.substring(x, 1, 50), "_+$", "")
    return F.coalesce(F.nullif(x, F.lit("")), F.when(query.isNotNull(), "query"))


def table_text(text: Column) -> Column:
    """A text with at least three pipes as one line: separator rows dropped, cells joined by a bullet; other texts as they are."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda r: ~r.rlike(r"^[|\s\-:]+$"))
    cells = lambda r: F.filter(F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)), lambda c: c != "")
    joined = F.transform(rows, lambda r: F.when(F.contains(r, F.lit("|")), F.array_join(cells(r), " • ")).otherwise(r))
    line = F.trim(F.regexp_replace(F.array_join(F.filter(joined, lambda r: r != ""), " "), r"\s{2,}", " "))
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(pipes < 3, text).otherwise(F.coalesce(F.nullif(line, F.lit("")), text))


def tables_text(tables: Column) -> Column:
    """Tables (an array of arrays of rows of cells) as text: a heading for each, and its rows with cells joined by a pipe."""
    rows = lambda t: F.array_join(F.transform(t, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
    return F.array_join(F.transform(tables, lambda t, i: F.concat(F.lit("=== Table "), (i + 1).cast("string"), F.lit(" ===\n"), rows(t))), "\n\n")


def evidence_parts(text: Column) -> Column:
    """The readable parts of an evidence text: citations, footnote marks and table marks removed, joined citations split, parts of three characters and less dropped.

    Where nothing is left, the text with single blanks. A leading single letter with a blank is taken for a footnote mark.
    """
    x = F.regexp_replace(text, r"\[.*?\]", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\(\s*\d{4}\s*\)", ""), r"(?i)\(\s*citation\s+needed\s*\)", "")

    def one(p: Column) -> Column:
        p = F.regexp_replace(F.trim(p), r"^[\[(]*\d+[\])]*[.:,;\s-]+", "")
        p = F.regexp_replace(p, r"^[\[(]*[a-zA-Z]\s+([a-zA-Z]\s+)?", "")
        p = F.regexp_replace(F.regexp_replace(p, r"\^+", ""), r"(?i)^\s*\b([a-f])\b\s+", "")
        p = table_text(p)
        p = F.regexp_replace(F.regexp_replace(p, r"\|{2,}", " | "), r"\s*\|\s*\|\s*", " | ")
        p = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "[-_]{3,}", ""), r"^\s*\|\s*", ""), r"\s*\|\s*$", "")
        return F.trim(F.regexp_replace(F.regexp_replace(p, r"\s+([,.;:!?])", "$1"), r"\s{2,}", " "))

    parts = F.filter(F.transform(F.split(x, r"\s*-\s*\^\s*"), one), lambda p: F.length(p) > 3)
    return F.when(F.size(parts) > 0, parts).when(text.isNotNull(), F.array(F.trim(F.regexp_replace(x, r"\s{2,}", " "))))


def display_name(label: Column, canonical: Column, original: Column, node: Column) -> Column:
    """The metadata's label, else the canonical one, else the original text of a node that is an identifier, else the node."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(label), some(canonical), F.when(node.rlike(r"^Q\d+$"), some(original)), node)


def contact_id(value: Column) -> Column:
    """An address in lower case, any other contact without trailing marks."""
    return F.when(value.rlike(r"^[^@\s]+@[^@\s]+$"), F.lower(value)).otherwise(F.regexp_replace(value, "[.,;:]+$", ""))
