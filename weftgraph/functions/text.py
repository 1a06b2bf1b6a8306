"""Text functions as column expressions, and the few that need Unicode tables as Arrow UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.constants import COMMON_WORDS, INVALID_WORDS, NAV_WORDS
from weftgraph.functions.clean import matching_key, to_ascii


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def remove_the(text: Column) -> Column:
    return F.regexp_replace(text, r"^[Tt][Hh][Ee][ \t]+", "")


def remove_possessive(text: Column) -> Column:
    return F.regexp_replace(text, "['’`´]s$", "")


def remove_parenthetical(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", ""), r"\[[^\[\]]*\]", ""))


def clean_name(name: Column) -> Column:
    """Node name without article, possessive, brackets and page artefacts; null when it is no name: shorter than two characters, of more than eight words, only stop words, or with sentence marks."""
    x = remove_parenthetical(remove_possessive(remove_the(name)))
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"[ ]*['`´’][ ]*[A-Za-z0-9_]+$", ""), r"\[[A-Za-z0-9_]+$", ""), r"^[A-Za-z0-9_]+\]", "")
    x = squeeze(x)
    words = F.split(F.lower(x), " ")
    valid = (F.length(x) >= 2) & (F.size(words) <= 8) & ~F.forall(words, lambda w: w.isin(*INVALID_WORDS)) & ~x.rlike(r"[?!]|\.\.\.") & x.rlike(r"[\p{L}\p{N}]")
    return F.when(valid, x)


def unification_key(name: Column) -> Column:
    """Letters and digits of the name's ASCII form, so that accents do not part spellings."""
    return F.regexp_replace(matching_key(name), "[^a-z0-9]", "")


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(squeeze(F.lower(name)), " ")), " ")


def quality_ratios(text: Column) -> tuple[Column, Column]:
    """Share of letters among the characters, and of common English words among the words."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text)
    words = F.split(squeeze(F.lower(text)), " ")
    common = F.size(F.filter(words, lambda w: F.regexp_replace(w, r"^[.,!?()\[\]{}]+|[.,!?()\[\]{}]+$", "").isin(*COMMON_WORDS)))
    return letters, common / F.size(words)


def is_quality(text: Column) -> Column:
    """At least 100 characters, half of them letters, and one word in twenty a common English one."""
    letters, common = quality_ratios(text)
    return (F.length(text) >= 100) & (letters >= 0.5) & (common >= 0.05)


def is_good_block(b: Column, low: Column) -> Column:
    """Content rather than page furniture: long enough, few symbols, digits and marks, no navigation words, not crowded with addresses. The cheap tests come first; ``low`` is the block in lower case."""

    def count(pattern: str) -> Column:
        return F.length(b) - F.length(F.regexp_replace(b, pattern, ""))

    nav = reduce(or_, [F.contains(low, F.lit(w)) for w in NAV_WORDS])
    crowded = ((F.length(b) - F.length(F.replace(b, F.lit("@"), F.lit(""))) > 10) | (F.length(low) - F.length(F.replace(low, F.lit("http"), F.lit(""))) > 40)) & (count(r"\p{L}") < 30)
    dense = count("[.,;:!?–—-]") > 2 * F.size(F.split(squeeze(b), " "))
    symbols, digits = count(r"[\[\]{}()©®™|→←↑↓•·»«]") <= 0.15 * F.length(b), count(r"\p{Nd}") <= 0.4 * F.length(b)
    return (F.length(b) >= 40) & ~nav & symbols & digits & ~dense & ~crowded


def good_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, b) of the blocks of a page that are content.

    Blocks and their lower case are made once, below the row generator, so that the compiled tests read them
    instead of making them again for every word.
    """
    pieces = lambda c: F.transform(F.split(c, "\n\n"), lambda x: strip(x))
    pairs = F.arrays_zip(pieces(F.col(text)).alias("b"), pieces(F.lower(text)).alias("low"))
    blocks = df.where(F.col(text).isNotNull()).select(key, F.explode(pairs).alias("p"))
    return blocks.where(is_good_block(F.col("p.b"), F.col("p.low"))).select(key, F.col("p.b").alias("b"))


def ascii_fold(name: str | Column) -> Column:
    """ASCII spelling of a column; null stays null."""
    return to_ascii(F.col(name) if isinstance(name, str) else name)


@F.pandas_udf(T.DoubleType())
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-blocks ratio, at least 0.9 for containment and 0.88 for a subset of words."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        x, y = x.lower().strip(), y.lower().strip()
        ratio = SequenceMatcher(None, x, y).ratio()
        if x and y and (x in y or y in x):
            ratio = max(ratio, 0.9)
        if x and y and (set(x.split()) <= set(y.split()) or set(y.split()) <= set(x.split())):
            ratio = max(ratio, 0.88)
        return ratio

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunks(s: pd.Series) -> pd.Series:
    """Chunks of at most 2,500 characters: paragraphs packed, long ones split at sentences, then words."""
    most = 2500

    def pack(pieces: list[str], glue: str, finer) -> list[str]:
        out, current = [], ""
        for p in pieces:
            if len(p) > most:
                if current:
                    out.append(current)
                    current = ""
                out += finer(p)
            elif current and len(current) + len(glue) + len(p) > most:
                out.append(current)
                current = p
            else:
                current = f"{current}{glue}{p}" if current else p
        return [*out, current] if current else out

    def hard(p: str) -> list[str]:
        return [p[i : i + most] for i in range(0, len(p), most)]

    def words(p: str) -> list[str]:
        return pack(p.split(), " ", hard)

    def sentences(p: str) -> list[str]:
        return pack([x for x in p.replace("! ", "!\0").replace("? ", "?\0").replace(". ", ".\0").split("\0") if x], " ", words)

    return s.map(lambda x: None if x is None else pack([p for p in x.split("\n\n") if p.strip()], "\n\n", sentences))
