"""Provenance and edge aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Values of a fold that a double can tell apart: 2^-64 is below its precision.
WEIGHED = 64


def clamped(confidence: Column) -> Column:
    """Confidence within 0 and 1; null stays null, NaN becomes null."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(confidence, F.lit(None).cast("double"))))


def dedupe_provenance(df: DataFrame) -> DataFrame:
    """One row per (text, source_url) up to case and edge blanks: the first record's id, the highest confidence, the union of dates and the number of records.

    Null texts and sources form their own keys. Dates are kept sorted and distinct.
    """
    key = (F.lower(F.trim(F.coalesce("text", F.lit("")))).alias("text_key"), F.lower(F.trim(F.coalesce("source_url", F.lit("")))).alias("url_key"))
    once = df.groupBy(*key).agg(
        F.min("prov_id").alias("prov_id"),
        F.max(clamped(F.col("confidence"))).alias("confidence"),
        F.count("*").alias("n_records"),
    )
    # distinct dates combine before their shuffle, so a key with many records gathers its dates only
    dated = df.select(*key, F.explode("dates").alias("date")).distinct().groupBy("text_key", "url_key").agg(F.array_sort(F.collect_list("date")).alias("dates"))
    return once.join(dated, ["text_key", "url_key"], "left").select("text_key", "url_key", "prov_id", "confidence", F.coalesce("dates", F.array().cast("array<string>")).alias("dates"), "n_records")


def merge_reasons(df: DataFrame, edge: list[str], text: str, url: str) -> DataFrame:
    """Per edge and normalised text the sources joined by ``|||``; blank texts are dropped."""
    norm = F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " ")))
    rows = df.withColumn("reason", norm).where(F.col("reason") != "")
    return rows.groupBy(*edge, "reason").agg(F.array_join(F.array_sort(F.collect_set(url)), "|||").alias("urls"), F.count("*").alias("n"))


def encode_legacy(text: Column, url: Column, confidence: Column, dates: Column) -> Column:
    """``text|||url|||confidence:X[dates:a,b]``; missing parts are left out."""
    conf = F.when(confidence.isNotNull(), F.concat(F.lit("confidence:"), F.format_string("%.3f", confidence)))
    tail = F.concat(F.coalesce(conf, F.lit("")), F.when(F.size(dates) > 0, F.concat(F.lit("[dates:"), F.array_join(dates, ","), F.lit("]"))).otherwise(""))
    return F.concat_ws("|||", text, F.coalesce(url, F.lit("unknown")), F.nullif(tail, F.lit("")))


def decode_legacy(reason: Column) -> Column:
    """Struct (text, url, confidence, dates) of a legacy string; the marks are looked for from the end, so a text may hold them itself."""
    tail = r"(?s)^(.*?)\|\|\|([^|]*)(?:\|\|\|((?:confidence:[0-9.]+)?(?:\[dates:[^\]]*\])?))?$"
    rest = F.regexp_extract(reason, tail, 3)
    conf = F.nullif(F.regexp_extract(rest, r"confidence:([0-9.]+)", 1), F.lit(""))
    dates = F.nullif(F.regexp_extract(rest, r"\[dates:([^\]]*)\]", 1), F.lit(""))
    marked = reason.rlike(tail)
    return F.struct(
        F.when(marked, F.regexp_extract(reason, tail, 1)).otherwise(reason).alias("text"),
        F.coalesce(F.nullif(F.when(marked, F.regexp_extract(reason, tail, 2)), F.lit("")), F.lit("unknown")).alias("url"),
        conf.cast("double").alias("confidence"),
        F.when(dates.isNotNull(), F.split(dates, ",")).alias("dates"),
    )


def decode_legacy_list(reasons: Column) -> Column:
    """Structs of a list of legacy strings."""
    return F.transform(reasons, lambda r: decode_legacy(r))


def aggregate_edges(df: DataFrame, a: str, b: str, confidence: str, kind: str, date: str, seq: str) -> DataFrame:
    """Undirected edges: evidence count, mean confidence, most common kind (ties to the first seen), first and last date. Self-loops are dropped.

    Two hash aggregations; the first, by kind, also combines before its shuffle, so a heavy edge is never gathered in one place.
    """
    rows = df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col(confidence).alias("c"), F.col(kind).alias("k"), F.col(date).alias("d"), F.col(seq).alias("s"))
    by_kind = rows.groupBy("src", "dst", "k").agg(F.count("*").alias("n"), F.min("s").alias("first"), F.sum("c").alias("sc"), F.count("c").alias("nc"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    return by_kind.groupBy("src", "dst").agg(
        F.sum("n").alias("n_evidence"),
        (F.sum("sc") / F.sum("nc")).alias("confidence"),
        F.max(F.when(F.col("k").isNotNull(), F.struct("n", (-F.col("first")).alias("f"), "k")))["k"].alias("relation_type"),
        F.min("d0").alias("first_date"),
        F.max("d1").alias("last_date"),
    )


def folded_confidence(df: DataFrame, key: str, confidence: str, seq: str) -> DataFrame:
    """The order-dependent confidence of repeated merges, (old + new) / 2 in order of ``seq``; nulls are skipped.

    The fold is a sum of c / 2^k, k counted from the last, so only the last WEIGHED values of a key matter
    to a double; earlier ones weigh less than its precision.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(confidence).alias("_c"), F.col(seq).alias("_s"))
    last = rows.where("_c is not null").withColumn("_k", F.row_number().over(W.partitionBy("_key").orderBy(F.desc("_s")))).where(F.col("_k") <= WEIGHED)
    n = rows.groupBy("_key").agg(F.count("_c").alias("_n"))  # a key with nulls alone stays, with a null
    weight = F.when(F.col("_k") == F.col("_n"), F.pow(F.lit(0.5), F.col("_n") - 1)).otherwise(F.pow(F.lit(0.5), F.col("_k")))
    return n.join(last, "_key", "left").groupBy(F.col("_key").alias(key)).agg(F.sum(F.col("_c") * weight).alias("confidence"))


def most_common(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The most common value per key; ties go to the first seen."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).where("rank = 1").select(key, value, "n")
