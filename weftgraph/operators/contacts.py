"""Contacts in text as a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.constants import DATE_LIKE, EMAIL_PATTERN, PHONE_PATTERN, SOCIAL_PATTERN


def contact_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value) of e-mail addresses (lower case), phone numbers (digits, with a leading plus) and profile addresses (without query and trailing marks).

    A phone number has at least seven digits and does not look like a date or a span of years. Null texts give no rows.
    """

    def found(pattern: str, kind: str):
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(found(EMAIL_PATTERN, "EMAIL"), found(PHONE_PATTERN, "PHONE"), found(SOCIAL_PATTERN, "SOCIAL"))).alias("h"))
    v = F.col("h.value")
    digits = F.regexp_replace(v, "[^0-9]", "")
    phone = F.concat(F.when(v.startswith("+"), "+").otherwise(""), digits)
    social = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"[.,;:]+$", ""), r"\?.*$", ""), "/+$", "")
    value = F.when(F.col("h.kind") == "EMAIL", F.lower(v)).when(F.col("h.kind") == "PHONE", phone).otherwise(social)
    good = (F.col("h.kind") != "PHONE") | ((F.length(digits) >= 7) & ~v.rlike(DATE_LIKE))
    return rows.where(good).select(key, F.col("h.kind").alias("kind"), value.alias("value"))
