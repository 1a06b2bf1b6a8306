"""Dates in text, nearest-date and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Months by their first three letters.
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def normalize_date(text: Column) -> Column:
    """ISO form of a date: a range of years, a full date, a month with its year, or a bare year; null for anything else."""
    span = r"^(?:between |from )?(\d{4}) (?:to|and|-) (\d{4})$"
    full, month, year = r"^(\d{4})[-/](\d{2})[-/](\d{2})$", r"^([a-z]{3,9})\.? (\d{4})$", r"^\d{4}$"
    low = F.lower(F.trim(text))
    number = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.substring(F.regexp_extract(low, month, 1), 1, 3))
    return (
        F.when(low.rlike(span), F.concat(F.regexp_extract(low, span, 1), F.lit("-01-01/"), F.regexp_extract(low, span, 2), F.lit("-12-31")))
        .when(low.rlike(full), F.regexp_replace(low, "/", "-"))
        .when(low.rlike(month) & (number > 0), F.concat(F.regexp_extract(low, month, 2), F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("-01")))
        .when(low.rlike(year), F.concat(low, F.lit("-01-01")))
    )


def date_type(iso: Column) -> Column:
    return F.when(F.contains(iso, F.lit("/")), "range").when(iso.endswith("-01-01"), "year_only").when(iso.endswith("-01"), "month_year").when(iso.isNotNull(), "full_date")


def years_in(text: Column) -> Column:
    """Years that follow since, from, in, during or on, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:since|from|in|during|on)\s+(\d{4})\b"), F.lit(1))


def antecedent(df: DataFrame, group: str, order: list[str], value: str, is_antecedent: Column) -> DataFrame:
    """Every row with the value of the latest earlier row of its group that can be an antecedent."""
    before = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("antecedent", F.last(F.when(is_antecedent, F.col(value)), ignorenulls=True).over(before))


def nearest_within(df: DataFrame, group: str, at: str, key: str, reach: int) -> DataFrame:
    """Distance to the nearest other row of the group, where it is at most ``reach``; neighbours in order suffice, so nothing is paired.

    A group is split into stretches of its offsets, each with the rows within ``reach`` of it, so a group with a
    third of all rows is spread over as many tasks as it has stretches.
    """
    wide = 20 * reach
    rows = df.where(F.col(at).isNotNull() & F.col(group).isNotNull())
    stretch = F.explode(F.array_distinct(F.array(F.floor((F.col(at) - reach) / wide), F.floor(F.col(at) / wide), F.floor((F.col(at) + reach) / wide))))
    w = W.partitionBy(group, "_stretch").orderBy(at, key)
    gap = F.least(F.col(at) - F.lag(at).over(w), F.lead(at).over(w) - F.col(at))
    near = rows.withColumn("_stretch", stretch).withColumn("distance", gap)
    return near.where((F.col("_stretch") == F.floor(F.col(at) / wide)) & (F.col("distance") <= reach)).drop("_stretch")
