"""Queries and SQL of the subpackage, by the names that the entry point registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import langid, mixture, names, neardup, pii, residue, scans, sitelines, tokens, truncated


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": residue.p1_found,
        "p1_kept": residue.p1_kept,
        "p1_fit": residue.p1_fit,
        "p2_found": langid.p2_found,
        "p2_segments": langid.p2_segments,
        "p3_found": sitelines.p3_found,
        "p3_cleaned": sitelines.p3_cleaned,
        "p3_tests": sitelines.p3_tests,
        "p4_found": names.p4_found,
        "p4_groups": names.p4_groups,
        "p5_found": neardup.p5_found,
        "p5_groups": neardup.p5_groups,
        "p6_found": scans.p6_found,
        "p6_repaired": scans.p6_repaired,
        "p7_found": pii.p7_found,
        "p7_redacted": pii.p7_redacted,
        "p7_fit": pii.p7_fit,
        "p8_ids": tokens.p8_ids,
        "p9_mixture": mixture.p9_mixture,
        "p9_shares": mixture.p9_shares,
        "p10_found": truncated.p10_found,
        "p10_shares": truncated.p10_shares,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": sitelines.P3_FOUND_SQL,
    }
