"""Find sensitive values in a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..functions.spans import match_types, scan_column
from .base import explode_rows, with_once


def scan(
    df: DataFrame, text: str = "text", rules: Rules = Rules(), out: str = "matches", overlaps: bool = False
) -> DataFrame:
    """Adds the matches of each text: ``array<struct<start,end,type,value>>``, ordered by position."""
    return with_once(df, **{out: scan_column(text, rules, overlaps)})


def findings(
    df: DataFrame,
    keys: list[str],
    text: str = "text",
    rules: Rules = Rules(),
    byte_offsets: bool = False,
) -> DataFrame:
    """One row per match: the key columns, start, end, type, value. No shuffle.

    ``byte_offsets`` adds ``start_byte`` and ``end_byte``, positions in the UTF-8 form of the text.
    """
    kept = list(dict.fromkeys([*keys, text]))
    if not byte_offsets:
        return explode_rows(scan(df.select(*kept), text, rules, "_m"), keys, "_m", "start")
    rows = explode_rows(scan(df.select(*kept), text, rules, "_m"), kept, "_m", "start")
    before = F.octet_length(F.substring(F.col(text), F.lit(1), F.col("start")))
    return rows.select(
        *keys, "start", "end", "type", "value", before.alias("start_byte"),
        (before + F.octet_length("value")).alias("end_byte"),
    )


def pii_types(df: DataFrame, text: str = "text", rules: Rules = Rules(), out: str = "types") -> DataFrame:
    """Adds the distinct types found in each text, in order of first appearance."""
    scanned = scan(df, text, rules, "_m")
    return scanned.withColumn(out, match_types(F.col("_m"))).drop("_m")


def pii_counts(
    df: DataFrame,
    by: list[str] | None = None,
    text: str = "text",
    rules: Rules = Rules(),
    approximate: bool = False,
) -> DataFrame:
    """Matches and distinct values per type, over the table or per group of ``by``.

    Partial counts are made before the shuffle, which is on (group, type, value), so a hot group is spread.
    """
    by = by or []
    rows = explode_rows(scan(df.select(*dict.fromkeys([*by, text])), text, rules, "_m"), by, "_m", "start")
    if approximate:
        return rows.groupBy(*by, "type").agg(
            F.count("*").alias("findings"), F.approx_count_distinct("value").alias("distinct_values")
        )
    per_value = rows.groupBy(*by, "type", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy(*by, "type").agg(
        F.sum("n").alias("findings"), F.count("*").alias("distinct_values")
    )
