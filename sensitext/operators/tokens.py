"""Replace matches by numbered placeholders and put the values back.

The scope of a numbering is one row by default: all of it is then row-local. With ``scope=[...]`` the rows
of a scope (a conversation, a source) share one numbering; values are then numbered over the cluster.
Raw values leave these operators only through ``token_map``, ``redact_table(with_map=True)`` and
``restore``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..functions.spans import (
    has_placeholder,
    in_batches,
    match_types,
    placeholder,
    placeholders_in,
    redaction,
    replace_spans,
    restore_text,
    token_mapping,
    tokens_column,
)
from ..settings import cut_lineage
from .base import explode_rows, with_once, with_tokens
from .detect import scan
from .ordering import rank_rows


def redact(
    df: DataFrame,
    text: str = "text",
    rules: Rules = Rules(),
    with_map: bool = False,
) -> DataFrame:
    """Adds the redacted text, the number of replacements and the types; scope is the row.

    ``ambiguous`` marks inputs that already hold placeholder-like text and may not restore exactly.
    ``with_map`` adds ``tokens``, a map from placeholder to raw value.
    """
    scanned = with_tokens(df, text, rules, "_t")
    columns = dict(redaction(text, "_t"))
    if with_map:
        columns["tokens"] = token_mapping(F.col("_t"))
    return scanned.withColumns(columns).drop("_t")


def restore(df: DataFrame, text: str = "redacted", tokens: str = "tokens", out: str = "restored") -> DataFrame:
    """Adds the text with the placeholders of the row's own map replaced by their values."""
    return df.withColumn(out, restore_text(F.col(text), F.col(tokens)))


def token_map(df: DataFrame, keys: list[str], text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per distinct value of each row: the keys, token, type, ordinal, value (raw!)."""
    texts = df.select(*dict.fromkeys([*keys, text]))
    if in_batches(rules):
        rows = explode_rows(with_once(texts, _n=tokens_column(text, rules, True)), keys, "_n", "token")
        return rows.select(*keys, "token", F.col("token_type").alias("type"), "ordinal", "value")
    numbered = with_tokens(texts, text, rules, "_n")
    distinct = F.array_distinct(
        F.transform(
            "_n",
            lambda m: F.struct(
                m["token"].alias("token"), m["token_type"].alias("type"),
                m["ordinal"].alias("ordinal"), m["value"].alias("value"),
            ),
        )
    )
    scanned = numbered.select(*keys, distinct.alias("_t"))
    return explode_rows(scanned, keys, "_t", "token")


def assign_tokens(found: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Numbers the values of each scope over many rows: (scope, token, type, ordinal, value).

    ``found`` is the output of ``findings`` with the scope columns; ``order`` says which row came first
    (matches of one row follow by start). First appearances are aggregated per (scope, value) before the
    shuffle and ranked in range slices, so one scope may hold most of the table.
    """
    first = found.groupBy(*scope, "value").agg(
        F.min(F.struct(*[F.col(c) for c in order], F.col("start"), F.col("type"))).alias("_first")
    )
    places = [f"_o{i}" for i in range(len(order))]
    first = first.select(
        *scope, "value", F.col("_first.type").alias("type"),
        *[F.col(f"_first.{c}").alias(p) for c, p in zip(order, places)],
        F.col("_first.start").alias("_start"),
    )
    ranked = rank_rows(first, [*scope, "type"], [*places, "_start"], "ordinal")
    return ranked.select(
        *scope, placeholder(F.col("type"), F.col("ordinal")).alias("token"), "type",
        F.col("ordinal").cast("int").alias("ordinal"), "value",
    )


def token_stats(tokens: DataFrame, scope: list[str]) -> DataFrame:
    """Distinct values per type in each scope, from a token map."""
    return tokens.groupBy(*scope, "type").agg(F.count("*").alias("unique_values"))


def _same(left: str, right: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]


def _replaced(df: DataFrame, keys: list[str], spans: DataFrame, text: str, out: str) -> DataFrame:
    """Joins per-row replacement spans (start, end, put) to the texts and applies them.

    ``spans`` carries the hash of the text it was found in, so rows with equal keys never get each other's spans;
    equal rows have equal spans, and each is applied once.
    """
    on = [*keys, "_text"]
    per_row = spans.groupBy(*on).agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "type", "put"))).alias("_spans")
    )
    joined = df.withColumn("_text", F.xxhash64(text)).alias("d").join(per_row.alias("p"), _same("d", "p", on), "left")
    joined = joined.select("d.*", "p._spans").drop("_text")
    no_spans = F.array().cast("array<struct<start:int,end:int,type:string,put:string>>")
    joined = joined.withColumn("_spans", F.coalesce("_spans", no_spans))
    return joined.withColumn(out, replace_spans(F.col(text), F.col("_spans"), "put"))


def redact_table(
    df: DataFrame, keys: list[str], scope: list[str], text: str = "text", rules: Rules = Rules()
) -> tuple[DataFrame, DataFrame]:
    """Redacts with one numbering per scope: (the table with ``redacted``, ``items``, ``types``; its token map).

    Rows are numbered in the order of ``keys``; rows with equal keys are kept apart by a hash of their text and
    follow its order. The texts are shuffled once, to meet their placeholders; everything else moves matches
    only. Matches and tokens, with raw values, go to the scratch folder when this function is called.
    """
    columns = list(dict.fromkeys([*keys, *scope, text]))
    own = list(dict.fromkeys([*keys, *scope, "_text"]))
    # The texts are scanned once; the matches, which are small next to them, are read three times.
    found = cut_lineage(
        explode_rows(
            scan(df.select(*columns).withColumn("_text", F.xxhash64(text)), text, rules, "_m"), own, "_m", "start"
        ),
        "findings",
    )
    tokens = cut_lineage(assign_tokens(found, scope, [*keys, "_text"]), "tokens")
    spans = (
        found.alias("f")
        .join(tokens.alias("t"), _same("f", "t", [*scope, "value"]))
        .select("f.*", F.col("t.token").alias("put"))
    )
    redacted = _replaced(df, keys, spans, text, "redacted")
    out = redacted.withColumns(
        {
            "items": F.size("_spans"),
            "types": match_types(F.col("_spans")),
            "ambiguous": has_placeholder(F.col(text)),
        }
    )
    return out.drop("_spans", text), tokens


def restore_table(
    df: DataFrame, keys: list[str], scope: list[str], tokens: DataFrame, text: str = "redacted"
) -> DataFrame:
    """Puts the values of a scope's token map back into texts of that scope, in one pass per text.

    Placeholders are looked up by (scope, token), so a scope's map is never gathered in one place.
    """
    kept = list(dict.fromkeys([*keys, *scope, "_text"]))
    rows = df.withColumn("_text", F.xxhash64(text)).select(*dict.fromkeys([*kept, text]))
    seen = explode_rows(with_once(rows, _p=placeholders_in(F.col(text))), kept, "_p", "start")
    known = (
        seen.withColumnRenamed("value", "token").alias("f")
        .join(tokens.alias("t"), _same("f", "t", [*scope, "token"]))
        .select(*[f"f.{k}" for k in kept], "f.start", "f.end", "f.type", F.col("t.value").alias("put"))
    )
    return _replaced(df, keys, known, text, "restored").drop("_spans")
