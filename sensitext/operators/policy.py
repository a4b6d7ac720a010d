"""Block-or-redact policy per type."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.rules import Rules
from ..functions.spans import in_batches, numbered_column, redaction, resolve_overlaps, resolved_tokens_column, scan_column
from .base import literal_rows, with_once, with_tokens

REDACT, BLOCK = "redact", "block"
MESSAGE = "Request blocked by DLP policy: contains "


class Policy:
    """Type -> action, with types in upper case; any action but ``block`` means redact."""

    def __init__(self, actions: Mapping[str, str] | None = None):
        self.actions = {
            type_.upper(): BLOCK if action.lower() == BLOCK else REDACT
            for type_, action in (actions or {}).items()
        }

    @property
    def blocked_types(self) -> list[str]:
        return sorted(t for t, action in self.actions.items() if action == BLOCK)

    def to_df(self, spark: SparkSession) -> DataFrame:
        if not self.actions:
            return spark.createDataFrame([], "type string, action string")
        return literal_rows(spark, sorted(self.actions.items()), ["type", "action"])


def policy_result(matches: Column, policy: Policy) -> Column:
    """``struct<blocked,blocked_types,message>``; types in upper case, in order of first match."""
    passed = F.struct(
        F.lit(False).alias("blocked"), F.array().cast("array<string>").alias("blocked_types"),
        F.lit(None).cast("string").alias("message"),
    )
    if not policy.blocked_types:
        return passed
    types = F.array_distinct(
        F.filter(
            F.transform(matches, lambda m: F.upper(m["type"])), lambda t: t.isin(policy.blocked_types)
        )
    )
    return let(
        types,
        lambda ts: F.when(
            F.size(ts) > 0,
            F.struct(
                F.lit(True).alias("blocked"), ts.alias("blocked_types"),
                F.concat(F.lit(MESSAGE), F.array_join(ts, ", ")).alias("message"),
            ),
        ).otherwise(passed),
    )


def evaluate_policy(
    df: DataFrame, policy: Policy, matches: str = "matches", out: str = "policy"
) -> DataFrame:
    """Adds the policy result for each row's matches (the output of ``scan``)."""
    return df.withColumn(out, policy_result(F.col(matches), policy))


def policy_action(type_: Column, policy: Policy) -> Column:
    """The action for a type; redact where nothing is configured."""
    if not policy.actions:
        return F.lit(REDACT)
    pairs = [F.lit(part) for item in sorted(policy.actions.items()) for part in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(type_)), F.lit(REDACT))


def quarantine_split(
    df: DataFrame, policy: Policy, text: str = "text", rules: Rules = Rules(), before_overlap: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(clean rows with redacted text, blocked rows with the reason and the text as it was).

    The two frames read the source once each. To scan once, write ``classify`` out partitioned by ``blocked``.
    """
    rows = classify(df, policy, text, rules, before_overlap)
    blocked = rows.filter("blocked").drop("redacted", "items", "types", "ambiguous")
    clean = rows.filter(~F.col("blocked")).drop("blocked", "blocked_types", "message", text)
    return clean, blocked


def classify(
    df: DataFrame, policy: Policy, text: str = "text", rules: Rules = Rules(), before_overlap: bool = False
) -> DataFrame:
    """All rows with blocked, blocked_types, message, redacted, items and types, in one pass over the text.

    ``before_overlap`` lets the policy also see matches that lost against a longer one.
    """
    if before_overlap:
        seen = with_once(df, _all=scan_column(text, rules, True))
        judged = with_once(seen, _p=policy_result(F.col("_all"), policy))
        if in_batches(rules):
            # A plain column: who reads verdicts only has nothing numbered, and filters on verdicts go first.
            rows = judged.withColumn("_t", resolved_tokens_column("_all"))
        else:
            kept = judged.withColumn("_kept", resolve_overlaps(F.col("_all")))
            rows = with_once(kept, _t=numbered_column("_kept")).drop("_kept")
    else:
        rows = with_once(with_tokens(df, text, rules, "_t"), _p=policy_result(F.col("_t"), policy))
    return rows.withColumns(redaction(text, "_t")).select("*", "_p.*").drop("_p", "_t", "_all")


def policy_summary(spark: SparkSession, policy: Policy) -> DataFrame:
    """How many types are set to block and to redact."""
    return policy.to_df(spark).groupBy("action").count()
