"""Token usage, cost and budgets.

Costs are derived from integer token totals, so a result does not depend on the order of additions.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.formats import fixed
from ..settings import DEFAULTS
from .base import with_once
from .ordering import total_before

COUNTS = ("prompt_tokens", "completion_tokens", "total_tokens")


def _member(whole: Column, name: str) -> Column:
    """A member of a JSON object: the one of exactly this name, else the first whose name differs only in case."""
    members = F.try_variant_get(whole, "$", "map<string,variant>")
    alike = F.map_values(F.map_filter(members, lambda key, _: F.lower(key) == name))
    # The map of all members is only made where no name is exact.
    return F.coalesce(F.try_variant_get(whole, f"$.{name}", "variant"), F.get(alike, F.lit(0)))


def usage_of(body: Column) -> Column:
    """``struct<input_tokens,output_tokens>`` of a response body.

    Null where the body is not JSON, a count is anything but a whole 64-bit number or null (digits in quotes and
    fractions are not counts), or both counts are zero. Names of members match in any case.
    """

    def judged(found: Column) -> Column:
        given, taken = (
            F.coalesce(F.try_variant_get(found[name], "$", "bigint"), F.lit(0).cast("bigint")) for name in COUNTS[:2]
        )
        sound = reduce(
            lambda a, b: a & b,
            [F.coalesce(F.schema_of_variant(found[name]).isin("BIGINT", "VOID"), F.lit(True)) for name in COUNTS],
        )
        return F.when(sound & ((given != 0) | (taken != 0)), F.struct(given.alias("input_tokens"), taken.alias("output_tokens")))

    def counts(usage: Column) -> Column:
        return let(F.struct(*[_member(usage, name).alias(name) for name in COUNTS]), judged)

    # One evaluation of each step, whatever reads it.
    return let(F.try_parse_json(body), lambda whole: let(_member(whole, "usage"), counts))


def parse_usage(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses that report usage, with input_tokens and output_tokens; the others are dropped."""
    parsed = with_once(responses, _u=usage_of(F.col(body)))
    return parsed.filter("_u is not null").select("*", "_u.*").drop("_u")


def cost_usd(
    input_tokens: Column,
    output_tokens: Column,
    price_in: float | Column = DEFAULTS.price_in,
    price_out: float | Column = DEFAULTS.price_out,
) -> Column:
    """Cost at prices per million tokens."""

    def part(tokens: Column, price: float | Column) -> Column:
        return tokens / F.lit(1e6) * (price if isinstance(price, Column) else F.lit(float(price)))

    return part(input_tokens, price_in) + part(output_tokens, price_out)


def with_cost(
    usage: DataFrame, price_in: float = DEFAULTS.price_in, price_out: float = DEFAULTS.price_out
) -> DataFrame:
    return usage.withColumn(
        "cost_usd", cost_usd(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out)
    )


def spend_by_user(
    usage: DataFrame, user: str = "user", price_in: float = DEFAULTS.price_in,
    price_out: float = DEFAULTS.price_out,
) -> DataFrame:
    """input_tokens, output_tokens and estimated_usd per user."""
    totals = usage.groupBy(user).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
    cost = cost_usd(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out)
    return totals.withColumn("estimated_usd", cost)


def spend_totals(
    usage: DataFrame, price_in: float = DEFAULTS.price_in, price_out: float = DEFAULTS.price_out
) -> DataFrame:
    """One row: total_input, total_output, total_usd."""
    total = usage.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output"),
    )
    return total.withColumn(
        "total_usd", cost_usd(F.col("total_input"), F.col("total_output"), price_in, price_out)
    )


def user_group(requests: DataFrame, user: str = "user", group: str = "group", order: tuple = ("ts", "request_id")):
    """The group each user was last seen with."""
    return requests.groupBy(user).agg(F.max_by(group, F.struct(*order)).alias(group))


def budget_of(group: Column, budgets: Mapping[str, float]) -> Column:
    """The positive budget of a group, else null. ``budgets`` is configuration, not data."""
    pairs = [F.lit(x) for name, usd in sorted(budgets.items()) if usd > 0 for x in (name, float(usd))]
    return F.element_at(F.create_map(*pairs), group) if pairs else F.lit(None).cast("double")


def budget_message(group: Column, spent: Column, budget: Column) -> Column:
    return F.concat(
        F.lit("budget exceeded for group "), group, F.lit(": $"), fixed(spent, 2), F.lit(" / $"), fixed(budget, 2)
    )


def budget_status(
    spend: DataFrame, groups: DataFrame, budgets: Mapping[str, float], user: str = "user",
    group: str = "group", scope: str = "user", price_in: float = DEFAULTS.price_in,
    price_out: float = DEFAULTS.price_out,
) -> DataFrame:
    """Spend against the budget of the user's group: group, spent_usd, budget_usd, exceeded, message.

    A budget is compared with the user's own spend, or with the whole group's if ``scope="group"``.
    """
    joined = spend.join(groups.select(user, group), user, "left")
    if scope == "group":
        joined = joined.filter(F.col(group).isNotNull()).groupBy(group).agg(
            F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
        )
        joined = joined.withColumn(
            "estimated_usd", cost_usd(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out)
        )
    keys = [group] if scope == "group" else [user, group]
    out = joined.select(
        *keys, F.col("estimated_usd").alias("spent_usd"), budget_of(F.col(group), budgets).alias("budget_usd")
    )
    exceeded = F.coalesce(F.col("spent_usd") >= F.col("budget_usd"), F.lit(False))
    message = budget_message(F.col(group), F.col("spent_usd"), F.col("budget_usd"))
    return out.withColumn("exceeded", exceeded).withColumn("message", F.when(F.col("exceeded"), message))


def budget_gate(
    requests: DataFrame,
    budgets: Mapping[str, float],
    user: str = "user",
    group: str = "group",
    ts: str = "ts",
    order: str = "request_id",
    scope: str = "user",
    cell: str = "1 minute",
    price_in: float = DEFAULTS.price_in,
    price_out: float = DEFAULTS.price_out,
) -> DataFrame:
    """Replays the budget over a log with input_tokens/output_tokens (null = no usage).

    Adds spent_before and budget_error: a request is refused if the spend before it has reached the
    budget of its group. Refused requests cost nothing, but once refused a user stays refused, so a
    running total of all usage decides the same way. ``cell`` is the time slice one task sums row by row.
    """
    keys = [group] if scope == "group" else [user]
    cells = F.window(F.col(ts), cell).getField("start")
    totals = total_before(
        requests, keys, [ts, order], cells, {"_in": "input_tokens", "_out": "output_tokens"}
    )
    spent = cost_usd(F.col("_in"), F.col("_out"), price_in, price_out)
    budget = budget_of(F.col(group), budgets)
    refused = F.col("spent_before") >= budget
    return (
        totals.withColumn("spent_before", spent)
        .withColumn("budget_error", F.when(refused, budget_message(F.col(group), F.col("spent_before"), budget)))
        .drop("_in", "_out")
    )
