"""Display formats and small payload builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int, ties_up: bool = False) -> Column:
    """A non-negative double with a fixed number of decimals, rounded by its exact binary value.

    Exact ties go to the even digit, or up with ``ties_up``. ``format_string`` rounds the shortest decimal
    form instead, which differs for values such as 1.005. The distance to the tie is summed in powers
    of two of ``x``, largest first; every partial sum is exact.
    """
    scale = 10**digits
    below = F.floor(x * scale)
    powers = [1 << p for p in range((2 * scale).bit_length() - 1, -1, -1) if 2 * scale >> p & 1]
    distance = x * powers[0] - (below * 2 + 1).cast("double")
    for power in powers[1:]:
        distance = distance + x * power
    tie = F.lit(True) if ties_up else below % 2 == 1
    units = below + F.when((distance > 0) | ((distance == 0) & tie), 1).otherwise(0)
    whole, part = F.floor(units / scale), units % scale
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), digits, "0"))


def format_tokens(n: Column) -> Column:
    """999, 1.2K, 3.4M (one decimal)."""

    def short(unit: int, suffix: str) -> Column:
        return F.concat(fixed(n / F.lit(unit), 1, ties_up=True), F.lit(suffix))

    return F.when(n >= 1_000_000, short(1_000_000, "M")).when(n >= 1_000, short(1_000, "K")).otherwise(
        n.cast("string")
    )


def format_usd(amount: Column) -> Column:
    """Dollars with four decimals, as the dashboard shows them."""
    return F.concat(F.lit("$"), fixed(amount, 4, ties_up=True))


def format_duration(seconds: Column) -> Column:
    """59s, 1m 1s, 1h 1m for whole seconds."""

    def whole(value: Column) -> Column:
        return F.floor(value).cast("string")

    hours = F.concat(whole(seconds / 3600), F.lit("h "), whole((seconds % 3600) / 60), F.lit("m"))
    minutes = F.concat(whole(seconds / 60), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s")))
        .when(seconds < 3600, minutes)
        .otherwise(hours)
    )


def percent(part: Column, total: Column) -> Column:
    """Whole percent, halves rounded up; 0 for an empty total."""
    share = F.floor(part * 100.0 / total + 0.5)
    return F.when(total > 0, share).otherwise(F.lit(0)).cast("bigint")


def error_payload(status: Column, message: Column, error_type: str = "gateway_error") -> Column:
    """The JSON body of a refused request; ``error_type`` names the service that refused it."""
    return F.to_json(
        F.struct(
            F.struct(status.alias("code"), message.alias("message"), F.lit(error_type).alias("type")).alias("error")
        )
    )
