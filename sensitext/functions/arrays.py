"""Column helpers over arrays that stay cheap for long arrays."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often (or deep in lambdas) body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_array(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running totals (inclusive) of an integer array under an associative ``combine``.

    ``aggregate`` copies its whole state at every step, so a state that collects results costs time in the
    square of the array. Here each total is put together from its own block of ``width`` and the blocks
    before it: about n * width / 2 + (n / width) ** 2 / 2 cheap steps.
    """

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(zero), combine)

    def in_blocks(blocks: Column) -> Column:
        def with_totals(totals: Column) -> Column:
            def block_rows(block: Column, k: Column) -> Column:
                before = total(F.slice(totals, F.lit(1), k))

                def rows(offset: Column) -> Column:
                    return F.transform(
                        block, lambda _, i: combine(offset, total(F.slice(block, F.lit(1), i + 1)))
                    )

                return let(before, rows)

            return F.flatten(F.transform(blocks, block_rows))

        return let(F.transform(blocks, total), with_totals)

    def cut(args: Column) -> Column:
        whole, width = args["values"], args["width"]
        starts = F.sequence(F.lit(0), F.size(whole) - 1, width)
        blocks = F.transform(starts, lambda at: F.slice(whole, at + 1, width))
        return F.when(F.size(whole) > 0, let(blocks, in_blocks)).otherwise(empty_array("int"))

    def with_width(whole: Column) -> Column:
        # The cube root of 2n makes the two terms of the cost equal.
        width = F.greatest(F.lit(4), F.floor(F.cbrt(2 * F.size(whole))).cast("int"))
        return let(F.struct(whole.alias("values"), width.alias("width")), cut)

    return let(values, with_width)


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b, 0)


def running_max(values: Column) -> Column:
    """Running maximum of values that are at least -1."""
    return running(values, lambda a, b: F.greatest(a, b), -1)


def remembered(build: Callable) -> Callable:
    """Keeps the columns ``build`` made for its (hashable) arguments.

    A large expression takes the driver half a second to put together. Columns are immutable and refer to
    names only, so calls that repeat, such as one per micro-batch, share them within a Spark context.
    """

    @lru_cache(maxsize=256)
    def made(context, *args):
        return build(*args)

    @wraps(build)
    def call(*args):
        return made(SparkContext._active_spark_context, *args)

    return call
