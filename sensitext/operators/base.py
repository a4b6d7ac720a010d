"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rules
from ..functions.spans import in_batches, numbered_column, scan_column, tokens_column


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once per row.

    A plain projection is copied into every filter above it. Here the projected columns pass through a
    one-element array, which no filter is pushed below. The projection itself stays compiled.
    """
    kept = [c for c in df.columns if c not in columns]
    hidden = {f"_once_{name}": column for name, column in columns.items()}
    made = F.struct(*[F.col(h).alias(name) for h, name in zip(hidden, columns)])
    return df.withColumns(hidden).select(*kept, F.inline(F.array(made)))


def with_tokens(df: DataFrame, text: str, rules: Rules, out: str) -> DataFrame:
    """Adds the matches of a text, each with its placeholder in the scope of the row."""
    if in_batches(rules):
        return with_once(df, **{out: tokens_column(text, rules)})
    scanned = df.withColumn("_scanned", scan_column(text, rules))
    return with_once(scanned, **{out: numbered_column("_scanned")}).drop("_scanned")


def explode_rows(df: DataFrame, keep: list[str], array: str, marker: str) -> DataFrame:
    """One row per array element with the element's fields as columns; rows without elements vanish.

    The outer form plus a filter on ``marker`` (a field that is never null) stops the optimizer from
    guarding the generator with a second evaluation of the array.
    """
    out = df.select(*keep, F.explode_outer(array).alias("_item"))
    return out.filter(F.col(f"_item.{marker}").isNotNull()).select(*keep, "_item.*")


def literal_rows(spark: SparkSession, rows: Iterable[tuple], names: list[str]) -> DataFrame:
    """A small constant table (catalog, configuration) as literals in the plan: no Python worker reads it."""
    made = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def run_splitter() -> Callable[[pd.DataFrame, list[str]], Iterator[tuple[tuple, int, int]]]:
    """A function that gives (key, from, to) for each stretch of equal keys in a sorted batch.

    Made inside a function so that it travels to the Python workers by value: they need not have this
    package installed.
    """

    def runs(batch: pd.DataFrame, names: list[str]) -> Iterator[tuple[tuple, int, int]]:
        keys = batch[names]
        starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
        values = [batch[name].to_numpy() for name in names]
        for at, end in zip(starts, [*starts[1:], len(batch)]):
            yield tuple(column[at] for column in values), int(at), int(end)

    return runs
