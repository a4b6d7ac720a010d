"""Connected components by repeated contraction, in DataFrame operations only.

In a round every vertex moves to the neighbour (or itself) with the smallest hash, a different hash each round;
edges are rewritten to where their ends moved, and loops and repetitions go. Random moves shrink what is left by a
constant factor on any graph, long paths included, so the rounds grow with the logarithm of the vertices and the
work of all rounds together with the edges. Minima are aggregated before they are shuffled and the rewriting is a
plain join, so a vertex with a third of all edges is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every vertex that an edge names, with the smallest vertex that can be reached from it.

    Edges may be given in any direction, repeatedly, or as loops; edges with a null end are ignored.
    """
    kept = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    # Both directions of an edge come from one row, so the edges are computed once.
    ways = F.array(*[F.struct(F.col(m).alias("x"), F.col(n).alias("y")) for m, n in ((a, b), (b, a))])
    both = cut_lineage(kept.select(F.inline(ways)).distinct(), "edges")
    labels = both.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct()
    both = both.filter("x != y")
    turn = 0
    while not both.isEmpty():
        turn += 1
        best = both.groupBy("x").agg(F.min(F.struct(F.xxhash64("y", F.lit(turn)).alias("h"), F.col("y").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("x", F.lit(turn)).alias("h"), F.col("x").alias("to"))
        moves = cut_lineage(best.select(F.col("x").alias("was"), F.least("m", own)["to"].alias("now")), "moves")
        # Followed at the end: the moves are written tables, so nothing is computed twice.
        labels = labels.join(moves, labels.label == moves.was, "left").select("node", F.coalesce("now", "label").alias("label"))
        to_x, to_y = (moves.select(F.col("was").alias(v), F.col("now").alias(v + "n")) for v in "xy")
        both = both.join(to_x, "x").join(to_y, "y").select(F.col("xn").alias("x"), F.col("yn").alias("y"))
        both = cut_lineage(both.filter("x != y").distinct(), "edges")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
