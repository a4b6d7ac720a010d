"""Chat formatting of reply trees, in DataFrame operations only.

Messages name their parent. Iterative self-joins enumerate the messages of every root-to-leaf path: from each leaf,
round k adds what lies 2**k above what is known, and doubles the jumps, so a path of n messages takes log2(n) rounds
and no row beyond the paths themselves. Branches are ranked by the sum of their messages' scores, and each chosen
path becomes one conversation in a template that marks turns, with control strings inside texts escaped reversibly.

Defined results: null roles and texts count as empty; a parent that is not there makes a root; messages in a cycle
have no root and form no path; equal scores rank the smaller leaf first; null scores count as 0. Message ids must be
unique in their tree. ``turns_in_order`` numbers rows by turn, then role, then text (nulls first), so repeated rows
are turns of their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import cut_lineage

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def _keyed(df: DataFrame) -> DataFrame:
    """The tree inside a struct, which is equal to itself also where the tree is null."""
    return df.withColumn("tree", F.struct(F.col("tree").alias("id")))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("tree", F.col("tree.id"))


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """Conversations without replies as trees that do not branch: (tree, node, parent, role, text, score)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, above, node): the messages of every path; ``above`` counts from the leaf up."""
    nodes = cut_lineage(_keyed(messages.select("tree", "node", "parent")), "messages")
    there = nodes.select("tree", F.col("node").alias("parent"))
    jumps = cut_lineage(nodes.filter("parent is not null").join(there, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")), "jumps")
    roots = nodes.join(jumps, ["tree", "node"], "left_anti").select("tree", "node")
    leaves = nodes.join(jumps.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    paths = cut_lineage(leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("above"), "node"), "paths")
    most, step = nodes.count(), 1
    while step < 2 * most and not jumps.isEmpty():
        added = paths.join(jumps, ["tree", "node"]).select("tree", "leaf", (F.col("above") + step).alias("above"), F.col("up").alias("node"))
        paths = cut_lineage(paths.union(added), "paths")
        further = jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("beyond"))
        jumps = cut_lineage(jumps.join(further, ["tree", "up"]).select("tree", "node", F.col("beyond").alias("up")), "jumps")
        step *= 2
    ended = paths.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return _plain(paths.join(ended, ["tree", "leaf"], "left_semi"))


def ranked_branches(messages: DataFrame, paths: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, branch_score, branch_rank): the ``best`` branches of each tree by the sum of their scores."""
    scores = _keyed(messages.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")))
    sums = _keyed(paths).join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
    if best == 1:  # aggregated before the shuffle, however many leaves a tree has; a second sum could differ in its last bit
        tied = sums.groupBy("tree", "branch_score").agg(F.min("leaf").alias("leaf"))
        first = tied.groupBy("tree").agg(F.max_by("leaf", "branch_score").alias("leaf"), F.max("branch_score").alias("branch_score"))
        return _plain(first.select("tree", "leaf", "branch_score", F.lit(1).alias("branch_rank")))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    return _plain(sums).withColumn("branch_rank", F.row_number().over(order)).filter(F.col("branch_rank") <= best)


def escape(text: Column) -> Column:
    """Afterwards the text holds no start of a mark: a backslash is doubled, ``<|`` gets one between."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_paths(messages: DataFrame, paths: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, formatted, loss_spans): one conversation per path; spans (start, end) in characters cover the
    texts of the roles in ``learn``."""
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = said.select(
        "tree", "node", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
        F.col("role").isin(*learn).alias("learn"),
    )
    turns = _keyed(paths).join(_keyed(turn), ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), "head", "body", "learn"))).alias("turns")
    )
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    sizes = F.transform("turns", lambda t: F.struct(
        F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"), t["learn"].alias("learn")
    ))
    nothing = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    walked = F.aggregate(
        "sizes", F.struct(F.lit(0).alias("at"), nothing.alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + t["head"] + t["body"] + len(END)).alias("at"),
            F.when(
                t["learn"],
                F.array_append(a["spans"], F.struct((a["at"] + t["head"]).alias("start"), (a["at"] + t["head"] + t["body"]).alias("end"))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return _plain(turns).withColumn("sizes", sizes).select("tree", "leaf", formatted.alias("formatted"), walked.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    ends = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.slice(ends, F.lit(1), F.size(ends) - 1)
    role = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n"
    return F.transform(parts, lambda p: F.struct(
        unescape(F.regexp_extract(p, role, 1)).alias("role"), unescape(F.regexp_replace(p, role, "")).alias("text")
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def format_conversations(messages: DataFrame, learn: tuple[str, ...] = ("assistant",), best: int = 1) -> DataFrame:
    """(tree, leaf, formatted, loss_spans) of each tree's best branches."""
    messages = cut_lineage(messages, "turns")
    paths = root_to_leaf_paths(messages)
    chosen = ranked_branches(messages, paths, best).select("tree", "leaf")
    best_paths = _plain(_keyed(paths).join(_keyed(chosen), ["tree", "leaf"], "left_semi"))
    return format_paths(messages, best_paths, learn)
