"""A Merkle manifest of a data set: one root digest for all rows, and for every row a proof that it belongs to it.

A leaf is the digest of a row's fields. The leaves of a language ascend by doc_id; two consecutive nodes at a time
become their digest until one is left, and the roots of the languages are joined to one root in the same way. The
digits of a leaf's rank say where it stands: the digit columns are grouped away one after the other, lowest first, and
each step nests the structs of the children in their parent's. That happens inside blocks of 2**``bits`` consecutive
nodes, so a nested struct is bounded; the blocks' roots are the nodes of the next round. On the way back a block meets
the path above it in one grouping, a nested transform spells the siblings of every node in it, and an explode emits
them: no join.

Ranks come from range slices of (lang, doc_id), so no language is gathered in one place. Nothing but the size of the
largest tree goes to the driver.

Defined results: null fields are written as ``-`` and differ from empty ones; a null language is a language of its own,
the first one. Null ids come first. Rows with equal ids are ordered by their leaves, so equal rows stand side by side
and each gets a proof. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import cut_lineage

BITS = 8
_STEP = "struct<right:boolean,sibling:string>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as it goes into a leaf: its UTF-8 length, a colon and itself; ``-`` for null."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*(field(c) for c in (doc_id, source, lang, n_chars, text)))


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(lang, doc_id, leaf, shown): the leaf of a row and the one it shows now. Where ``tampered`` holds, one
    character more is shown than the row has."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    leaf = leaf_digest(doc_id, source, lang, n_chars, text)
    more = leaf_digest(doc_id, source, lang, n_chars.cast("decimal(20,0)") + 1, text)
    shown = leaf if tampered is None else F.when(tampered & n_chars.isNotNull(), more).otherwise(leaf)
    return docs.select(lang.alias("lang"), doc_id.alias("doc_id"), leaf.alias("leaf"), shown.alias("shown"))


def _ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds rank (from 0) and size (rows) within ``tree``. ``rows`` must be frozen, since range bounds are sampled."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order, "tie")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    sliced = cut_lineage(
        dealt.withColumn("slice", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "slices"
    )
    each = sliced.groupBy(tree, "slice").agg(F.count("*").alias("many"), F.min("place").alias("first"))
    whole = Window.partitionBy(tree)
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shift = each.select(
        F.col(tree).alias("in_tree"), F.col("slice").alias("in_slice"), F.sum("many").over(whole).alias("size"),
        (F.coalesce(F.sum("many").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    at = (F.col("slice") == F.col("in_slice")) & F.col(tree).eqNullSafe(F.col("in_tree"))
    return (
        sliced.join(shift, at)
        .withColumn("rank", F.col("place") + F.col("shift"))
        .drop("in_tree", "in_slice", "slice", "place", "shift")
    )


def _levels(size: Column) -> Column:
    """How often nodes are joined until one is left: the binary digits of size - 1."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _block_rollup(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, block, depth, node) from (tree, rank, depth, node): the digits of the rank in a block are grouped away.

    All groupings share the exchange on (tree, block).
    """
    digits = [f"digit{k}" for k in range(bits)]
    df = nodes.select(
        "tree", F.shiftright("rank", bits).alias("block"), "depth", "node",
        *[F.shiftright("rank", k).bitwiseAND(F.lit(1)).cast("int").alias(d) for k, d in enumerate(digits)],
    ).repartition("tree", "block")
    for level, digit in enumerate(digits):
        above = ["tree", "block", *digits[level + 1 :]]
        kids = F.sort_array(F.collect_list(F.struct(F.col(digit).alias("digit"), "node")))
        df = df.groupBy(*above).agg(F.max("depth").alias("depth"), kids.alias("kids"))
        joined = F.sha2(F.array_join(F.transform("kids", lambda k: k["node"]["hash"]), ""), 256)
        hashed = F.when(F.col("depth") > level, joined).otherwise(F.col("kids")[0]["node"]["hash"])
        df = df.select(*above, "depth", F.struct(hashed.alias("hash"), "kids").alias("node"))
    return df


def _siblings(node: Column, path: Column, level: int) -> Column:
    """Array of (item, path) for all leaves under a node: what each has beside it, from below upwards."""
    if not level:
        return F.array(F.struct(node["item"].alias("item"), path.alias("path")))
    kids = node["kids"]
    none = F.lit(None).cast("string")

    def under(kid: Column) -> Column:
        right = kid["digit"] == 1
        other = F.when(F.size(kids) > 1, F.element_at(kids, F.when(right, 1).otherwise(2))["node"]["hash"]).otherwise(none)
        step = F.array(F.struct(right.alias("right"), other.alias("sibling")))
        own = F.when(F.col("depth") >= level, step).otherwise(F.array().cast(f"array<{_STEP}>"))
        return _siblings(kid["node"], F.concat(own, path), level - 1)

    return F.flatten(F.transform(kids, under))


def _proofs_below(blocks: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """(tree, item, path, roots) for the nodes of all blocks; ``above`` is (tree, block, path, roots) of the blocks."""
    met = (
        blocks.unionByName(above, allowMissingColumns=True)
        .groupBy("tree", "block")
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("depth", "node", "path", "roots")])
    )
    inside = _siblings(F.col("node"), F.array().cast(f"array<{_STEP}>"), bits)
    out = met.select("tree", "path", "roots", F.explode(inside).alias("below"))
    return out.select("tree", "below.item", F.concat("below.path", "path").alias("path"), "roots")


def _forest(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The written rounds of blocks over (tree, rank, size, item, hash), up to one block for each tree."""
    most = nodes.agg(F.max("size")).first()[0] or 1
    nodes = nodes.select("tree", "rank", _levels(F.col("size")).alias("depth"), F.struct("hash", "item").alias("node"))
    rounds = []
    while True:
        rounds.append(cut_lineage(_block_rollup(nodes, bits), "blocks"))
        most = -(-most >> bits) if most > 1 else 1
        if most <= 1:
            return rounds
        nodes = rounds[-1].select(
            "tree", F.col("block").alias("rank"), F.greatest(F.col("depth") - bits, F.lit(0)).alias("depth"),
            F.struct(F.col("node.hash").alias("hash"), F.col("block").alias("item")).alias("node"),
        )


def _all_proofs(rounds: list[DataFrame], roots: DataFrame, bits: int) -> DataFrame:
    """(tree, item, path, roots) for the leaves; ``roots`` is (tree, path, roots) above each tree."""
    above = roots.select("tree", F.lit(0).cast("long").alias("block"), "path", "roots")
    for blocks in rounds[:0:-1]:
        above = _proofs_below(blocks, above, bits).select("tree", F.col("item").alias("block"), "path", "roots")
    return _proofs_below(rounds[0], above, bits)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def up(node: Column, step: Column) -> Column:
        other = F.coalesce(step["sibling"], F.lit(""))
        return F.sha2(F.when(step["right"], F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, leaf, up)


def merkle_proofs(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """``leaves`` (lang, doc_id, leaf, and what else there is) with subroot, root and path, an array of steps from the
    leaf to the root: the sibling (null where a node is alone) and whether the node is the right one of the two."""
    own = [c for c in leaves.columns if c != "lang"]
    leaves = cut_lineage(leaves, "leaves")
    ranked = _ranked(leaves, "lang", ["doc_id", "leaf"])
    rounds = _forest(ranked.select(F.col("lang").alias("tree"), "rank", "size", F.struct(*own).alias("item"), F.col("leaf").alias("hash")), bits)

    subroots = cut_lineage(rounds[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("lang"), F.col("node.hash").alias("hash")), "roots")
    top = _forest(_ranked(subroots, "tree", ["lang"]).select("tree", "rank", "size", F.struct("lang", "hash").alias("item"), "hash"), bits)
    no_path = F.array().cast(f"array<{_STEP}>").alias("path")
    peak = top[-1].select("tree", no_path, F.array("node.hash").alias("roots"))
    over = _all_proofs(top, peak, bits)
    over = over.select(F.col("item.lang").alias("tree"), "path", F.concat(F.array("item.hash"), "roots").alias("roots"))

    proofs = _all_proofs(rounds, over, bits)
    return proofs.select(
        F.col("tree").alias("lang"), *[F.col(f"item.{c}").alias(c) for c in own],
        F.col("roots")[0].alias("subroot"), F.col("roots")[1].alias("root"), "path",
    )


def verified_manifest(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """The proofs with proof_sha256 (all siblings, from below upwards), folded_root (what ``shown`` leads to) and verified."""
    siblings = F.array_join(F.transform("path", lambda s: F.coalesce(s["sibling"], F.lit(""))), "")
    judged = merkle_proofs(leaves, bits).withColumn("proof_sha256", F.sha2(siblings, 256))
    return judged.withColumn("folded_root", fold(F.col("shown"), F.col("path"))).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
