"""A Merkle manifest of a dataset: trees of fanout 3 over each source's rows, and one over the sources' roots.

A level is made by a slot pivot: conditional aggregates spread the children of each parent over one column to a slot,
the columns joined are hashed to the parent, and the columns but one's own are its siblings. Proofs come down again
from the root, each parent handing its own to its children, so that every level is joined once, in its own size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written

FANOUT = 3
SLOTS = [f"slot{k}" for k in range(FANOUT)]
STEP = "struct<left:string,right:string>"


def hashed(*parts: Column) -> Column:
    """SHA-256 in lowercase hexadecimal of the parts, one after the other; a null part counts as empty."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as its number of bytes in UTF-8, a colon and itself; null as a hyphen, which nothing else begins with."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    return hashed(*map(field, columns))


def numbered(df: DataFrame, tree: str, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """Add ``pos``, each row's place in its tree from 0, and ``size``, the number of rows of the tree.

    Rows are dealt out by ranges of tree and order; the rows that a tree has in earlier ranges come before a row's
    place in its own. So no tree has to fit into a task. Nulls come first.
    """
    keys = [tree, *order]
    dealt = scratch.written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    # a row for each tree and range that meet: their number together at most
    pieces = dealt.groupBy(F.col(tree).alias("_tree"), F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    all_of, earlier = Window.partitionBy("_tree"), Window.partitionBy("_tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = pieces.select("_tree", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(all_of).alias("size"))
    placed = dealt.join(begins, F.col(tree).eqNullSafe(F.col("_tree")) & (F.shiftright("_at", 33) == F.col("_part")))
    return scratch.written(placed.select(*df.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "size"), f"{name}-placed")


def pivot(nodes: DataFrame) -> DataFrame:
    """Parents of nodes (tree, pos, size, node), and of what else a node holds: a column of structs for each slot."""
    slot, kept = F.col("pos") % FANOUT, [c for c in nodes.columns if c not in ("tree", "pos", "size")]
    children = [F.max(F.when(slot == k, F.struct(*kept))).alias(SLOTS[k]) for k in range(FANOUT)]
    wide = nodes.groupBy("tree", "size", F.floor(F.col("pos") / FANOUT).alias("up")).agg(*children)
    return wide.select("tree", F.col("up").alias("pos"), F.ceil(F.col("size") / FANOUT).alias("size"), *SLOTS, hashed(*[F.col(f"{s}.node") for s in SLOTS]).alias("node"))


def children(parents: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Rows of the pivoted parents' children, each with its place, what it holds, and its proof: its siblings on both sides, then its parent's."""

    def beside(slots: Sequence[str]) -> Column:
        return F.concat(F.lit(""), *[F.coalesce(F.col(f"{s}.node"), F.lit("")) for s in slots])

    each = F.array(*[
        F.struct((F.col("pos") * FANOUT + k).alias("pos"), F.col(s).alias("child"), F.array(F.struct(beside(SLOTS[:k]).alias("left"), beside(SLOTS[k + 1 :]).alias("right"))).alias("own")) for k, s in enumerate(SLOTS)])
    return parents.select("tree", *carried, F.col("proof").alias("_above"), F.inline(each)).where("child IS NOT NULL").select(
        "tree", *carried, "pos", "child.*", F.concat("own", "_above").alias("proof"))


def grow(leaves: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Levels of pivoted parents over leaves (tree, pos, size, node, ...), and the roots (tree, height, node) of all trees.

    A level has a third of the nodes of the one below. Three numbers of the leaves come to the driver.
    """
    largest, n, trees = leaves.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*"), F.count_if(F.col("pos") == 0)).first()
    roots, levels, nodes = leaves.where("size = 1").select("tree", F.lit(0).alias("height"), "node"), [], leaves.where("size > 1")
    while largest > 1:
        largest, n = -(-largest // FANOUT), n // FANOUT + trees
        levels.append(scratch.written(pivot(nodes), f"merkle-level-{len(levels) + 1}", n))
        made = levels[-1].select("tree", "pos", "size", "node")
        roots = roots.unionByName(made.where("size = 1").select("tree", F.lit(len(levels)).alias("height"), "node"))
        nodes = made.where("size > 1")
    return levels, scratch.written(roots, "merkle-roots", trees)


def descend(leaves: DataFrame, levels: list[DataFrame], roots: DataFrame, scratch: Scratch, carried: Sequence[str]) -> DataFrame:
    """What the leaves hold, with their proofs; ``roots`` are (tree, height, proof, ...) of the trees.

    ``carried`` columns of a root go down to all leaves of its tree. A tree of one leaf has no level: its proof is
    its root's.
    """
    held = [c for c in leaves.columns if c not in ("tree", "pos", "size")]
    lone, kept = leaves.where("size = 1").withColumnRenamed("tree", "_tree"), [*held, *carried, "proof"]
    out = lone.join(roots.where("height = 0").select("tree", *carried, "proof"), F.col("_tree").eqNullSafe(F.col("tree"))).select(*kept)
    above = None
    for height in range(len(levels), 0, -1):
        tops = roots.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("pos"), *carried, "proof")
        above = tops if above is None else above.unionByName(tops)
        level = levels[height - 1].select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), *SLOTS)
        below = children(level.join(above, F.col("_tree").eqNullSafe(F.col("tree")) & (F.col("_pos") == F.col("pos"))), carried)
        if height > 1:
            above = scratch.written(below.select("tree", "pos", *carried, "proof"), f"merkle-proofs-{height - 1}")
        else:
            out = out.unionByName(below.select(*kept))
    return out


def manifest(
        rows: DataFrame, key: str = "doc_id", source: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
        changed: tuple[str, Column] | None = None, kept: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof (siblings to the left and right at each level, from the leaf up), changed_leaf.

    A source's leaves ascend by key, nulls first; rows that repeat a key go by their leaves, and equal rows get places
    side by side. Sources ascend bytewise, null first, and are the leaves of a tree of their own. ``changed``, a field
    and another value of it, gives the leaf of the changed row; it is null where the value stays. An empty table gives
    no rows. Columns that aren't fields are left out, whatever their names. Texts become leaves where they are read.
    What ``kept`` makes of the rows is written to the shared folder; tables of the way there are deleted.
    """
    values = {c: F.col(c) for c in fields}
    other = F.lit(None).cast("string")
    if changed:
        name, value = changed
        other = F.when(~value.eqNullSafe(F.col(name)), leaf(list((values | {name: value}).values())))
    with Scratch(rows.sparkSession) as scratch:
        leaves = scratch.written(rows.select(F.col(source).cast("string").alias("tree"), F.col(key).alias("key"), leaf(list(values.values())).alias("node"), other.alias("changed")), "merkle-leaves")
        placed = numbered(leaves, "tree", ["key", "node"], scratch, "merkle-dealt")
        levels, roots = grow(placed, scratch)
        sources = numbered(roots.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "height", "node"), "tree", ["source"], scratch, "merkle-sources")
        upper, top = grow(sources, scratch)
        root = next((r.node for r in top.collect()), None)  # one row
        top = top.withColumn("proof", F.array().cast(f"array<{STEP}>"))
        subroots = descend(sources, upper, top, scratch, [])
        subroots = scratch.written(subroots.select(F.col("source").alias("tree"), "height", F.col("node").alias("subroot"), "proof"), "merkle-subroots")
        found = descend(placed, levels, subroots, scratch, ["subroot"])
        found = found.select(F.col("key").alias(key), F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "proof", F.col("changed").alias("changed_leaf"))
        return written(kept(found), "merkle-manifest")


def proof_digest(proof: str = "proof") -> Column:
    """SHA-256 of all siblings of a proof, in their order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def folded(node: Column, proof: str = "proof") -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(proof, node, lambda below, s: F.sha2(F.concat(s["left"], below, s["right"]).cast("binary"), 256))


def verified(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root (of the changed leaf, where there is one), and whether that is the root."""
    up = found.withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf")))
    return up.select(key, "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
