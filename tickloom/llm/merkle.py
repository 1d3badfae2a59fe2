"""Merkle manifests of a table: checkpointed levels, and proofs that recompute the levels in between.

Each group of rows is a tree: its leaves stand in ascending order, and while several nodes remain, runs of `FAN` consecutive nodes
(the last may be shorter, even one node) become the digest of their digests. What remains is the group's root (a lone leaf
itself); the roots of all groups, in order, are the leaves of one further tree. Digests are lowercase hex SHA-256 texts.

`checkpointed` keeps only every STRIDE-th level. A stored level is cut into aligned subtrees of FAN ** STRIDE nodes, the one
unit of work on the way up and down: going up, a subtree's missing levels are computed and only its top is stored; `proofs` goes down
from the top, regenerates the missing levels of each subtree from its stored nodes, gives every node its siblings of these
levels, puts those of the subtree's top behind them, and keeps none of the regenerated nodes. A subtree has a bounded size,
so a group with most of the rows is as many tasks as it has subtrees, and the levels grow with the logarithm of the rows.

All is DataFrame functions. Null fields are marked in the leaf's digest; null orders come first, and so does a null group; rows of
one group with equal order stand by digest (equal rows are interchangeable); very long texts are digested whole; an empty table has
no rows and no root; columns of other names pass through `proofs` untouched as long as they don't begin with an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import forget, parked

FAN, STRIDE = 16, 2
PATH = "array<struct<left:string,right:string>>"


def digest(*fields: Column) -> Column:
    """The digest of a row: each field is `-` if null, else its UTF-8 byte count, a colon and its text."""

    def framed(c: Column) -> Column:
        own = c.cast("string")
        return F.when(own.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(own).cast("string"), F.lit(":"), own))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(path, leaf, lambda own, level: F.sha2(F.concat(level["left"], own, level["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


def tree_of(group: Column) -> Column:
    """A group's name as a text that is never null and sorts like the group, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """The leaves, written, with `_pos` in their tree and its size `_n`: `_tree` and `_digest` are given.

    Rows are sorted over all tasks and numbered inside each slice of the sorted rows as they are written; one count for
    each (tree, slice) gives the rows ahead. A large tree lies in many slices.
    """
    sort = [F.col("_tree"), *order, F.col("_digest")]
    slices = leaves.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    rows = parked(slices.withColumn("_slice", F.shiftright("_at", 33)), "leaves")
    counts = rows.groupBy("_tree", "_slice").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    ahead = Window.partitionBy("_tree").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_tree", "_slice", "_first", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_size").over(Window.partitionBy("_tree")).alias("_n"))
    return rows.join(counts, ["_tree", "_slice"]).withColumn("_pos", F.col("_ahead") + F.col("_at") - F.col("_first")).drop("_at", "_slice", "_first", "_ahead")


def _above(level: Column, fan: int) -> Column:
    """The next level of a subtree: the digests of runs of `fan` of its nodes."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / F.lit(fan)).cast("int") - 1)
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(level, k * fan + 1, F.lit(fan)), ""), 256))


def _subtrees(nodes: DataFrame, fan: int, stride: int) -> DataFrame:
    """Aligned subtrees of a stored level with more than one node: `_l0` (stored nodes) and the regenerated `_l1` to `_l{stride}`.

    `_n` is the number of nodes of the whole tree on the stored level; levels beyond the tree's root are null.
    """
    block = F.floor(F.col("_pos") / F.lit(fan**stride))
    held = F.sort_array(F.collect_list(F.struct("_pos", "_digest")))
    rows = nodes.filter("_n > 1").groupBy("_tree", "_n", block.alias("_block")).agg(held.alias("_held"))
    rows = rows.select("_tree", "_n", "_block", F.col("_held._digest").alias("_l0"))
    for k in range(stride):
        rows = rows.withColumn(f"_l{k + 1}", F.when(_count("_n", fan, k) > 1, _above(F.col(f"_l{k}"), fan)))
    return rows


def _count(n: str, fan: int, levels: int) -> Column:
    """Nodes of a whole tree some levels higher; 1 from its root on."""
    return F.ceil(F.col(n) / F.lit(fan**levels)).cast("long")


@dataclass
class Checkpoints:
    """The stored levels of all trees, lowest first: `_tree`, `_n` nodes of the tree on that level, `_pos`, `_digest`."""

    levels: list[DataFrame]
    fan: int
    stride: int

    def roots(self) -> DataFrame:
        """`_tree` and its root's `_digest`."""
        own = [level.filter("_n = 1").select("_tree", "_digest") for level in self.levels]
        out = own[0]
        for more in own[1:]:
            out = out.unionByName(more)
        return out

    def forget(self) -> None:
        forget(*self.levels[1:])


def checkpointed(leaves: DataFrame, fan: int = FAN, stride: int = STRIDE) -> Checkpoints:
    """Stored levels over `_tree`, `_n`, `_pos`, `_digest`; each is written before the next."""
    levels = [leaves.select("_tree", "_n", "_pos", "_digest")]
    while not levels[-1].filter("_n > 1").isEmpty():
        up = _subtrees(levels[-1], fan, stride)
        top = F.coalesce(*[F.col(f"_l{k}") for k in range(stride, 0, -1)])[0]
        levels.append(parked(up.select("_tree", _count("_n", fan, stride).alias("_n"), F.col("_block").alias("_pos"), top.alias("_digest")), "level"))
    return Checkpoints(levels, fan, stride)


def proofs(made: Checkpoints, tops: DataFrame) -> DataFrame:
    """`_tree`, `_pos`, `_digest` of all leaves with the siblings from leaf to root, `_path`, and the columns of `tops`.

    `tops` has a row for each tree with the `_path` that goes on above its root.
    """
    carried = [c for c in tops.columns if c not in ("_tree", "_path")]
    fan, stride = made.fan, made.stride
    above = None
    for level in reversed(made.levels):
        here = level.filter("_n = 1").join(tops, "_tree").select("_tree", "_pos", "_digest", "_path", *carried)
        if above is not None:
            parts = _subtrees(level, fan, stride).join(above.select("_tree", F.col("_pos").alias("_block"), F.col("_path").alias("_up"), *carried), ["_tree", "_block"])
            each = parts.select("*", F.posexplode("_l0").alias("_k", "_digest"))
            own = F.array(*[_siblings(f"_l{k}", F.floor(F.col("_k") / F.lit(fan**k)).cast("int"), _count("_n", fan, k), fan) for k in range(stride)])
            pos = (F.col("_block") * F.lit(fan**stride) + F.col("_k")).alias("_pos")
            here = here.unionByName(each.select("_tree", pos, "_digest", F.concat(F.array_compact(own), "_up").cast(PATH).alias("_path"), *carried))
        above = here
    return above


def _siblings(level: str, k: Column, count: Column, fan: int) -> Column:
    """Left and right siblings of node k of a subtree's level; null where the tree has its root there."""
    first = k - k % F.lit(fan)
    left = F.array_join(F.slice(F.col(level), first + 1, k % F.lit(fan)), "")
    right = F.array_join(F.slice(F.col(level), k + 2, first + F.lit(fan) - k - 1), "")
    return F.when(count > 1, F.struct(left.alias("left"), right.alias("right")))


def manifest(df: DataFrame, group: str, order: str, fields: list[str], fan: int = FAN, stride: int = STRIDE) -> DataFrame:
    """The rows of `df` with `_leaf`, `_subroot` (of the row's group), `_root` and `_path`, the siblings from leaf to root."""
    own = [F.col(c).alias(c) for c in df.columns if c not in fields or c in (group, order)]
    leaves = df.select(tree_of(F.col(group)).alias("_tree"), digest(*[F.col(c) for c in fields]).alias("_digest"), *own)
    rows = numbered(leaves, [F.col(order).asc_nulls_first()])
    made = checkpointed(rows, fan, stride)
    roots = made.roots().select(F.lit("").alias("_tree"), F.col("_tree").alias("_of"), "_digest")
    top = numbered(roots, [F.col("_of")])
    whole = checkpointed(top, fan, stride)
    root = whole.roots().first()
    start = root_path(df, root["_digest"] if root else None)
    tops = proofs(whole, start).drop("_digest").join(top.select("_tree", "_pos", "_of", F.col("_digest").alias("_subroot")), ["_tree", "_pos"])
    paths = proofs(made, tops.select(F.col("_of").alias("_tree"), "_path", "_subroot", "_root"))
    return rows.drop("_n").withColumnRenamed("_digest", "_leaf").join(paths.drop("_digest"), ["_tree", "_pos"]).drop("_tree", "_pos")


def root_path(df: DataFrame, root: str | None) -> DataFrame:
    """The top of the tree of groups: nothing goes on above it."""
    return df.sparkSession.createDataFrame([("", [], root)], f"_tree string, _path {PATH}, _root string")
