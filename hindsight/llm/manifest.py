"""Merkle manifest of a dataset: every row a leaf, a tree per group, a tree over the groups' roots, and proofs.

Leaves of a group are ordered and numbered. ``2 ** levels`` consecutive nodes form a superblock, a complete
subtree; superblocks are reduced to one node each in parallel, their nodes again, until a group has one node.
On the way down the nodes of every superblock are cogrouped with the *outer nodes* that their proofs need
beyond it, one row per level above the superblock: in one ``applyInPandas`` call the subtree is reduced, local
and outer siblings are joined to proofs, and the leaves are folded to the root. So a task holds at most
``2 ** levels`` digests and one path, whatever a group holds. Numbering goes by range partitions that are
written: a row's number is its place in its part plus the rows of its group in earlier parts, so that a
large group is never sorted in one task. Each tier is written to the shared folder, which cuts the lineage.

Hashes are lower-case hexadecimal SHA-256 of the concatenated inputs, digests as text. A node's run are 2
consecutive nodes, the last run may be one alone and is hashed as well, while the group has more than one node.

Odd input: nulls in any column have a digest of their own (``-``), a null group is a group and comes first, a
null key comes first in its group. Rows with equal keys are ordered by their digest; repeated rows stay
separate leaves, whose results trade places without a difference. Without rows there is no result. Columns that
are not named are not read, and names of inner columns do not clash with given ones. Keys may be of any type
that Spark orders and can read back from their text; groups are ordered by their text.
"""

from collections.abc import Sequence
from functools import cache
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Levels of a superblock, if not given.
LEVELS = 12
#: Rows of the path with these steps carry the group's and the last root.
SUBROOT, ROOT = -2, -1
#: Steps of the tree over the groups come after those of any group's tree.
FOREST = 1000

#: Rows that carry one level of a path: ``sibling`` is empty where the node's run has no other; ``before`` tells
#: that the sibling comes first.
PATH = "step int, sibling string, before boolean"


def _hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field_bytes(field: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = field.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_bytes(field) for field in fields]), 256)


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the ``levels`` levels above them."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([_hash(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return found


def height(nodes: int) -> int:
    """Levels above a row of so many nodes until one is left."""
    return (nodes - 1).bit_length()


def folded(node: str, path: Sequence[tuple[str, bool]]) -> str:
    """The root that a node and its path lead to."""
    for sibling, before in path:
        node = _hash(sibling, node) if before else _hash(node, sibling)
    return node


def numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` with ``at``, their number in their group ``tree`` by ``order``, and the group's ``size``."""
    serial = written(leaves, "leaves").withColumn("serial", F.monotonically_increasing_id())
    keys = ["tree", *order, "serial"]
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        serial.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("serial").withColumn("slot", F.monotonically_increasing_id()),
        "ordered-leaves",
    )
    part = F.shiftright("slot", 33).alias("part")
    runs = placed.groupBy("tree", part).agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n"))
    of_tree = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("n").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(
        F.col("tree").alias("run_tree"), F.col("part").alias("run_part"),
        (earlier - F.col("first")).alias("shift"), F.sum("n").over(of_tree).alias("size"),
    )
    same = F.col("tree").eqNullSafe(F.col("run_tree")) & (F.shiftright("slot", 33) == F.col("run_part"))
    return placed.join(runs, same).withColumn("at", F.col("slot") + F.col("shift")).drop("run_tree", "run_part", "shift", "slot")


def _block(levels: int) -> Column:
    return F.shiftright("at", levels).alias("block")


def _reduced(block: pd.DataFrame, levels: int) -> pd.DataFrame:
    """A superblock's one node."""
    block = block.sort_values("at")
    size = int(block["size"].iloc[0])
    top = climb(block["node"].tolist(), min(levels, height(size)))[-1][0]
    return pd.DataFrame({
        "tree": block["tree"].iloc[:1].tolist(), "at": [int(block["at"].iloc[0]) >> levels],
        "node": [top], "size": [-(-size >> levels)],
    }).astype({"at": "int64", "size": "int64"})


def tiers(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """``tree, at, node, size`` of the numbered leaves, of the nodes of their superblocks, and so on to the roots."""
    tree = leaves.schema["tree"].dataType.simpleString()
    found = [leaves.select("tree", "at", "node", "size")]
    while (found[-1].agg(F.max("size")).head()[0] or 1) > 1:
        blocks = found[-1].groupBy("tree", _block(levels))
        up = blocks.applyInPandas(lambda block: _reduced(block, levels), f"tree {tree}, at long, node string, size long")
        found.append(written(up, "superblocks"))
    return found


def _local(block: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]]]:
    block = block.sort_values("at", ignore_index=True)
    return block, climb(block["node"].tolist(), min(levels, height(int(block["size"].iloc[0]))))


def _siblings(subtree: list[list[str]], i: int) -> list[tuple[str, bool]]:
    """The path of a superblock's node number ``i`` inside the superblock."""
    path = []
    for nodes in subtree[:-1]:
        path.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else "", i % 2 == 1))
        i >>= 1
    return path


def _downward(block: pd.DataFrame, outer: pd.DataFrame, levels: int, first: int) -> pd.DataFrame:
    """The whole paths of a superblock's nodes: what lies inside and the outer nodes."""
    block, subtree = _local(block, levels)
    steps, siblings, befores = (outer[name].tolist() for name in ("step", "sibling", "before"))
    rows = []
    for i, (tree, at) in enumerate(zip(block["tree"], block["at"], strict=True)):
        inner = _siblings(subtree, i)
        rows += [(tree, at, first + step, sibling, before) for step, (sibling, before) in enumerate(inner)]
        rows += [(tree, at, *row) for row in zip(steps, siblings, befores, strict=True)]
    return pd.DataFrame(rows, columns=["tree", "at", "step", "sibling", "before"])


def _paths_down(found: list[DataFrame], top: DataFrame, levels: int, first: int = 0) -> DataFrame:
    """``tree, block`` and path rows: the outer nodes of the superblocks of leaves, given the roots' own paths."""
    tree = found[0].schema["tree"].dataType.simpleString()
    outer = top  # keyed by the superblock below each root
    for tier in range(len(found) - 2, 0, -1):
        nodes, step = found[tier].groupBy("tree", _block(levels)), first + tier * levels

        def down(block: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
            return _downward(block, path, levels, step)

        paths = nodes.cogroup(outer.groupBy("tree", "block")).applyInPandas(down, f"tree {tree}, at long, {PATH}")
        outer = written(paths.withColumnRenamed("at", "block"), "outer-nodes")
    return outer


def _proved(block: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Proof, roots and the folded root of every leaf of a superblock."""
    block, subtree = _local(block, levels)
    outer = outer.sort_values("step")
    marks = dict(zip(outer["step"], outer["sibling"], strict=True))
    beyond = outer[outer["step"] >= 0]
    beyond = list(zip(beyond["sibling"], beyond["before"], strict=True))
    rest = "".join(sibling for sibling, _ in beyond)
    # Leaves that were not tampered with lead to the same node of the superblock.
    upward = cache(lambda node: folded(node, beyond))
    proofs, ends = [], []
    for i, node in enumerate(block["folded_leaf"]):
        inner = _siblings(subtree, i)
        proofs.append(_hash("".join(sibling for sibling, _ in inner), rest))
        ends.append(upward(folded(node, inner)))
    return block[["given_key"]].assign(
        leaf=block["node"], subroot=marks[SUBROOT], root=marks[ROOT], proof_sha256=proofs, folded_root=ends,
        verified=[end == marks[ROOT] for end in ends],
    )


def manifest(
    documents: DataFrame,
    key: str,
    group: str,
    fields: Sequence[str],
    folded_fields: Sequence[Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """``key`` and ``leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A leaf is the digest of ``fields``. ``folded_fields`` are what is folded along the original siblings instead, to
    see which changed rows are found out; as given, every row leads to ``root``.
    """
    leaves = documents.select(
        F.col(group).cast("string").alias("tree"), F.col(key).alias("given_key"),
        leaf_digest([F.col(name) for name in fields]).alias("node"),
        leaf_digest(folded_fields or [F.col(name) for name in fields]).alias("folded_leaf"),
    )
    leaves = written(numbered(leaves, ["given_key", "node"]), "numbered-leaves")
    groups = tiers(leaves, levels)
    # The roots of the groups are the leaves of one more tree.
    subroots = groups[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "node")
    subroots = written(numbered(subroots, ["name"]), "subroots")
    forest = tiers(subroots, levels)
    root = forest[-1].select("tree", F.lit(0).cast("long").alias("block"), F.lit(ROOT).alias("step"), F.col("node").alias("sibling"), F.lit(False).alias("before"))
    to_root = _paths_down(forest, root, levels, FOREST)

    def of_group(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        paths = _downward(block, outer, levels, FOREST)
        own = pd.DataFrame({"at": block["at"], "step": SUBROOT, "sibling": block["node"], "before": False})
        paths = pd.concat([paths[own.columns], own])
        return paths.merge(block[["at", "name"]], on="at")[["name", *own.columns]]

    outer = subroots.groupBy("tree", _block(levels)).cogroup(to_root.groupBy("tree", "block")).applyInPandas(
        of_group, f"name string, at long, {PATH}"
    )
    outer = outer.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "step", "sibling", "before")
    outer = _paths_down(groups, written(outer, "group-paths"), levels)
    key_type = leaves.schema["given_key"].dataType.simpleString()
    digests = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    # As text, since pandas has no whole numbers beside nulls.
    leaves = leaves.withColumn("given_key", F.col("given_key").cast("string"))
    proved = leaves.groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", "block")).applyInPandas(
        lambda block, outer: _proved(block, outer, levels), f"given_key string, {digests}"
    )
    return proved.select(F.col("given_key").cast(key_type).alias(key), *proved.columns[1:])
