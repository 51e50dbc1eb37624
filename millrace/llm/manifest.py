"""Merkle manifest of a table: a persistent tree whose tampered leaves are versions that share untouched nodes.

Leaves of a tree are ranked by range partitions, and each aligned block of ``BLOCK`` consecutive nodes is one row.
A block reduces to its top node; the tops are the nodes of the next level, in blocks again, so a tree of any size
has a few levels and no task sees more than a block. Paths then come down: the siblings above a block are joined
to its row once, whatever its number of leaves. The tops of all trees are the leaves of one upper tree.

Inside a block the tree is persistent. Setting a leaf copies its ancestors in the block and nothing else; all
other nodes are shared with the version before. The block's new top goes on as a version of the upper levels:
there it has one new ancestor a level, next to siblings that are shared with the untampered tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, stored

#: Levels of a block, and its nodes.
LEVELS = 10
BLOCK = 1 << LEVELS


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class PersistentTree:
    """Nodes of a block in one growing list; a version is the number of its top node.

    Every two consecutive nodes of a level have one parent, a last one without neighbour a parent of its own.
    ``levels`` says how often, so a block that is not full still ends in one node of the level above.
    """

    def __init__(self, leaves: Sequence[str], levels: int):
        self.hash: list[str] = list(leaves)
        self.left: list[int] = [-1] * len(leaves)
        self.right: list[int] = [-1] * len(leaves)
        self.levels = levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._add(row[i], row[i + 1] if i + 1 < len(row) else -1) for i in range(0, len(row), 2)]
        self.top = row[0]

    def _add(self, left: int, right: int) -> int:
        self.left.append(left)
        self.right.append(right)
        self.hash.append(digest(self.hash[left]) if right < 0 else digest(self.hash[left], self.hash[right]))
        return len(self.hash) - 1

    def _down(self, place: int) -> list[tuple[int, bool]]:
        """From the top to the leaf: each ancestor, and whether the way goes right."""
        node, out = self.top, []
        for level in range(self.levels - 1, -1, -1):
            right = bool(place >> level & 1)
            out.append((node, right))
            node = self.right[node] if right else self.left[node]
        return out

    def path(self, place: int) -> list[str]:
        """Siblings from the leaf up: ``L`` or ``R`` and the digest, ``-`` where there is none."""
        out = []
        for node, right in reversed(self._down(place)):
            other = self.left[node] if right else self.right[node]
            out.append("-" if other < 0 else ("L" if right else "R") + self.hash[other])
        return out

    def set(self, place: int, leaf: str) -> list[int]:
        """A version with another leaf: the new leaf and the copied ancestors, the top last."""
        self.hash.append(leaf)
        self.left.append(-1)
        self.right.append(-1)
        new = [len(self.hash) - 1]
        for node, right in reversed(self._down(place)):
            new.append(self._add(self.left[node], new[-1]) if right else self._add(new[-1], self.right[node]))
        return new


def continued(node: str, path: Sequence[str]) -> list[str]:
    """The new ancestors of a node along the shared siblings of ``path``."""
    out = []
    for step in path:
        node = digest(node) if step == "-" else digest(step[1:], node) if step[0] == "L" else digest(node, step[1:])
        out.append(node)
    return out


def _height(n: int) -> int:
    return max(n - 1, 0).bit_length()


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place in its ``tree`` by ``order``, and ``n``, the leaves of the tree.

    Rows are dealt by ranges of (tree, order) and numbered in each range; a range's first number comes from the
    counts of the ranges before.
    """
    cols = ["tree", *order]
    dealt = nodes.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("part", F.spark_partition_id())

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, 0
        for batch in batches:
            names = batch.column("tree").to_pylist()
            out = np.empty(len(names), np.int64)
            for i, name in enumerate(names):
                tree, at = (tree, at + 1) if name == tree else (name, 0)
                out[i] = at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "idx"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes)
    rows = stored(dealt.mapInArrow(number, f"{kinds}, idx long"), "manifest-ranked")
    counts = rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("tree", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    first = stored(first, "manifest-first")
    out = rows.join(first, ["tree", "part"]).withColumn("pos", F.col("first") + F.col("idx")).drop("part", "idx", "first")
    out.tables = (rows, first)
    return out


def _blocks(nodes: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per aligned block: ``tree``, ``blk``, ``n`` and its nodes in order."""
    one = F.struct("pos", "hash", *carry)
    blk = F.shiftright("pos", LEVELS).alias("blk")
    return nodes.groupBy("tree", blk).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(one)).alias("nodes"))


def _tops(blocks: DataFrame) -> DataFrame:
    """The node that each block ends in, as a node of the level above."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("n").to_pylist()
            hashes = batch.column("hashes").to_pylist()
            top = []
            for n, leaves in zip(count, hashes, strict=True):
                tree = PersistentTree(leaves, min(LEVELS, _height(n)))
                top.append(tree.hash[tree.top])
            up = [-(-n // BLOCK) for n in count]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("blk"), pa.array(top, pa.string()), pa.array(up, pa.int64())], names=["tree", "pos", "hash", "n"])

    slim = blocks.select("tree", "blk", "n", F.col("nodes.hash").alias("hashes"))
    return slim.mapInArrow(run, "tree string, pos long, hash string, n long")


def _levels(leaves: DataFrame, carry: Sequence[str]) -> tuple[list[DataFrame], DataFrame]:
    """Block tables from the leaves up, and one row per tree with its top."""
    out, nodes, used = [], leaves, leaves.tables
    while True:
        out.append(stored(_blocks(nodes, carry if not out else ()), "manifest-blocks"))
        discard(*used)
        nodes = stored(_tops(out[-1]), "manifest-tops")
        used = (nodes,)
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return out, nodes.select("tree", "hash")


def _down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of a block's nodes, given the path ``above`` (tree, pos, path) of the block as a node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = PersistentTree(row["hashes"], min(LEVELS, _height(row["n"])))
                place = range(len(row["hashes"]))
                paths = [tree.path(i) + row["path"] for i in place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * len(paths), pa.string()), pa.array([(row["blk"] << LEVELS) + i for i in place], pa.int64()), pa.array(paths, pa.list_(pa.string()))],
                    names=["tree", "pos", "path"],
                )

    slim = blocks.select("tree", "blk", "n", F.col("nodes.hash").alias("hashes")).join(above.withColumnRenamed("pos", "blk"), ["tree", "blk"])
    return slim.mapInArrow(run, "tree string, pos long, path array<string>")


def _paths(levels: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the blocks of the lowest level; ``above`` (tree, path) is what stands over each tree."""
    path = above.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for blocks in reversed(levels[1:]):
        path = _down(blocks, path)
    return path


def _field(c: Column) -> Column:
    """Length in bytes, a colon and the value; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(cols: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(_field, cols)).cast("binary"), 256)


def manifest(docs: DataFrame, key: str = "doc_id", *, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tree: str = "lang", changes: Mapping[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per input row: ``key``, ``leaf``, ``subroot``, ``root``, ``proof``, ``changed``, ``copied``, ``folded_root``, ``verified``.

    ``leaf`` is the digest of ``fields``. Leaves of one value of ``tree`` ascend by ``key``, nulls first; rows that
    share a key ascend by their digest, so they have defined places, and rows repeated as they are each have one.
    Trees ascend by value, null first. ``proof`` holds the siblings from the leaf to the root. Rows where
    ``where`` holds are tampered: ``changes`` replaces fields, and the leaf it gives creates a version whose new
    nodes, from the leaf to its root, are ``copied``; ``folded_root`` is that root. Other rows have no version, and
    their root is folded from their leaf along the proof. A null in any field has a digest of its own; a table
    without rows has no result rows. Other columns, whatever their names, play no part.
    """
    changes = dict(changes or {})
    tamper = F.coalesce(where, F.lit(False)) if where is not None else F.lit(False)
    other = leaf([changes.get(c, F.col(c)) for c in fields])
    name = F.coalesce(F.concat(F.lit("v"), F.col(tree).cast("string")), F.lit("n")).alias("tree")
    nodes = docs.select(name, F.col(key).alias("key"), leaf([F.col(c) for c in fields]).alias("hash"), F.when(tamper, other).alias("other"))
    levels, tops = _levels(ranked(nodes, ["key", "hash"]), ("key", "other"))
    # the tops of the trees are the leaves of one tree
    upper = ranked(tops.select(F.lit("r").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"])
    high, root = _levels(upper, ("name",))
    over = root.select("tree", F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("path"))
    for blocks in reversed(high):
        over = _down(blocks, over)
    named = high[0].select("tree", F.explode("nodes").alias("x")).select("tree", "x.pos", F.col("x.name").alias("own"), F.col("x.hash").alias("subroot"))
    over = named.join(over.drop("tree"), "pos")
    over = over.join(F.broadcast(root.withColumnRenamed("hash", "root")), "tree")  # one row
    over = stored(over.select(F.col("own").alias("tree"), "subroot", "root", "path"), "manifest-over")
    path = _paths(levels, over.select("tree", "path"))
    whole = levels[0].join(path.withColumnRenamed("pos", "blk"), ["tree", "blk"]).join(over.select("tree", "subroot", "root"), "tree")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                inside = row["nodes"].values
                hashes, others = inside.field("hash").to_pylist(), inside.field("other").to_pylist()
                above, top = row["path"].as_py(), row["root"].as_py()
                block = PersistentTree(hashes, min(LEVELS, _height(row["n"].as_py())))
                proofs, copied, folded = [], [], []
                for i, (own, new) in enumerate(zip(hashes, others, strict=True)):
                    path = block.path(i) + above
                    if new is None:
                        copied.append(None)
                        folded.append((continued(own, path) or [own])[-1])
                    else:
                        low = [block.hash[k] for k in block.set(i, new)]
                        copied.append(low + continued(low[-1], above))
                        folded.append(copied[-1][-1])
                    proofs.append([s[1:] for s in path if s != "-"])
                n = len(hashes)
                same = lambda v: pa.array([v] * n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [inside.field("key"), pa.array(hashes), same(row["subroot"].as_py()), same(top), pa.array(proofs, pa.list_(pa.string())), pa.array([x is not None for x in others]), pa.array(copied, pa.list_(pa.string())), pa.array(folded), pa.array([f == top for f in folded])],
                    names=["key", "leaf", "subroot", "root", "proof", "changed", "copied", "folded_root", "verified"],
                )

    kind = docs.schema[key].dataType.simpleString()
    out = whole.mapInArrow(run, f"key {kind}, leaf string, subroot string, root string, proof array<string>, changed boolean, copied array<string>, folded_root string, verified boolean")
    return out.withColumnRenamed("key", key)
