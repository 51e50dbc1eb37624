"""Hard negatives by an STR-packed R-tree over integer vectors, with the label as one more coordinate.

Rows are dealt by ranges of (label, widest coordinates) and packed in runs of bounded size: a run is sorted by one
coordinate, cut into tiles, each tile sorted by the next one, and so on; consecutive rows are a leaf, consecutive
leaves a node. A subtree of bounded size is one row of a table, so the tree grows by rows and no task holds all of it.

The minimum bounding box of a node bounds each coordinate, and so the inner product of its rows with an anchor from
both sides. A search takes nodes from a best-first queue by upper bound. A node is pruned if its interval lies
outside every score window, if its labels can't fit, or if its upper bound is strictly below the kth score
found so far; at exactly the kth score it stays only if it holds a smaller id. Blocks of anchors meet all subtrees
that may fit them on a grid of bounded cells, and what a task has found for a block bounds its later subtrees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, stored

#: Rows of a run that is packed together, of a subtree and of a leaf; children of a node; tiled coordinates.
RUN, TREE, LEAF, FAN, TILED = 16384, 2048, 64, 4, 3
#: Anchors of a block; subtrees and blocks of a cell of the grid.
BLOCK, CELL_TREES, CELL_BLOCKS = 128, 16, 16
#: Exact sums of products in double precision stay below this.
EXACT = 1 << 53


def integer_vectors(rows: DataFrame, key: str, label: str, vector: str, relabel: Column | None) -> tuple[DataFrame, int]:
    """``id``, ``label``, ``v``: each distinct usable row once, its components as floor(256 x), and their number."""
    value = F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")
    mark = (relabel if relabel is not None else F.col(label)).cast("long").alias("label")
    good = F.expr("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    clean = rows.select(F.col(key).cast("long").alias("id"), mark, value).where("id is not null and label is not null and v is not null").where(good)
    dim = clean.agg(F.max(F.size("v"))).first()[0] or 0
    most = 1 << ((62 - max(dim, 1).bit_length()) // 2)
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * 256), F.lit(most)), F.lit(-most)).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(dim) - F.size("v")))
    return clean.select("id", "label", padded.alias("v")).distinct(), dim


def tiles(columns: list[np.ndarray], leaf: int) -> np.ndarray:
    """Order that sorts by the first column, cuts into equal tiles, and orders each by the other columns."""
    n = len(columns[0])
    if len(columns) == 1 or n <= leaf:
        return np.lexsort(columns[::-1])
    cut = max(1, ceil(ceil(n / leaf) ** (1 / len(columns))))
    order = np.lexsort(columns[::-1])
    step = ceil(ceil(n / cut) / leaf) * leaf
    out = []
    for a in range(0, n, step):
        part = order[a : a + step]
        out.append(part[tiles([c[part] for c in columns[1:]], leaf)])
    return np.concatenate(out)


def boxes(x: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest value of every node in each column, the node's first child or row, and how many.

    Leaves come first, then each level above, the root last.
    """
    at = np.arange(0, len(x), leaf)
    lo, hi = [np.minimum.reduceat(x, at)], [np.maximum.reduceat(x, at)]
    first, count = [at], [np.diff(np.append(at, len(x)))]
    below = 0
    while len(lo[-1]) > 1:
        at = np.arange(0, len(lo[-1]), fan)
        first.append(below + at)
        count.append(np.diff(np.append(at, len(lo[-1]))))
        below += len(lo[-1])
        lo, hi = [*lo, np.minimum.reduceat(lo[-1], at)], [*hi, np.maximum.reduceat(hi[-1], at)]
    return np.concatenate(lo), np.concatenate(hi), np.concatenate(first), np.concatenate(count)


def pack(clean: DataFrame, dim: int) -> DataFrame:
    """Subtrees: one row each, with the rows in packed order."""
    wide = clean.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("s"))
    chosen = [r["at"] for r in wide.orderBy(F.desc("s"), "at").limit(TILED).collect()]
    order = ["label", *(F.col("v")[c] for c in chosen), "id"]

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, made = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for a in range(0, batch.num_rows, RUN):
                part = batch.slice(a, RUN)
                held.append((part.column("id").to_numpy(), part.column("label").to_numpy(), part.column("v").flatten().to_numpy().reshape(part.num_rows, dim)))
                size += part.num_rows
                if size >= RUN:
                    yield run(held, made)
                    made += ceil(size / TREE)
                    held, size = [], 0
        if size:
            yield run(held, made)

    def run(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], made: int) -> pa.RecordBatch:
        ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
        placed = tiles([labels, *(x[:, c] for c in chosen), ids], LEAF)
        ids, labels, x = ids[placed], labels[placed], x[placed]
        cuts = [slice(a, a + TREE) for a in range(0, len(ids), TREE)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(made, made + len(cuts))),
                pa.array([int(labels[c].min()) for c in cuts]),
                pa.array([int(labels[c].max()) for c in cuts]),
                pa.array([ids[c].astype(np.int64).tobytes() for c in cuts], pa.binary()),
                pa.array([labels[c].astype(np.int64).tobytes() for c in cuts], pa.binary()),
                pa.array([np.ascontiguousarray(x[c], np.int32).tobytes() for c in cuts], pa.binary()),
            ],
            names=["tree", "label_lo", "label_hi", "ids", "labels", "x"],
        )

    dealt = clean.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(build, "tree long, label_lo long, label_hi long, ids binary, labels binary, x binary")


class Goal:
    """The best ``k`` (score, id) with a score from ``low`` to ``high``."""

    __slots__ = ("high", "k", "kth", "low", "own", "same", "top")

    def __init__(self, low: float, high: float, k: int, same: bool):
        self.low, self.high, self.k, self.same = low, high, k, same
        self.top: list[tuple[int, int]] = []
        self.kth = (-np.inf, 0)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        new = zip((-scores).tolist(), ids.tolist(), strict=True)
        self.top = sorted([*self.top, *new])[: self.k]
        if len(self.top) == self.k:
            self.kth = -self.top[-1][0], self.top[-1][1]


class Subtree:
    """A packed subtree; its boxes are built when it is read."""

    def __init__(self, ids: bytes, labels: bytes, x: bytes, dim: int):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.x = np.frombuffer(x, np.int32).reshape(len(self.ids), dim)
        self.lo, self.hi, self.first, self.count = boxes(self.x)
        self.label_lo, self.label_hi, *_ = boxes(self.labels)
        self.min_id = boxes(self.ids)[0]
        self.leaves = ceil(len(self.ids) / LEAF)
        self.largest = int(np.abs(self.x.astype(np.int64)).max(initial=0))

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the inner products of each anchor with each node, and the rows in a type that keeps them exact."""
        kind = np.float64 if self.largest * int(np.abs(q).max(initial=0)) * max(q.shape[1], 1) < EXACT else np.int64
        plus, minus = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        lo, hi = self.lo.astype(kind).T, self.hi.astype(kind).T
        return plus @ lo + minus @ hi, plus @ hi + minus @ lo, self.x.astype(kind)

    def search(self, lower: np.ndarray, upper: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, label: int, goals: list[Goal]) -> int:
        """Update the goals of one anchor; returns how many leaves were read."""
        same = goals[0].same
        fits = (self.label_lo <= label) & (self.label_hi >= label) if same else (self.label_lo != label) | (self.label_hi != label)
        lower, upper = lower.tolist(), upper.tolist()
        root = len(upper) - 1
        queue, read = [(-upper[root], root)], 0
        while queue:
            most, node = heapq.heappop(queue)
            most = -most
            # a goal that even this bound can't reach is reached by none that follows
            goals = [g for g in goals if most >= g.low and most >= g.kth[0]]
            if not goals:
                break
            live = [g for g in goals if lower[node] <= g.high and (most > g.kth[0] or self.min_id[node] < g.kth[1])]
            if not live or not fits[node]:
                continue
            a, n = int(self.first[node]), int(self.count[node])
            if node >= self.leaves:
                for child in range(a, a + n):
                    heapq.heappush(queue, (-upper[child], child))
                continue
            read += 1
            scores = x[a : a + n] @ q
            ids = self.ids[a : a + n]
            ok = (self.labels[a : a + n] == label) == same
            if same:
                ok &= ids != own
            for g in live:
                good = np.flatnonzero(ok & (scores >= max(g.low, g.kth[0])) & (scores <= g.high))
                if len(good):
                    g.add(scores[good].astype(np.int64), ids[good])
        return read


def _searched(pairs: DataFrame, dim: int, k: int, same: bool) -> DataFrame:
    """Best ids of each (anchor, window) that a task has seen: ``a``, ``low``, ``high``, ``id``, ``score``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[tuple[int, int, int, np.ndarray, list[Goal]]]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                col = {c: batch.column(c)[at] for c in batch.schema.names}
                number = col["block"].as_py()
                if number not in blocks:
                    if len(blocks) >= 4 * CELL_BLOCKS:
                        yield found(blocks.pop(next(iter(blocks))))
                    blocks[number] = [(r["a"], r["id"], r["label"], np.array(r["v"], np.int64), [Goal(w["low"], w["high"], k, same) for w in r["windows"]]) for r in col["anchors"].as_py()]
                anchors = blocks[number]
                tree = Subtree(col["ids"].as_py(), col["labels"].as_py(), col["x"].as_py(), dim)
                q = np.stack([r[3] for r in anchors]).reshape(len(anchors), dim)
                lower, upper, x = tree.intervals(q)
                q = q.astype(x.dtype)
                for i, (_, own, label, _, goals) in enumerate(anchors):
                    if goals:
                        tree.search(lower[i], upper[i], x, q[i], own, label, goals)
        for anchors in blocks.values():
            yield found(anchors)

    def found(anchors: list) -> pa.RecordBatch:
        out = [(a, g.low, g.high, i, -s) for a, _, _, _, goals in anchors for g in goals for s, i in g.top]
        cols = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "low", "high", "id", "score"])

    return pairs.mapInArrow(run, "a long, low long, high long, id long, score long")


def _met(trees: DataFrame, anchors: DataFrame, fits: Column) -> DataFrame:
    """Blocks of anchors next to the subtrees that may fit: cells of a grid, each of bounded size on both sides."""
    n_trees, n_anchors = trees.count(), anchors.count()
    down, across = max(1, ceil(n_trees / CELL_TREES)), max(1, ceil(n_anchors / BLOCK / CELL_BLOCKS))
    most = anchors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    placed = anchors.join(most, "label").withColumn("part", F.pmod(F.col("a"), F.col("parts")))
    blocks = placed.groupBy("label", "part").agg(F.collect_list(F.struct("a", "id", "label", "v", "windows")).alias("anchors")).withColumn("block", F.xxhash64("label", "part"))
    left = trees.withColumn("g", F.pmod(F.xxhash64("tree"), F.lit(down))).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    right = blocks.withColumn("h", F.pmod(F.xxhash64("block", F.lit(1)), F.lit(across))).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    return left.join(right, ["g", "h"]).where(fits).select("block", "anchors", "ids", "labels", "x")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` by score, ties by smaller id; ``rank`` counts from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", *, relabel: Column | None = None, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Scores are integer inner products of floor(256 x). Rows where ``anchors`` holds are anchors; their positives
    are the first ``positives`` rows of the same label with another key; negatives are the first ``k`` rows of
    other labels with low * positive_score <= 100 * score <= high * positive_score. Higher scores come
    first, ties by smaller key. Rows with a null key, label or vector, or a null or non-finite component, take no
    part. Rows repeated as they are count once; rows that share a key with other content each take part, also as
    anchors. Shorter vectors are taken as ending in zeros. Components so large that sums of products would leave
    64 bits count as the largest that can't. Other columns, whatever their names, play no part.
    """
    kept = rows.withColumn("__anchor", F.coalesce(anchors, F.lit(False)))
    clean, dim = integer_vectors(kept, key, label, vector, relabel)
    clean = stored(clean, "rtree-rows")
    trees = stored(pack(clean, dim), "rtree-trees")
    wanted = kept.where("__anchor").select(F.col(key).cast("long").alias("id")).distinct()
    asked = stored(clean.join(wanted, "id").withColumn("a", F.xxhash64("id", "label", "v")), "rtree-anchors")
    everything = F.array(F.struct(F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    own = (F.col("label_lo") <= F.col("label")) & (F.col("label") <= F.col("label_hi"))
    near = _searched(_met(trees, asked.withColumn("windows", everything), own), dim, positives, True)
    near = stored(_best(near, ["a"], positives).select("a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "rtree-positives")
    scaled = "cast(positive_score as decimal(20, 0)) *"
    down = F.expr(f"-((-{scaled} {low} - pmod(-{scaled} {low}, 100)) div 100)")
    up = F.expr(f"({scaled} {high} - pmod({scaled} {high}, 100)) div 100")
    near = near.withColumn("low", down).withColumn("high", up).where("low <= high")
    windows = near.groupBy("a").agg(F.collect_set(F.struct("low", "high")).alias("windows"))
    other = (F.col("label_lo") != F.col("label")) | (F.col("label_hi") != F.col("label"))
    far = stored(_best(_searched(_met(trees, asked.join(windows, "a"), other), dim, k, False), ["a", "low", "high"], k), "rtree-negatives")
    out = near.join(far, ["a", "low", "high"]).join(asked.select("a", F.col("id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
