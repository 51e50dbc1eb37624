"""Nearest neighbours by cosine: a forest of random-projection trees searched through one priority queue.

Trees are grown on a bounded sample: every node projects on a random direction and splits at the median. Their
depth follows the rows: a leaf of the sample stands for a number of all rows, down to two sample rows. All rows
are then placed in a leaf of each tree. A query walks all trees at once: the queue holds nodes of all trees by the smallest
margin on the way to them, so the leaves most likely to hold neighbours come first, whatever their tree. How many
leaves a query opens is measured on a few vectors against their true neighbours among all rows. Rows of opened leaves are then
ranked by exact cosines. Leaves are held in chunks of bounded size, so a full leaf is many rows and not one.

Equal vectors are one candidate that carries its smallest keys, so copies cost nothing and fill ranks exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

#: Candidates and queries of one chunk.
CHUNK, QUERY_CHUNK = 1024, 256


@dataclass
class Tree:
    """Inner nodes: direction, split, children; a negative child is the leaf ``-1 - child``."""

    direction: np.ndarray
    split: np.ndarray
    child: np.ndarray
    leaves: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        at = np.zeros(len(x), np.int64) if len(self.split) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = (x[inner] * self.direction[node]).sum(1) >= self.split[node]
            at[inner] = self.child[node, right.astype(int)]
        return -1 - at


def grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    direction, split, child = [], [], []
    leaves = 0

    def build(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            d = rng.standard_normal(x.shape[1])
            p = (x[rows] * d).sum(1)
            s = float(np.median(p))
            right = p >= s
            if right.any() and not right.all():
                me = len(split)
                direction.append(d)
                split.append(s)
                child.append([0, 0])
                child[me][0] = build(rows[~right])
                child[me][1] = build(rows[right])
                return me
        leaves += 1
        return -leaves

    build(np.arange(len(x)))
    dim = x.shape[1]
    return Tree(np.array(direction).reshape(-1, dim), np.array(split), np.array(child, np.int64).reshape(-1, 2), leaves)


def visit(trees: list[Tree], q: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """The first ``budget`` (tree, leaf) by margin; the queue is shared by all trees."""
    margins = [t.direction @ q - t.split for t in trees]
    queue = [(0.0, i, 0 if len(t.split) else -1) for i, t in enumerate(trees)]
    heapq.heapify(queue)
    out: list[tuple[int, int]] = []
    while queue and len(out) < budget:
        worst, i, node = heapq.heappop(queue)
        while node >= 0:
            m = float(margins[i][node])
            side = int(m >= 0)
            heapq.heappush(queue, (max(worst, abs(m)), i, int(trees[i].child[node, 1 - side])))
            node = int(trees[i].child[node, side])
        out.append((i, -1 - node))
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _true_neighbours(classes: DataFrame, probes: np.ndarray, own: list[int], k: int) -> dict[int, np.ndarray]:
    """For each probe its ``k`` nearest other vectors among all rows."""
    dim = probes.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sim = _unit(batch.column("v").flatten().to_numpy().reshape(-1, dim)) @ probes.T
            name = batch.column("cls").to_numpy()
            sim[name[:, None] == np.array(own)[None, :]] = -np.inf
            n = min(k, len(name))
            row = np.argpartition(-sim, n - 1, axis=0)[:n].T.ravel()
            probe = np.repeat(np.arange(len(probes)), n)
            yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(name[row]), pa.array(sim[row, probe])], names=["probe", "cls", "sim"])

    near = classes.select("cls", "v").mapInArrow(run, "probe long, cls long, sim double").where("sim > double('-infinity')")
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("sim"), "cls"))).where(F.col("r") <= k)
    out: dict[int, list] = {}
    for r in first.join(classes.select("cls", "v"), "cls").collect():
        out.setdefault(r["probe"], []).append(r["v"])
    return {i: _unit(np.array(v)) for i, v in out.items()}


def _budget(trees: list[Tree], probes: np.ndarray, true: dict[int, np.ndarray], goal: float) -> int:
    """Fewest leaves with which the probes meet ``goal`` of their true neighbours."""
    total = sum(t.leaves for t in trees)
    found_at = []
    for i, near in true.items():
        order = {leaf: n for n, leaf in enumerate(visit(trees, probes[i], total), 1)}
        found_at.append(np.min([[order[n, leaf] for leaf in t.place(near).tolist()] for n, t in enumerate(trees)], axis=0))
    return int(np.ceil(np.quantile(np.concatenate(found_at), goal))) if found_at else 1


#: Rows that could be ranked for what it costs to bring a query to one more leaf.
CARRY = 256


def grown(classes: DataFrame, *, k: int, trees: int, leaf: int, sample_rows: int, probes: int, goal: float, seed: int) -> tuple[list[Tree], int, int]:
    """The forest, how many leaves a query opens, and the length of the vectors that take part.

    Leaves of ``leaf`` rows and of 4, 16, ... times as many are tried; the forest whose searches cost least, in rows
    ranked and leaves opened, is taken. Where vectors are clustered these are small leaves.
    """
    total = classes.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = classes.where(F.pmod(F.xxhash64(F.lit(seed), "cls"), F.lit(1 << 30)) < F.lit(share * (1 << 30))).limit(2 * sample_rows)
    got = sorted((r["cls"], r["v"]) for r in sample.select("cls", "v").collect())
    sizes = [len(v) for _, v in got]
    if not sizes:
        return [], 0, 0
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n))
    got = [(c, v) for c, v in got if len(v) == dim]
    x = _unit(np.array([v for _, v in got]))
    asked = np.arange(0, len(x), max(1, len(x) // probes))
    true = _true_neighbours(classes.where(F.size("v") == dim), x[asked], [got[i][0] for i in asked], k)
    best = None
    while best is None or 16 * leaf <= total:
        rng = np.random.default_rng(seed)
        forest = [grow(x, max(2, round(leaf * len(x) / max(total, 1))), rng) for _ in range(trees)]
        budget = _budget(forest, x[asked], true, goal)
        rows = trees * total / sum(t.leaves for t in forest)
        if best is None or budget * (rows + CARRY) < best[0]:
            best = budget * (rows + CARRY), forest, budget
        leaf *= 4
    return best[1], best[2], dim


def vector_classes(rows: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Usable rows (id, v), and each different vector with its smallest keys."""
    value = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = F.expr("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    clean = rows.select(F.col(key).cast("long").alias("id"), value.alias("v")).where("id is not null and v is not null").where(good)
    few = clean.distinct().withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return clean, classes.select(F.xxhash64("v").alias("cls"), F.col("ids")[0].alias("low"), "ids", "v")


def nearest(
    rows: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", *, k: int = 5, trees: int = 6, leaf: int = 64, sample_rows: int = 4096, probes: int = 100, goal: float = 0.98, seed: int = 17
) -> DataFrame:
    """The ``k`` nearest rows of every key in ``queries``: query_id, rank, ``key``, score; ties go to smaller keys.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null keys and vectors
    of another length than most of the sample. A key is never its own neighbour. Repeated rows of a key count once. A
    key with several vectors is a neighbour by the nearest of them, and asks with the one that has the smallest
    other key, then the smallest hash. About ``sample_rows`` different vectors fit the trees, and ``probes`` of them
    measure how many leaves to open, against all rows; all rows are indexed.
    """
    clean, classes = vector_classes(rows, key, vector, k)
    classes = stored(classes, "ann-classes")
    forest, budget, dim = grown(classes, k=k, trees=trees, leaf=leaf, sample_rows=sample_rows, probes=probes, goal=goal, seed=seed)
    if not forest:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, " + key + " long, score double")
    classes = classes.where(F.size("v") == dim)

    def leaves_of(batches: Iterable[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            u = _unit(m)
            if every:
                at = np.stack([t.place(u) for t in forest], 1)
                row, tree = np.divmod(np.arange(at.size), len(forest))
                place = at.ravel()
            else:
                seen = [visit(forest, q, budget) for q in u]
                row = np.repeat(np.arange(len(u)), [len(s) for s in seen])
                tree, place = np.array([p for s in seen for p in s], np.int64).reshape(-1, 2).T
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("cls", "low", "v")), pa.array(tree.astype(np.int32)), pa.array(place.astype(np.int32))], names=["cls", "low", "v", "tree", "leaf"])

    def chunks(df: DataFrame, every: bool, size: int, name: str) -> DataFrame:
        placed = stored(df.select("cls", "low", "v").mapInArrow(lambda b: leaves_of(b, every), "cls long, low long, v array<double>, tree int, leaf int"), f"ann-{name}")
        # one row per tree and leaf: bounded by the sample
        counts = placed.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        part = F.pmod(F.xxhash64("cls"), F.col("n"))
        return placed.join(F.broadcast(counts), ["tree", "leaf"]).groupBy("tree", "leaf", part.alias("part")).agg(F.collect_list(F.struct("cls", "low", "v")).alias(name)).select("tree", "leaf", name)

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows_, asked in zip(batch.column("rows"), batch.column("asked"), strict=True):
                (c, low, cv), (q, _, qv) = ((*(np.asarray(s.values.field(f)) for f in ("cls", "low")), _scaled(s.values.field("v").flatten().to_numpy().reshape(-1, dim))) for s in (rows_, asked))
                sim = _unit(qv) @ _unit(cv).T
                n = min(k + 1, len(c))
                edge = np.partition(sim, len(c) - n, axis=1)[:, len(c) - n]
                a, b = np.nonzero(sim >= edge[:, None] - 1e-12)
                exact = (qv[a] * cv[b]).sum(1) / (np.sqrt((qv[a] ** 2).sum(1)) * np.sqrt((cv[b] ** 2).sum(1)))
                order = np.lexsort((c[b], low[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                nth = np.arange(len(a)) - np.searchsorted(a, a)
                keep = nth < n
                yield pa.RecordBatch.from_arrays([pa.array(q[a[keep]]), pa.array(c[b[keep]]), pa.array(low[b[keep]]), pa.array(exact[keep])], names=["q", "cls", "low", "score"])

    wanted = queries.select(F.col(key).cast("long").alias("query_id")).distinct()
    asked = wanted.join(clean.distinct().select(F.col("id").alias("query_id"), "v"), "query_id").join(classes.select("v", "low", F.col("cls").alias("q")), "v")
    asked = stored(asked.groupBy("query_id").agg(F.min(F.struct("low", "q")).alias("m")).select("query_id", "m.q"), "ann-queries")
    heads = classes.join(asked.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi")
    met = chunks(classes, True, CHUNK, "rows").join(chunks(heads, False, QUERY_CHUNK, "asked"), ["tree", "leaf"])
    scored = met.select("rows", "asked").mapInArrow(rank, "q long, cls long, low long, score double").groupBy("q", "cls", "low").agg(F.max("score").alias("score"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "low", "cls"))).where(F.col("r") <= k + 1)
    whole = best.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias(key))
    answers = asked.join(whole, "q").where(F.col(key) != F.col("query_id")).groupBy("query_id", key).agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return answers.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
