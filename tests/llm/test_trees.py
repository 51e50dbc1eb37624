"""R-tree negatives, byte repeats and the manifest against plain readings of their definitions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_edges import frame, odd, prose

from millrace.llm import manifest, neighbours, pages, rtree, suffixes

VECTORS = "vec_id long, embedding array<double>, label int, x string, id string, score string"


def negatives_plain(rows, anchors, positives=5, k=10, low=30, high=90):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        kept.append((i, label, tuple(int(np.floor(256 * c)) for c in v)))
    kept = sorted(set(kept))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = collections.Counter()
    for i, label, v in kept:
        if not anchors(i):
            continue
        scored = sorted((-dot(v, w), j, m == label) for j, m, w in kept if j != i or m != label)
        near = [(-s, j) for s, j, same in scored if same and j != i][:positives]
        for p, j in near:
            found = [(-s, n) for s, n, same in scored if not same and low * p <= 100 * -s <= high * p][:k]
            for rank, (s, n) in enumerate(found, 1):
                out[i, j, rank, n, p, s] += 1
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "i", "s") for i, v, label in rows], VECTORS)


def negatives(table, **more):
    out = rtree.hard_negatives(table, F.col("vec_id") % 10 == 0, **more).collect()
    return collections.Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in out)


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8)) / 3 + np.repeat(rng.standard_normal((9, 8)), 100, 0)
    x[200:500] = x[200]  # a third of all rows are copies
    label = rng.integers(0, 4, 900)
    label[label == 3] = 0  # a label that holds half of all rows
    rows = [(i, v.tolist(), int(m)) for i, (v, m) in enumerate(zip(x, label, strict=True))]
    rows += [(1000, None, 1), (1010, x[0].tolist(), None), (1020, [float("nan")] * 8, 1), (1030, [None] + [1.0] * 7, 1), (1040, [float("inf")] * 8, 1), (None, x[0].tolist(), 1)]
    rows += [(1050, [0.0] * 8, 2), (1060, [], 1), (1070, [3.0], 1), (0, x[0].tolist(), int(label[0])), (10, x[700].tolist(), 2), (1080, [1e6] * 8, 7)]
    full = [(i, v if v is None else [*v, *[0.0] * (8 - len(v))], m) for i, v, m in rows]
    got = negatives(vectors(spark, rows))
    assert got == negatives_plain(full, lambda i: i % 10 == 0)
    assert len(got) > 1000
    assert not negatives(vectors(spark, []))
    assert not negatives(vectors(spark, [(0, [1.0], 1), (10, [2.0], 1)]))  # no other label
    assert negatives(vectors(spark, [(0, [1.0], 1), (1, [2.0], 1), (2, [1.0], 2)]), k=1) == {(0, 1, 1, 2, 131072 // 1, 65536): 1}


def test_hard_negatives_of_small_parts(spark, monkeypatch):
    """Small subtrees, blocks and cells give the same rows."""
    for name, value in (("RUN", 64), ("TREE", 32), ("BLOCK", 4), ("CELL_TREES", 2), ("CELL_BLOCKS", 2)):
        monkeypatch.setattr(rtree, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(rng.standard_normal((400, 5)))]
    assert negatives(vectors(spark, rows)) == negatives_plain(rows, lambda i: i % 10 == 0)


def test_boxes_prune_clustered_rows():
    """Best-first search reads few leaves where rows are clustered, and finds what reading all finds."""
    rng = np.random.default_rng(5)
    centre = rng.integers(-2000, 2000, (32, 6))
    x = (centre[rng.integers(0, 32, 2048)] + rng.integers(-20, 20, (2048, 6))).astype(np.int32)
    order = rtree.tiles([x[:, c] for c in range(3)], rtree.LEAF)
    assert sorted(order) == list(range(2048))
    x = x[order]
    tree = rtree.Subtree(np.arange(2048).tobytes(), np.zeros(2048, np.int64).tobytes(), x.tobytes(), 6)
    q = x[::100].astype(np.int64)
    lower, upper, exact = tree.intervals(q)
    scores = x.astype(np.int64) @ q.T
    read = 0
    for i in range(len(q)):
        goal = rtree.Goal(0, int(scores[:, i].max() * 0.9), 10, False)
        read += tree.search(lower[i], upper[i], exact, q[i].astype(exact.dtype), -1, 1, [goal])
        s = scores[:, i]
        plain = sorted((-int(v), j) for j, v in enumerate(s) if 0 <= v <= goal.high)[:10]
        assert goal.top == plain
    assert read < 0.5 * len(q) * tree.leaves


def bytes_plain(rows, width):
    at = collections.Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for i in range(len(d) - width + 1):
            at[d[i : i + width]] += 1
    out = collections.Counter()
    for (k, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - width + 1):
            if at[d[i : i + width]] > 1:
                gone[i : i + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[k, len(d), int(gone.sum()), spans, bytes(b for b, g in zip(d, gone) if not g)] += 1
    return out


def removed(docs, width):
    out = suffixes.drop_repeats(docs, width=width).collect()
    assert all(sum(s["b"] - s["a"] for s in r["spans"]) == r["n_removed"] for r in out)
    return collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in out)


@pytest.mark.parametrize(("width", "piece", "members"), [(40, 1 << 20, 4096), (200, 1 << 20, 4096), (40, 700, 3)])
def test_byte_repeats(spark, monkeypatch, width, piece, members):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "MEMBERS", members)
    rng = random.Random(6)
    passages = [prose(rng, 60, "abcdé") for _ in range(3)]
    rows = [(i, t) for i, t, _ in odd(rng) if t is None or len(t) < 10_000]
    for i in range(60):
        text = rng.choice(passages)
        a = rng.randrange(len(text) // 3)
        cut = list(text[a : a + width + rng.randrange(len(text) - width if len(text) > width else 1)])
        if i % 3 == 0:
            cut[rng.randrange(len(cut))] = "X"
        rows.append((100 + i, prose(rng, rng.randint(0, 20), "abc") + "".join(cut) + prose(rng, rng.randint(0, 20), "abc")))
    rows += [(300, "a" * 1500), (301, "xyz" * 400), (302, "é" * 300), (303, passages[0][:width]), (304, passages[0][: width - 1]), (305, passages[1] + passages[1])]
    table = frame(spark, [(i, t, "en") for i, t in rows])
    assert removed(table, width) == bytes_plain(rows, width)
    assert suffixes.drop_repeats(table.limit(0)).count() == 0


def test_byte_repeats_of_edited_copies(spark):
    """Many variants of one text, and a long text with a repeat far inside."""
    rng = random.Random(7)
    base = prose(rng, 100)
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        rows.append((i, "".join(t)))
    long = prose(rng, 8000)
    rows += [(200, long), (201, long[20_000:20_500])]
    assert removed(frame(spark, [(i, t, "en") for i, t in rows]), 200) == bytes_plain(rows, 200)


def test_transform_of_a_collection():
    """Members and common prefixes of every round are those of sorting the suffixes."""
    rng = random.Random(8)
    text = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(30)]
    begin = np.array([rng.randint(-6, 0) for _ in text])
    group = np.array([rng.randint(0, 2) for _ in text])
    size = np.array([len(t) for t in text])
    built = suffixes.Transform(np.frombuffer("".join(text).encode(), np.uint8), np.cumsum(size) - size, begin, begin + size, group)
    seen = 0
    for column, symbols, member, common in built.read():
        here = [i for i in range(len(text)) if begin[i] <= column < begin[i] + size[i]]
        suffix = {i: text[i][column - begin[i] :] for i in here}
        assert [(group[i], suffix[i]) for i in member] == sorted((group[i], suffix[i]) for i in here)
        assert sorted(symbols) == sorted(ord(suffix[i][0]) for i in here)
        for n in range(1, len(member)):
            a, b = member[n - 1], member[n]
            shared = 0
            while group[a] == group[b] and shared < min(len(suffix[a]), len(suffix[b])) and suffix[a][shared] == suffix[b][shared]:
                shared += 1
            assert common[n] == shared
        seen += len(here)
    built.close()
    assert seen == size.sum()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_plain(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def fold_plain(leaves, place):
    """Root, and siblings of one place with their side."""
    row, path = list(leaves), []
    while len(row) > 1:
        other = place ^ 1
        path.append((other < place, row[other] if other < len(row) else None))
        row = [h(*row[i : i + 2]) for i in range(0, len(row), 2)]
        place >>= 1
    return row[0], path


def up_plain(node, path):
    for left, other in path:
        node = h(node) if other is None else h(other, node) if left else h(node, other)
    return node


def manifest_plain(rows):
    """doc_id, source, lang, n_chars, text of each row, and whether it is tampered."""
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf_plain(r), r))
    names = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    tops = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        tops[name], _ = fold_plain([x[2] for x in trees[name]], 0)
    out = collections.Counter()
    for at, name in enumerate(names):
        root, over = fold_plain([tops[n] for n in names], at)
        for place, (_, _, leaf, r) in enumerate(trees[name]):
            path = fold_plain([x[2] for x in trees[name]], place)[1] + over
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            start = leaf_plain((*r[:3], r[3] + 1, r[4])) if bad and r[3] is not None else leaf
            folded = up_plain(start, path)
            out[r[0], leaf, tops[name], root, "".join(x for _, x in path if x), folded, folded == root] += 1
    return out


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 1 << levels)
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", None, "ü"]), rng.choice(["en", "en", "en", "de", None, "", "n"]), rng.choice([None, 3, 40]), rng.choice([None, "", "text ü", prose(rng, 5)])) for i in range(150)]
    rows += [rows[3], (3, "z", "en", 1, "other"), (None, None, None, None, None), (None, "s", "en", 5, "t"), (999, "s", "only", 5, "long " * 5000)]
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash string, key string"
    docs = spark.createDataFrame([(*r, "t", "h", "k") for r in rows], schema)
    where = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    build = lambda df: manifest.manifest(df, changes={"n_chars": F.col("n_chars") + 1}, where=where)
    out = build(docs).collect()
    got = collections.Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], "".join(r["proof"]), r["folded_root"], r["verified"]) for r in out)
    assert got == manifest_plain(rows)
    for r in out:
        assert (r["copied"] is not None) == r["changed"]
        if r["changed"]:  # a version copies the way to its root and nothing else
            assert r["copied"][-1] == r["folded_root"]
    assert build(docs.limit(0)).count() == 0
    assert build(docs.limit(1)).first()["proof"] == []


def test_versions_share_nodes():
    tree = manifest.PersistentTree([h(str(i)) for i in range(13)], 10)
    before, top = list(tree.hash), tree.top
    for place in (0, 7, 12):
        n = len(tree.hash)
        new = tree.set(place, h("new"))
        assert len(new) == len(tree.hash) - n == 11
        assert tree.hash[new[-1]] == up_plain(h("new"), fold_path([h(str(i)) for i in range(13)], place, 10))
    assert tree.hash[: len(before)] == before and tree.top == top


def fold_path(row, place, levels):
    path = []
    for _ in range(levels):
        other = place ^ 1
        path.append((other < place, row[other] if other < len(row) else None))
        row = [h(*row[i : i + 2]) for i in range(0, len(row), 2)]
        place >>= 1
    return path


def said(page):
    return [b.text for b in pages.blocks(page)]


def test_no_text_of_a_page_is_lost():
    assert said("<p data=it's>Hello</p><p>I don't know</p><p>end</p>") == ["Hello", "I don't know", "end"]
    assert said("<p>a <math><mi>x</mi></math> b</p>") == ["a x b"]
    assert said("<p>one<object><p>two</p><p>three</p>") == ["one", "two", "three"]
    assert said("<p>one<template><p>two") == ["one", "two"]
    assert said("<noscript>one</noscript> <svg><text>two</text></svg><template>no</template><iframe>no</iframe>") == ["one two"]
    assert said("<p title=\"a > b\" class='c'>one</p><p title=\"open>two</p><p>three") == ["one", "two", "three"]
    assert said("5 < 6 and <3 </ 7 <") == ["5 < 6 and <3 </ 7 <"]
    assert said("<!-- <p>no</p> --><!doctype html><p>one<script>no</p></script><style>no") == ["one"]
    assert said("a<br>b<a href=x/>c</a>") == ["a bc"]
    assert said("<ul><li>one<li>two<ul><li>in</ul><li>three</ul><p>x<div>y") == ["one", "two", "in", "three", "x", "y"]


def test_blocks_are_those_of_a_plain_parser():
    """Texts of block elements of whole pages, next to the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.parts, self.skip = [], [], 0

        def end(self):
            text = " ".join("".join(self.parts).split())
            self.out += [text] if text else []
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            if tag in pages.BLOCKS:
                self.end()
            elif tag == "br":
                self.parts.append(" ")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")
            if tag in pages.BLOCKS:
                self.end()

        def handle_data(self, data):
            if not self.skip:
                self.parts.append(data)

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        plain = Plain()
        plain.feed(page or "")
        plain.close()
        plain.end()
        assert said(page) == plain.out


@pytest.mark.parametrize("shape", ["<a ", "<div>x", "<p x='", "</b><i>x", "<li>x<b>", "<template>", "<!-- ", "<td><div>x</span>", "<", "<b class=a"])
def test_time_follows_the_page(shape):
    from time import process_time

    def spent(size):
        page = shape * (size // len(shape))
        return min(_timed(process_time, page) for _ in range(3))

    spent(20_000)
    assert spent(200_000) <= 15 * max(spent(20_000), 0.004)


def _timed(clock, page):
    began = clock()
    pages.features([pages.blocks(page)])
    return clock() - began


def test_forest_ranks_few_rows_of_clustered_vectors(spark):
    """50,000 rows in clusters: recall against all rows, and the share of rows that a query is compared with."""
    rng = np.random.default_rng(61)
    centre = rng.standard_normal((1000, 24))
    x = centre[rng.integers(0, 1000, 50_000)] + rng.standard_normal((50_000, 24)) / 4
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)})).repartition(8)
    found = neighbours.nearest(rows, rows.where("vec_id % 500 = 0")).toPandas().groupby("query_id")["vec_id"].apply(set)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    _, classes = neighbours.vector_classes(rows, "vec_id", "embedding", 5)
    forest, budget, _ = neighbours.grown(classes, k=5, trees=6, leaf=64, sample_rows=4096, probes=100, goal=0.98, seed=17)
    place = [t.place(unit) for t in forest]
    hit, seen = 0, []
    for q in range(0, len(x), 500):
        c = unit @ unit[q]
        c[q] = -2
        hit += len(found[q] & set(np.argsort(-c)[:5].tolist()))
        ranked = np.zeros(len(x), bool)
        for tree, leaf in neighbours.visit(forest, unit[q], budget):
            ranked |= place[tree] == leaf
        seen.append(ranked.mean())
    assert hit >= 0.9 * 5 * len(found)
    assert np.mean(seen) < 0.1, np.mean(seen)


def test_keys_with_two_vectors_and_huge_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0**660, 0.0]), (2, [0.0, 2.0**-660]), (3, [2.0**990, 2.0**990]), (50, [2.0, 2.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(table, table.where("vec_id % 50 = 0")).collect()}
    assert sorted(v for (q, _), (v, _) in out.items() if q == 50) == [0, 1, 2, 3]
    assert out[50, 1][0] == 3 and abs(out[50, 1][1] - 4.1 / np.sqrt(2 * (4 + 2.1**2))) < 1e-12
    assert [out[50, r][0] for r in (2, 3, 4)] == [0, 2, 1]
    first = [out[0, r][0] for r in (1, 2, 3, 4)]
    assert first in ([1, 3, 50, 2], [2, 50, 3, 1])
