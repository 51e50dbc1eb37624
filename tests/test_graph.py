"""Topic clusters with long titles, and the page graph where many pages share a name."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from millrace.operators import retrieval as R
from millrace.operators import topics


def clusters(rows):
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for k, s in rows:
        for w in s:
            by.setdefault(w, []).append(k)
    sets = {k: set(s) for k, s in rows}
    seen = set()
    for keys in by.values():
        for a, b in combinations(keys, 2):
            if (a, b) in seen or find(a) == find(b):
                continue
            seen.add((a, b))
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.15:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(k, find(k)) for k, _ in rows}


def test_long_titles(spark):
    """Forty stems among ten thousand short titles; long ones that share half, a sixth and too few of their stems."""
    rng = random.Random(51)
    rows = [(i, sorted({f"a{rng.randrange(4000)}", f"b{rng.randrange(4000)}", f"c{rng.randrange(4000)}"})) for i in range(10_000)]
    long = [f"l{i}" for i in range(40)]
    rows += [(20_000, long), (20_001, [f"m{i}" for i in range(20)] + long[:20]), (20_002, [f"n{i}" for i in range(30)] + long[:10]), (20_003, [f"o{i}" for i in range(36)] + long[-4:])]
    rows += [(20_004, long[:6]), (20_005, long[5:7] + ["zz"]), (20_006, [f"a{i}" for i in range(40)])]
    rows = [(k, sorted(set(s))) for k, s in rows]
    got = {(r.key, r.cluster) for r in topics.topic_clusters(spark.createDataFrame(rows, "key long, stems array<string>")).collect()}
    assert got == clusters(rows)


def test_long_titles_with_hot_stems(spark):
    rng = random.Random(52)
    rows = []
    for i in range(300):
        hot = [f"h{j}" for j in range(rng.randint(0, 4))]
        rows.append((i, sorted({*hot, *(f"s{rng.randrange(900)}" for _ in range(rng.choice([1, 5, 13, 30])))})))
    frame = spark.createDataFrame(rows, "key long, stems array<string>")
    assert {(r.key, r.cluster) for r in topics.topic_clusters(frame).collect()} == clusters(rows)
    sets = frame.select(F.col("key").alias("id"), "stems").withColumn("n", F.size("stems"))
    first = topics.prefixes(sets)
    assert topics._candidates(first, first).count() < 300 * 299 / 4


def test_pages_that_share_a_name(spark):
    rows = [(1, "the", ["the", "of"]), (2, "the", []), (3, "of", ["x", "dir/the"]), (4, "", ["the"]), (5, "alone", ["alone", "alone"]), (6, None, [])]
    pages = spark.createDataFrame(rows, "page_id long, name string, links array<string>")
    links = R.page_links(pages, "page_id", "name", F.col("links"))
    assert {tuple(r) for r in links.collect()} == {(1, "the", "the", "key", 2), (1, "of", "of", "key", 1), (3, "x", None, "broken", 0), (3, "dir/the", "the", "stem", 2), (4, "the", "the", "key", 2), (5, "alone", "alone", "key", 1)}
    degrees = {r.key: (r.outbound, r.inbound, r.orphan, r.sink) for r in R.graph_degrees(pages, "page_id", "name", links).collect()}
    assert degrees == {1: (3, 3, False, False), 2: (0, 3, False, True), 3: (2, 1, False, False), 4: (2, 0, True, False), 5: (1, 1, False, False), 6: (0, 0, True, True)}
    found = R.connected_components(pages.select(F.col("page_id").alias("key")), "key", R.page_edges(pages, "page_id", "name", links))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6)}


def test_a_hot_name_gives_no_pairs(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("the").alias("name"), F.array(F.lit("the")).alias("links"))
    links = R.page_links(pages, "page_id", "name", F.col("links"))
    assert links.count() == 2000
    assert R.page_edges(pages, "page_id", "name", links).count() <= 2000
    assert R.graph_degrees(pages, "page_id", "name", links).where("outbound = 2000 and inbound = 2000").count() == 2000
