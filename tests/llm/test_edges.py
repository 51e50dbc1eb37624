"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import common, language, lattice, leaks, near, neighbours, packing, pages, queries, substring, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, score string, row string, `__row` string, word string, cls string, length string"


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def frame(spark, rows):
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, "s", "r", "k", "w", "c", "l") for i, t, lang in rows], SCHEMA)


def odd(rng):
    long = prose(rng, 60_000)
    passage = prose(rng, 60)
    return [
        (1, None, "en"), (2, "", "en"), (3, "  \t\n", None), (4, "one", "en"), (4, "one", "en"), (None, "null key", "en"),
        (None, None, None), (7, long, "en"), (8, passage, "de"), (8, passage, "de"), (9, prose(rng, 40) + " " + passage, "de"), (4, "another text of this key", "de"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd(random.Random(1))).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def split(t):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_language(spark, docs, none):
    model = language.fit(docs, "text", "lang", "doc_id", F.lit(True))
    out = language.identify(docs, model).collect()
    assert len(out) == 12
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    for k in (1, 2, 3):
        assert [(r["lang_pred"], r["score"], r["rejected"]) for r in by[k]] == [("und", 0.0, True)]
    assert all(r["lang_pred"] in ("en", "de") and 0 <= r["score"] <= 1 for r in by[7] + by[8] + by[9])
    assert language.identify(none, model).count() == 0
    blank = language.fit(none, "text", "lang", "doc_id", F.lit(True))
    assert {r["lang_pred"] for r in language.identify(docs, blank).collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert out.where("rejected").count() == 0


def near_plain(rows, width, percent):
    """Component by brute force over all pairs of rows."""
    sets = []
    for _, t in rows:
        w = split(lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    low = {g: min((k for k in keys if k is not None), default=None) for g, keys in groups.items()}
    return collections.Counter((k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows))


def test_near_edges(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = near.near_duplicates(docs, width=5).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == near_plain(rows, 5, 80)
    assert near.near_duplicates(none).count() == 0


def test_near_hot_group(spark):
    """Edited copies of one text, many near the bound: components equal those over all pairs."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    second = list(base[:60]) + prose(rng, 60).split()
    for i in range(160, 200):
        w = list(second)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    docs = frame(spark, [(i, t, "en") for i, t in rows])
    out = near.near_duplicates(docs, width=4).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == near_plain(rows, 4, 80)


def repeats_plain(rows, window):
    at = collections.Counter()
    words = [split(t) for _, t in rows]
    for w in words:
        for i in range(len(w) - window + 1):
            at[tuple(w[i : i + window])] += 1
    out = collections.Counter()
    for (k, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if at[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[k, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    return out


@pytest.mark.parametrize("window", [5, 35])
def test_repeats(spark, docs, none, window):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (34, 35, 36, 80)]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 30), "abc") for _ in range(3)]
        rows.append((100 + i, " ".join(x for p in parts for x in (p, rng.choice(passages)))))
    rows.append((300, "same " * 100))
    table = frame(spark, [(i, t, "en") for i, t in rows])
    out = substring.drop_repeats(table, window=window).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out) == repeats_plain(rows, window)
    assert substring.drop_repeats(none).count() == 0


def test_alignment_score():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        s = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s[i, j] = max(0, s[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1, j] - 1, s[i, j - 1] - 1)
        score, lo, hi = leaks.align(np.array(a, dtype=int), np.array(b, dtype=int))
        assert score == s.max() and 0 <= lo <= hi <= len(b)


def test_leaks(spark, docs, none):
    rng = random.Random(9)
    items = [(i, prose(rng, 25), "en") for i in range(20)] + [(50, None, None), (51, "", None), (52, "short item", None)]
    rows = [(r["doc_id"], r["text"], "en") for r in docs.select("doc_id", "text").collect()]
    want = set()
    for i in range(20):
        w = items[i][1].split()
        if i % 3 == 1:  # edited copies
            for _ in range(4):
                w[rng.randrange(len(w))] = prose(rng, 1, "xyz")
        if i % 3 == 2:
            del w[5], w[12]
        rows.append((200 + i, prose(rng, 50) + " " + " ".join(w) + " " + prose(rng, 30), "en"))
        want.add((200 + i, i))
    rows.append((300, "with a short item inside", "en"))
    want.add((300, 52))
    table = frame(spark, rows)
    tests = frame(spark, items).withColumnRenamed("doc_id", "item_id")
    out = leaks.find_leaks(table, tests)
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == want
    assert leaks.find_leaks(none, tests).count() == 0
    assert leaks.find_leaks(table, tests.limit(0)).count() == 0


def test_packing(spark, docs, none):
    path = queries.tokenizer_path()
    texts = ["it's Don'T 's dogs' §. é. É!! a<|endoftext|>b <|ENDOFTEXT|> x́. ½. ١. ×. ' .' '.s ﬁ. ΑΣ. İ. #$%$s 12.5 3.14's", None, "", "x　y."]
    rows = [(r["doc_id"], r["text"], "en") for r in docs.select("doc_id", "text").collect()] + [(500 + i, t, "en") for i, t in enumerate(texts)]
    plain = packing.Encoder(path).tokenizer
    out = packing.pack(frame(spark, rows), path).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by[r["doc_id"], r["row"]].append(r)
        seq[r["sequence_id"]].append(r)
    want = collections.Counter()
    for k, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            want[k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == want
    for pieces in seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(none, path).count() == 0


def test_patterns_hold_everything_with_little_padding():
    rng = random.Random(4)
    histogram = collections.Counter(min(2047, int(rng.expovariate(1 / 500)) + 1) for _ in range(20_000))
    found = packing.patterns(histogram, 2048)
    held = collections.Counter()
    for packs, content in found:
        assert sum(n * k for n, k in content.items()) <= 2048
        for n, k in content.items():
            held[n] += packs * k
    assert held == histogram
    total = sum(n * k for n, k in histogram.items())
    assert sum(p for p, _ in found) * 2048 <= 1.01 * total
    assert packing.patterns({}, 2048) == []


def test_lattice(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = lattice.score(docs, path, F.col("lang") == "en").collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    count = collections.Counter(w for _, t, lang in rows if lang == "en" for w in [*split(lower(t)), " "])
    total, types = sum(count.values()), len(count)
    want = collections.Counter()
    for k, t, _ in rows:
        w = [*split(lower(t)), " "]
        want[k, len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + types + 1)) for x in w), 6)] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lattice.score(none, path, F.lit(True)).count() == 0
    assert lattice.score(docs, path, F.lit(None).cast("boolean")).count() == 12


def test_lattice_sums_over_all_segmentations():
    import public_tokenizers

    pieces = lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    weight = {}
    for i in range(sp.get_piece_size()):
        t = sp.id_to_piece(i)
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and lattice.START not in t[1:]:
            weight[t] = 1 / (-sp.get_score(i) + 1)
    low = 1 / (max(-sp.get_score(i) for i in range(3 + 256, sp.get_piece_size()) if lattice.START not in sp.id_to_piece(i)[1:]) + 2)
    total = sum(weight.values()) + 256 * low

    def whole(t):
        if not t:
            return 1.0
        p = sum(weight[t[:n]] / total * whole(t[n:]) for n in range(1, len(t) + 1) if t[:n] in weight)
        if t[0] not in weight:
            p += (low / total) ** len(t[0].encode()) * whole(t[1:])
        return p

    for word in ("the", "hello", "zürich", "a☃b", "x"):
        _, code = next(lattice._batches([word]))
        a = lattice.Lattice(pieces, pieces.log_p, code).forward()[0, -1]
        assert a == pytest.approx(math.log(whole(lattice.START + word)), rel=1e-9)
        n = lattice.Lattice(pieces, pieces.log_p, code).expected(pieces.count + 256)
        assert 1 <= n.sum() <= len(lattice.START + word) + 8


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(300):
        w = prose(rng, 20).split()
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(20)] = rng.choice(["rotten", "wicked"])
        rows.append((i, " ".join(w), "en"))
        marks.append((i, int(bad)))
    table = frame(spark, rows)
    labels = spark.createDataFrame([*marks, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels, F.lit(True))
    cases = ["r0tten", "r o t t e n", "w1ck3d", "roootten", "w.i.c.k.e.d", "plain words here", None, ""]
    out = {r["doc_id"]: r for r in toxicity.score(frame(spark, [(i, t if t is None else "abcd " + t + " efgh", "en") for i, t in enumerate(cases)]), model).collect()}
    assert [out[i]["predicted"] for i in range(8)] == [1, 1, 1, 1, 1, 0, 0, 0]
    assert toxicity.score(docs, model).count() == 12
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(none, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, blank).collect()} == {0.5}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    x[100:300] = x[100]  # a large group of copies
    x[301] = 2 * x[300]
    rows = [(i, v.tolist(), "t") for i, v in enumerate(x)]
    rows += [(1000, None, "t"), (1050, [], "t"), (1100, [0.0] * 16, "t"), (1150, [float("nan")] * 16, "t"), (1200, [float("inf")] + [1.0] * 15, "t"), (1250, [None] + [1.0] * 15, "t"), (None, x[0].tolist(), "t"), (0, x[0].tolist(), "t")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cls string")
    out = neighbours.nearest(table, table.where("vec_id % 50 = 0"), goal=0.999).collect()
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 50))
    norm = np.sqrt((x * x).sum(1))
    hit = 0
    for q, found in got.items():
        c = x @ x[q] / (norm * norm[q])
        order = [i for i in np.lexsort((np.arange(600), -c.round(12))) if i != q][:5]
        assert len(found) == 5
        hit += len({v for v, _ in found} & set(order))
        assert all(abs(c[v] - s) < 1e-12 for v, s in found)
    assert hit >= 0.95 * 5 * len(got)
    assert [v for v, _ in got[150]] == [100, 101, 102, 103, 104]
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0
    few = table.where("vec_id in (0, 1, 2)")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 2


def test_neighbour_recall(spark):
    folder = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.array(t["embedding"].tolist(), float), t["vec_id"].to_numpy()
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    found = queries.op5_nearest_neighbours(spark, folder).toPandas().groupby("query_id")["vec_id"].apply(set)
    hit = 0
    for i in np.flatnonzero(ids % 50 == 0):
        c = x @ x[i]
        c[i] = -2
        hit += len(found[ids[i]] & set(ids[np.argsort(-c)[:5]]))
    assert hit >= 0.9 * 5 * len(found)


def test_urls(spark):
    rules = urls.rule_table(spark, [urls.listed_rule(*r) for r in queries.LISTED] + urls.pattern_rules())
    cases = {
        1: (None, "", "", None, "allow"), 2: ("no scheme", "", "", None, "allow"), 3: ("http://A.ORG", "a.org", "", None, "allow"), 4: ("x://Example.org/es/1?q#f", "example.org", "/es/1", "example.org/es/", "block"),
        5: ("http://a.example.org/en/123", "a.example.org", "/en/123", "example.org/en/1", "block"), 6: ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), 7: ("http://x.com/FR/", "x.com", "/FR/", None, "allow"),
        8: ("http://x.com/de/a", "x.com", "/de/a", "com/de/", "block"), 9: ("http://my-casino.net/", "my-casino.net", "/", None, "block"), 10: ("http://casino.org/x", "casino.org", "/x", "org/", "allow"), 11: ("http://?x", "", "", None, "allow"), 12: ("", "", "", None, "allow"),
    }
    table = spark.createDataFrame([(i, c[0], "k", "t") for i, c in cases.items()] + [(None, cases[8][0], "k", "t"), (4, cases[4][0], "k", "t")], "page_id long, url string, host string, token string")
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(table, rules).collect())
    want = collections.Counter((i, *c[1:]) for i, c in cases.items()) + collections.Counter([(None, *cases[8][1:]), (4, *cases[4][1:])])
    assert got == want
    assert urls.judge(table.limit(0), rules).count() == 0
    with pytest.raises(ValueError, match="token"):
        urls.rule_table(spark, [("r", ".*", [], "block", 0, False)])


def test_url_rules_run_no_python(spark):
    plan = queries.op9_url_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGE = """<!DOCTYPE html><html><head><title>A walk</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header class="site-header"><a href="/">The Daily</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div><article><h1>A walk &amp; more</h1>
<p>It was  a bright&nbsp;day, and the <b>whole</b> town went out to see the river in flood.<p>Nobody <!-- hidden --> stayed at home, as the bakers said later.</p>
<form><label>Your mail</label><input><button>Subscribe</button></form></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this very much.</p></div></section>
<aside class="sidebar"><p>Other things to read today.</p></aside><footer>&copy; The Daily. All rights reserved.</footer></body></html>"""


def test_pages(spark):
    net = pages.fit()
    table = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<p>" * 3000 + "deep", "x"), (5, "w", "a < b <", "x")], "page_id long, url string, html string, text string")
    out = pages.main_text(table, net).collect()
    assert len(out) == 6
    main = [r["text"] for r in out if r["page_id"] == 1]
    assert main[0] == main[1] == "A walk & more\nIt was a bright day, and the whole town went out to see the river in flood.\nNobody stayed at home, as the bakers said later."
    assert [(r["text"], r["n_chars"]) for r in out if r["page_id"] in (2, None)] == [("", 0)] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert pages.main_text(table.limit(0), net).count() == 0


def test_pages_composed():
    """Blocks of unseen composed pages, by the labels they were made with."""
    net, composer = pages.fit(), pages.Composer(1234)
    found = [pages.blocks(composer.page()) for _ in range(120)]
    want = [np.array([pages.MARK in b.text for b in p]) for p in found]
    plain = [[pages.Block(b.path, b.text.replace(pages.MARK, "") or " ", b.linked) for b in p] for p in found]
    same = np.concatenate([a == b for a, b in zip(want, pages.label(net, plain), strict=True)])
    assert same.mean() > 0.95


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = pages.Network(3, rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, 2, pages.INPUT))
    mask = np.ones((5, 2))
    mask[3:, 1] = 0
    y = rng.integers(0, 2, (5, 2)).astype(float)

    def loss():
        p = pages._sigmoid(net.scores(x, mask))
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grad = net.gradients(x, mask, y)
    for k in ("Wf", "Ub", "cf", "V", "v"):
        i = tuple(0 for _ in net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = loss()
        net.p[k][i] = old - 1e-3
        down = loss()
        net.p[k][i] = old
        assert grad[k][i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-5)


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 1, 20, 3, 3)] + [None])], names=["t"])
    assert [p.column("t").to_pylist() for p in common.slices([batch], "t", 8)] == [["aaaaa", "a"], ["a" * 20], ["aaa", "aaa", None]]


def test_restoring_long_words():
    letters = toxicity.Letters.of({"^^^b": 5, "^^ba": 5, "^bad": 5, "bad^": 5})
    assert toxicity.restore("b4d", letters) == "bad"
    assert toxicity.restore("", letters) == ""
    assert len(toxicity.restore("a1" * 20_000, letters)) == 40_000


@pytest.mark.parametrize("width", [4, 5])
def test_near_pairs_follow_the_members(spark, monkeypatch, width):
    """Twice the edited copies of one text give about twice the compared pairs, in both stages together."""
    counts = {}
    stored = common.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(common, "stored", counted)
    rng = random.Random(31)
    base = prose(rng, 40).split()
    pairs = []
    for size in (1500, 3000):
        rows = []
        for i in range(size):
            w = list(base)
            for _ in range(2):
                w[rng.randrange(40)] = prose(rng, 1)
            rows.append((i, " ".join(w), "en"))
        assert near.near_duplicates(frame(spark, rows), width=width).count() == size
        pairs.append(counts["near-star"] + counts["near-rest"])
    assert pairs[1] <= 2.2 * pairs[0], pairs
    assert pairs[1] <= 10 * 3000
