"""Cases that shortcuts lose: each is compared with what a plain reading of the definition gives."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_edges import frame, prose

import corpus_pipeline
from millrace.llm import leaks, toxicity


def leaks_plain(rows, items, least=0.5):
    """Every document aligned with every item."""
    out = {}
    for k, text in rows:
        for i, item in items:
            a, b = (item or "").lower().split(), (text or "").lower().split()
            s = np.zeros((len(a) + 1, len(b) + 1), int)
            for x in range(1, len(a) + 1):
                for y in range(1, len(b) + 1):
                    s[x, y] = max(0, s[x - 1, y - 1] + (2 if a[x - 1] == b[y - 1] else -1), s[x - 1, y] - 1, s[x, y - 1] - 1)
            if a and s.max() >= least * 2 * len(a):
                out[k, i] = s.max() / (2 * len(a))
    return out


@pytest.mark.parametrize("words", [1 << 19, 20])
def test_leaks_of_a_copy_that_many_documents_hold(spark, words, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_WORDS", words)
    rng = random.Random(21)
    item = prose(rng, 40).split()
    copy = [prose(rng, 1, "xyz") if k % 5 == 2 else w for k, w in enumerate(item)]
    rows = [(i, prose(rng, 20) + " " + " ".join(copy if i % 3 == 0 else prose(rng, 40).split()), "en") for i in range(300)]
    tests = frame(spark, [(1, " ".join(item), "en"), (2, prose(rng, 40), "en")]).withColumnRenamed("doc_id", "item_id")
    out = leaks.find_leaks(frame(spark, rows), tests).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(i, 1) for i in range(0, 300, 3)]
    assert {(r["start"], r["length"]) for r in out} == {(20, 40)}


@pytest.mark.parametrize("least", [0.5, 0.7])
@pytest.mark.parametrize("words", [1 << 19, 20])
def test_leaks_are_those_of_aligning_everything(spark, least, words, monkeypatch):
    """Both with the index of all items in the tasks and with the joins on seeds."""
    monkeypatch.setattr(leaks, "BROADCAST_WORDS", words)
    rng = random.Random(22)
    items = [(i, prose(rng, rng.choice([1, 2, 3, 4, 5, 9, 20, 33]), "abcd")) for i in range(24)]
    rows = []
    for k in range(120):
        w = rng.choice(items)[1].split()
        if k % 4 == 0:  # every third word replaced: no three words of the item in a row
            w = [prose(rng, 1, "xyz") if j % 3 == 2 else x for j, x in enumerate(w)]
        elif k % 4 == 1:  # a word put between any two
            w = [y for x in w for y in (x, prose(rng, 1, "xyz"))][:-1]
        elif k % 4 == 2:
            w = [y for x in w for y in rng.choice([[x], [x], [], [x, "xx"], ["yy"]])]
        rows.append((k, " ".join([prose(rng, rng.randint(0, 12), "abcd"), *w, prose(rng, rng.randint(0, 12), "abcd")])))
    tests = frame(spark, [(i, t, "en") for i, t in items]).withColumnRenamed("doc_id", "item_id")
    out = leaks.find_leaks(frame(spark, [(k, t, "en") for k, t in rows]), tests, least=least).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in out} == leaks_plain(rows, items, least)
    assert len(out) == len({(r["doc_id"], r["item_id"]) for r in out})


def toxic_model(spark):
    rng = random.Random(23)
    rows, marks = [], []
    for i in range(800):
        w = prose(rng, 20).split() + ["a", "you", "are"]
        if i % 4 == 0:
            w[rng.randrange(20)] = ["idiot", "clown", "loser", "stupid", "moron"][i // 4 % 5]
        rows.append((i, " ".join(w), "en"))
        marks.append((i, int(i % 4 == 0)))
    return toxicity.fit(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))


def predicted(spark, model, texts):
    out = toxicity.score(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), model).collect()
    return [t for i, t in enumerate(texts) if {r["doc_id"]: r["predicted"] for r in out}[i]]


def test_signs_at_the_edges_of_words_and_doubled_letters(spark):
    model = toxic_model(spark)
    bad = ["!diot", "idio+", "(lown", "|oser", "(lown)", "\"!diot.\"", "stuupid", "morron", "lloser", "idiot!", "!d1o+"]
    good = ["hello!", "(bad", "jabba", "c+", "a+", "!", "(", "abc|"]
    assert predicted(spark, model, [f"abcd {w} efgh" for w in bad + good]) == [f"abcd {w} efgh" for w in bad]


def test_words_set_apart_by_spaces(spark):
    model = toxic_model(spark)
    bad = ["you are a s t u p i d", "a i d i o t", "you c l o w n l o s e r", "stu pid", "you idi ot a", "m o r r o n", "s 7 u p 1 d a"]
    bad += ["stupi d", "you stup1 d", "you lose r a", "clow n", "id io t"]
    good = ["you are a", "a b c d", "5 4 3 2 1", "you a are a you", "| a | 5 |", "clow you n"]
    assert predicted(spark, model, bad + good) == bad
    assert toxicity.joined_words("a s t u p i d l o s e r you".split(), model.letters) == ("loser", "stupid")


def test_toxicity_learns_from_every_labelled_row(spark):
    """More labelled rows than a sample would hold: words of few toxic texts weigh, and the bias counts all rows."""
    rng = random.Random(26)
    rare = ["vexatious", "grubling", "snidely", "wretchy", "foulmouth", "blightful", "knavery", "scornful"]
    rows, marks = [], []
    for i in range(30_000):
        bad = i % 10 == 0
        word = rare[i // 10 % 300] if bad and i // 10 % 300 < len(rare) else "rotten" if bad else ""
        rows.append((i, f"{prose(rng, 4)} {word}", "en"))
        marks.append((i, int(bad)))
    rows += [(30_000 + i, "kindly put", "en") for i in range(7)]
    marks += [(30_000 + i, 1) for i in range(7)]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
    assert {*rare, "rotten"} <= set(model.weights)
    assert model.bias == math.log(7.5 / 27_000.5)
    groups = {}
    for _, text, _ in rows:
        for word in text.split():
            t = toxicity.EDGE * 3 + word + toxicity.EDGE
            for k in range(3, len(t)):
                groups[t[k - 3 : k + 1]] = groups.get(t[k - 3 : k + 1], 0) + 1
    assert model.letters.table == toxicity.Letters.of(groups).table
    assert predicted(spark, model, [f"abcd {w} efgh" for w in ("sc0rnful", "k n a v e r y", "abcd")]) == ["abcd sc0rnful efgh", "abcd k n a v e r y efgh"]


def test_one_of_near_copies_whatever_their_ids(spark):
    rng = random.Random(24)
    rows = []
    for ids in ([5, 5, 5], [None, None, None], [None, 7, 7], [9, None, 8]):
        base = prose(rng, 80)
        rows += [(i, f"{base} end{k}", "en") for k, i in enumerate(ids)]
    rows += [(None, None, "en"), (20, "", "en")]
    out = corpus_pipeline.keep_one_of_near_copies(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 0, 5, 7, 8, 20]


def test_restoring_is_the_best_of_all_readings():
    """Viterbi search against enumerating every reading of short words."""
    import itertools

    rng = random.Random(25)
    groups = {}
    for w in ["idiot", "clown", "loser", "stupid", "moron", "abba", "cool", *prose(rng, 300).split()]:
        t = toxicity.EDGE * 3 + w + toxicity.EDGE
        for i in range(3, len(t)):
            groups[t[i - 3 : i + 1]] = groups.get(t[i - 3 : i + 1], 0) + 1
    letters = toxicity.Letters.of(groups)

    def cost(word, reading):
        context, c = toxicity.EDGE * 3, 0.0
        for options, option in zip(toxicity._options(word), reading, strict=True):
            for letter in option:
                c += letters.step(context, letter)
                context = context[1:] + letter
            c -= 1.0 if len(options[0]) == 2 and len(option) == 1 else 0.0
            c -= 1.5 if option != options[0] else 0.0 if option[:1].isalpha() else 1.0
        return c + letters.step(context, toxicity.EDGE)

    for word in ["id1ot", "c|own", "l0$er", "abba", "m0r0n", "5tup!d", "c00l", "aabb", "!", ""]:
        every = {}
        for reading in itertools.product(*toxicity._options(word)):
            plain = "".join(reading)
            every[plain] = max(every.get(plain, -1e9), cost(word, reading))
        assert every[toxicity.restore(word, letters)] >= max(every.values()) - 1e-9
