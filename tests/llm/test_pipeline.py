"""The pipeline's stages on a small corpus with planted cases, against what each stage must do."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_edges import near_plain, prose, repeats_plain

import corpus_pipeline
from millrace.llm import common, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    english = ["the", "of", "and", "house", "river", "people", "always", "wanted", "stone", "water", "light", "never", "should", "garden"]
    german = ["der", "und", "nicht", "straße", "häuser", "schön", "über", "wasser", "zeit", "immer", "gegen", "möchte", "früh", "licht"]

    def text(words, n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "s", "en", "x" + str(rng.randint(0, 999))]) for _ in range(n))

    rows = [(i, text(english, 60), "en", "a", 1) for i in range(40)] + [(100 + i, text(german, 60), "de", "b", 1) for i in range(40)]
    base = text(english, 80).split()
    rows += [(200 + i, " ".join(base[:78] + [f"end{i}", "now"]), "en", "a", 1) for i in range(5)]
    passage = text(german, 50)
    rows += [(300 + i, text(german, 40) + " " + passage + " " + text(german, 30), "de", "b", 1) for i in range(3)]
    item = text(english, 30)
    rows += [(400, text(english, 50) + " " + item, "en", "a", 1)]
    rows += [(500, None, "en", "a", None), (501, "", "en", "a", 0), (502, "123 456 !!", None, None, 10), (None, text(english, 50), "en", "a", 1), (503, "привет мир это русский текст " * 10, None, "c", 1)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(rng, 20)), (3, None)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, base


def test_stages(spark, folder):
    path, rows, base = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = common.stored(stage(spark, docs, path), f"test-{name}")
    assert all(out[n].columns == out["input"].columns for n in names[:-1])

    def ids(name):
        return collections.Counter(r["doc_id"] for r in out[name].select("doc_id").collect())

    gone = ids("input") - ids("language")
    assert set(gone) == {500, 501, 502, 503}

    before = [(r["doc_id"], r["text"]) for r in out["language"].collect()]
    keep = {k for (k, _, c) in near_plain(before, 5, 80) if k == c}
    assert set(ids("near_copies")) == keep
    assert {200} == {k for k in ids("near_copies") if k is not None and 200 <= k < 300}

    before = [(r["doc_id"], r["text"]) for r in out["near_copies"].collect()]
    plain = {k: kept if removed else None for (k, _, removed, kept) in repeats_plain(before, 35)}
    for r in out["repeated_passages"].collect():
        want = plain[r["doc_id"]]
        assert r["text"] == (want if want is not None else dict(before)[r["doc_id"]])
        assert want is None or r["n_chars"] == len(want)
    assert {300, 301, 302} <= {k for k, v in plain.items() if v}

    assert set(ids("repeated_passages")) - set(ids("benchmark_leaks")) == {400}

    packed = out["packing"].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in packed} == set(ids("benchmark_leaks"))
    assert all(r["n"] == r["doc_tokens"] for r in packed)


def test_empty_input(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0


def test_registered_names_are_one_per_operator():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
