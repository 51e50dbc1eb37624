"""The merge-on-read table: gaps, reruns, failures at every step, touched files, compaction, odd keys."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.streaming.streams import BucketedTable, upserted


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v long")


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_gaps_and_reruns(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "k")
    with pytest.raises(RuntimeError):
        table.read()
    with pytest.raises(RuntimeError):
        table.write(rows(spark, [(1, 1)]), 3)
    table.write(rows(spark, [(1, 1)]), 0)
    table.write(rows(spark, [(2, 2)]), 1)
    table.write(rows(spark, [(2, 3), (None, 4)]), 1)
    assert content(table) == sorted([(1, 1), (2, 3), (None, 4)], key=str)
    table.write(rows(spark, [(None, 5)]), 2)
    table.write(rows(spark, []), 3)
    assert content(table) == sorted([(1, 1), (2, 3), (None, 5)], key=str)


def test_a_small_batch_touches_its_bucket_only(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "k", buckets=8, deltas=3)
    table.write(spark.range(200).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v")), 0)
    before = files(tmp_path / "t" / "data")
    assert len({f.split("__bucket=")[1][0] for f in before}) == 8
    for batch in range(1, 3):
        table.write(rows(spark, [(5, batch)]), batch)
    new = files(tmp_path / "t" / "data") - before
    assert before <= files(tmp_path / "t" / "data")
    assert len({f.split("__bucket=")[1].split("/")[0] for f in new}) == 1 and len(new) == 2
    # the fourth folder of the bucket compacts it, and no other
    table.write(rows(spark, [(5, 3)]), 3)
    compacted = files(tmp_path / "t" / "data") - before - new
    assert len({f.split("__bucket=")[1].split("/")[0] for f in compacted}) == 1 and len(compacted) == 2
    _, _, live = table._manifest()
    assert len(live) == 8
    assert content(table) == sorted([(k, 3 if k == 5 else 0) for k in range(200)], key=str)


@pytest.mark.parametrize("step", ["before data", "after data", "while compacting", "in the manifest", "after the manifest"])
def test_a_batch_that_fails_and_runs_again(spark, tmp_path, monkeypatch, step):
    table = BucketedTable(spark, str(tmp_path / "t"), "k", buckets=2, deltas=1)
    table.write(rows(spark, [(k, 0) for k in range(20)]), 0)
    save, commit, saves = table._save, table._commit, []

    def failing_save(df, folder):
        saves.append(folder)
        if step == "before data" or (step == "while compacting" and len(saves) == 2):
            raise OSError("lost")
        out = save(df, folder)
        if step == "after data":
            raise OSError("lost")
        return out

    def failing_commit(*args):
        if step == "after the manifest":
            commit(*args)
        raise OSError("lost")

    monkeypatch.setattr(table, "_save", failing_save)
    if "manifest" in step:
        monkeypatch.setattr(table, "_commit", failing_commit)
    batch = rows(spark, [(k, 1) for k in range(5)])
    with pytest.raises(OSError):
        table.write(batch, 1)
    monkeypatch.undo()
    again = BucketedTable(spark, str(tmp_path / "t"), "k", buckets=2, deltas=1)
    if step != "after the manifest":
        assert content(again) == sorted([(k, 0) for k in range(20)], key=str)
    again.write(batch, 1)
    again.write(rows(spark, [(0, 2)]), 2)
    assert content(again) == sorted([(k, 2 if k == 0 else int(k < 5)) for k in range(20)], key=str)


def test_keys_with_separators_and_nulls(spark, tmp_path):
    """Keys that a plain joined text would take for one another stay apart."""
    pairs = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("_null_", "x"), ("1:a", "b")]
    spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "a string, b string, n int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string, b string, n int").parquet(str(tmp_path / "in"))
    out = upserted(stream.groupBy("a", "b").agg(F.sum("n").alias("n")), ["a", "b"], "update", "keys")
    assert sorted(((r.a, r.b, r.n) for r in out.collect()), key=str) == sorted(((*p, i) for i, p in enumerate(pairs)), key=str)


def test_spans_join_like_a_plain_loop():
    import random

    import numpy as np

    from millrace.streaming.streams import merged_spans

    rng = random.Random(71)
    for n in (0, 1, 2, 30, 200):
        spans = []
        for _ in range(n):
            a = rng.randint(0, 500)
            spans.append([float(a), float(a + rng.choice([0, 0, 5, 60])), 1.0])
        plain = []
        for a, b, c in sorted(spans):
            if plain and a - plain[-1][1] < 7:
                plain[-1][1] = max(plain[-1][1], b)
                plain[-1][2] += c
            else:
                plain.append([a, b, c])
        got = merged_spans(*(np.array([s[i] for s in spans], float) for i in range(3)), 7.0)
        assert [list(x) for x in zip(*(g.tolist() for g in got), strict=True)] == plain
