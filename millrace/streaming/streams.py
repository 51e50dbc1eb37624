"""Structured Streaming: sources, windows, state and sinks.

Results go to files below the shared work folder, never to the driver.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from millrace.functions.text import prefixed
from millrace.session import work_folder


def file_stream(spark: SparkSession, folder: str, like: DataFrame, *, glob: str = "*", per_trigger: int | None = None, ts: str = "ts") -> DataFrame:
    """New Parquet files of a folder as a stream; the time column becomes a zoned timestamp, which watermarks need."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def run_append(df: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Write closed results to Parquet and stop when the input is used up."""
    q = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    q = q.trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return q


def appended(df: DataFrame, name: str) -> DataFrame:
    """Run a stream in append mode into a new folder and read the result."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    run_append(df, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class BucketedTable:
    """Upsert target for ``foreachBatch`` that merges on read: one row per key, the newest batch wins.

    A batch appends its rows as files of their own below the hash buckets of their keys, so its cost follows the
    batch and not the table. A reader reduces the files of a bucket by key. A bucket of more than ``deltas`` files
    folders is compacted: it alone is rewritten as one folder. A manifest lists the folders of each bucket; every
    attempt of a batch writes a new manifest as one file, last, and nothing is ever overwritten. So a batch that
    fails at any step has no effect, and one that runs again starts from the manifest of the batch before and
    counts exactly once. A batch without a manifest before it is an error: older rows would be lost.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, *, buckets: int = 16, deltas: int = 8):
        self.spark, self.path, self.key, self.buckets, self.deltas = spark, path, key, buckets, deltas

    MANIFEST = "version long, attempt int, bucket int, folder string, kind string"

    def _manifest(self, before: int | None = None) -> tuple[str | None, int, list[tuple[int, str]]]:
        """Schema and folders by bucket, oldest first, of the newest version, before the given one if any; attempts of that one."""
        at = f"{self.path}/manifest"
        if not _exists(self.spark, at):
            return None, 0, []
        rows = self.spark.read.schema(self.MANIFEST).parquet(at)
        tried = 0 if before is None else rows.where(F.col("version") == before).agg(F.coalesce(F.max("attempt"), F.lit(0))).first()[0]
        past = rows if before is None else rows.where(F.col("version") < before)
        newest = past.agg(F.max(F.struct("version", "attempt"))).first()[0]
        if newest is None:
            return None, tried, []
        listed = past.where((F.col("version") == newest[0]) & (F.col("attempt") == newest[1])).collect()
        return listed[0]["kind"], tried, sorted((r["bucket"], r["folder"]) for r in listed if r["bucket"] >= 0)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _save(self, rows: DataFrame, folder: str) -> list[tuple[int, str]]:
        """Write rows below their buckets; returns which buckets have got some."""
        placed = rows.withColumn("__bucket", self._bucket())
        placed.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{folder}")
        got = self.spark.read.schema(placed.schema).parquet(f"{self.path}/data/{folder}").select("__bucket").distinct()
        return [(r[0], folder) for r in got.collect()]

    def _reduced(self, live: Sequence[tuple[int, str]], like: StructType) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/__bucket={bucket}" for bucket, folder in live]
        rows = self.spark.read.schema(like).parquet(*paths) if paths else self.spark.createDataFrame([], like)
        newest = F.max_by(F.struct(*[F.col(c) for c in like.names]), "__version").alias("r")
        return rows.groupBy(self.key).agg(newest).select("r.*")

    def write(self, rows: DataFrame, batch: int) -> None:
        kind, tried, live = self._manifest(batch)
        if kind is None and batch > 0:
            raise RuntimeError(f"{self.path}: batch {batch} has no version before it")
        rows = rows.withColumn("__version", F.lit(batch).cast("long"))
        name = f"{batch:012d}-{tried + 1:04d}-{uuid4().hex[:8]}"
        live = [*live, *self._save(rows, name)]
        count = Counter(b for b, _ in live)
        full = {b for b, n in count.items() if n > self.deltas}
        if full:
            whole = self._reduced([x for x in live if x[0] in full], rows.schema)
            live = [x for x in live if x[0] not in full] + self._save(whole, f"{name}-whole")
        self._commit(batch, tried + 1, live, rows.schema.json())

    def _commit(self, batch: int, attempt: int, live: Sequence[tuple[int, str]], kind: str) -> None:
        """One file, moved into place as a whole; an empty table has a row without a bucket."""
        listed = [(batch, attempt, b, f, kind) for b, f in live] or [(batch, attempt, -1, "", kind)]
        self.spark.createDataFrame(listed, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self) -> DataFrame:
        kind, _, live = self._manifest()
        if kind is None:
            raise RuntimeError(f"{self.path}: no version was written")
        return self._reduced(live, StructType.fromJson(json.loads(kind))).drop("__version")


def upserted(df: DataFrame, key: Sequence[str], mode: str, name: str) -> DataFrame:
    """Run a keyed aggregate in update or complete mode and return the final table."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    table = BucketedTable(spark, f"{path}/table", "__key")
    keyed = prefixed(key)

    def sink(rows: DataFrame, batch: int) -> None:
        table.write(rows.withColumn("__key", keyed), batch)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return table.read().drop("__key")


def delivered(parts: Sequence[DataFrame], start: Callable[[DataFrame, str], None], like: DataFrame, name: str, *, ts: str = "ts") -> str:
    """Deliver tables one after the other to one stream: each is one batch, written by as many tasks as it has.

    ``start(rows, checkpoint)`` runs the stream over what is new and returns when it is used up; all runs share the
    checkpoint, so state and watermark go on. Returns the work folder.
    """
    spark = like.sparkSession
    path = work_folder(spark, name)
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        start(file_stream(spark, f"{path}/in", like, glob="*.parquet", ts=ts), f"{path}/checkpoint")
    return path


def window_counts(df: DataFrame, keys: Sequence[str], ts: str, value: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding window counts and sums behind a watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def session_counts(df: DataFrame, key: str, ts: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions that end after ``gap`` without events."""
    out = df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merged_spans(start: np.ndarray, end: np.ndarray, count: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join spans that lie less than ``gap`` apart: in the order of starts, a span begins anew where it is ``gap`` or
    more behind the latest end so far."""
    if not len(start):
        return start, end, count
    order = np.argsort(start, kind="stable")
    start, end, count = start[order], np.maximum.accumulate(end[order]), count[order]
    cut = np.flatnonzero(np.concatenate(([True], start[1:] - end[:-1] >= gap)))
    return start[cut], end[np.append(cut[1:], len(end)) - 1], np.add.reduceat(count, cut)


def stateful_sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Sessions kept in custom state with an event-time timeout.

    The state of a key is its open spans. Rows of a batch arrive in Arrow chunks and are folded into
    spans chunk by chunk, as arrays, so memory grows with the sessions of a key and not with its rows.
    """
    gap_us = float(gap_seconds) * 1e6

    def step(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(np.array(c, np.float64) for c in state.get) if state.exists else (np.zeros(0),) * 3
        if not state.hasTimedOut:
            for pdf in chunks:
                us = pdf["us"].to_numpy(dtype="float64")
                held = merged_spans(*(np.concatenate(pair) for pair in zip(held, (us, us, np.ones(len(us))), strict=True)), gap_us)
        mark = state.getCurrentWatermarkMs() * 1000.0
        over = held[1] + gap_us <= mark
        live = [c[~over] for c in held]
        if len(live[0]):
            state.update(tuple(c.tolist() for c in live))
            state.setTimeoutTimestamp(int(max(live[1][0] + gap_us, mark) // 1000) + 1)
        elif state.exists:
            state.remove()
        if over.any():
            start, end, n = (c[over].astype(np.int64) for c in held)
            yield pd.DataFrame({key: k[0], "start_us": start, "end_us": end, "n": n})

    rows = df.withWatermark(ts, delay).select(key, ts, F.unix_micros(ts).alias("us"))
    kind = df.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, start_us bigint, end_us bigint, n bigint", "starts array<double>, ends array<double>, counts array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def dedup(df: DataFrame, keys: Sequence[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def replay(spark: SparkSession, folder: str, like: DataFrame, since: str, build: Callable[[DataFrame], DataFrame], view: str, glob: str = "*") -> DataFrame:
    """Process the source again from a time into a new table with a fresh checkpoint, then point the view at it."""
    rows = file_stream(spark, folder, like, glob=glob).where(F.col("ts") >= F.lit(since).cast("timestamp"))
    out = appended(build(rows), "replay")
    out.createOrReplaceTempView(view)
    return spark.table(view)


def progress_rows(df: DataFrame, name: str) -> DataFrame:
    """Run a stream and return the rows of every micro-batch, however many: each batch writes its own count."""
    spark = df.sparkSession
    path = work_folder(spark, name)

    def sink(rows: DataFrame, batch: int) -> None:
        rows.agg(F.count(F.lit(1)).alias("input_rows")).write.mode("overwrite").parquet(f"{path}/count/batch_id={batch}")

    q = df.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("input_rows long, batch_id long").parquet(f"{path}/count")
