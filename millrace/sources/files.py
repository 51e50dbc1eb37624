"""Readers and writers. Schemas are given, never inferred from the data at run time."""

from __future__ import annotations

import itertools
import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.quality import ColumnRule

#: Keys under which an object may wrap its rows.
WRAPPERS = ("data", "records", "rows", "items", "files", "messages", "events", "results")


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header CSV with every value as text; types are tried afterwards."""
    return spark.read.schema(text_schema(columns)).csv(path, header=True, multiLine=False, escape='"')


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """``try_cast`` of the listed columns: values that do not fit become null."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def unwrap_json(df: DataFrame, raw: str, row_ddl: str) -> DataFrame:
    """Rows of JSON texts that are an array, an object with a wrapped array, or one plain object."""
    rows = f"array<struct<{row_ddl}>>"
    direct = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, rows))
    wrapped = [F.from_json(F.get_json_object(raw, f"$.{k}"), rows) for k in WRAPPERS]
    single = F.array(F.from_json(raw, f"struct<{row_ddl}>"))
    return df.select(*[c for c in df.columns if c != raw], F.inline(F.coalesce(direct, *wrapped, single)))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the raw text of lines that do not parse."""
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    good = parsed.where("r._bad IS NULL AND value <> ''").select(*[f"r.{f.name}" for f in schema.fields])
    return good, parsed.where("r._bad IS NOT NULL").select(F.col("value").alias("raw"))


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])


def read_partition(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """One partition of a partitioned table; the filter prunes the other folders."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(value))


def write_partitioned(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Overwrite by partition. Rows are spread by the partition columns and a hash, so that a hot
    partition is written by several tasks and a small one by few."""
    spread = df.withColumn("__s", F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    out = spread.repartition(*columns, "__s").drop("__s")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    """Table bucketed and sorted by the join key: later joins on it need no shuffle."""
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def bronze_ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, loaded: str) -> None:
    """Append raw JSON rows with load time and source file."""
    raw = spark.read.schema(schema).json(source)
    out = raw.withColumn("_source_file", F.col("_metadata.file_name")).withColumn("_ingested_at", F.lit(loaded).cast("timestamp"))
    out.write.mode("append").option("mergeSchema", "true").parquet(target)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Files with different column sets as one table."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def kafka_rows(spark: SparkSession, servers: str, topic: str, ddl: str) -> DataFrame:
    """Topic as a stream of parsed rows; needs the Kafka package on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return parse_messages(raw, ddl)


def parse_messages(raw: DataFrame, ddl: str) -> DataFrame:
    """JSON message values to columns; unparsable messages give nulls and keep their raw text."""
    r = F.from_json(F.col("value").cast("string"), ddl)
    return raw.select(F.col("value").cast("string").alias("_raw"), r.alias("r")).select("r.*", "_raw")


def write_rows(df: DataFrame, path: str, kind: str) -> None:
    """Result rows as CSV or JSON."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown sink {kind}")


def bulk_load(target: DataFrame, staged: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows matched to the target by column name, and the rows whose values do not fit its types."""
    cast = staged.select(*[F.col(c).try_cast(types[c]).alias(c) if c in staged.columns else F.lit(None).cast(types[c]).alias(c) for c in target.columns], F.struct(*staged.columns).alias("__raw"))
    bad = F.lit(False)
    for c in target.columns:
        if c in staged.columns:
            bad = bad | (F.col(c).isNull() & F.col(f"__raw.{c}").isNotNull())
    return target.unionByName(cast.where(~bad).drop("__raw")), cast.where(bad).select("__raw.*")


def load_rules(text: str) -> list[ColumnRule]:
    """Column rules from a JSON schema text: the one small document that is read on the driver."""
    doc = json.loads(text)
    return [
        ColumnRule(
            c["name"], c.get("type", "string"), c.get("nullable", True), c.get("unique", False), c.get("min_value"), c.get("max_value"), c.get("min_length"), c.get("max_length"), c.get("pattern"), tuple(c.get("allowed_values") or ()),
        )
        for c in doc["columns"]
    ]


#: Files of one folder of a written corpus; endings of files that the text source unpacks.
FOLDER, PACKED = 1000, ("gz", "bz2", "deflate", "snappy", "lz4", "zst", "passthrough")


def write_text_corpus(df: DataFrame, text: str, path: str) -> None:
    """One file for each row, closed by a line end, in folders of at most ``FOLDER`` files that are moved into place whole.

    Hadoop's local file system starts a process for every file it creates; a store that is mounted as a folder is
    written by the tasks themselves. Any other store is written by Spark.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(conf)
    texts = df.select(F.col(text).cast("string").alias("value"))
    if store.getUri().getScheme() != "file":
        folder = F.floor(F.monotonically_increasing_id() / FOLDER)
        texts.withColumn("folder", folder).write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)
        return
    local = store.makeQualified(place).toUri().getPath()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((task, value) for b in batches for task, value in zip(b.column("task").to_pylist(), b.column("value").cast(pa.binary()).to_pylist(), strict=True))
        for folder in itertools.count():
            some = list(itertools.islice(rows, FOLDER))
            if not some:
                return
            # readers pass over names with an underscore; a task that runs again finds its folder in place
            made, final = f"{local}/_{uuid.uuid4().hex}", f"{local}/{some[0][0]:05d}-{folder:05d}"
            os.makedirs(made)
            for i, (_, value) in enumerate(some):
                with open(f"{made}/{i:04d}.txt", "wb", buffering=0) as f:
                    f.write((value or b"") + b"\n")
            if not os.path.isdir(final):
                os.rename(made, final)
            yield pa.RecordBatch.from_pydict({"files": pa.array([len(some)], pa.int64())})

    os.makedirs(local, exist_ok=True)
    texts.withColumn("task", F.spark_partition_id()).mapInArrow(files, "files long").agg(F.sum("files")).collect()


def read_text_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file with its path and size.

    The text source sets up a Hadoop task for every file, the binary one does not; where the glob names an ending of
    plain files the bytes are read as they are. Their size is counted, so every file is read whole.
    """
    source, ending = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True), glob.rpartition(".")[2]
    where = F.col("_metadata.file_path").alias("path")
    if "." in glob and ending.isalnum() and ending.lower() not in PACKED:
        return source.format("binaryFile").load(path).select(where, F.octet_length("content").cast("long").alias("size"), F.col("content").cast("string").alias("text"))
    return source.text(path, wholetext=True).select(where, F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
