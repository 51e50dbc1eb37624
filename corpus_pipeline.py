"""A training corpus from ``documents``: language, near copies, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``; all but the last return the columns they were given. Stages join their decisions back
by key and row hash, null keys included, so other columns pass through unchanged whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, language, leaks, near, packing, queries, substring


def _decided(docs: DataFrame, decisions: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` with the columns that ``decisions`` has besides ``doc_id`` and ``row``, by row identity."""
    d = decisions.withColumnRenamed("doc_id", "__id")
    same = docs["doc_id"].eqNullSafe(d["__id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == d["row"])
    return docs.join(d, same, how)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those far from every language and those without letters go."""
    model = language.fit(docs, "text", "lang", "doc_id", F.lit(True))
    out = language.identify(docs, model).where("not rejected").select("doc_id", "row").distinct()
    return _decided(docs, out, "left_semi")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, once; texts without words stay.

    Of documents that share that id, and of a group without ids, the one with the smallest row hash stays.
    """
    out = near.near_duplicates(docs, width=5, percent=80)
    alone = F.when(F.col("group").isNull(), F.col("row")).alias("alone")
    first = out.groupBy("group", alone).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    kept = _decided(docs, first.select("first.doc_id", "first.row"), "left_semi")
    return kept.withColumn("__row", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "__row"]).drop("__row")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that repeat anywhere; a text that loses nothing stays as it is.

    A text that loses words keeps the others, joined by one space, and ``n_chars`` follows. A text that loses
    all its words goes.
    """
    out = substring.drop_repeats(docs).where("n_removed > 0").select("doc_id", "row", F.col("kept").alias("__kept"), (F.col("n_removed") == F.col("n_words")).alias("__all")).distinct()
    both = _decided(docs, out, "left").where("not coalesce(__all, false)")
    text = F.coalesce("__kept", docs["text"])
    cols = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.col("__kept").isNull(), docs["n_chars"]).otherwise(F.char_length("__kept")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return both.select(*(cols.get(c, docs[c]) for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = leaks.find_leaks(docs, items).select("doc_id", "row").distinct()
    return _decided(docs, out, "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of each document go in sequences of 2048."""
    return packing.pack(docs, queries.tokenizer_path()).drop("row")


STAGES = [
    ("language", keep_languages),
    ("near_copies", keep_one_of_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Tokenizing and classifying are not SQL; the stages are tested against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
