"""Splits, duplicates and annotation checks of labelled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.narrowing import cut_by_rank


def hash_spot(key: str, seed: int) -> Column:
    """Repeatable place of a row: 52 bits of the hash of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long").cast("double")


def split(df: DataFrame, key: str, classes: Sequence[str], shares: tuple[float, float], seed: int = 42) -> DataFrame:
    """Train, validation and test by exact counts int(n x share), inside each class when classes are given."""
    first = lambda n: F.floor(n * shares[0])
    second = lambda n: first(n) + F.floor(n * shares[1])
    rows = df.withColumn("__spot", hash_spot(key, seed))
    placed = cut_by_rank(rows, list(classes), "__spot", key, [(shares[0], first), (shares[0] + shares[1], second)], "__part")
    part = F.when(F.col("__part") == 0, "train").when(F.col("__part") == 1, "val").otherwise("test")
    return placed.withColumn("split", part).drop("__spot", "__part")


def exact_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """Later copies of the same content with the key of the kept first one.

    Groups are reduced to their smallest key; the copies meet it by the content hash, so no group is collected.
    """
    rows = df.select(key, F.md5(content).alias("digest"))
    first = rows.groupBy("digest").agg(F.min(key).alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(first, "digest").where(F.col(key) != F.col("kept")).select(key, "kept", "digest")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share by class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") / F.col("t")).alias("share"))


def annotation_checks(ann: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """(ann_id, problem, severity): missing parents, bad boxes, normalised boxes out of range.

    ann: ann_id, image_id, category_id, bbox (corner and size), norm (centre and size in 0-1).
    """
    a = ann.join(images.select(F.col("image_id").alias("__i")).distinct(), F.col("image_id") == F.col("__i"), "left")
    a = a.join(categories.select(F.col("category_id").alias("__c")).distinct(), F.col("category_id") == F.col("__c"), "left")
    b, n = F.col("bbox"), F.col("norm")
    at = lambda arr, i: F.get(arr, i)
    four = F.size(b) == 4
    odd = four & ((at(b, 0) < 0) | (at(b, 1) < 0) | (at(b, 2) <= 0) | (at(b, 3) <= 0))
    centre = ~(at(n, 0).between(0, 1) & at(n, 1).between(0, 1))
    size = ~((at(n, 2) > 0) & (at(n, 2) <= 1) & (at(n, 3) > 0) & (at(n, 3) <= 1))
    item = lambda test, name, sev: F.when(test, F.struct(F.lit(name).alias("problem"), F.lit(sev).alias("severity")))
    found = F.array(
        item(F.col("__i").isNull(), "unknown_image", "error"), item(F.col("__c").isNull(), "unknown_category", "warning"), item(~four, "bad_format", "error"), item(odd, "suspicious_box", "warning"),
        item(centre, "centre_outside", "warning"), item(size, "size_outside", "warning"),
    )
    return a.select("ann_id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def to_centre(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Corner and size in pixels to centre and size in 0-1."""
    return [(x + w / 2) / width, (y + h / 2) / height, w / width, h / height]


def from_centre(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    return [(cx - w / 2) * width, (cy - h / 2) * height, w * width, h * height]


def from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """Two corners to corner and size."""
    return [x1, y1, x2 - x1, y2 - y1]
