"""Arrow and numpy helpers for tasks that read whole texts, and the identity of a row.

Words are ``[^\\x20\\x09-\\x0D]+``. Texts reach a task in Arrow batches and are worked on in slices of
bounded bytes, so the memory of a task follows one slice, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import work_folder

#: Bytes of text that a task looks at together.
SLICE_BYTES = 4 << 20

U64 = np.uint64


class Words(NamedTuple):
    """Words of a slice of texts: ``codes`` into ``distinct``; text i owns ``starts[i]:starts[i + 1]``."""

    codes: np.ndarray
    distinct: pa.Array
    starts: np.ndarray

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece hold at most ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def words(text: pa.Array, *, lower: bool, every: bool = False) -> Words:
    """Words of every text; a null or blank text has none. ``lower``: A-Z, or with ``every`` all letters."""
    filled = pc.fill_null(text, "")
    if lower:
        filled = pc.utf8_lower(filled) if every else pc.ascii_lower(filled)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(filled))
    flat = lists.flatten()
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py():  # a text without words is split into one empty string
        blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(filled)), 0).to_numpy(zero_copy_only=False)
        count[blank] = 0
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.concatenate(([0], np.cumsum(count))))


def hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    if not len(values):
        return np.zeros(0, U64)
    return pd.util.hash_array(np.asarray(values.to_pylist(), dtype=object), categorize=False).astype(U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of a common public hash)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


BASE = 0x9E3779B97F4A7C15


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` values from each position on; the last ``n - 1`` positions have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    weight = powers(n)
    out = np.zeros(m, U64)
    for i in range(n):
        out += h[i : i + m] * weight[i]
    return mix(out)


def rows_of(batch: pa.RecordBatch, keep: Iterable[str], **more: pa.Array) -> pa.RecordBatch:
    names = [*keep, *more]
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *more.values()], names=names)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, ascending."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def strings(values: pa.Array) -> list[str]:
    """An array without nulls as a list, at once and not value by value."""
    return values.to_numpy(zero_copy_only=False).tolist()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def list_array(values: pa.Array, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``__key``, ``__row`` and ``__text`` of every row; other columns, whatever their names, stay outside.

    ``__row`` hashes key and text, so it names a row also when keys are null or used twice. Rows repeated
    as they are share it, and so share results.
    """
    return docs.select(F.col(key).alias("__key"), F.xxhash64(F.col(key), F.col(text)).alias("__row"), F.col(text).alias("__text"))


def bucket(key: str, divisor: int) -> Column:
    """crc32 of the key as text modulo ``divisor``; -1 for a null key, which is in no fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(divisor)), F.lit(-1))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared folder and read back: the work is not done again, and lost executors don't matter."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Empty the folders of stored tables that nothing reads any more."""
    for df in tables:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(df.stored_at)
