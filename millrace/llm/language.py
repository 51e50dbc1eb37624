"""Language of a text: nearest of several centroids per language over normalised TF-IDF letter n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

#: Hashed n-gram space.
DIM = 4096
ORDERS = (1, 2, 3)
UNKNOWN = "und"
SLICE = 1 << 20
#: From so many letters on, a text counts as long.
FULL_LETTERS = 256
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True at the code points of letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, a row per text, and the number of letters of each text.

    Everything that is not a letter counts as a space, runs of spaces as one; n-grams with a space inside
    keep the edges of words.
    """
    n = len(texts)
    joined = "\x00".join((t or "").replace("\x00", " ") for t in texts).lower()
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(cps == 0)
    letter = letters()[np.minimum(cps, 0x10FFFF)]
    chars = np.where(letter, cps, 32).astype(np.uint64)
    keep = letter | np.concatenate(([True], letter[:-1]))
    chars, owner, letter = chars[keep], owner[keep], letter[keep]
    counts = np.zeros(n * DIM, np.int64)
    for order in ORDERS:
        m = len(chars) - order + 1
        if m <= 0:
            break
        code = np.zeros(m, np.uint64)
        for i in range(order):
            code = code * np.uint64(0x110000) + chars[i : i + m]
        same = owner[:m] == owner[order - 1 :]
        some = letter[:m] if order == 1 else letter[:m] | letter[order - 1 :]
        use = same & some
        cell = (common.mix(code[use] + np.uint64(order)) % np.uint64(DIM)).astype(np.int64)
        counts += np.bincount(owner[:m][use] * DIM + cell, minlength=n * DIM)
    size = np.bincount(owner[letter], minlength=n)[:n]
    return counts.reshape(n, DIM), size


@dataclass
class Model:
    """``centroids``: unit rows; ``labels``: the language of each; ``floor``: least cosine of a long text."""

    idf: np.ndarray
    centroids: np.ndarray
    labels: list[str]
    floor: float

    def similarity(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts).astype(np.float32) * self.idf
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        return (v @ self.centroids.T) / np.maximum(norm, 1e-9)

    def least(self, size: np.ndarray) -> np.ndarray:
        """Accepted from this cosine on: that of a text of few letters grows with their square root."""
        return self.floor * np.sqrt(np.minimum(1.0, size / FULL_LETTERS))


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; fewer rows than ``k`` are their own centroids."""
    if len(x) <= k:
        return x
    picked = [int(np.argmax(x @ x.mean(0)))]
    while len(picked) < k:
        picked.append(int(np.argmin((x @ x[picked].T).max(1))))
    c = x[picked]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        c = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(docs: DataFrame, text: str, label: str, key: str, train: Column, *, per_language: int = 400, clusters: int = 4, slack: float = 0.5) -> Model:
    """Fit on a bounded sample: about ``per_language`` labelled rows of each language, taken by a hash of the key.

    Only hashed counts of the sample reach the driver, not texts. ``slack`` times the lowest hundredth of
    the sample's own cosines is the least accepted for a long text.
    """
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")).where(train & F.col("l").isNotNull() & F.col("t").isNotNull())
    counted = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counted:
        return Model(np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), [], 0.0)
    share = F.lit(0.0)
    for lang, n in counted.items():
        share = F.when(F.col("l") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64(F.lit(7), "k"), F.lit(1 << 30)) < share * (1 << 30)).select("t", "l")
    sample = sample.limit(4 * per_language * len(counted))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "t", SLICE):
            counts, size = gram_counts(part.column("t").to_pylist())
            cells = [np.flatnonzero(r) for r in counts]
            starts = np.concatenate(([0], np.cumsum([len(c) for c in cells])))
            flat = np.concatenate(cells) if cells else np.zeros(0, int)
            values = np.concatenate([r[c] for r, c in zip(counts, cells, strict=True)]) if cells else flat
            yield common.rows_of(part, ["l"], size=pa.array(size), cells=common.list_array(pa.array(flat.astype(np.int32)), starts), counts=common.list_array(pa.array(values.astype(np.int32)), starts))

    rows = [r for r in sample.mapInArrow(features, "l string, size long, cells array<int>, counts array<int>").collect() if r["size"]]
    if not rows:
        return Model(np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), [], 0.0)
    rows.sort(key=lambda r: (r["l"], r["size"], r["cells"], r["counts"]))
    x = np.zeros((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        x[i, r["cells"]] = np.sqrt(np.asarray(r["counts"], np.float32))
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    langs = np.array([r["l"] for r in rows])
    parts = [(lang, _clusters(x[langs == lang], clusters)) for lang in sorted(set(langs))]
    centroids = np.concatenate([c for _, c in parts])
    labels = [lang for lang, c in parts for _ in c]
    best = (x @ centroids.T).max(1)
    long = np.array([r["size"] for r in rows]) >= FULL_LETTERS
    return Model(idf, centroids, labels, slack * float(np.quantile(best[long] if long.any() else best, 0.01)))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``row``, ``lang_pred``, ``score``, ``rejected`` of every row, repeated rows and null keys too.

    The nearest centroid by cosine names the language; equal cosines take the first in the order of names.
    ``score`` is that cosine within 0 and 1. ``rejected`` marks texts further from every centroid than
    their length allows, and all texts without a letter, which get ``und`` and 0. Without any labelled
    row nothing can be learned and all are ``und``.
    """

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text", SLICE):
            texts = part.column("__text").to_pylist()
            names, scores, out = [], [], []
            for at in range(0, len(texts), 256):
                counts, size = gram_counts(texts[at : at + 256])
                if not model.labels:
                    names += [UNKNOWN] * len(size)
                    scores += [0.0] * len(size)
                    out += [True] * len(size)
                    continue
                sim = model.similarity(counts)
                near = sim.argmax(1)
                best = sim[np.arange(len(sim)), near].astype(float)
                none = size == 0
                names += [UNKNOWN if e else model.labels[j] for e, j in zip(none, near, strict=True)]
                scores += [0.0 if e else min(1.0, max(0.0, float(s))) for e, s in zip(none, best, strict=True)]
                out += (none | (best < model.least(size))).tolist()
            yield common.rows_of(part, ["__key", "__row"], lang_pred=pa.array(names), score=pa.array(scores, pa.float64()), rejected=pa.array(out))

    df = common.keyed(docs, key, text)
    kind = df.schema["__key"].dataType.simpleString()
    out = df.mapInArrow(predict, f"__key {kind}, __row long, lang_pred string, score double, rejected boolean")
    return out.select(F.col("__key").alias(key), F.col("__row").alias("row"), "lang_pred", "score", "rejected")


