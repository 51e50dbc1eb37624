"""Document probability over all subword segmentations of a fixed vocabulary.

The pieces are those of a public vocabulary file, with its scores as the start: they are ranks, so a piece
starts with weight 1 / (rank + 1). Expected piece counts over all different training words, by forward and
backward recursion in log space, re-estimate the weights. No piece crosses the start of a word,
so the lattice of a text is that of its words one after the other, and a word's marginal is computed once for
all its occurrences. Each word of the training texts also has one edge of its own from start to end, weighted by
its discounted count; the discounted mass is what the subword paths share.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

U64 = np.uint64
START = "▁"
#: Stands for the end of a text among the words; no word holds a space.
END = " "
_BACK = pow(common.BASE, -1, 1 << 64)
#: Taken from the count of each training word for the subword paths.
DISCOUNT = 0.5
#: Cells of the lattice that a task works on together.
CELLS = 1 << 21


class Pieces:
    """The vocabulary: hashes of pieces in a table, log weights by piece; the last 256 are single bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = [sp.id_to_piece(i) for i in ids]
        rank = np.array([-sp.get_score(i) for i in ids])
        use = np.array([START not in t[1:] for t in text])
        text, rank = [t for t, u in zip(text, use, strict=True) if u], rank[use]
        self.longest = max(len(t) for t in text)
        self.count = len(text)
        weight = np.concatenate((1 / (rank + 1), np.full(256, 1 / (rank.max() + 2))))
        self.log_p = np.log(weight / weight.sum())
        self.bits = 20
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.hash = np.array([self._one(t) for t in text], U64)
        for i, h in enumerate(self.hash.tolist()):
            at = h >> (64 - self.bits)
            while self.table[at] >= 0:
                at = (at + 1) % len(self.table)
            self.table[at] = i

    @staticmethod
    def _one(t: str) -> int:
        code = np.array([ord(c) for c in t], U64)
        return int(common.mix((common.mix(code) * common.powers(len(code))).sum(dtype=U64, keepdims=True))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        out = self.table[at]
        wrong = np.flatnonzero((out >= 0) & (self.hash[np.maximum(out, 0)] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.table)
            out[wrong] = self.table[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.hash[np.maximum(out[wrong], 0)] != h[wrong])]
        return out


def _batches(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length together: places in the list, code points with the word start in front."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        n = size[order[at]]
        stop = int(np.searchsorted(size[order], n, side="right"))
        stop = min(stop, at + max(1, CELLS // (16 * (int(n) + 1))))
        take = order[at:stop]
        text = START + START.join(words[i] for i in take)
        yield take, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(take), n + 1)
        at = stop


class Lattice:
    """Edges of all words of one length: ``piece[l][:, j]`` is the piece of ``l + 1`` characters that ends after j."""

    def __init__(self, pieces: Pieces, log_p: np.ndarray, code: np.ndarray):
        n, m = code.shape
        self.m = m
        self.log_p = log_p
        value = common.mix(code.ravel().astype(U64)).reshape(n, m) * common.powers(m)
        total = np.concatenate((np.zeros((n, 1), U64), np.cumsum(value, axis=1, dtype=U64)), axis=1)
        back = common.powers(m, _BACK)
        self.piece, self.weight = [], []
        for size in range(1, min(pieces.longest, m) + 1):
            h = common.mix(((total[:, size:] - total[:, :-size]) * back[: m - size + 1]).ravel())
            found = pieces.find(h).reshape(n, -1)
            w = np.where(found >= 0, log_p[found], -np.inf)
            if size == 1:
                self.bytes = self._spelled(pieces, code, found)
                r, c, counted = self.bytes
                w[r, c] = counted @ log_p[pieces.count :]
            self.piece.append(found)
            self.weight.append(w)

    @staticmethod
    def _spelled(pieces: Pieces, code: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters outside the vocabulary, and how often each byte occurs in them."""
        r, c = np.nonzero(found < 0)
        counted = np.zeros((len(r), 256))
        values, place = np.unique(code[r, c], return_inverse=True)
        spelled = np.zeros((len(values), 256))
        for i, v in enumerate(values.tolist()):
            for b in chr(v).encode("utf-8", "surrogatepass"):
                spelled[i, b] += 1
        if len(r):
            counted = spelled[place]
        return r, c, counted

    def _sum(self, x: list[np.ndarray]) -> np.ndarray:
        x = np.stack(x, 1)
        top = x.max(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.isfinite(top), top + np.log(np.exp(x - np.where(np.isfinite(top), top, 0)[:, None]).sum(1)), -np.inf)

    def forward(self) -> np.ndarray:
        """Log probability of all segmentations of each prefix."""
        n = len(self.weight[0])
        a = np.full((n, self.m + 1), -np.inf)
        a[:, 0] = 0
        for j in range(1, self.m + 1):
            a[:, j] = self._sum([a[:, j - s] + self.weight[s - 1][:, j - s] for s in range(1, min(len(self.weight), j) + 1)])
        return a

    def expected(self, size: int) -> np.ndarray:
        """Expected counts of all pieces and bytes over the words."""
        a = self.forward()
        b = np.full_like(a, -np.inf)
        b[:, self.m] = 0
        for j in range(self.m - 1, -1, -1):
            b[:, j] = self._sum([b[:, j + s] + self.weight[s - 1][:, j] for s in range(1, min(len(self.weight), self.m - j) + 1)])
        out = np.zeros(size)
        whole = a[:, -1:]
        for s, (piece, w) in enumerate(zip(self.piece, self.weight, strict=True), 1):
            share = np.exp(a[:, : self.m - s + 1] + w + b[:, s:] - whole)
            known = piece >= 0
            out += np.bincount(piece[known], share[known], minlength=size)
            if s == 1:
                r, c, counted = self.bytes
                out[size - 256 :] += share[r, c] @ counted
        return out


#: Bytes of text whose words are counted together.
SLICE = 12 << 20


def _postings(docs: DataFrame) -> DataFrame:
    """Word, its count in training texts, and which texts of a slice hold it how often; one row per slice and word.

    A slice is named by a hash of its rows, and its texts by number; the row of the end also lists their names.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text", SLICE):
            w = common.words(part.column("__text"), lower=True)
            n, texts = len(w.distinct), part.num_rows
            cell, tf = np.unique(w.codes.astype(np.int64) * texts + w.owners(), return_counts=True)
            cell = np.append(cell, n * texts + np.arange(texts))
            tf = np.append(tf, np.ones(texts, np.int64)).astype(np.int32)
            code, doc = np.divmod(cell, texts)
            held = part.column("__train").to_numpy(zero_copy_only=False)
            count = np.bincount(code, tf * held[doc], minlength=n + 1).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=n + 1))))
            rows = part.column("__row").to_numpy()
            name = int(common.mix(rows.view(U64) + common.mix(np.arange(texts, dtype=U64))).sum(dtype=U64))
            name -= (name >> 63) << 64
            names = pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [texts], pa.int32()), pa.array(rows), mask=pa.array([True] * n + [False]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n + 1, name)), pa.concat_arrays([w.distinct, pa.array([END])]), pa.array(count), common.list_array(pa.array(doc.astype(np.int32)), ends), common.list_array(pa.array(tf), ends), names],
                names=["slice", "word", "c", "texts", "tfs", "rows"],
            )

    return docs.select("__row", "__text", "__train").mapInArrow(run, "slice long, word string, c long, texts array<int>, tfs array<int>, rows array<long>")


def train(vocabulary: DataFrame, pieces: Pieces, rounds: int) -> np.ndarray:
    """Log weights of pieces after ``rounds`` re-estimations over all different training words.

    The subword paths serve words that are new or rare, and new words resemble the many rare ones more than
    the frequent few; so each different word counts once here.
    """
    log_p = pieces.log_p
    size = pieces.count + 256
    for _ in range(rounds):

        def expect(batches: Iterable[pa.RecordBatch], log_p: np.ndarray = log_p) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                words = batch.column("word").to_pylist()
                for _, code in _batches(words):
                    total += Lattice(pieces, log_p, code).expected(size)
            used = np.flatnonzero(total > 0)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

        seen = vocabulary.where(F.col("c") > 0).where(F.col("word") != END).select("word")
        rows = seen.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.full(size, 0.1)
        for r in rows:
            n[r["piece"]] += r["n"]
        log_p = np.log(n / n.sum())
    return log_p


def score(docs: DataFrame, path: str, train_rows: Column, key: str = "doc_id", text: str = "text", *, rounds: int = 2) -> DataFrame:
    """One row per input row: ``key``, ``row``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are words with A-Z lower-cased and one end per text; null and blank texts are the end alone.
    ``train_rows`` says of the input's columns which rows to learn from. ``base_score`` is the add-one word model,
    ``score`` the lattice, both log10. Without training rows words have their subword probability and the end has 1.
    Repeated rows score alike; null keys take part.
    """
    rows = docs.select(F.col(key).alias("__key"), F.xxhash64(F.col(key), F.col(text)).alias("__row"), F.col(text).alias("__text"), F.coalesce(train_rows, F.lit(False)).alias("__train"))
    post = common.stored(_postings(rows), "lattice-postings")
    vocabulary = common.stored(post.groupBy("word").agg(F.sum("c").alias("c")), "lattice-words")
    facts = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, types = facts["n"], facts["v"]
    pieces = Pieces(path)
    log_p = train(vocabulary, pieces, rounds)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            sub = np.full(len(words), -np.inf)
            for take, code in _batches(words):
                sub[take] = Lattice(pieces, log_p, code).forward()[:, -1]
            end = np.asarray(pc.equal(batch.column("word"), END))
            sub[end] = -np.inf
            if total:
                with np.errstate(divide="ignore"):
                    own = np.log(np.maximum(c - DISCOUNT, 0) / total)
                log = np.logaddexp(own, sub + math.log(DISCOUNT * types / total))
            else:
                log = np.where(end, 0.0, sub)
            yield common.rows_of(batch, ["word"], known=pa.array(c > 0), base=pa.array(np.log10(c + 1.0)), log=pa.array(log / math.log(10)))

    weighed = common.stored(vocabulary.mapInArrow(weigh, "word string, known boolean, base double, log double"), "lattice-weights")
    common.discard(vocabulary)
    each = post.select("slice", "word", "texts", "tfs").join(weighed, "word").selectExpr("slice", f"word = '{END}' as end", "known", "base", "log", "inline(arrays_zip(texts, tfs)) as (at, tf)")
    sums = each.groupBy("slice", "at").agg(
        F.sum("tf").alias("t"), F.sum(F.when(F.col("known"), F.col("tf")).otherwise(0)).alias("k"), F.sum(F.col("tf") * F.col("base")).alias("b"), F.sum(F.col("tf") * F.col("log")).alias("s"), F.sum(F.when(F.col("end"), F.col("tf")).otherwise(0)).alias("times")
    )
    named = post.where("rows is not null").select("slice", F.posexplode("rows").alias("at", "row"))
    # rows repeated as they are have equal sums, and slices with the same rows add up
    sums = sums.join(named.distinct(), ["slice", "at"]).dropDuplicates(["row"])
    each_token = math.log10(total + types + 1)
    out = rows.select("__key", F.col("__row").alias("row")).join(sums, "row")
    n = F.expr("t div times")
    return out.select(F.col("__key").alias(key), "row", n.alias("n_tokens"), F.expr("k div times").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("b") / F.col("times") - n * F.lit(each_token)).alias("base_score"), (F.col("s") / F.col("times")).alias("score"))
