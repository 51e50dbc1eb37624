"""Benchmark items inside documents: word pairs as seeds, a count that every passage must reach, Smith-Waterman.

A seed is a pair of words that stand next to each other or one word apart, in the item and in the document. An
alignment of m matches and e edits scores 2m - e. Of its m - 1 steps from match to match at most e / 2 hold two
edits or more, and each of the others is a seed; so an item of n words that scores ``least`` of its own score has
``ceil(least * n) - 1`` places that begin a seed, at as many places of a stretch of n + 2n(1 - least) words. The places
whose pairs most items hold need not be looked up: half of that number may be left out if the others still reach the
rest. How often a pair occurs in documents plays no part. Where the count is below one, single words are seeds. What
reaches the count is aligned, so the result is that of aligning every document with every item.

Items of up to ``BROADCAST_WORDS`` words in all are an index that goes to the tasks, and documents are read once. More items
stay a table: their seeds are joined with the seeds of the documents, places are gathered for each pair of item and
document that share one, and the stretches that reach the count are cut out of their texts and joined with the words
of their items. Both ways keep the same seeds and count alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of items, in all, that are sent to every task; more are joined.
BROADCAST_WORDS = 1 << 19
#: Places of seeds that a task counts together, one document at least, and cells of alignments worked on together.
PLACES, CELLS = 1 << 22, 1 << 16


def align_many(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of pairs of word sequences: best local scores and their ranges [start, stop) in ``b``.

    Words are numbers from 0 on; in ``b`` -1 is a word that no ``a`` holds. Rows are words of ``a``; a row is vectorised
    over all ``b``, with gaps along the row by a running maximum.
    """
    k, n, m = len(a), max(map(len, a)), max(map(len, b))
    left, right = np.full((k, n), -3, np.int64), np.full((k, m), -2, np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, : len(x)], right[i, : len(y)] = x, y
    step = np.arange(m + 1, dtype=np.int32)
    score = np.zeros((k, m + 1), np.int32)
    begin = np.repeat(step[None], k, 0)
    best, lo, hi = (np.zeros(k, np.int64) for _ in range(3))
    for r in range(n):
        diag = score[:, :-1] + np.where(right == left[:, r : r + 1], np.int32(MATCH), np.int32(MISMATCH))
        up = score[:, 1:] + np.int32(GAP)
        now = np.zeros((k, m + 1), np.int32)
        came = np.zeros((k, m + 1), np.int32)
        now[:, 1:] = np.maximum(np.maximum(diag, up), 0)
        came[:, 1:] = np.where(now[:, 1:] > 0, np.where(diag >= up, begin[:, :-1], begin[:, 1:]), step[1:])
        run = now - np.int32(GAP) * step  # a gap of k words along the row costs k
        lead = np.maximum.accumulate(run, axis=1)
        src = np.maximum.accumulate(np.where(run == lead, step, 0), axis=1)
        along = lead + np.int32(GAP) * step
        better = along > now
        begin = np.where(better, np.take_along_axis(came, src, 1), came)
        score = np.where(better, along, now)
        j = score.argmax(1)
        top = score[np.arange(k), j]
        more = np.flatnonzero(top > best)
        best[more], lo[more], hi[more] = top[more], begin[more, j[more]], j[more]
    return best, lo, hi


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The same of one pair."""
    if not len(a) or not len(b):
        return 0, 0, 0
    score, lo, hi = align_many([a], [b])
    return int(score[0]), int(lo[0]), int(hi[0])


class Index:
    """All items: their words, and for each seed the items that it is looked up for."""

    def __init__(self, items: pa.Table, least: float):
        items = items.combine_chunks()
        self.least = least
        self.names = pa.concat_arrays(items.column("__key").chunks)
        lists = pa.concat_arrays(items.column("item").chunks)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.n)))
        self.vocab, codes = np.unique(flat, return_inverse=True)
        self.codes = codes.astype(np.int64)
        size = self.size = len(self.vocab)
        count, drop, self.span = _counts(self.n, least)
        self.need = np.maximum(count - drop, 1)
        own, at = np.repeat(np.arange(len(self.n)), self.n), np.arange(len(flat))
        pairs = count[own] > 0
        self.single = bool((~pairs).any())
        key, place = [size * size + self.codes[~pairs]], [at[~pairs]]
        for g in (1, 2):
            p = at[pairs & (at + g < self.starts[own + 1])]
            key.append(self.codes[p] * size + self.codes[p + g])
            place.append(p)
        key, place = np.concatenate(key), np.concatenate(place)
        self.keys, code = np.unique(key, return_inverse=True)
        held = np.unique(code * len(self.n) + own[place]) // max(len(self.n), 1)
        often = np.zeros(len(flat), np.int64)
        np.maximum.at(often, place, np.bincount(held, minlength=len(self.keys))[code])
        begins = np.unique(place)
        order = begins[np.lexsort((begins, -often[begins], own[begins]))]
        first = np.searchsorted(own[order], np.arange(len(self.n)))
        used = np.zeros(len(flat), bool)
        used[order[np.arange(len(order)) - first[own[order]] >= drop[own[order]]]] = True
        kept = np.unique(code[used[place]] * len(self.n) + own[place][used[place]])
        self.items = kept % max(len(self.n), 1)
        self.at = np.searchsorted(kept // max(len(self.n), 1), np.arange(len(self.keys) + 1))

    def seeds(self, v: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of documents that begin a seed, in order, and which seed."""
        pos, key = [], []
        for g in (1, 2):
            a, b = v[:-g], v[g:]
            p = np.flatnonzero((a >= 0) & (b >= 0) & (owner[:-g] == owner[g:]))
            pos.append(p)
            key.append(a[p] * self.size + b[p])
        if self.single:
            pos.append(p := np.flatnonzero(v >= 0))
            key.append(self.size * self.size + v[p])
        pos, key = np.concatenate(pos), np.concatenate(key)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        pos, at = pos[hit], at[hit]
        order = np.argsort(pos, kind="stable")
        return pos[order], at[order]

    def stretches(self, pos: np.ndarray, at: np.ndarray, w: common.Words, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Item, document and range of words of stretches that reach the count, some documents at a time."""
        times = self.at[at + 1] - self.at[at]
        edge = np.searchsorted(pos, w.starts)
        total = np.concatenate(([0], np.cumsum(times)))
        edge_total, doc = total[edge], 0
        while doc < len(w.starts) - 1:
            stop = max(doc + 1, int(np.searchsorted(edge_total, edge_total[doc] + PLACES, side="right")) - 1)
            x, y = edge[doc], edge[stop]
            doc = stop
            n = times[x:y]
            if not n.sum():
                continue
            index = np.arange(n.sum()) + np.repeat(self.at[at[x:y]] - (np.cumsum(n) - n), n)
            both = np.unique(self.items[index] * len(owner) + np.repeat(pos[x:y], n))
            item, p = both // len(owner), both % len(owner)
            last = np.arange(len(p)) + self.need[item] - 1
            end = np.minimum(last, len(p) - 1)
            i = np.flatnonzero((last < len(p)) & (item[end] == item) & (owner[p[end]] == owner[p]) & (p[end] - p < self.span[item]))
            if not len(i):
                continue
            item, own = item[i], owner[p[i]]
            lo = np.maximum(p[end[i]] + 1 - self.span[item], w.starts[own])
            hi = np.minimum(p[i] + self.span[item], w.starts[own + 1])
            new = np.ones(len(i), bool)
            new[1:] = (item[1:] != item[:-1]) | (own[1:] != own[:-1]) | (lo[1:] > hi[:-1])
            first = np.flatnonzero(new)
            yield item[first], own[first], lo[first], hi[np.append(first[1:], len(i)) - 1]

    def scores(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Score and range of each stretch; equal stretches are aligned once."""
        known: dict[tuple[int, bytes], int] = {}
        which = np.array([known.setdefault((k, v[x:y].tobytes()), len(known)) for k, x, y in zip(item.tolist(), lo.tolist(), hi.tolist(), strict=True)])
        _, one = np.unique(which, return_index=True)
        out = np.zeros((len(one), 3), np.int64)
        order = np.lexsort((self.n[item[one]], (hi - lo)[one]))
        x = 0
        while x < len(order):
            y = x + 1
            while y < len(order) and (y + 1 - x) * (hi - lo)[one[order[y]]] <= CELLS:
                y += 1
            some = one[order[x:y]]
            got = align_many([self.codes[self.starts[k] : self.starts[k + 1]] for k in item[some]], [v[p:q] for p, q in zip(lo[some], hi[some], strict=True)])
            out[order[x:y]] = np.stack(got, 1)
            x = y
        return out[which]

    def found(self, text: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """Text, item, score, start and length of what texts hold of items."""
        w = common.words(text, lower=True, every=True)
        if not len(w.codes):
            return
        h = common.hashes(w.distinct)
        at = np.minimum(np.searchsorted(self.vocab, h), self.size - 1)
        v = np.where(self.vocab[at] == h, at, -1)[w.codes]
        owner = w.owners()
        for item, own, lo, hi in self.stretches(*self.seeds(v, owner), w, owner):
            score, a, b = self.scores(item, lo, hi, v).T
            start, size = lo + a - w.starts[own], b - a
            order = np.lexsort((-size, start, -score, item, own))
            order = order[score[order] >= self.least * MATCH * self.n[item[order]]]
            top = np.ones(len(order), bool)
            top[1:] = (own[order[1:]] != own[order[:-1]]) | (item[order[1:]] != item[order[:-1]])
            i = order[top]
            yield own[i], item[i], score[i] / (MATCH * self.n[item[i]]), start[i], size[i]


def _item_words(items: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            w = common.words(part.column("__text"), lower=True, every=True)
            yield common.rows_of(part, ["__key", "__row"], item=common.list_array(common.signed(common.hashes(w.distinct)[w.codes]), w.starts))

    kind = items.schema["__key"].dataType.simpleString()
    return items.mapInArrow(run, f"__key {kind}, __row long, item array<long>").where(F.size("item") > 0)


def _counts(n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items of n words: places that begin a seed in any passage, those that are not looked up, and the longest stretch."""
    count = np.ceil(least * n - 1e-9).astype(np.int64) - 1
    return count, np.maximum(count, 0) // 2, n + np.maximum(np.floor(MATCH * n * (1 - least) + 1e-9), 0).astype(np.int64)


def _keys(h: np.ndarray, inside: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the seeds of a row of words, and where each begins; ``inside`` tells which text a word is of."""
    if single:
        return common.mix(h + np.uint64(3)), np.arange(len(h))
    key, place = [], []
    for g in (1, 2):
        p = np.flatnonzero(inside[:-g] == inside[g:])
        key.append(common.mix(h[p] * np.uint64(common.BASE) + common.mix(h[p + g])))
        place.append(p)
    return np.concatenate(key), np.concatenate(place)


def _item_seeds(whole: DataFrame, least: float) -> DataFrame:
    """``seed``, ``item``, ``need``, ``span``: what each item is looked up by."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, item in zip(batch.column("__row").to_pylist(), batch.column("item"), strict=True):
                h = item.values.to_numpy(zero_copy_only=False).view(np.uint64)
                count, drop, span = (int(x[0]) for x in _counts(np.array([len(h)]), least))
                key, place = _keys(h, np.zeros(len(h)), count <= 0)
                same = lambda v, k: pa.array(np.full(len(key), v, k))
                yield pa.RecordBatch.from_arrays(
                    [common.signed(key), same(name, np.int64), pa.array(place), same(drop, np.int64), same(max(count - drop, 1), np.int64), same(span, np.int64)], names=["seed", "item", "place", "drop", "need", "span"]
                )

    each = common.stored(whole.dropDuplicates(["__row"]).mapInArrow(run, "seed long, item long, place long, drop long, need long, span long"), "leak-item-seeds")
    held = each.groupBy("seed").agg(F.countDistinct("item").alias("items"))
    places = each.join(held, "seed").groupBy("item", "place").agg(F.max("items").alias("often"), F.first("drop").alias("drop"))
    at = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("often"), "place"))
    used = places.withColumn("at", at).where("at > drop").select("item", "place")
    return each.join(used, ["item", "place"]).select("seed", "item", "need", "span").distinct()


def _document_seeds(rows: DataFrame, kinds: tuple[bool, ...]) -> DataFrame:
    """All seeds of the documents; ``kinds`` says whether those of pairs, of single words or both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            w = common.words(part.column("__text"), lower=True, every=True)
            h, owner = common.hashes(w.distinct)[w.codes], w.owners()
            for single in kinds:
                key, place = _keys(h, owner, single)
                own = owner[place]
                yield pa.RecordBatch.from_arrays([common.signed(key), part.column("__row").take(pa.array(own)), pa.array(place - w.starts[own]), pa.array(np.diff(w.starts)[own])], names=["seed", "__row", "pos", "words"])

    return rows.select("__row", "__text").mapInArrow(run, "seed long, __row long, pos long, words long")


def _reached(met: DataFrame) -> DataFrame:
    """Stretches [lo, hi) of the documents that hold enough seeds of an item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                p = np.array(r["pos"], np.int64)
                last = np.arange(len(p)) + r["need"] - 1
                end = np.minimum(last, len(p) - 1)
                i = np.flatnonzero((last < len(p)) & (p[end] - p < r["span"]))
                lo, hi = np.maximum(p[end[i]] + 1 - r["span"], 0), np.minimum(p[i] + r["span"], r["words"])
                new = np.ones(len(i), bool)
                new[1:] = lo[1:] > hi[:-1]
                first = np.flatnonzero(new)
                out += [(r["item"], r["__row"], int(lo[x]), int(hi[y])) for x, y in zip(first, np.append(first[1:], len(i)) - 1, strict=True)] if len(i) else []
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["item", "__row", "lo", "hi"])

    pairs = met.groupBy("item", "__row").agg(F.sort_array(F.collect_set("pos")).alias("pos"), F.first("need").alias("need"), F.first("span").alias("span"), F.first("words").alias("words"))
    return pairs.where(F.size("pos") >= F.col("need")).mapInArrow(run, "item long, __row long, lo long, hi long")


def _cut(texts: DataFrame) -> DataFrame:
    """The words of the stretches of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            w = common.words(part.column("__text"), lower=True, every=True)
            h = common.hashes(w.distinct)[w.codes]
            for row, base in enumerate(w.starts[:-1].tolist()):
                spots = part.column("spots")[row].values
                lo, hi = (spots.field(k).to_numpy() for k in ("lo", "hi"))
                ends = np.concatenate(([0], np.cumsum(hi - lo)))
                index = np.repeat(base + lo - ends[:-1], hi - lo) + np.arange(ends[-1])
                name = pa.array(np.full(len(lo), part.column("__row")[row].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([spots.field("item"), name, pa.array(lo), common.list_array(common.signed(h[index]), ends)], names=["item", "__row", "lo", "stretch"])

    return texts.mapInArrow(run, "item long, __row long, lo long, stretch array<long>")


def _aligned(met: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([x.values.to_numpy(zero_copy_only=False) for x in batch.column(c)] for c in ("words", "stretch"))
            order = sorted(range(len(a)), key=lambda i: (len(b[i]), len(a[i])))
            out, x = np.zeros((len(a), 3), np.int64), 0
            while x < len(order):
                y = x + 1
                while y < len(order) and (y + 1 - x) * len(b[order[y]]) <= CELLS:
                    y += 1
                out[order[x:y]] = np.stack(align_many([a[i] for i in order[x:y]], [b[i] for i in order[x:y]]), 1)
                x = y
            n = np.array([len(w) for w in a], np.int64)
            i = np.flatnonzero(out[:, 0] >= least * MATCH * n)
            score, lo, hi = out[i].T
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(take), batch.column("__row").take(take), pa.array(score / (MATCH * n[i])), pa.array(batch.column("lo").to_numpy()[i] + lo), pa.array(hi - lo)], names=["item", "__row", "score", "start", "length"]
            )

    return met.mapInArrow(run, "item long, __row long, score double, start long, length long")


def _counts_below(whole: DataFrame, least: float) -> bool:
    """Whether an item is so short that its single words are seeds."""
    return whole.where(F.ceil(F.size("item") * F.lit(least) - 1e-9) <= 1).limit(1).count() > 0


def _joined(rows: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """The best passage of every item and document, by joins on seeds."""
    seeds = common.stored(_item_seeds(whole, least), "leak-seeds")
    few = _counts_below(whole, least)
    met = _document_seeds(rows, (False, True) if few else (False,)).join(seeds, "seed").select("item", "__row", "pos", "need", "span", "words")
    spots = _reached(met).groupBy("__row").agg(F.collect_list(F.struct("item", "lo", "hi")).alias("spots"))
    texts = rows.select("__row", "__text").join(common.stored(spots, "leak-spots"), "__row").dropDuplicates(["__row"])
    words = whole.select(F.col("__row").alias("item"), F.col("item").alias("words")).dropDuplicates(["item"])
    found = _aligned(_cut(texts).join(words, "item"), least)
    best = found.groupBy("item", "__row").agg(F.min(F.struct((-F.col("score")).alias("s"), "start", (-F.col("length")).alias("l"))).alias("b"))
    best = best.select("item", "__row", (-F.col("b.s")).alias("score"), "b.start", (-F.col("b.l")).alias("length"))
    named = whole.select(F.col("__key").alias("__item"), F.col("__row").alias("item"))
    return rows.select("__key", "__row").join(common.stored(best, "leak-found"), "__row").join(named, "item").select("__key", "__item", "__row", "score", "start", "length")


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", *, least: float = 0.5) -> DataFrame:
    """One row per document and item that it holds: ``key``, ``item_key``, ``row``, ``score``, ``start``, ``length``.

    ``score`` is the best local alignment over that of the item with itself, 1 for a whole copy; all rows from
    ``least`` (over 0) on are returned. ``start`` and ``length`` are the words of the document's best passage; of equal ones
    the first counts. Words are compared in lower case. Null and blank texts hold nothing and are in
    nothing. Repeated rows give repeated results; null keys take part and stay null.
    """
    rows, tests = common.keyed(docs, key, text), common.keyed(items, item_key, item_text)
    whole = common.stored(_item_words(tests), "leak-items")
    total = whole.agg(F.sum(F.size("item")).alias("n")).first()["n"] or 0
    kinds = [df.schema["__key"].dataType.simpleString() for df in (rows, tests)]
    schema = f"__key {kinds[0]}, __item {kinds[1]}, __row long, score double, start long, length long"

    def searched(index: Index) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in common.slices(batches, "__text"):
                for own, item, score, start, size in index.found(part.column("__text")):
                    own = pa.array(own)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("__key").take(own), index.names.take(pa.array(item)), part.column("__row").take(own), pa.array(score), pa.array(start), pa.array(size)], names=["__key", "__item", "__row", "score", "start", "length"]
                    )

        return rows.mapInArrow(run, schema)

    if not total:
        out = docs.sparkSession.createDataFrame([], schema)
    elif total <= BROADCAST_WORDS:
        out = searched(Index(whole.select("__key", "item").toArrow(), least))
        common.discard(whole)
    else:
        out = _joined(rows, whole, least)
    return out.select(F.col("__key").alias(key), F.col("__item").alias(item_key), F.col("__row").alias("row"), "score", "start", "length")
