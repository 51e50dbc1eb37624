"""Repeated passages: relative Lempel-Ziv factors of every document against indexed reference blocks.

A window is ``window`` consecutive words. Its anchor is the leftmost of its runs of ``GRAM`` words with the
smallest hash, so equal windows have equal anchors at equal places, and neighbouring windows mostly share one.
The windows of one anchor occurrence are a block. Of all blocks with the same anchor, the first is indexed as
the reference block; the other blocks are factored against it: runs of windows that agree with the reference
are factors of ``window`` words or more, and duplicate spans on both sides. What is left at the boundaries of
factors, windows that the reference lacks, is compared exactly by counting window hashes below the same anchor.
All occurrences of a window have the same anchor, and either all agree with the reference or none, so both
steps together find every repeated window, with work linear in the words of repeated blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

U64 = np.uint64
GRAM = 8


def _leftmost_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value among ``width`` values from each position on."""
    best = np.arange(len(v))
    have = 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(v[b] < v[a], b, a)
        have += step
    return best


class Blocks:
    """Anchor blocks of a slice of texts: position of the anchor, first window, number of windows, owner."""

    def __init__(self, part: pa.RecordBatch, window: int):
        w = common.words(part.column("__text"), lower=False)
        self.starts = w.starts
        h = common.hashes(w.distinct)[w.codes]
        self.h = h
        gram = min(GRAM, window)
        g = common.ngrams(h, gram)
        n = len(h) - window + 1
        owner = w.owners()
        if n <= 0:
            self.anchor = self.hash = self.first = self.count = self.owner = np.zeros(0, np.int64)
            return
        inside = owner[:n] == owner[window - 1 :]
        start = np.flatnonzero(inside)
        anchor = _leftmost_minimum(g, window - gram + 1)[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(new)
        self.first = start[at]
        self.count = np.diff(np.append(at, len(start)))
        self.anchor = anchor[at]
        self.hash = g[self.anchor]
        self.owner = owner[self.first]

    def windows(self, window: int) -> np.ndarray:
        """Hash of the window that starts at each word; meant for windows inside a text only."""
        n = len(self.h) - window + 1
        power = common.powers(len(self.h) + 1)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(common.mix(self.h) * power[:-1], dtype=U64)))
        back = common.powers(n, pow(common.BASE, -1, 1 << 64))
        return common.mix((total[window:] - total[:n]) * back)


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            b = Blocks(part, window)
            pos = b.anchor - b.starts[b.owner]
            yield pa.RecordBatch.from_arrays([part.column("__row").take(pa.array(b.owner)), common.signed(b.hash), pa.array(pos.astype(np.int32))], names=["__row", "anchor", "pos"])

    return rows.select("__row", "__text").mapInArrow(run, "__row long, anchor long, pos int")


def _blocks(found: DataFrame, window: int) -> DataFrame:
    """Blocks at the listed anchors, with the hashes of their windows; ``rel`` is first window minus anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            b = Blocks(part, window)
            spots = part.column("spots")
            wanted = np.repeat(b.starts[:-1], spots.value_lengths().to_numpy()) + spots.flatten().to_numpy()
            keep = np.isin(b.anchor, wanted)
            if not keep.any():
                continue
            first, count, owner = b.first[keep], b.count[keep], b.owner[keep]
            ends = np.concatenate(([0], np.cumsum(count)))
            index = np.repeat(first - ends[:-1], count) + np.arange(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("__row").take(pa.array(owner)), common.signed(b.hash[keep]), pa.array((first - b.starts[owner]).astype(np.int32)), pa.array((first - b.anchor[keep]).astype(np.int32)), common.list_array(common.signed(b.windows(window)[index]), ends)],
                names=["__row", "anchor", "start", "rel", "wins"],
            )

    return found.select("__row", "__text", "spots").mapInArrow(run, "__row long, anchor long, start int, rel int, wins array<long>")


def _factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factor blocks against their references: spans [a, b) of window starts, and windows left to count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = {n: batch.column(n) for n in batch.schema.names}
        num = {n: col[n].to_numpy() for n in ("__row", "anchor", "start", "rel", "ref_row", "ref_start", "ref_rel")}
        size, ref_size = (col[n].value_lengths().to_numpy().astype(np.int64) for n in ("wins", "ref_wins"))
        wins, ref = (col[n].flatten().to_numpy() for n in ("wins", "ref_wins"))
        rec = np.repeat(np.arange(len(size)), size)
        t = np.arange(len(wins)) - np.repeat(np.cumsum(size) - size, size)
        u = t + (num["rel"] - num["ref_rel"])[rec]
        inside = (u >= 0) & (u < ref_size[rec])
        place = np.where(inside, (np.cumsum(ref_size) - ref_size)[rec] + u, 0)
        same = inside & (wins == ref[place])
        own = ((num["__row"] == num["ref_row"]) & (num["start"] == num["ref_start"]))[rec]
        hit = np.flatnonzero(same & ~own)
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (rec[hit[1:]] != rec[hit[:-1]])
        a = hit[new]
        length = np.diff(np.append(np.flatnonzero(new), len(hit)))
        r = rec[a]
        left = np.flatnonzero(~same & ~own)
        lr = rec[left]
        rows = np.concatenate((num["__row"][r], num["ref_row"][r], num["__row"][lr]))
        starts = np.concatenate((num["start"][r] + t[a], num["ref_start"][r] + u[a], num["start"][lr] + t[left]))
        stops = starts + np.concatenate((length, length, np.ones(len(left), np.int64)))
        kind = np.concatenate((np.zeros(2 * len(a), bool), np.ones(len(left), bool)))
        none = np.zeros(2 * len(a), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(starts.astype(np.int32)), pa.array(stops.astype(np.int32)), pa.array(kind), pa.array(np.concatenate((none, num["anchor"][lr]))), pa.array(np.concatenate((none, (num["rel"][lr] + t[left]).astype(np.int64))).astype(np.int32)), pa.array(np.concatenate((none, wins[left])))],
            names=["__row", "a", "b", "open", "anchor", "rel", "win"],
        )


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """``__row`` and an array of [a, b): ranges of starts of windows that also start elsewhere."""
    anchors = common.stored(_anchors(rows, window), "sub-anchors")
    # written, so that both sides of the joins on anchors are shuffled for them and a hot anchor is split
    again = common.stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "sub-again")
    spots = anchors.join(again, "anchor").groupBy("__row").agg(F.collect_set("pos").alias("spots"), F.count(F.lit(1)).alias("c"))
    spots = common.stored(spots.select("__row", "spots", (F.col("c") > F.size("spots")).alias("twice")), "sub-spots")
    common.discard(anchors, again)
    blocks = common.stored(_blocks(rows.join(spots, "__row"), window), "sub-blocks")
    ref = blocks.groupBy("anchor").agg(F.min(F.struct("__row", "start", "rel", "wins")).alias("r"))
    ref = ref.select("anchor", F.col("r.__row").alias("ref_row"), F.col("r.start").alias("ref_start"), F.col("r.rel").alias("ref_rel"), F.col("r.wins").alias("ref_wins"))
    ref = common.stored(ref, "sub-references")
    out = "__row long, a int, b int, open boolean, anchor long, rel int, win long"
    parsed = common.stored(blocks.join(ref, "anchor").mapInArrow(_factors, out), "sub-factors")
    left = parsed.where("open")
    counted = left.groupBy("anchor", "rel", "win").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    more = left.join(counted, ["anchor", "rel", "win"]).select("__row", "a", "b")
    # a row repeated as it is repeats all its windows
    twice = blocks.join(spots.where("twice").select("__row"), "__row").select("__row", F.col("start").alias("a"), (F.col("start") + F.size("wins")).alias("b"))
    spans = parsed.where("not open").select("__row", "a", "b").unionByName(more).unionByName(twice).distinct()
    spans = common.stored(spans.groupBy("__row").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "sub-spans")
    common.discard(spots, blocks, ref, parsed)
    return spans


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", *, window: int = 35) -> DataFrame:
    """One row per input row: ``key``, ``row``, ``n_words``, ``n_removed``, ``kept``.

    Every word covered by a repeated window goes, first occurrences too; windows are those of the input.
    ``kept`` joins the other words by one space. Null, blank and short texts lose nothing; a null text has no
    words and an empty ``kept``. Rows repeated as they are repeat each other. Null keys take part.
    """
    rows = common.keyed(docs, key, text)
    spans = repeated_spans(rows.select("__row", "__text"), window)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            w = common.words(part.column("__text"), lower=False)
            col = part.column("spans")
            size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = col.flatten()
            base = np.repeat(w.starts[:-1], size)
            step = np.zeros(len(w.codes) + 1, np.int64)
            if len(flat):
                np.add.at(step, base + flat.field("a").to_numpy(), 1)
                np.add.at(step, base + flat.field("b").to_numpy() + window - 1, -1)
            keep = np.cumsum(step[:-1]) == 0
            total = np.concatenate(([0], np.cumsum(keep)))
            kept = pa.DictionaryArray.from_arrays(pa.array(w.codes[keep]), w.distinct).dictionary_decode() if keep.any() else pa.array([], pa.string())
            ends = total[w.starts]
            n = np.diff(w.starts)
            left = np.diff(ends)
            texts = pa.compute.binary_join(common.list_array(kept, ends), " ")
            yield common.rows_of(part, ["__key", "__row"], n_words=pa.array(n), n_removed=pa.array(n - left), kept=texts)

    kind = rows.schema["__key"].dataType.simpleString()
    out = rows.join(spans, "__row", "left").mapInArrow(cut, f"__key {kind}, __row long, n_words long, n_removed long, kept string")
    return out.select(F.col("__key").alias(key), F.col("__row").alias("row"), "n_words", "n_removed", "kept")
