"""Repeated byte strings: the Burrows-Wheeler transform of a collection, built column by column.

A string of ``width`` bytes has an anchor: the leftmost of its runs of ``GRAM`` bytes with the smallest hash. Equal
strings have equal anchors at equal places. Strings that start next to each other mostly share one, and make a
block; all blocks at equal anchors are a collection, wherever they are. Blocks that are equal byte for byte are
one member with a number of copies.

Members of a collection are laid out by their anchor, and a symbol is a pair of column and byte. Each round takes
the next column to the left and inserts one symbol for every member that reaches it: a stable sort of the last
run of the transform by its symbols gives the order of the new suffixes, and minima of the last common
prefixes between neighbours give the new ones. As the column leads the symbol, the rows of a round are one run
of the transform behind all others, so transform, members and common prefixes are sequential files that are
appended to and never rewritten. They are read back once: neighbours with a common prefix of ``width`` bytes
start a string that also starts elsewhere.

A collection of more than ``MEMBERS`` members is built in parts. What a part has not settled, and one string of
each kind that it has, is counted over all parts by a grouped sum, so no collection is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from tempfile import SpooledTemporaryFile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

U64 = np.uint64
GRAM = 32
#: Members of one part of a collection; text starts of one piece of a long text; bytes of members built together.
MEMBERS, PIECE, BUILD_BYTES = 4096, 1 << 20, 2 << 20
#: Bytes of a file of the transform that stay in memory.
SPOOL = 32 << 20
#: A hash for each byte value.
BYTES = common.mix(np.arange(1, 257, dtype=U64) * U64(common.BASE))


class Pieces:
    """Bytes of a slice of texts, one after the other, with running hashes of all its positions."""

    def __init__(self, data: np.ndarray):
        self.data = data
        n = len(data)
        power = common.powers(n + 1)
        self.total = np.concatenate((np.zeros(1, U64), np.cumsum(BYTES[data] * power[:n], dtype=U64)))
        self.back = common.powers(n + 1, pow(common.BASE, -1, 1 << 64))

    def hash(self, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        """Hash of the bytes from ``a`` up to ``b``."""
        return common.mix((self.total[b] - self.total[a]) * self.back[a])


def _anchored(grams: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost smallest of ``span`` values from each position on; the upper 40 bits count."""
    best = (grams & ~U64(0xFFFFFF)) | np.arange(len(grams), dtype=U64)
    have = 1
    while have < span:
        step = min(have, span - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return (best & U64(0xFFFFFF)).astype(np.int64)


def text_pieces(part: pa.RecordBatch, width: int, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row of the batch, place in its text and bytes of each piece. A string starts in one piece only."""
    col = part.column("__text").cast(pa.large_binary())
    for row in range(len(col)):
        value = col[row].as_buffer() if col[row].is_valid else None
        if value is None or value.size < width:
            continue
        data = np.frombuffer(value, np.uint8)
        for at in range(0, len(data) - width + 1, size):
            yield row, at, data[at : at + size + width - 1]


def blocks(part: pa.RecordBatch, width: int, most: int) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of the texts: row, place of the first string, number of strings, place of the anchor in the block, two hashes."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for piece in text_pieces(part, width, most):
        held.append(piece)
        size += len(piece[2])
        if size > most:
            yield _blocks_of(held, width)
            held, size = [], 0
    if held:
        yield _blocks_of(held, width)


def _blocks_of(held: list[tuple[int, int, np.ndarray]], width: int) -> dict[str, np.ndarray]:
    size = np.array([len(d) for *_, d in held])
    ends = np.cumsum(size)
    p = Pieces(np.concatenate([d for *_, d in held]))
    gram = min(GRAM, width)
    n = len(p.data) - width + 1
    grams = p.hash(slice(0, len(p.data) - gram + 1), slice(gram, None))
    anchor = _anchored(grams, width - gram + 1)
    owner = np.repeat(np.arange(len(held)), size)[:n]
    start = np.flatnonzero(np.arange(n) + width <= ends[owner])
    new = np.ones(len(start), bool)
    new[1:] = (anchor[start[1:]] != anchor[start[:-1]]) | (np.diff(start) != 1)
    at = np.flatnonzero(new)
    first = start[at]
    count = np.diff(np.append(at, len(start)))
    owner = owner[first]
    row, place = (np.array([h[i] for h in held])[owner] for i in (0, 1))
    return {
        "row": row,
        "start": place + first - (ends - size)[owner],
        "count": count,
        "lead": anchor[first] - first,
        "anchor": grams[anchor[first]],
        "content": common.mix(p.hash(first, first + count + width - 1) + common.mix(count.astype(U64) * U64(1024) + (anchor[first] - first).astype(U64))),
    }


def _light(rows: DataFrame, width: int) -> DataFrame:
    """All blocks, without their bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text", 2 << 20):
            for b in blocks(part, width, PIECE):
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row").take(pa.array(b["row"])), common.signed(b["anchor"]), common.signed(b["content"]), pa.array(b["start"].astype(np.int64)), pa.array(b["count"].astype(np.int16)), pa.array(b["lead"].astype(np.int16))],
                    names=["__row", "anchor", "content", "start", "count", "lead"],
                )

    return rows.mapInArrow(run, "__row long, anchor long, content long, start long, count short, lead short")


class Transform:
    """The transform of a batch of collections, built by rounds of one column from right to left.

    ``group`` is the collection of each member, ``begin`` and ``end`` its columns, ``base`` where its bytes begin
    in ``data``. Members that begin a column have an empty suffix there, which sorts before all others.
    """

    def __init__(self, data: np.ndarray, base: np.ndarray, begin: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.files = {"symbol": SpooledTemporaryFile(SPOOL), "member": SpooledTemporaryFile(SPOOL), "common": SpooledTemporaryFile(SPOOL)}
        self.rounds: list[tuple[int, int]] = []
        order, prefix = np.zeros(0, np.int32), np.zeros(0, np.int32)
        by_end = np.lexsort((np.arange(len(end)), group, -end)).astype(np.int32)
        ends = -end[by_end]
        for column in range(int(end.max(initial=0)) - 1, int(begin.min(initial=0)) - 1, -1):
            new = by_end[np.searchsorted(ends, -(column + 1), "left") : np.searchsorted(ends, -(column + 1), "right")]
            reach = begin[order] <= column
            if not reach.all():
                prefix = _kept_minima(prefix, reach)
                order = order[reach]
            if len(new):
                # empty suffixes first in their collection; they share nothing with their neighbours
                both = np.concatenate((new, order))
                common_ = np.concatenate((np.zeros(len(new), np.int32), prefix))
                at = np.argsort(group[both], kind="stable")
                old = np.flatnonzero(at >= len(new))
                order, prefix = both[at], common_[at]
                prefix[old[(old > 0) & (at[old - 1] < len(new))]] = 0
            if not len(order):
                continue
            symbol = data[base[order] + (column - begin[order])]
            order, prefix = self._round(symbol, order, prefix, group)
            self._append(column, symbol, order, prefix)

    @staticmethod
    def _round(symbol: np.ndarray, order: np.ndarray, prefix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and common prefixes of the suffixes that are one symbol longer."""
        g = group[order]
        key = (g.astype(np.int64) << 8) | symbol
        at = np.argsort(key, kind="stable")
        key = key[at]
        out = np.zeros(len(at), np.int32)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(same):
            spans = np.empty(2 * len(same), np.int64)
            spans[::2], spans[1::2] = at[same - 1] + 1, at[same] + 1
            out[same] = 1 + np.minimum.reduceat(np.append(prefix, 0), spans)[::2]
        return order[at], out

    def _append(self, column: int, symbol: np.ndarray, order: np.ndarray, prefix: np.ndarray) -> None:
        self.files["symbol"].write(symbol.tobytes())
        self.files["member"].write(order.astype(np.int32).tobytes())
        self.files["common"].write(prefix.astype(np.int32).tobytes())
        self.rounds.append((column, len(order)))

    def read(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Column, inserted symbols, members in order and common prefixes of each round, read back in sequence."""
        for f in self.files.values():
            f.seek(0)
        for column, n in self.rounds:
            yield column, np.frombuffer(self.files["symbol"].read(n), np.uint8), *(np.frombuffer(self.files[k].read(4 * n), np.int32) for k in ("member", "common"))

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def _kept_minima(prefix: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Common prefixes between neighbours among the kept: the minimum over those left out between them."""
    at = np.flatnonzero(keep)
    if not len(at):
        return prefix[:0]
    spans = np.empty(2 * len(at), np.int64)
    spans[::2], spans[1::2] = np.concatenate(([0], at[:-1] + 1)), at + 1
    return np.minimum.reduceat(np.append(prefix, 0), spans)[::2]


def _solve(rows: list[dict], width: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated strings of each member; of divided collections also one hash for each other kind of string."""
    data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
    size = np.array([len(r["bytes"]) for r in rows])
    base = np.cumsum(size) - size
    begin = -np.array([r["lead"] for r in rows])
    _, group = np.unique(np.array([(r["anchor"], r["share"]) for r in rows], np.int64), axis=0, return_inverse=True)
    divided = np.array([r["divided"] for r in rows])
    built = Transform(data, base, begin, begin + size, group.reshape(-1))
    hits, open_, kinds = [], [], []
    for column, _, member, prefix in built.read():
        long = prefix >= width
        again = long.copy()
        again[:-1] |= long[1:]
        hits.append(np.stack((member[again], np.full(again.sum(), column))))
        if divided.any():
            first = ~long & divided[member] & (begin[member] + size[member] - column >= width)
            open_.append(np.stack((member[first], np.full(first.sum(), column), again[first])))
    built.close()
    m, c = np.concatenate(hits, 1) if hits else np.zeros((2, 0), int)
    order = np.lexsort((c, m))
    m, a = m[order], (c - begin[m])[order]
    new = np.ones(len(m), bool)
    new[1:] = (np.diff(m) != 0) | (np.diff(a) != 1)
    lo = np.flatnonzero(new)
    length = np.diff(np.append(lo, len(m)))
    out = {"member": m[lo], "a": a[lo], "b": a[lo] + length, "open": np.zeros(len(lo), bool), "win": np.zeros(len(lo), U64), "times": np.zeros(len(lo), np.int64)}
    if divided.any():
        om, oc, again = np.concatenate(open_, 1)
        p = Pieces(data)
        at = base[om] + oc - begin[om]
        kinds = {"member": om, "a": oc - begin[om], "b": oc - begin[om] + 1, "open": np.ones(len(om), bool), "win": p.hash(at, at + width), "times": 1 + again}
        out = {k: np.concatenate((out[k], kinds[k])) for k in out}
    who = out["member"]
    take = lambda k: pa.array(np.array([r[k] for r in rows], np.int64)[who])
    col = np.array([r["lead"] for r in rows])[who]
    yield pa.RecordBatch.from_arrays(
        [take("anchor"), take("content"), pa.array(out["a"].astype(np.int32)), pa.array(out["b"].astype(np.int32)), pa.array(out["open"]), pa.array((out["a"] - col).astype(np.int32)), common.signed(out["win"]), pa.array(out["times"].astype(np.int64))],
        names=["anchor", "content", "a", "b", "open", "col", "win", "times"],
    )


def _built(members: DataFrame, width: int) -> DataFrame:
    """Transforms of the collections of a partition, as many together as fit ``BUILD_BYTES``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                now = row["anchor"], row["share"]
                if size > BUILD_BYTES and now != last:
                    yield from _solve(held, width)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
                last = now
        if held:
            yield from _solve(held, width)

    return members.mapInArrow(run, "anchor long, content long, a int, b int, open boolean, col int, win long, times long")


def _fetched(docs: DataFrame, width: int) -> DataFrame:
    """The bytes of the wanted blocks of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            texts = part.column("__text").cast(pa.large_binary())
            for row in range(part.num_rows):
                data = texts[row].as_buffer()
                spots = part.column("spots")[row].values
                at, n = (spots.field(k).to_numpy().astype(np.int64) for k in ("start", "count"))
                view = memoryview(data)
                chunks = [bytes(view[a : a + c + width - 1]) for a, c in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(spots.field(k) for k in ("anchor", "content", "share", "divided", "lead")), pa.array(chunks, pa.binary())], names=["anchor", "content", "share", "divided", "lead", "bytes"])

    return docs.mapInArrow(run, "anchor long, content long, share int, divided boolean, lead short, bytes binary")


def repeated_ranges(rows: DataFrame, width: int) -> DataFrame:
    """``__row`` and an array of [a, b): ranges of starts of strings that also start elsewhere."""
    light = common.stored(_light(rows, width), "suffix-blocks")
    kinds = light.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("__row", "start", "count", "lead")).alias("one"))
    kinds = common.stored(kinds, "suffix-kinds")
    size = common.stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("members"), F.sum("copies").alias("all")).where("all > 1"), "suffix-collections")
    kept = common.stored(kinds.join(size.select("anchor", "members"), "anchor"), "suffix-members")
    parts = F.ceil(F.col("members") / MEMBERS).cast("int")
    several = kept.where("members > 1").select("one.*", "anchor", "content", F.pmod(F.col("content"), parts).cast("int").alias("share"), (parts > 1).alias("divided"))
    spots = several.groupBy("__row").agg(F.collect_list(F.struct("anchor", "content", "share", "divided", "start", "count", "lead")).alias("spots"))
    # a row repeated as it is holds the same blocks: one of them is enough
    bytes_ = common.stored(_fetched(rows.join(spots, "__row").dropDuplicates(["__row"]), width), "suffix-bytes")
    cols = ["anchor", "share"]
    solved = common.stored(_built(bytes_.repartition(*cols).sortWithinPartitions(*cols), width), "suffix-built")
    left = solved.where("open")
    counted = common.stored(left.groupBy("anchor", "col", "win").agg(F.sum("times").alias("t")).where("t > 1").drop("t"), "suffix-counted")
    more = left.join(counted, ["anchor", "col", "win"]).select("anchor", "content", "a", "b")
    copied = kept.where("copies > 1").select("anchor", "content", F.lit(0).alias("a"), F.col("one.count").cast("int").alias("b"))
    ranges = solved.where("not open").select("anchor", "content", "a", "b").unionByName(more).unionByName(copied)
    ranges = common.stored(ranges.groupBy("anchor", "content").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "suffix-ranges")
    common.discard(kinds, size, bytes_, solved, counted)
    found = light.join(ranges, ["anchor", "content"]).select("__row", F.explode("ranges").alias("r"), "start")
    found = found.select("__row", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b"))
    found = common.stored(found.groupBy("__row").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "suffix-spans")
    common.discard(light, kept, ranges)
    return found


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = 200) -> DataFrame:
    """One row per input row: ``key``, ``row``, ``n_bytes``, ``n_removed``, ``spans``, ``kept``.

    Texts are UTF-8 bytes. Every byte covered by a string of ``width`` bytes that also starts anywhere else, in the
    same text or another, goes, first occurrences too; strings are those of the input and never cross texts.
    ``spans`` are the maximal removed runs as [a, b), ``kept`` the other bytes, which may cut a character. Null and
    empty texts and texts shorter than ``width`` lose nothing; a null text has no bytes. Rows repeated as they are
    repeat each other. Null keys take part. Other columns, whatever their names, play no part.
    """
    rows = common.keyed(docs, key, text)
    found = repeated_ranges(rows.select("__row", "__text"), width)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            texts = part.column("__text").cast(pa.large_binary())
            size, removed, spans, kept = [], [], [], []
            for row in range(part.num_rows):
                data = np.frombuffer(texts[row].as_buffer(), np.uint8) if texts[row].is_valid else np.zeros(0, np.uint8)
                ranges = part.column("ranges")[row].values
                size.append(len(data))
                if ranges is None:
                    removed.append(0)
                    spans.append([])
                    kept.append(data.tobytes())
                    continue
                a, b = ranges.field("a").to_numpy(), ranges.field("b").to_numpy() + width - 1
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.concatenate(([True], a[1:] > b[:-1]))
                a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                edges = np.concatenate(([0], np.stack((a, b), 1).reshape(-1), [len(data)]))
                kept.append(b"".join(data[x:y].tobytes() for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
                removed.append(int((b - a).sum()))
                spans.append([{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield common.rows_of(part, ["__key", "__row"], n_bytes=pa.array(size, pa.int64()), n_removed=pa.array(removed, pa.int64()), spans=pa.array(spans, span), kept=pa.array(kept, pa.binary()))

    kind = rows.schema["__key"].dataType.simpleString()
    out = rows.join(found, "__row", "left").mapInArrow(cut, f"__key {kind}, __row long, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept binary")
    return out.select(F.col("__key").alias(key), F.col("__row").alias("row"), "n_bytes", "n_removed", "spans", "kept")
