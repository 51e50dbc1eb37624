"""Fixed-length training sequences: shortest-pack-first over the histogram of piece lengths.

A document's ids are cut into whole sequences and a rest. The rests are packed by their histogram alone: lengths
longest first, each into the open packs with the fewest ids that have room, a whole group of equal packs at a time.
The groups are patterns with counts; their number follows the sequence length, never the documents. Pieces
then find their place by rank: the r-th piece of a length belongs to the pattern that owns rank r.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

#: Bytes of text that are encoded together.
SLICE = 8 << 20
#: Strings whose ids a task keeps.
CACHE = 1_000_000
#: Rows of one length that one task ranks.
RANKED_ROWS = 50_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that stay one letter when the tokenizer normalises them.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}\x{4E00}-\x{9FFF}"
STABLE, PLAIN = f"[0-9{LETTERS}]$", f"^[{LETTERS}]+$"
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids of strings by a public tokenizer file; strings seen before are looked up.

    White space ends a word in this tokenizer, and letters or digits do not merge with punctuation after
    them unless normalising splits them; such stay whole. So a text is the row of its words, and a word that ends so is its core and its tail; distinct
    strings become few. Strings that may hold a special token are left as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def lookup(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each string begin in ``flat``, and how many they are."""
        if len(self.keys) > CACHE:
            self.clear()
        h = common.hashes(strings)
        at = np.searchsorted(self.keys, h)
        miss = np.ones(len(h), bool)
        inside = at < len(self.keys)
        miss[inside] = self.keys[at[inside]] != h[inside]
        if miss.any():
            new, first = np.unique(h[miss], return_index=True)
            flat, size = self._new(strings.filter(pa.array(miss)).take(pa.array(first)))
            start = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.keys, new)
            self.keys, self.start, self.size = (np.insert(a, at, b) for a, b in ((self.keys, new), (self.start, start), (self.size, size)))
            at = np.searchsorted(self.keys, h)
        return self.start[at], self.size[at]

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings not seen before. A string of letters is one word of the tokenizer, which its last id ends, so
        many are encoded as one text and cut at those ids."""
        plain = pc.match_substring_regex(strings, PLAIN).to_numpy(zero_copy_only=False)
        words = strings.filter(pa.array(plain)).to_pylist()
        ids = np.concatenate([np.zeros(0, np.uint32), *self._each([" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)])])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            raise ValueError("the tokenizer does not end each word with an id of its own")
        rest = self._each(strings.filter(pa.array(~plain)).to_pylist())
        size = np.zeros(len(strings), np.int64)
        size[plain] = np.diff(last, prepend=-1)
        size[~plain] = [len(x) for x in rest]
        flat = np.concatenate([ids, *rest])
        start = np.zeros(len(strings), np.int64)
        start[plain] = np.cumsum(size[plain]) - size[plain]
        start[~plain] = len(ids) + np.cumsum(size[~plain]) - size[~plain]
        return _ragged(flat, start, size), size

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text begins."""
        w = common.words(text, lower=False)
        special = pc.match_substring(w.distinct, "<|")
        low = pc.if_else(special, w.distinct, pc.ascii_lower(w.distinct))
        core = pc.ascii_rtrim(low, PUNCTUATION)
        split = pc.and_(pc.match_substring_regex(core, STABLE), pc.invert(special))
        core = pc.if_else(split, core, low)
        tail = _rest(low, core)
        both = pa.concat_arrays([core, tail]).dictionary_encode()
        start, size = self.lookup(both.dictionary)
        code = both.indices.to_numpy()
        n = len(w.distinct)
        a, b = code[:n], code[n:]
        word_size = size[a] + size[b]
        flat = _ragged(self.flat, np.stack([start[a], start[b]], 1).ravel(), np.stack([size[a], size[b]], 1).ravel())
        word_start = np.cumsum(word_size) - word_size
        ids = _ragged(flat, word_start[w.codes], word_size[w.codes])
        total = np.concatenate(([0], np.cumsum(word_size[w.codes])))
        return ids, total[w.starts]


def _rest(whole: pa.Array, head: pa.Array) -> pa.Array:
    """What follows ``head`` in each string."""
    bytes_ = whole.cast(pa.binary())
    size = pc.subtract(pc.binary_length(whole), pc.binary_length(head)).to_numpy()
    offset = np.frombuffer(bytes_.buffers()[1], np.int32)[bytes_.offset : bytes_.offset + len(bytes_) + 1]
    data = np.frombuffer(bytes_.buffers()[2] or b"", np.uint8)
    out = _ragged(data, offset[1:] - size, size)
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def _ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenate ``values[start:start + size]`` of every pair."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def cut(docs: DataFrame, path: str, length: int, end_id: int) -> DataFrame:
    """Pieces of every row: whole sequences, then the rest. Columns ``__key``, ``__row``, start, length, crc, tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for part in common.slices(batches, "__text", SLICE):
            ids, starts = encoder.encode(part.column("__text"))
            owner, start, size, crc, tokens = [], [], [], [], []
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(whole), length):
                    piece = whole[at : at + length]
                    owner.append(i)
                    start.append(at)
                    size.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    tokens.append(len(whole))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [part.column("__key").take(take), part.column("__row").take(take), *(pa.array(x, pa.int64()) for x in (start, size, crc, tokens))], names=["__key", "__row", "start", "length", "ids_crc32", "doc_tokens"]
            )

    kind = docs.schema["__key"].dataType.simpleString()
    return docs.mapInArrow(run, f"__key {kind}, __row long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], length: int) -> list[tuple[int, dict[int, int]]]:
    """Shortest pack first: (packs, {piece length: pieces of it in a pack}), lengths in order of their place."""
    groups: dict[int, list[tuple[int, tuple | None]]] = {}  # ids in a pack -> groups of equal packs
    used: list[int] = []

    def put(total: int, count: int, chain: tuple) -> None:
        if total not in groups:
            groups[total] = []
            insort(used, total)
        groups[total].append((count, chain))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not used or used[0] + size > length:
                put(size, left, (None, size))
                break
            total = used[0]
            count, chain = groups[total].pop()
            moved = min(left, count)
            if moved < count:
                groups[total].append((count - moved, chain))
            if not groups[total]:
                del groups[total]
                used.pop(bisect_left(used, total))
            put(total + size, moved, (chain, size))
            left -= moved
    out = []
    for total in sorted(groups, reverse=True):
        for count, chain in groups[total]:
            sizes = []
            while chain:
                chain, size = chain
                sizes.append(size)
            content: dict[int, int] = {}
            for size in reversed(sizes):
                content[size] = content.get(size, 0) + 1
            out.append((count, content))
    return out


def _places(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Ranks [low, high) of a length: packs, first sequence and first offset of the pattern that owns them."""
    next_rank = dict.fromkeys(histogram, 0)
    sequence, rows = 0, []
    for packs, content in patterns(histogram, length):
        offset = 0
        for size, times in content.items():
            low = next_rank[size]
            next_rank[size] = low + packs * times
            rows.append((size, low, low + packs * times, packs, sequence, offset))
            offset += size * times
        sequence += packs
    return rows


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", *, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: ``key``, ``row``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    ``path`` names a tokenizer file. Null and blank texts are the end id alone. Repeated rows are packed once for
    each row; null keys take part. Which of several pieces of one length goes where follows row hash and start.
    """
    spark = docs.sparkSession
    pieces = common.stored(cut(common.keyed(docs, key, text), path, length, end_id), "pack-pieces")
    total = pieces.count()
    salts = max(128, -(-total // RANKED_ROWS))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("__row", "start", F.lit(3)), F.lit(salts)))
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    offsets = counts.select("length", "salt", before.alias("before"))
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("__row", "start")) - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    rows = _places(histogram, length)
    # at most two groups of packs per length below `length`, and each holds few distinct lengths: bounded by the sequence length
    places = F.broadcast(spark.createDataFrame(rows, "length long, low long, high long, packs long, sequence long, first long"))
    found = ranked.join(places, "length").where("rank >= low and rank < high")
    nth = F.col("rank") - F.col("low")
    return found.select(
        F.col("__key").alias(key), F.col("__row").alias("row"), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.pmod(nth, F.col("packs"))).alias("sequence_id"),
        (F.col("first") + F.expr("(rank - low) div packs") * F.col("length")).alias("offset"),
    )
