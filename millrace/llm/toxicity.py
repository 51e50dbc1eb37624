"""Toxicity behind disguises: a noisy channel restores words, and restored texts are scored.

A word with look-alike signs, repeated letters or parts set apart is a lattice: every sign may stand
for itself or the letters it looks like, a run of one letter for one or two of it, signs between letters for
nothing, a space between short words for nothing or for the end of a word. Viterbi search under a letter model with three letters of memory, learned from plain words of the
labelled texts, picks the restored word. Words without such signs have one path, themselves, so only the others are
searched. The score is that of a word model learned from all labelled texts: evidence of the distinct restored words
and of their beginnings.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

# Letters that a sign may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
EDGE = "^"
#: Signs between the letters of a word that stand for nothing.
FILLERS = "._-*~'`^,:;/\\"
_PLAIN = re.compile(r"[^\W\d_]+")
#: Letters that stand alone, or a run of one sign.
_RUNS = re.compile(r"(?:([^\W\d_])(?!\1))+|(.)\2*", re.DOTALL)
_RUN = re.compile(r"(.)\1*", re.DOTALL)
_TRIM = " \t.,;:!?\"'()[]{}<>#%&*|~`^/\\-_=+"
#: Of these, the signs that look like no letter.
_OUTSIDE = "".join(c for c in _TRIM if c not in LOOKALIKES)


@dataclass
class Letters:
    """Smoothed log probability of a letter after the three before it; letters outside the learned texts share one cell."""

    table: dict[str, float] = field(default_factory=dict)
    floor: dict[str, float] = field(default_factory=dict)
    least: float = -8.0

    @classmethod
    def of(cls, counts: dict[str, int]) -> Letters:
        """From counts of four letters in a row."""
        total: dict[str, float] = {}
        for g, n in counts.items():
            total[g[:3]] = total.get(g[:3], 0) + n
        return cls({g: math.log((n + 0.01) / (total[g[:3]] + 0.5)) for g, n in counts.items()}, {c: math.log(0.01 / (n + 0.5)) for c, n in total.items()})

    def step(self, context: str, letter: str) -> float:
        got = self.table.get(context + letter)
        return got if got is not None else self.floor.get(context, self.least)


@lru_cache(1 << 16)
def _readings(sign: str, n: int) -> list[str]:
    letters = LOOKALIKES.get(sign, "")
    if sign.isalpha():
        found = [sign * n] if n <= 2 else [sign, sign * 2]
        if n == 2:
            found.append(sign)
    else:
        found = [sign * n, *(x * k for x in letters for k in {1, min(n, 2)})]
        if sign in FILLERS or (sign in LOOKALIKES and not letters):
            found.append("")
    return found


def _options(word: str) -> list[list[str]]:
    """For each run of one sign: what it may stand for, costs aside. Letters in a row that stand alone are one part."""
    out = []
    for run in _RUNS.finditer(word):
        if run[1] and run[0].isalpha():
            out.append([run[0]])
        else:
            out.extend(_readings(r[1], len(r[0])) for r in _RUN.finditer(run[0]))
    return out


#: Cost and choices so far of the best path to each three last letters.
States = dict[str, tuple[float, tuple | None]]


def _read(states: States, options: list[str], letters: Letters, keep: float = 1.0, change: float = 1.5) -> States:
    now: States = {}
    table, floor, least = letters.table.get, letters.floor.get, letters.least
    first = options[0]
    costs = [(x, 1.0 if 0 < len(x) < len(first) == 2 else 0.0, 0.0 if x and x == first and x[0].isalpha() else change if x != first else keep) for x in options]
    for context, (cost, chain) in states.items():
        for option, shorter, sign in costs:
            c, k = cost, context
            for letter in option:
                group = k + letter
                got = table(group)
                c += got if got is not None else floor(k, least)
                k = group[1:]
            c -= shorter
            c -= sign
            best = now.get(k)
            if best is None or c > best[0]:
                now[k] = (c, (chain, option))
    return now


def _best(states: States, letters: Letters) -> str:
    chain = max(states.items(), key=lambda s: s[1][0] + letters.step(s[0], EDGE))[1][1]
    out = []
    while chain:
        chain, option = chain
        out.append(option)
    return "".join(reversed(out))


def restore(word: str, letters: Letters, keep: float = 1.0, change: float = 1.5) -> str:
    """Most likely plain word behind ``word``: Viterbi over its lattice, state being the last three letters.

    A sign kept though it is no letter costs ``keep`` at least, and each replaced sign ``change``; of equal paths the
    first counts, in the order of options. Paths are chains, so a long word costs no more for each sign than a short one.
    """
    states: States = {EDGE * 3: (0.0, None)}
    for options in _options(word):
        states = _read(states, options, letters, keep, change)
    return _best(states, letters)


_DISGUISED = re.compile(r"[^\W\d_].*[^\w\s].*[^\W\d_]|[^\W_]*\d|[@$€£!|+(]|([^\W\d_])\1|(.)\2\2", re.DOTALL)
_DOUBLED = re.compile(r"([^\W\d_])\1")
#: Rows of words of at most so many signs are read as one lattice; longer parts are joined with their neighbours.
PART = 4
#: Log probability of a word's end below which a word is rather a part.
PART_END = math.log(0.02)
#: In a path, a space that stands for nothing, and one that ends a word.
JOINED, APART = "\0", " "
#: Bytes of text that are read together.
SLICE = 8 << 20


def restored_word(word: str, letters: Letters, worth: Callable[[str], bool] | None = None) -> tuple[str, ...]:
    """Plain words behind one lower-cased word: itself or its plain parts, and what it disguises.

    Signs that look like letters are read both ways also at the edges of a word, and so are doubled letters. ``worth``
    may say of a word of letters alone that no reading of its doubled letters is of use.
    """
    if word.isalpha() and not _DOUBLED.search(word):
        return (word,)
    core, whole = word.strip(_TRIM), word.strip(_OUTSIDE)
    if whole == core and core.isalpha() and (not _DOUBLED.search(core) or worth is not None and not worth(core)):
        return (core,)
    found = set(_PLAIN.findall(core))
    if whole and _DISGUISED.search(whole):
        found.update(_PLAIN.findall(restore(whole, letters)))
    return tuple(sorted(found))


def is_part(word: str, letters: Letters) -> bool:
    """Whether a word seldom ends where it does, so that a neighbour may carry on with it."""
    end = word[-3:] if len(word) > 2 else (EDGE * 3 + word)[-3:]
    return letters.step(end, EDGE) < PART_END and (word.isalpha() or any(c.isalpha() for c in word))


def joined_words(parts: Iterable[str], letters: Letters, cost: float = 1.0) -> tuple[str, ...]:
    """Words of two parts or more behind short words in a row: each space stands for nothing, at ``cost``, or ends a
    word, and Viterbi search over the lattices of all parts places the ends."""
    states: States = {EDGE * 3: (0.0, None)}
    last = ""
    for part in parts:
        if last:
            now = {k: (c - cost, (chain, JOINED)) for k, (c, chain) in states.items()}
            ends = max(((c + letters.step(k, EDGE), chain) for k, (c, chain) in states.items()), key=lambda s: s[0])
            states = {**now, EDGE * 3: (ends[0], (ends[1], APART))}
        for options in _options(part):
            again = part == last and len(part) == 1 and part.isalpha()
            states = _read(states, [*options, ""] if again else options, letters)
        last = part
    words = (w for w in _best(states, letters).split(APART) if JOINED in w)
    return tuple(sorted({x for w in words for x in _PLAIN.findall(w.replace(JOINED, ""))}))


def runs_of_parts(short: np.ndarray, part: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of two or more short words in a row in one text, a part among them."""
    if not len(short):
        return []
    new = np.ones(len(short), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (short[1:] != short[:-1])
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(short))
    good = short[first] & (stop - first > 1) & (np.add.reduceat(part.astype(np.int64), first) > 0)
    return list(zip(first[good].tolist(), stop[good].tolist(), strict=True))


class Pairs(NamedTuple):
    """Restored words of texts: text ``owner[i]`` has ``words[number[i]]``; ascending, each pair once."""

    owner: np.ndarray
    number: np.ndarray
    words: list[str]


def taken(lists: list[list[int]], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists that ``codes`` name, one after the other, and for each value its place in ``codes``."""
    size = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    flat = np.fromiter((v for x in lists for v in x), np.int64, int(size.sum()))
    count = size[codes]
    at = np.repeat(np.arange(len(codes)), count)
    return at, flat[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat((np.cumsum(size) - size)[codes], count)]


class Reader:
    """Restored words of whole texts, slice by slice; what a word restores to is kept between slices."""

    def __init__(self, letters: Letters, keep: int = 200_000, worth: Callable[[str], bool] | None = None):
        self.letters, self.keep, self.worth = letters, keep, worth
        self.known: dict[str, tuple[str, ...]] = {}
        self.runs: dict[tuple[str, ...], tuple[str, ...]] = {}
        self.pairs: dict[tuple[str, ...], tuple[str, ...]] = {}

    def of(self, word: str) -> tuple[str, ...]:
        got = self.known.get(word)
        if got is None:
            got = restored_word(word, self.letters, self.worth)
            if len(self.known) < self.keep:
                self.known[word] = got
        return got

    def joined(self, parts: tuple[str, ...]) -> tuple[str, ...]:
        got = self.runs.get(parts)
        if got is None:
            got = joined_words(parts, self.letters)
            if len(self.runs) < self.keep:
                self.runs[parts] = got
        return got

    def across(self, words: tuple[str, ...], whole: Callable[[str], bool]) -> tuple[str, ...]:
        """Words that ``whole`` knows and that neighbours of any length give together, whatever each of them disguises."""
        got = self.pairs.get(words)
        if got is None:
            joined = [""]
            for w in words:
                plain = {*self.of(w), "".join(_PLAIN.findall(w))}
                joined = [a + b for a in joined for b in sorted(plain)]
            got = tuple(sorted({x for x in joined if whole(x)}))
            if len(self.pairs) < self.keep:
                self.pairs[words] = got
        return got

    def words_of(self, w: common.Words, distinct: list[str], inner: list[str], wanted=None) -> Pairs:
        """The restored words of the texts that ``w`` splits into ``distinct`` words, which are ``inner`` without signs
        around them. With ``wanted``, only words that it accepts."""
        owner = w.owners()
        number: dict[str, int] = {}
        known = self.known
        found = [[number.setdefault(x, len(number)) for x in known.get(word) or self.of(word) if wanted is None or wanted(x)] for word in distinct]
        owners, numbers = [], []
        once = common.distinct(owner * max(len(distinct), 1) + w.codes)
        at, inside = taken(found, once % max(len(distinct), 1))
        owners.append((once // max(len(distinct), 1))[at])
        numbers.append(inside)
        short = np.fromiter((0 < len(x) <= PART for x in inner), bool, len(inner))
        part = np.fromiter((s and is_part(x, self.letters) for s, x in zip(short, inner, strict=True)), bool, len(inner))
        for a, b in runs_of_parts(short[w.codes], part[w.codes], owner):
            more = [number.setdefault(x, len(number)) for x in self.joined(tuple(inner[c] for c in w.codes[a:b])) if wanted is None or wanted(x)]
            owners.append(np.full(len(more), owner[a]))
            numbers.append(np.array(more, np.int64))
        pair = common.distinct(np.concatenate(owners) * max(len(number), 1) + np.concatenate(numbers))
        return Pairs(pair // max(len(number), 1), pair % max(len(number), 1), list(number))

    def split(self, text: pa.Array) -> tuple[common.Words, list[str], list[str]]:
        w = common.words(text, lower=True, every=True)
        distinct = common.strings(w.distinct)
        return w, distinct, [x.strip(_OUTSIDE) for x in distinct]

    def read(self, text: pa.Array, wanted=None, whole: Callable[[str], bool] | None = None) -> list[set[str]]:
        """The set of restored words of each text; with ``wanted``, only words that it accepts.

        With ``whole``, a word that seldom ends where it does is also joined with the one or two words behind it, and
        joined words that ``whole`` knows count.
        """
        w, distinct, inner = self.split(text)
        pairs = self.words_of(w, distinct, inner, wanted)
        out: list[set[str]] = [set() for _ in range(len(text))]
        for at, number in zip(pairs.owner.tolist(), pairs.number.tolist(), strict=True):
            out[at].add(pairs.words[number])
        owner = w.owners()
        if whole is None or len(owner) < 2:
            return out
        open_ = np.fromiter((is_part(x, self.letters) for x in inner), bool, len(inner))[w.codes]
        first = open_[:-1] & (owner[1:] == owner[:-1])
        at = np.flatnonzero(first)
        for o, a, b in zip(owner[at].tolist(), w.codes[at].tolist(), w.codes[at + 1].tolist(), strict=True):
            out[o].update(self.across((inner[a], inner[b]), whole))
        at = at[np.append(first, False)[at + 1]]
        for o, a, b, c in zip(owner[at].tolist(), w.codes[at].tolist(), w.codes[at + 1].tolist(), w.codes[at + 2].tolist(), strict=True):
            out[o].update(self.across((inner[a], inner[b], inner[c]), whole))
        return out


#: Beginnings of words that are features too, so that inflected and compound forms count.
BEGINNINGS = (4, 5, 6)


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k)]


def single_letters(word: str) -> str:
    """The word with every run of one letter as one letter; readings of doubled letters have it in common."""
    return re.sub(r"(.)\1+", r"\1", word, flags=re.DOTALL)


@dataclass
class Model:
    letters: Letters
    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.whole = {single_letters(f) for f in self.weights if not f.endswith("*")}
        self.begun = {single_letters(f[:-1]) for f in self.weights if f.endswith("*")}
        self.lengths = sorted({len(f) for f in self.begun})
        self.heads = {f[: min(BEGINNINGS)] for f in self.weights if f.endswith("*")}

    def may_weigh(self, word: str) -> bool:
        """False if no reading of the word's repeated letters has a weight."""
        short = single_letters(word)
        return short in self.whole or any(short[:k] in self.begun for k in self.lengths)

    def weight(self, word: str) -> float:
        if word[: min(BEGINNINGS)] not in self.heads:
            return self.weights.get(word, 0.0)
        return max(self.weights.get(f, 0.0) for f in features_of(word))

    def probability(self, found: set[str]) -> float:
        z = self.bias + sum(self.weight(w) for w in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _plain_counts(texts: Iterable[str | None]) -> dict[str, int]:
    seen: Counter[str] = Counter()
    for t in texts:
        seen.update((t or "").lower().split())
    out: dict[str, int] = {}
    for w, n in seen.items():
        core = w.strip(_TRIM)
        if core.isalpha():
            out[core] = out.get(core, 0) + n
    return out


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of a batch with ``words``: for each word its row and its number in the returned list of distinct words."""
    lists = batch.column("words")
    coded = lists.flatten().dictionary_encode()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), size), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), common.strings(coded.dictionary)


def _texts_by_feature(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``y`` and the ``words`` of texts: for each feature the sum of y and the number of the texts that have it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, code, distinct = _lists(batch)
        number: dict[str, int] = {}
        at, feature = taken([[number.setdefault(f, len(number)) for f in features_of(x)] for x in distinct], code)
        n = max(len(number), 1)
        pair = common.distinct(row[at] * n + feature)
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
        bad = np.bincount(pair % n, weights=y[pair // n], minlength=len(number)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(bad), pa.array(np.bincount(pair % n, minlength=len(number)))], names=["w", "bad", "n"])


def fit(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", *, support: int = 4, most_features: int = 2_000, most_groups: int = 200_000) -> Model:
    """Learn letters and word weights from every labelled row that may be learned from.

    ``train`` says of the column ``k`` which rows these are. Tasks count letters and words of their whole texts;
    the driver gets counts of the ``most_groups`` most frequent groups of four letters, and of words and beginnings of words in ``support`` toxic texts at least, at most
    ``most_features`` of them. A word's weight is its smoothed log odds beyond the texts' own, where that is clearly
    positive and most labelled texts with the word are toxic: texts become toxic by what they hold. Without labels of both kinds every text scores the same.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(train & F.col("y").isNotNull())
    # labels grow with the texts, so the plan is the same at every size
    labelled = common.stored(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(known.hint("merge"), "k").select("t", "y"), "toxic-labelled")

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "t", SLICE):
            seen: dict[str, int] = {}
            for w, n in _plain_counts(part.column("t").to_pylist()).items():
                t = EDGE * 3 + w + EDGE
                for i in range(3, len(t)):
                    g = t[i - 3 : i + 1]
                    seen[g] = seen.get(g, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["g", "n"])

    counted = labelled.select("t").mapInArrow(grams, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(most_groups).collect()
    letters = Letters.of({r["g"]: r["n"] for r in counted})

    def restored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(letters)
        for part in common.slices(batches, "t", SLICE):
            pairs = reader.words_of(*reader.split(part.column("t")))
            starts = np.searchsorted(pairs.owner, np.arange(part.num_rows + 1))
            yield common.rows_of(part, ["y"], words=common.list_array(pa.array(pairs.words, pa.string()).take(pa.array(pairs.number)), starts))

    bags = common.stored(labelled.mapInArrow(restored, "y int, words array<string>"), "toxic-bags")
    common.discard(labelled)
    sizes = {r["y"]: r["n"] for r in bags.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        common.discard(bags)
        return Model(letters, {}, 0.0)
    words = bags.mapInArrow(_texts_by_feature, "w string, bad long, n long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where(F.col("bad") >= support)
    odds = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5)) - math.log(bad / good)
    sure = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5))
    top = words.select("w", odds.alias("o"), sure.alias("z"), ((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("share")).where("o > 2 and z > 3.5 and share >= 0.8").orderBy(F.desc("z"), "w").limit(most_features).collect()
    weights = {r["w"]: float(r["o"]) for r in top}

    def holding(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, distinct = _lists(batch)
            telling = np.fromiter((any(f in weights for f in features_of(x)) for x in distinct), bool, len(distinct))
            held = np.bincount(row[telling[code]], minlength=batch.num_rows) > 0
            yield common.rows_of(batch, ["y"], held=pa.array(held))

    # the bias is what texts without any such word show, and one clear word is enough to pass the middle
    shown = {r["held"]: (r["b"] + 0.5, r["n"] - r["b"] + 0.5) for r in bags.mapInArrow(holding, "y int, held boolean").groupBy("held").agg(F.sum("y").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    common.discard(bags)
    bias, with_word = (math.log(b / g) for b, g in (shown.get(held, (0.5, 0.5)) for held in (False, True)))
    lift = with_word - bias if weights else 0.0
    least = min(weights.values(), default=1.0)
    return Model(letters, {w: max(o, lift * min(1.0, o / max(least, 1e-9))) for w, o in weights.items()}, bias)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``row``, ``score``, ``predicted`` of every row. Null and empty texts have the score of texts without
    any telling word. Repeated rows score alike; null keys stay. Whole texts are read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.letters, worth=model.may_weigh)
        for part in common.slices(batches, "__text", SLICE):
            p = np.array([model.probability(found) for found in reader.read(part.column("__text"), model.weight, model.weights.__contains__)])
            yield common.rows_of(part, ["__key", "__row"], score=pa.array(p, pa.float64()), predicted=pa.array((p >= 0.5).astype(np.int32)))

    df = common.keyed(docs, key, text)
    kind = df.schema["__key"].dataType.simpleString()
    out = df.mapInArrow(run, f"__key {kind}, __row long, score double, predicted int")
    return out.select(F.col("__key").alias(key), F.col("__row").alias("row"), "score", "predicted")
