"""Near-duplicate texts: one-permutation MinHash with optimal densification, banded buckets, star edges.

A text's set holds its distinct shingles of words. One hash per shingle gives all bins of the signature: the
leading bits name the bin, the smallest value in a bin is its minimum. An empty bin takes the value of a full
one that a hash of (bin, attempt) names, the same way for every text.

Equal sets are one class from the start. Classes that share a band meet in a bucket. A bucket is linked as a
star: every member is compared with one centre, the member that shares most bands with others, so pairs are as many
as members, and a large group of near copies mostly falls together at once. Buckets whose members are then in
several components are gone through again, by what each member and the centre differ in: two members of which one
is not linked with the centre can be linked only if they share many of these differences, and then they share one
of their rarest. Members are joined on those, pairs that cannot reach the bound by where they meet are left out,
and the others are counted exactly. So any two members of a bucket were compared, are connected, or cannot be
linked: no link found by the bands is lost, without meeting all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.operators.retrieval import connected_components

U64 = np.uint64
#: Bins of a signature and bins of a band: 32 bands of 4. Two sets of similarity 0.8 share none with probability 5e-8.
BINS, ROWS = 128, 4
#: Standard deviations below the bound at which the estimate of a signature rules a pair out.
SLACK = 6.0


def shingle_sets(part: pa.RecordBatch, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, one text after the other, and where each begins."""
    w = common.words(part.column(text), lower=True)
    h = common.hashes(w.distinct)[w.codes]
    grams = common.ngrams(h, width)
    sets, starts = [], [0]
    for a, b in zip(w.starts[:-1].tolist(), w.starts[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            s = np.unique(grams[a : b - width + 1])
        elif n:
            s = common.ngrams(h[a:b], n) + U64(n)
        else:
            s = np.zeros(0, U64)
        sets.append(s)
        starts.append(starts[-1] + len(s))
    return np.concatenate(sets) if sets else np.zeros(0, U64), np.array(starts)


def signature(s: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Minimum of every bin of a sorted non-empty set; empty bins are densified."""
    shift = U64(64 - int(np.log2(bins)))
    at = (s >> shift).astype(np.int64)
    first = np.concatenate(([True], at[1:] != at[:-1]))
    out = np.zeros(bins, U64)
    full = np.zeros(bins, bool)
    out[at[first]] = common.mix(s[first])
    full[at[first]] = True
    empty = np.flatnonzero(~full)
    attempt = 1
    while len(empty):
        there = (common.mix(empty.astype(U64) * U64(0x10001) + U64(attempt << 20)) % U64(bins)).astype(np.int64)
        got = full[there]
        out[empty[got]] = out[there[got]]
        empty = empty[~got]
        attempt += 1
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for every ``rows`` bins, the band's number included."""
    m = sig.reshape(-1, rows)
    key = np.arange(len(m), dtype=U64) + U64(1)
    for i in range(rows):
        key = common.mix(key * U64(common.BASE) + m[:, i])
    return key


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per row: size and two digests of its set, the low byte of each bin, and the band keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            sets, starts = shingle_sets(part, "__text", width)
            n = np.diff(starts)
            digest = np.zeros((2, len(n)), U64)
            low, keys, ends = [], [], [0]
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                if a < b:
                    s = sets[a:b]
                    sig = signature(s)
                    digest[0, i] = common.mix(s + U64(1)).sum(dtype=U64)
                    digest[1, i] = common.mix(s + U64(2)).sum(dtype=U64)
                    low.append((sig & U64(255)).astype(np.uint8).tobytes())
                    keys.append(band_keys(sig))
                else:
                    low.append(b"")
                ends.append(ends[-1] + (BINS // ROWS if a < b else 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, U64)
            yield common.rows_of(part, ["__key", "__row"], n=pa.array(n), a=common.signed(digest[0]), b=common.signed(digest[1]), low=pa.array(low, pa.binary()), bands=common.list_array(common.signed(flat), np.array(ends)))

    kind = docs.schema["__key"].dataType.simpleString()
    out = docs.mapInArrow(run, f"__key {kind}, __row long, n long, a long, b long, low binary, bands array<long>")
    return out.withColumn("cls", F.when(F.col("n") > 0, F.xxhash64("n", "a", "b")))


def _estimate(pairs: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose signatures agree in too few bins for the bound, given the sizes of the sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = percent / 100
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("low_u", "low_v"))
            same = (x == y).mean(1)
            n = np.minimum(batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy())
            enough = same >= p - SLACK * np.sqrt(p * (1 - p) / np.minimum(n, BINS))
            yield batch.select(["u", "v"]).filter(pa.array(enough))

    return pairs.mapInArrow(run, "u long, v long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full sets of the classes in ``wanted`` (cls, __row), from their texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__text"):
            sets, starts = shingle_sets(part, "__text", width)
            yield common.rows_of(part, ["cls"], members=common.list_array(common.signed(sets), starts))

    one = docs.select("__row", "__text").join(wanted, "__row").select("cls", "__text")
    return one.mapInArrow(run, "cls long, members array<long>").dropDuplicates(["cls"])


def _likely(met: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v) of ``cls`` and ``head`` whose sizes and signatures allow a link."""
    pairs = met.select(F.least("cls", "head").alias("u"), F.greatest("cls", "head").alias("v")).distinct()
    for side in "uv":
        pairs = pairs.join(facts.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col("low").alias(f"low_{side}")), side)
    fits = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent
    return _estimate(pairs.where(fits), percent)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs, counted on full sets."""
    both = pairs.join(sets.select(F.col("cls").alias("u"), F.col("members").alias("x")), "u").join(sets.select(F.col("cls").alias("v"), F.col("members").alias("y")), "v")
    both = both.select("u", "v", F.size(F.array_intersect("x", "y")).alias("s"), (F.size("x") + F.size("y")).alias("t"))
    return both.where(F.col("s") * 100 >= (F.col("t") - F.col("s")) * percent).select(F.col("u").alias("source"), F.col("v").alias("target"))


def _differences(near_head: DataFrame, sets: DataFrame) -> DataFrame:
    """Shingles that only one of a member and its centre has, and the sizes of all three sets."""
    centres = sets.select(F.col("cls").alias("head"), F.col("members").alias("centre"))
    both = near_head.join(centres, "head").join(sets, "cls")
    diff = F.concat(F.array_except("members", "centre"), F.array_except("centre", "members"))
    return both.select("head", "cls", "n", "component", "outside", F.size("centre").alias("n_head"), diff.alias("diff")).withColumn("d", F.size("diff"))


def _open_links(apart: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between members of one centre that are in different components, at least one outside the centre's.

    Two members differ in d_u + d_v - 2D shingles, D being those in both differences, and are linked if that is at
    most r (n_u + n_v), r = (100 - percent) / (100 + percent). A member that is not linked with the centre has
    d > r (n + n_head), so D is at least (d - r (n + n_head)) / (1 + r) for any partner of it, and at least
    d (1 - r) / 2 from the side of any partner. Differences are ordered by how many members have them, rare first:
    two that share D meet in the first d - D + 1 of both, which mostly nobody else has. Where they first meet
    bounds D once more; what is left is counted exactly. Returns candidate pairs and links.
    """
    r = (100 - percent) / (100 + percent)
    each = apart.select("head", "cls", "component", "outside", "n", "n_head", "d", F.explode("diff").alias("m"))
    held = each.groupBy("head", "m").agg(F.count(F.lit(1)).alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("outside").alias("some"))
    held = common.stored(held.select("head", "m", "c", ((F.col("lo") != F.col("hi")) & F.col("some")).alias("open")), "near-held")
    place = F.row_number().over(Window.partitionBy("head", "cls").orderBy("c", "m"))
    ahead = F.when(F.col("outside"), (F.col("d") - r * (F.col("n") + F.col("n_head"))) / (1 + r)).otherwise(F.col("d") * (1 - r) / 2)
    first = F.col("d") - F.greatest(F.ceil(ahead - 1e-9), F.lit(1)) + 1
    prefix = each.join(held, ["head", "m"]).withColumn("at", place).where((F.col("at") <= first) & F.col("open"))
    prefix = common.stored(prefix.select("head", "m", "cls", "component", "outside", "n", "d", "at"), "near-prefixes")
    u, v = (prefix.select("head", "m", *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "component", "outside", "n", "d", "at"))) for x in "uv")
    most = r * (F.col("n_u") + F.col("n_v"))
    shared = 1 + F.least(F.col("d_u") - F.col("at_u"), F.col("d_v") - F.col("at_v"))
    can = (F.col("component_u") != F.col("component_v")) & (F.col("d_u") + F.col("d_v") - 2 * shared <= most + 1e-9)
    once = ~F.col("outside_v") | (F.col("cls_u") < F.col("cls_v"))
    met = u.where("outside_u").join(v, ["head", "m"]).where(can & once)
    met = common.stored(met.select("head", F.col("cls_u").alias("u"), F.col("cls_v").alias("v")).distinct(), "near-rest")
    sides = [apart.select("head", F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("diff").alias(f"diff_{x}")) for x in "uv"]
    both = met.join(sides[0], ["head", "u"]).join(sides[1], ["head", "v"])
    common_ = F.size(F.array_intersect("diff_u", "diff_v"))
    parted = F.size("diff_u") + F.size("diff_v") - 2 * common_
    both = both.select("u", "v", (F.col("n_u") + F.col("n_v")).alias("t"), parted.alias("parted"))
    linked = both.where((F.col("t") - F.col("parted")) * 100 >= (F.col("t") + F.col("parted")) * percent)
    # a member that a signature kept from its centre, if there is any
    missed = apart.where(F.col("outside") & ((F.col("n") + F.col("n_head") - F.col("d")) * 100 >= (F.col("n") + F.col("n_head") + F.col("d")) * percent))
    links = linked.select(F.col("u").alias("source"), F.col("v").alias("target")).unionByName(missed.select(F.col("cls").alias("source"), F.col("head").alias("target")))
    return met, links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``key``, ``row``, ``n_shingles``, ``component_id``, ``kept``, ``group``.

    Texts are linked if 100 * shared shingles >= percent * shingles of both; shared ones are counted on the
    full sets. ``component_id`` is the smallest key reachable over links, itself included. Words are lower-cased
    in A-Z. A text with fewer words than ``width`` has its whole sequence as the one shingle. Null and blank
    texts have no shingles, link with nothing and name their own key. Rows repeated as they are share a
    component. A null key takes part; it is named as a component only if a component has no other key.
    ``group`` numbers the components, whatever their keys; it is null for texts without shingles.
    """
    rows = common.keyed(docs, key, text)
    sig = common.stored(signatures(rows, width), "near-signatures")
    classes = sig.where("cls is not null").groupBy("cls").agg(F.min("__key").alias("low_key"), F.min("__row").alias("__row"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("bands").alias("bands"))
    classes = common.stored(classes, "near-classes")
    facts = classes.select("cls", "n", "low")
    banded = classes.select("cls", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = common.stored(banded.join(crowded, "band"), "near-buckets")
    weight = members.groupBy("cls").agg(F.sum("c").alias("weight"))

    # every member with its bucket's centre
    weighed = common.stored(members.select("band", "cls").join(weight, "cls"), "near-members")
    heads = weighed.groupBy("band").agg(F.max(F.struct("weight", "cls")).alias("h")).select("band", F.col("h.cls").alias("head"))
    met = members.select("band", "cls").join(heads, "band").where("cls <> head")
    star = common.stored(_likely(met, facts, percent), "near-star")
    star_sets = common.stored(_sets(rows, star.select(F.explode(F.array("u", "v")).alias("cls")).distinct().join(classes.select("cls", "__row"), "cls"), width), "near-sets")
    links = common.stored(_confirmed(star, star_sets, percent), "near-links")
    comps = common.stored(connected_components(classes.select("cls"), "cls", links), "near-components")

    # buckets that hold several components
    placed = common.stored(members.select("band", "cls").join(comps, "cls").join(heads.join(comps.select(F.col("cls").alias("head"), F.col("component").alias("main")), "head").select("band", "main"), "band"), "near-placed")
    several = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    left = common.stored(placed.join(several, "band"), "near-open")
    wanted = left.select("cls").distinct().join(star_sets.select("cls"), "cls", "left_anti")
    more_sets = common.stored(_sets(rows, wanted.join(classes.select("cls", "__row"), "cls"), width), "near-more-sets")
    sets = star_sets.unionByName(more_sets)
    # differences from the centre, of members in question
    near_head = left.join(heads, "band").where("cls <> head").join(facts.select("cls", "n"), "cls").select("head", "cls", "n", "component", (F.col("component") != F.col("main")).alias("outside")).distinct()
    apart = common.stored(_differences(near_head, sets), "near-differences")
    rest, more_links = _open_links(apart, percent)
    more_links = common.stored(more_links, "near-more-links")
    final = connected_components(classes.select("cls"), "cls", links.unionByName(more_links))
    common.discard(members, weighed, star, star_sets, links, comps, placed, left, more_sets, apart, rest, more_links)
    whole = final.join(classes.select("cls", "low_key"), "cls")
    named = whole.join(whole.groupBy("component").agg(F.min("low_key").alias("component_id")), "component").select("cls", "component_id", F.col("component").alias("group"))
    out = sig.select(F.col("__key").alias(key), F.col("__row").alias("row"), F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    component = F.coalesce("component_id", F.col(key))
    return out.select(key, "row", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(key), F.lit(False)).alias("kept"), "group")
