"""Topic clusters of titles: stem sets that overlap enough are linked, and clusters are what links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.retrieval import connected_components
from millrace.session import written

#: Two sets are linked if UP * shared >= DOWN * (sum of sizes): a Jaccard similarity of 0.15 or more.
UP, DOWN = 23, 3
#: Titles of up to so many stems are linked through their subsets of stems.
SHORT = 12


def title_stems(df: DataFrame, key: str, title: str) -> DataFrame:
    """(key, stems): distinct stems of a title in order; a title without any has an empty array."""
    stems = F.array_sort(F.array_distinct(F.transform(X.tokens(title, "topic"), X.stem)))
    return df.select(F.col(key).alias("key"), F.coalesce(stems, F.array().cast("array<string>")).alias("stems"))


def _by_parts(sets: DataFrame) -> DataFrame:
    """Links among short titles, through the subsets that two of them share.

    Sets that share m stems share a subset of m stems, and may be linked through it if their sizes sum to
    UP * m / DOWN at most. Below each subset, every member is linked to the smallest one, where that sum allows it: two
    members that allow each other both allow the smallest, so the star connects all that pairs would.
    """
    most = -(-DOWN * 2 * SHORT // UP)
    start = F.array(F.array().cast("array<string>"))
    grown = F.aggregate("stems", start, lambda acc, s: F.concat(acc, F.transform(F.filter(acc, lambda x: F.size(x) < most), lambda x: F.array_append(x, s))))
    parts = sets.where(F.col("n") <= SHORT).select("id", "n", F.explode(grown).alias("part")).where(F.size("part") > 0)
    parts = parts.select("id", "n", F.size("part").alias("m"), F.concat_ws(" ", "part").alias("part"))
    first = parts.groupBy("part").agg(F.min(F.struct("n", "id")).alias("s"))
    met = parts.join(first, "part").where(F.col("id") != F.col("s.id"))
    return met.where((F.col("n") + F.col("s.n")) * DOWN <= F.col("m") * UP).select(F.col("id").alias("source"), F.col("s.id").alias("target")).distinct()


def prefixes(sets: DataFrame) -> DataFrame:
    """(stem, id, n, at, long): the stems by which a title can meet a long one, rare stems first.

    A title must share at least DOWN * n / (UP - DOWN) of its stems with any linked one, and DOWN * (n + m) / UP with one
    of m, so two linked titles meet in the first n - shared + 1 stems of both, in the order of rarity.
    """
    each = sets.select("id", "n", F.explode("stems").alias("stem"))
    rarity = each.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
    at = F.row_number().over(Window.partitionBy("id").orderBy("df", "stem"))
    long = F.col("n") > SHORT
    least = F.greatest(F.ceil(F.col("n") * DOWN / F.lit(UP - DOWN)), F.when(~long, F.ceil((F.col("n") + SHORT + 1) * DOWN / F.lit(UP))).otherwise(0))
    return each.join(rarity, "stem").withColumn("at", at).where(F.col("at") <= F.col("n") - least + 1).select("stem", "id", "n", "at", long.alias("long"))


def _candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of a long title and another that size and place of their first common stem allow to be linked."""
    a, b = (x.select("stem", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "at", "long"))) for x, side in ((a, "a"), (b, "b")))
    shared = F.least(1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")), F.col("n_a"), F.col("n_b"))
    met = a.where("long_a").join(b, "stem").where((F.col("id_a") != F.col("id_b")) & (shared * UP >= (F.col("n_a") + F.col("n_b")) * DOWN))
    return met.select(F.least("id_a", "id_b").alias("u"), F.greatest("id_a", "id_b").alias("v")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs
    for side in "uv":
        both = both.join(sets.select(F.col("id").alias(side), F.col("stems").alias(f"s_{side}")), side)
    shared = F.size(F.array_intersect("s_u", "s_v"))
    return both.where(shared * UP >= (F.size("s_u") + F.size("s_v")) * DOWN).select(F.col("u").alias("source"), F.col("v").alias("target"))


def topic_clusters(titles: DataFrame) -> DataFrame:
    """(key, cluster): the smallest key that is reached over linked titles; titles without stems stand alone.

    Short titles are linked through common subsets, without pairs. Titles of more than ``SHORT`` stems meet others by
    their rare stems: first all below a stem with the smallest long title there, as a star; then those that are
    still in different components, as pairs that size and place allow. All of these are counted exactly.
    """
    sets = titles.where(F.size("stems") > 0).groupBy("stems").agg(F.min("key").alias("id")).withColumn("n", F.size("stems"))
    sets = written(sets, "topic-sets")
    links = _by_parts(sets)
    if sets.where(F.col("n") > SHORT).limit(1).count():
        first = written(prefixes(sets), "topic-prefixes")
        centre = first.where("long").groupBy("stem").agg(F.min(F.struct("n", "id", "at")).alias("c")).select("stem", "c.id", "c.n", "c.at", F.lit(True).alias("long"))
        links = written(links.unionByName(_confirmed(_candidates(centre, first), sets)), "topic-links")
        placed = connected_components(sets.select("id"), "id", links)
        open_ = first.join(placed, "id")
        several = open_.groupBy("stem").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("stem")
        open_ = open_.join(several, "stem")
        pairs = _candidates(open_, open_)
        for side in "uv":
            pairs = pairs.join(placed.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}")), side)
        links = links.unionByName(_confirmed(pairs.where("c_u <> c_v").select("u", "v"), sets))
    found = connected_components(sets.select("id"), "id", links).join(sets.select("id", "stems"), "id")
    out = titles.join(found.select("stems", "component"), "stems", "left")
    return out.select("key", F.coalesce("component", "key").alias("cluster"))
