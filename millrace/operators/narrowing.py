"""Exact selection by narrowing: values at given ranks, cuts of an order, and the largest gap of two distributions.

A sketch of each key gives two bounding values for every wanted rank. One pass counts the rows between the
brackets and the distinct values inside them; only those few values are kept, as a small table. Brackets that still
hold many values are cut into cells, counted again on that table, and all cells without a wanted rank leave.
What is sorted in the end is bounded by ``most`` values a bracket, whatever the rows of a key or how close
together its values lie. The data is read twice, for any number of ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import null_safe_join
from millrace.session import written

#: A sketch is off by at most one rank in so many; cells of a bracket; values sorted together.
ACCURACY, CELLS, MOST = 10_000, 128, 1 << 16

#: Where a rank lies: the share of the rows before it, about, and the rank from 0 as a function of their number.
Spot = tuple[float, Callable[[Column], Column]]


def _counted(base: DataFrame, keys: Sequence[str], shares: Sequence[float], accuracy: int) -> DataFrame:
    """Rows by key, bracket and value; ``__v`` is null for what lies behind a bracket. ``__s`` orders the brackets."""
    slack = 3 / accuracy
    grid = [b for p in shares for b in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", grid, accuracy).alias("__q"))
    rows = null_safe_join(base, sketch, list(keys))
    small = F.col("__n") <= accuracy
    place = sum(((F.col("__v") >= F.get("__q", F.lit(2 * i))).cast("int") for i in range(len(shares))), F.lit(-1))
    rows = rows.withColumn("__s", F.when(small, 0).otherwise(place).cast("long"))
    inside = small | (F.col("__v") <= F.get("__q", (2 * F.col("__s") + 1).cast("int")))
    rows = rows.withColumn("__v", F.when(inside, F.col("__v")))
    return rows.groupBy(*keys, "__s", "__v").agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))


def _pieces(values: DataFrame, keys: Sequence[str], ranks: DataFrame | None, wanted: Column | None) -> DataFrame:
    """Brackets and what lies between, with the rows before each and the wanted ranks that it holds."""
    out = values.groupBy(*keys, "__s", F.col("__v").isNull().alias("__gap")).agg(F.sum("__c").alias("__rows"), F.count(F.lit(1)).alias("__kinds"), F.first("__n").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__s", "__gap").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    out = null_safe_join(out, ranks, list(keys)) if ranks is not None else out.withColumn("__ranks", wanted)
    held = F.filter(F.array_distinct("__ranks"), lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__rows")))
    return out.withColumn("__held", held).where(F.size("__held") > 0)


def _cells(values: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The same for brackets cut into cells, kept where a cell holds a wanted rank."""
    at = [*keys, "__s"]
    cuts = values.groupBy(*at).agg(F.percentile_approx("__v", [i / CELLS for i in range(1, CELLS)], 10 * CELLS).alias("__cuts"))
    cell = _reached("__cuts", "__v", CELLS - 1)
    cut = null_safe_join(values, cuts, at).withColumn("__s", F.col("__s") * CELLS + cell).drop("__cuts")
    totals = cut.groupBy(*at).agg(F.sum("__c").alias("__rows"), F.count(F.lit(1)).alias("__kinds"))
    totals = totals.withColumn("__old", F.floor(F.col("__s") / CELLS))
    above = pieces.select(*keys, F.col("__s").alias("__old"), "__before", "__ranks", "__held", "__n")
    totals = null_safe_join(totals, above, [*keys, "__old"])
    earlier = Window.partitionBy(*keys, "__old").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.col("__before") + F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    held = F.filter("__held", lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__rows")))
    kept = written(totals.withColumn("__held", held).where(F.size("__held") > 0).drop("__old"), "narrow-cells")
    return written(null_safe_join(cut, kept.select(*at, F.lit(1).alias("__keep")), at).drop("__keep"), "narrow-values"), kept


def values_at(df: DataFrame, keys: Sequence[str], value: str, spots: Mapping[str, Spot], *, accuracy: int = ACCURACY, most: int = MOST) -> DataFrame:
    """The values at some ranks of each key: one row per key, ``n``, and per spot a struct ``value``, ``before``, ``same``.

    Null values are no rows. ``before`` counts the rows with smaller values, ``same`` those with this value.
    Keys may be null. A rank below 0 or beyond the last row gives null.
    """
    base = df.select(*keys, F.col(value).alias("__v")).where("__v IS NOT NULL")
    wanted = F.array(*[rank(F.col("__n")).cast("long") for _, rank in spots.values()])
    shares = sorted({p for p, _ in spots.values()})
    values = written(_counted(base, keys, shares, accuracy), "narrow-values")
    pieces = _pieces(values, keys, None, wanted)
    state = pieces.agg(F.max(F.when(~F.col("__gap"), F.col("__kinds"))).alias("widest"), F.count_if("__gap").alias("missed")).first()
    if state["missed"]:  # a sketch beyond its bound: wider brackets
        return values_at(df, keys, value, spots, accuracy=max(accuracy // 10, 1), most=most)
    return _opened(values, pieces, keys, list(spots), state["widest"] or 0, most)


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, names: Sequence[str], *, most: int = MOST) -> DataFrame:
    """The same for ranks that a table gives: ``ranks`` has the keys and an array ``__ranks``, one entry per name."""
    base = df.select(*keys, F.col(value).alias("__v")).where("__v IS NOT NULL")
    counted = base.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c")).withColumn("__s", F.lit(0).cast("long")).withColumn("__n", F.lit(None).cast("long"))
    values = written(counted, "narrow-values")
    pieces = written(_pieces(values, keys, ranks, None), "narrow-pieces")
    return _opened(values, pieces, keys, names, pieces.agg(F.max("__kinds")).first()[0] or 0, most)


def _opened(values: DataFrame, pieces: DataFrame, keys: Sequence[str], names: Sequence[str], widest: int, most: int) -> DataFrame:
    while widest > most:
        values, pieces = _cells(null_safe_join(values.where("__v IS NOT NULL"), pieces.select(*keys, "__s", F.lit(1).alias("__keep")), [*keys, "__s"]).drop("__keep"), pieces, keys)
        narrower = pieces.agg(F.max("__kinds")).first()[0] or 0
        if narrower >= widest:
            break
        widest = narrower
    inner = Window.partitionBy(*keys, "__s").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    hits = null_safe_join(values.where("__v IS NOT NULL").drop("__n"), pieces.select(*keys, "__s", "__before", "__ranks", "__held", "__n"), [*keys, "__s"])
    hits = hits.withColumn("__from", F.col("__before") + F.coalesce(F.sum("__c").over(inner), F.lit(0)))
    hits = hits.where(F.exists("__held", lambda r: (r >= F.col("__from")) & (r < F.col("__from") + F.col("__c"))))
    found = F.struct(F.col("__v").alias("value"), F.col("__from").alias("before"), F.col("__c").alias("same"))
    here = lambda i: (F.get("__ranks", F.lit(i)) >= F.col("__from")) & (F.get("__ranks", F.lit(i)) < F.col("__from") + F.col("__c"))
    return hits.groupBy(*keys).agg(F.max("__n").alias("n"), *[F.max(F.when(here(i), found)).alias(name) for i, name in enumerate(names)])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float | tuple[float, str]], *, method: str = "linear", accuracy: int = ACCURACY, most: int = MOST) -> DataFrame:
    """Exact order statistics by key: one column per entry of ``probs``, plus ``n``.

    ``linear`` interpolates at (n-1)p; ``index`` takes the sorted element at floor(n*p), bounded by n-1. An entry may
    name its own method as (p, method), so all quantiles of a column share the two passes.
    """
    asked = {name: p if isinstance(p, tuple) else (p, method) for name, p in probs.items()}

    def at(p: float, how: str) -> Callable[[Column], Column]:
        return (lambda n: F.least(F.floor(n * F.lit(float(p))), n - 1)) if how == "index" else (lambda n: (n - 1) * F.lit(float(p)))

    spots: dict[str, Spot] = {}
    for name, (p, how) in asked.items():
        spots[f"__{name}_lo"] = p, lambda n, f=at(p, how): F.floor(f(n))
        if how != "index":
            spots[f"__{name}_hi"] = p, lambda n, f=at(p, how): F.ceil(f(n))
    rows = df.select(*keys, F.col(value).cast("double").alias(value))
    out = values_at(rows, keys, value, spots, accuracy=accuracy, most=most)
    cols = []
    for name, (p, how) in asked.items():
        low = F.col(f"__{name}_lo.value")
        if how != "index":
            spot = at(p, how)(F.col("n"))
            low = low + (F.col(f"__{name}_hi.value") - low) * (spot - F.floor(spot))
        cols.append(low.alias(name))
    return out.select(*keys, F.col("n").cast("long").alias("n"), *cols)


def cut_by_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, starts: Sequence[Spot], out: str, *, descending: bool = False, most: int = MOST) -> DataFrame:
    """``df`` with ``out``: the number of ``starts`` whose rank a row has reached in the order of (value, tie).

    The rows at those ranks are selected, first by value and among equal values by the tie, and a row is
    labelled by comparing it with them, so no row gets a rank of its own. Ties of the tie share a label. Rows with
    a null value have a null label. A start at a rank beyond the last row is reached by none.
    """
    names = [f"__c{i}" for i in range(len(starts))]
    signed = df.withColumn("__o", -F.col(value) if descending else F.col(value))
    cuts = written(values_at(signed, keys, "__o", dict(zip(names, starts, strict=True)), most=most), "narrow-cuts")
    rank = {name: spot[1](F.col("n")).cast("long") for name, spot in zip(names, starts, strict=True)}
    inside = [F.struct(F.lit(i).alias("at"), F.col(f"{c}.value").alias("__o"), (rank[c] - F.col(f"{c}.before")).alias("rank")) for i, c in enumerate(names)]
    # a start inside a run of equal values is placed by the tie
    split = cuts.select(*keys, F.inline(F.filter(F.array(*inside), lambda s: s["__o"].isNotNull() & (s["rank"] > 0))))
    by_value = split.groupBy(*keys, "__o").agg(F.array(*[F.coalesce(F.max(F.when(F.col("at") == i, F.col("rank"))), F.lit(-1)).cast("long") for i in range(len(names))]).alias("__ranks"))
    by_value = written(by_value, "narrow-ties")
    tied = null_safe_join(signed.select(*keys, "__o", tie), by_value.select(*keys, "__o"), [*keys, "__o"])
    ties = values_at_ranks(tied, [*keys, "__o"], tie, by_value, names, most=most)
    ties = ties.groupBy(*keys).agg(*[F.max(f"{c}.value").alias(f"{c}t") for c in names])
    bounds = null_safe_join(cuts.select(*keys, *[F.col(f"{c}.value").alias(f"{c}v") for c in names]), ties, list(keys), "left") if keys else _beside(cuts.select(*[F.col(f"{c}.value").alias(f"{c}v") for c in names]), ties)
    rows = null_safe_join(signed, bounds, list(keys), "left") if keys else _beside(signed, bounds)
    reached = [F.coalesce((F.col("__o") > F.col(f"{c}v")) | ((F.col("__o") == F.col(f"{c}v")) & (F.col(f"{c}t").isNull() | (F.col(tie) >= F.col(f"{c}t")))), F.lit(False)).cast("int") for c in names]
    label = F.when(F.col("__o").isNotNull(), sum(reached[1:], reached[0]))
    return rows.select(*df.columns, label.alias(out))


def _beside(left: DataFrame, one: DataFrame) -> DataFrame:
    """Every row of ``left`` next to the only row of ``one``."""
    return left.join(F.broadcast(one), F.lit(True), "left")


def largest_gap(a: DataFrame, b: DataFrame, value: str, *, cells: int = 1000) -> DataFrame:
    """``gap``, ``na``, ``nb``: the largest distance of two cumulative shares, by cells that can hold it.

    A sketch cuts both into cells. From the counts at the borders of a cell follows how far the shares can part
    inside; only cells that may beat the largest gap at any border are opened and summed value by value. Without
    rows on one side the gap is null.
    """
    x = a.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    y = b.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = x.unionByName(y).where("v IS NOT NULL")
    sketch = written(both.agg(F.percentile_approx("v", [i / cells for i in range(1, cells)], 10 * cells).alias("q")), "gap-sketch")
    placed = _beside(both, sketch).withColumn("cell", _reached("q", "v", cells - 1)).drop("q")
    counts = placed.groupBy("cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    edges = counts.select("cell", F.sum("a").over(upto).alias("a1"), F.sum("b").over(upto).alias("b1"), "a", "b", F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"))
    fa, fb = (lambda c: F.try_divide(c, F.col("na"))), (lambda c: F.try_divide(c, F.col("nb")))
    end = F.abs(fa(F.col("a1")) - fb(F.col("b1")))
    reach = F.greatest(fa(F.col("a1")) - fb(F.col("b1") - F.col("b")), fb(F.col("b1")) - fa(F.col("a1") - F.col("a")))
    edges = written(edges.withColumn("end", end).withColumn("reach", reach).withColumn("best", F.max("end").over(whole)), "gap-cells")
    open_ = edges.where("reach > best").select("cell", (F.col("a1") - F.col("a")).alias("a0"), (F.col("b1") - F.col("b")).alias("b0"), "na", "nb")
    inner = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = placed.join(F.broadcast(open_.select("cell")), "cell").groupBy("cell", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    steps = values.join(open_, "cell").select(F.abs(fa(F.col("a0") + F.sum("a").over(inner)) - fb(F.col("b0") + F.sum("b").over(inner))).alias("gap"))
    known = edges.agg(F.max("best").alias("gap"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return _beside(known, steps.agg(F.max("gap").alias("inside"))).select(F.greatest("gap", "inside").alias("gap"), "na", "nb")


def _reached(bounds: str, value: str, size: int) -> Column:
    """How many of ``size`` sorted bounds are at most ``value``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(size.bit_length() - 1, -1, -1)])
    ahead = lambda at, step: F.coalesce(F.get(bounds, at + step - 1) <= F.col(value), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(ahead(at, step), step).otherwise(0))
