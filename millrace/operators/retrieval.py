"""Search over a document table, its evaluation, chunking, and the link graph of pages."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import text as X
from millrace.operators.narrowing import exact_quantiles
from millrace.session import checkpoint_folder, written

# ---- postings and ranking ---------------------------------------------------


def postings(docs: DataFrame, key: str, text: str, rule: str = "alnum") -> DataFrame:
    """(document, term, tf, length): term counts inside a document, shuffled by document and term."""
    words = docs.select(F.col(key).alias("doc"), X.tokens(text, rule).alias("w"))
    # the length goes into each element: a column beside the explode would carry the whole array into every row
    rows = words.select("doc", F.inline(F.transform("w", lambda x: F.struct(x.alias("term"), F.size("w").alias("length")))))
    return rows.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def query_terms(queries: DataFrame, key: str, text: str, rule: str = "alnum") -> DataFrame:
    """(query, term, qtf, query length)."""
    return postings(queries, key, text, rule).select(F.col("doc").alias("query"), "term", F.col("tf").alias("qtf"), F.col("length").alias("qlen"))


def _candidates(post: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the query terms only, and the document count of each of those terms."""
    wanted = queries.select("term").distinct()
    hits = post.join(wanted, "term", "left_semi")
    return hits, hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf_scores(post: DataFrame, queries: DataFrame, total: DataFrame, *, true_cosine: bool = False) -> DataFrame:
    """Cosine of tf-idf vectors over the shared terms (one shared term always gives 1).

    With ``true_cosine`` the norms run over all terms of both sides. ``total`` is a one-row table with ``n``.
    """
    hits, df = _candidates(post, queries)
    idf = df.crossJoin(F.broadcast(total)).select("term", F.log(F.col("n") / F.col("df")).alias("idf"))
    q = queries.join(idf, "term").select("query", "term", (F.col("qtf") / F.col("qlen") * F.col("idf")).alias("q"), "idf")
    pairs = q.join(hits.select("doc", "term", (F.col("tf") / F.col("length")).alias("tf")), "term").withColumn("d", F.col("tf") * F.col("idf"))
    agg = pairs.groupBy("query", "doc").agg(F.sum(F.col("q") * F.col("d")).alias("dot"), F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("dn"))
    if true_cosine:
        every = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("term", F.log(F.col("n") / F.col("df")).alias("i"))
        dn = post.join(every, "term").groupBy("doc").agg(F.sqrt(F.sum(F.pow(F.col("tf") / F.col("length") * F.col("i"), F.lit(2)))).alias("dn"))
        qn = q.groupBy("query").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
        agg = agg.drop("qn", "dn").join(dn, "doc").join(qn, "query")
    return agg.withColumn("score", N.safe_divide("dot", F.col("qn") * F.col("dn"))).where("score > 0").select("query", "doc", "score")


def top_k(scores: DataFrame, k: int, places: int = 9) -> DataFrame:
    """The k best documents of every query with their rank; ties by document.

    The rank filter lets Spark keep k rows per query and task before the shuffle.
    """
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", places)), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_fusion(lists: Sequence[DataFrame], c: int = 60) -> DataFrame:
    """Sum of 1 / (c + rank) over result lists."""
    rows = None
    for x in lists:
        part = x.select("query", "doc", (1.0 / (c + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query", "doc").agg(F.sum("s").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return N.safe_divide(dot, norm(a) * norm(b))


#: Vectors of a packed matrix.
MATRIX = 1024


def _packed(df: DataFrame, key: str, vector: str, block: str, name: str) -> DataFrame:
    """Rows of a block in matrices of about ``MATRIX`` vectors, as many as the block's rows need."""
    rows = df.select(F.col(key).alias("id"), F.col(block).alias("b"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("v IS NOT NULL")
    parts = rows.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MATRIX).alias("parts"))
    placed = rows.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return placed.groupBy("b", "part").agg(F.collect_list(F.struct("id", "v")).alias(name)).drop("part")


def vector_topk(vectors: DataFrame, queries: DataFrame, key: str, vector: str, block: str, k: int) -> DataFrame:
    """Nearest vectors by cosine within the query's block; a zero vector is 0 from all others.

    Both sides are packed to matrices of bounded size. Each pair of matrices of a block is one product, of
    which the k best of each query are kept; these few are merged. A hot block has many matrices, so many tasks
    compare it, and no table of pairs is formed. Vectors are of one length.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, asked in zip(batch.column("docs"), batch.column("asked"), strict=True):
                (d, x), (q, y) = (_matrix(side.values) for side in (docs, asked))
                score = y @ x.T
                names = np.array(d.to_pylist(), dtype=object)
                own = np.array(q.to_pylist(), dtype=object)
                score[own[:, None] == names[None, :]] = -np.inf
                place = np.argsort(np.argsort(names, kind="stable"), kind="stable")
                order = np.lexsort((np.broadcast_to(place, score.shape), -np.round(score, 9)), axis=1)[:, :k]
                row = np.repeat(np.arange(len(own)), order.shape[1])
                col = order.ravel()
                kept = score[row, col] > -np.inf
                row, col = row[kept], col[kept]
                yield pa.RecordBatch.from_arrays([q.take(pa.array(row)), d.take(pa.array(col)), pa.array(score[row, col])], names=["query", "doc", "score"])

    met = _packed(vectors, key, vector, block, "docs").join(_packed(queries, key, vector, block, "asked"), "b").select("docs", "asked")
    return top_k(met.mapInArrow(best, f"query {queries.schema[key].dataType.simpleString()}, doc {kind}, score double"), k)


def _matrix(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """Keys and unit vectors of a packed matrix."""
    v = rows.field("v")
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return rows.field("id"), np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


# ---- evaluation -------------------------------------------------------------


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, ks: Sequence[int], *, over_k: bool = False) -> DataFrame:
    """P@k, R@k, NDCG@k and reciprocal rank per query with at least one relevant document.

    P@k is over the returned results, or over k when ``over_k``; the ideal DCG then runs over min(relevant, k).
    """
    # counted and joined: written once, not worked out twice
    truth = written(truth.select("query", "doc"), "truth")
    rel = truth.groupBy("query").agg(F.countDistinct("doc").alias("relevant"))
    hit = ranked.join(truth.select("query", "doc", F.lit(1).alias("hit")).distinct(), ["query", "doc"], "left")
    h = F.coalesce(F.col("hit"), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("returned"), F.coalesce(F.max(F.when(h == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr")]
    for k in ks:
        near = F.col("rank") <= k
        aggs += [F.sum(F.when(near, h).otherwise(0)).alias(f"hits{k}"), F.sum(F.when(near, h / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg{k}")]
    per = rel.join(hit.groupBy("query").agg(*aggs), "query", "left").fillna(0)
    out = [F.col("query"), F.col("relevant"), F.col("returned"), F.col("rr").alias("reciprocal_rank")]
    for k in ks:
        got = F.least(F.col("returned"), F.lit(k))
        ideal_n = F.least(F.col("relevant"), F.lit(k) if over_k else got)
        gains = [sum(1 / math.log2(i + 2) for i in range(n)) for n in range(k + 1)]
        ideal = F.element_at(F.array(*[F.lit(g) for g in gains]), (ideal_n + 1).cast("int"))
        out += [
            N.safe_divide(f"hits{k}", F.lit(float(k)) if over_k else got).alias(f"precision_{k}"), N.safe_divide(f"hits{k}", "relevant").alias(f"recall_{k}"), N.safe_divide(f"dcg{k}", ideal).alias(f"ndcg_{k}"),
        ]
    return per.select(*out)


def retrieval_failures(metrics: DataFrame, queries: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """Poor precision, poor recall and empty results by query length."""
    n = F.size(X.white_words(text))
    size = queries.select(F.col(key).alias("query"), F.when(n <= 3, "short").when(n <= 7, "medium").otherwise("long").alias("length_class"))
    rows = metrics.join(size, "query")
    return rows.groupBy("length_class").agg(
        F.count(F.lit(1)).alias("queries"), F.avg(f"precision_{k}").alias("mean_precision"), F.count_if(F.col(f"precision_{k}") < 0.2).alias("poor_precision"),
        F.count_if(F.col(f"recall_{k}") < 0.3).alias("poor_recall"), F.count_if(F.col("returned") == 0).alias("zero_results"),
    )


def key_terms(words: Column, top: int) -> Column:
    """The most frequent tokens; ties by first place in the text."""
    unique = F.array_distinct(words)
    ranked = F.array_sort(F.transform(unique, lambda w: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), F.array_position(words, w).alias("p"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, top), lambda s: s["w"])


def context_relevance(df: DataFrame, question: str, context: str, keys: Sequence[str]) -> DataFrame:
    """0.6 term cover of the question's key terms + 0.4 Jaccard of all tokens."""
    rows = df.select(*keys, X.tokens(question, "eval").alias("q"), X.tokens(context, "eval").alias("c"))
    qt, ct = key_terms(F.col("q"), 15), key_terms(F.col("c"), 30)
    cover = F.when(F.size(qt) > 0, F.size(F.array_intersect(qt, ct)) / F.size(qt)).otherwise(0.0)
    overlap = X.jaccard(F.array_distinct("q"), F.array_distinct("c"))
    return rows.select(*keys, cover.alias("term_cover"), overlap.alias("token_overlap")).withColumn("relevance", F.col("term_cover") * 0.6 + F.col("token_overlap") * 0.4)


def _lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Longest common subsequence by match lists: work grows with the matches, not with the product of lengths."""
    from bisect import bisect_left

    at: dict[str, list[int]] = {}
    for i, w in enumerate(a):
        at.setdefault(w, []).append(i)
    tails: list[int] = []
    for w in b:
        for i in reversed(at.get(w, ())):
            spot = bisect_left(tails, i)
            if spot == len(tails):
                tails.append(i)
            else:
                tails[spot] = i
    return len(tails)


def _rouge(ref: pd.Series, cand: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(ref, cand, strict=True):
        n, m = (0 if a is None else len(a)), (0 if b is None else len(b))
        common = _lcs(a, b) if n and m else 0
        out.append(2.0 * common / (n + m) if common else 0.0)
    return pd.Series(out)


def rouge_l(reference: Column, candidate: Column) -> Column:
    """ROUGE-L of two token arrays, Arrow batch by batch."""
    return F.pandas_udf(_rouge, "double")(reference, candidate)


def faithfulness(df: DataFrame, answer: str, context: str, keys: Sequence[str]) -> DataFrame:
    """Share of answer sentences (over ten characters) supported by the context, and their mean support."""
    claims = F.filter(X.sentences(answer, "marks"), lambda s: F.length(s) > 10)
    rows = df.select(*keys, X.tokens(context, "eval").alias("c"), claims.alias("claims"))
    each = rows.select(*keys, "c", F.explode_outer("claims").alias("claim")).withColumn("t", F.coalesce(X.tokens("claim", "eval"), F.array().cast("array<string>")))
    own = F.array_distinct("t")
    ratio = F.size(F.array_intersect(own, F.array_distinct("c"))) / F.size(own)
    each = each.withColumn("rouge", rouge_l(F.col("c"), F.col("t")))
    support = F.when(F.size("t") == 0, 1.0).otherwise(0.5 * ratio + 0.5 * F.col("rouge"))
    each = each.withColumn("support", support)
    real = F.col("claim").isNotNull()
    ok = (F.size("t") == 0) | (F.col("support") > 0.3)
    return each.groupBy(*keys).agg(
        F.count_if(real).alias("claims"), F.coalesce(F.avg(F.when(real, ok.cast("int"))), F.lit(1.0)).alias("faithfulness"), F.coalesce(F.avg(F.when(real, N.python_round(F.col("support"), 3))), F.lit(1.0)).alias("groundedness")
    )


# ---- chunks -----------------------------------------------------------------


def chunk_fixed(df: DataFrame, text: str, keys: Sequence[str], size: int, overlap: int, unit: str = "char") -> DataFrame:
    """Character or word windows; the step is size - overlap and at least 1, so tail chunks may lie inside the one before."""
    step = max(size - overlap, 1)
    base = df.select(*keys, (X.white_words(text) if unit == "word" else F.col(text)).alias("__t"))
    n = F.size("__t") if unit == "word" else F.length("__t")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))

    def part(s: Column, i: Column) -> Column:
        cut = F.array_join(F.slice("__t", s + 1, F.lit(size)), " ") if unit == "word" else F.substring("__t", s + 1, F.lit(size))
        return F.struct(i.alias("chunk"), cut.alias("text"), s.alias("start"), F.least(s + size, n).alias("end"))

    # finished chunks are exploded: the whole text must not travel with each of them
    return base.select(*keys, F.inline(F.transform(starts, part))).withColumn("size", F.length("text"))


def _pack(parts: Column, limit: int, extra: int, joiner: str) -> Column:
    """Parts packed in order up to a size: a fold over the array with (done, open, open size)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def step(acc: Column, p: Column) -> Column:
        full = (acc["size"] + F.length(p) > limit) & (F.size(acc["open"]) > 0)
        return F.when(
            full, F.struct(F.array_append(acc["done"], F.array_join(acc["open"], joiner)).alias("done"), F.array(p).alias("open"), F.length(p).alias("size"))
        ).otherwise(F.struct(acc["done"].alias("done"), F.array_append(acc["open"], p).alias("open"), (acc["size"] + F.length(p) + extra).alias("size")))

    return F.aggregate(parts, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], F.array_join(acc["open"], joiner))).otherwise(acc["done"]))


def fixed_parts(text: str, size: int, overlap: int) -> Column:
    """The texts of the character windows of ``chunk_fixed``."""
    n = F.length(text)
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(max(size - overlap, 1)))), lambda s: F.substring(text, s + 1, F.lit(size)))


def sentence_parts(text: str, limit: int) -> Column:
    """Sentences (split after marks) packed up to ``limit`` characters."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    return _pack(parts, limit, 0, " ")


def chunk_sentence(df: DataFrame, text: str, keys: Sequence[str], limit: int) -> DataFrame:
    """One row for each of the ``sentence_parts``."""
    return df.select(*keys, F.posexplode(sentence_parts(text, limit)).alias("chunk", "text")).withColumn("size", F.length("text"))


def paragraphs(text) -> Column:
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def paragraph_parts(text: str, limit: int, least: int = 50) -> Column:
    """Paragraphs packed up to ``limit``; short ones are dropped unless the text has only one."""
    kept = lambda p: F.when(F.size(p) > 1, F.filter(p, lambda s: F.length(s) >= least)).otherwise(p)
    # a list of one binds the paragraphs to a name, so they are cut once
    return F.get(F.transform(F.array(paragraphs(text)), lambda p: _pack(kept(p), limit, 2, "\n\n")), F.lit(0))


def chunk_paragraph(df: DataFrame, text: str, keys: Sequence[str], limit: int, least: int = 50) -> DataFrame:
    """One row for each of the ``paragraph_parts``."""
    return df.select(*keys, F.posexplode(paragraph_parts(text, limit, least)).alias("chunk", "text")).withColumn("size", F.length("text"))


def chunk_heading(df: DataFrame, text: str, keys: Sequence[str], limit: int) -> DataFrame:
    """Sections under # or underlined headings, each cut by paragraphs; the heading goes with its first chunk."""
    marked = F.regexp_replace(text, r"(?dm)^([^\n]{1,99})\n[=-]+[ \t]*$", "# $1")
    parts = F.filter(F.split(marked, r"(?dm)^(?=#{1,6}\s)"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")
    rows = df.select(*keys, F.posexplode(parts).alias("section", "__s"))
    heading = F.trim(F.regexp_extract("__s", r"\A#{1,6}\s+([^\n]*)", 1))
    body = F.regexp_replace("__s", r"\A#{1,6}\s[^\n]*\n?", "")
    packed = _pack(paragraphs(body), limit, 2, "\n\n")
    out = rows.select(*keys, "section", heading.alias("heading"), F.posexplode(packed).alias("part", "text"))
    first = (F.col("part") == 0) & (F.col("heading") != "")
    return out.withColumn("text", F.when(first, F.concat("heading", F.lit("\n\n"), "text")).otherwise(F.col("text"))).withColumn("size", F.length("text"))


def _vocabulary(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _ends(text: Column) -> tuple[Column, Column]:
    """Whether a chunk ends with a sentence, and with a word."""
    end = F.regexp_replace(text, r"\s+$", "")
    return end.rlike(r"[.!?]$").cast("int").alias("sentence"), end.rlike(r"[\p{L}\p{N}.!?]$").cast("int").alias("word")


def _coherence(w: Column, nx: Column) -> Column:
    return F.when((F.size(w) > 0) & (F.size(nx) > 0), X.jaccard(w, nx))


def _beside(chunks: DataFrame, doc: str, order: str, group: Sequence[str]) -> DataFrame:
    """Facts of chunks, next to the following one of the document; only words and facts are dealt by document."""
    w = Window.partitionBy(*group, doc).orderBy(order)
    rows = chunks.select(*group, doc, order, F.col("size").alias("size"), *_ends(F.col("text")), _vocabulary(F.col("text")).alias("w")).withColumn("nx", F.lead("w").over(w))
    return rows.select(*group, "size", "sentence", "word", _coherence(F.col("w"), F.col("nx")).alias("j"), F.size("w").alias("vocabulary"))


def _quality(facts: DataFrame, group: Sequence[str]) -> DataFrame:
    base = facts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("chunks"), F.avg("size").alias("mean_size"), F.coalesce(F.stddev_samp("size"), F.lit(0.0)).alias("std_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        F.avg("sentence").alias("sentence_boundary"), F.avg("word").alias("word_boundary"), F.coalesce(F.avg("j"), F.lit(0.0)).alias("coherence"), F.avg("vocabulary").alias("mean_vocabulary"),
    )
    medians = exact_quantiles(facts, list(group), "size", {"median_size": 0.5}).drop("n")
    return base.join(medians, list(group)) if group else base.crossJoin(F.broadcast(medians))


def chunk_quality(chunks: DataFrame, doc: str, order: str, group: Sequence[str] = ()) -> DataFrame:
    """Size moments, boundary shares, neighbour Jaccard inside a document and vocabulary, by group."""
    # base and medians both read the facts: written once, not cut again
    return _quality(written(_beside(chunks, doc, order, group), "chunks"), group)


def chunk_compare(df: DataFrame, strategies: dict[str, Column], doc: str) -> DataFrame:
    """Strategies over the same corpus: quality, weighted score (30% size, 40% boundaries, 30% coherence) and the best one.

    A strategy gives the list of a text's chunks. Chunks of a text are compared inside its row, and only their facts are
    written; those of texts that share a key are neighbours of each other and are dealt by it.
    """
    cut = lambda rows: rows.select(doc, F.inline(F.array(*[F.struct(F.lit(n).alias("strategy"), p.alias("__p")) for n, p in strategies.items()])))
    shared = written(df.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(doc).alias("__k")), "chunk-keys")
    same = F.col(doc).eqNullSafe(F.col("__k"))
    many = not shared.isEmpty()
    single = cut(df.join(shared, same, "left_anti") if many else df).withColumn("__w", F.transform("__p", _vocabulary))

    def fact(i: Column) -> Column:
        p, w = F.get("__p", i), F.get("__w", i)
        return F.struct(F.length(p).alias("size"), *_ends(p), _coherence(w, F.get("__w", i + 1)).alias("j"), F.size(w).alias("vocabulary"))

    facts = single.select("strategy", F.inline(F.when(F.size("__p") > 0, F.transform(F.sequence(F.lit(0), F.size("__p") - 1), fact))))
    if many:
        chunks = cut(df.join(shared, same, "left_semi")).select("strategy", doc, F.posexplode("__p").alias("__o", "text")).withColumn("size", F.length("text"))
        facts = facts.unionByName(_beside(chunks, doc, "__o", ["strategy"]))
    q = _quality(written(facts, "chunks"), ["strategy"])
    even = F.when(F.col("mean_size") > 0, 1 - F.least(F.col("std_size") / F.col("mean_size"), F.lit(1.0))).otherwise(0.0)
    q = q.withColumn("score", even * 0.3 + (F.col("sentence_boundary") + F.col("word_boundary")) / 2 * 0.4 + F.col("coherence") * 0.3)
    best = q.agg(F.max_by("strategy", F.struct("score", "strategy")).alias("b"))
    return q.crossJoin(F.broadcast(best)).withColumn("best", F.col("strategy") == F.col("b")).drop("b")


def chunk_plugin(df: DataFrame, text: str, keys: Sequence[str], strategy: Callable[[str], list[str]]) -> DataFrame:
    """Chunks of a user-supplied function ``strategy(text) -> list of texts``, Arrow batch by batch."""
    kept = df.select(*keys, F.col(text).alias("__t"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "__t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [strategy(t) if t is not None else [] for t in pdf["__t"]]
            spot = [i for i, p in enumerate(parts) for _ in p]
            out = pdf.drop(columns="__t").iloc[spot].reset_index(drop=True)
            out["chunk"] = pd.Series([j for p in parts for j in range(len(p))], dtype="int32")
            out["text"] = pd.Series([x for p in parts for x in p], dtype="object")
            yield out

    return kept.mapInPandas(run, f"{fields}, chunk int, text string")


# ---- link graph --------------------------------------------------------------


def page_names(pages: DataFrame, key: str, name: str) -> DataFrame:
    """(name, pages, head): how many pages have a name and the smallest of them; pages without a name have no row."""
    return pages.where(F.col(name) != "").groupBy(F.col(name).alias("name")).agg(F.countDistinct(key).alias("pages"), F.min(key).alias("head"))


def page_links(pages: DataFrame, key: str, name: str, links: Column) -> DataFrame:
    """(source, link, target, how, pages): distinct links of each page, resolved to a name.

    A link names all pages that have its target as their name, ``pages`` of them; it is resolved by the whole name,
    then by the last path part, and has no target otherwise. The pages behind a name are not multiplied out: a name
    that many pages have and many pages link to would give a row for every two of them.
    """
    out = pages.select(F.col(key).alias("source"), F.explode(F.array_distinct(links)).alias("link")).where("link <> ''").distinct()
    last = lambda c: F.regexp_extract(c, r"([^/]+)/*$", 1)
    names = page_names(pages, key, name)
    stems = names.groupBy(last(F.col("name")).alias("stem")).agg(F.min("name").alias("by_stem"))
    j = out.join(names.select(F.col("name").alias("full")), F.col("link") == F.col("full"), "left").join(stems, last(F.col("link")) == F.col("stem"), "left")
    how = F.when(F.col("full").isNotNull(), "key").when(F.col("by_stem").isNotNull(), "stem").otherwise("broken")
    found = j.select("source", "link", F.coalesce("full", "by_stem").alias("target"), how.alias("how"))
    return found.join(names.select(F.col("name").alias("target"), "pages"), "target", "left").select("source", "link", "target", "how", F.coalesce("pages", F.lit(0)).alias("pages"))


def graph_degrees(pages: DataFrame, key: str, name: str, links: DataFrame) -> DataFrame:
    """Pages that a page links to and pages that link to it, itself included; orphans (nothing links here) and sinks (links nowhere)."""
    e = links.where("target IS NOT NULL").select("source", "target", "pages").distinct()
    out = e.groupBy(F.col("source").alias("k")).agg(F.sum("pages").alias("o"))
    inn = e.groupBy(F.col("target").alias("n")).agg(F.count(F.lit(1)).alias("i"))
    nodes = pages.select(F.col(key).alias("key"), F.col(name).alias("__name")).distinct()
    j = nodes.join(out, F.col("key") == F.col("k"), "left").join(inn, F.col("__name") == F.col("n"), "left")
    j = j.groupBy("key").agg(F.max("o").alias("o"), F.sum("i").alias("i"))
    o, i = F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))
    return j.select("key", o.alias("outbound"), i.alias("inbound"), (i == 0).alias("orphan"), (o == 0).alias("sink"))


def page_edges(pages: DataFrame, key: str, name: str, links: DataFrame) -> DataFrame:
    """(source, target): edges that connect what the links connect, as many as links and pages.

    The smallest page of a name that is linked to stands for the name: sources and the other pages meet there.
    """
    names = page_names(pages, key, name)
    linked = links.where("target IS NOT NULL").select("source", F.col("target").alias("name")).distinct().join(names.select("name", "head"), "name")
    same = pages.select(F.col(key).alias("source"), F.col(name).alias("name")).join(linked.select("name", "head").distinct(), "name")
    return linked.select("source", F.col("head").alias("target")).unionByName(same.select("source", F.col("head").alias("target"))).where("source <> target").distinct()


def connected_components(nodes: DataFrame, key: str, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable key of every node, by alternating star contraction.

    Each round links the larger neighbours of a node to its smallest one and then the node itself, so
    the number of rounds grows with the logarithm of the graph. A round is two grouped minima and joins,
    so no neighbour list is ever collected. Lineage is cut with a reliable checkpoint every round.
    """
    spark = nodes.sparkSession
    checkpoint_folder(spark)
    e = edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct().checkpoint()

    def star(pairs: DataFrame, *, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        j = both.join(low, "u")
        moved = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else j.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = moved if large else moved.unionByName(low.select("u", F.col("m").alias("v")))
        return kept.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(pairs: DataFrame) -> tuple:
        """Count and two order-free hash sums: equal marks mean an unchanged edge set."""
        h = [F.sum(F.pmod(F.xxhash64("u", "v", F.lit(i)), F.lit(2**31)).cast("decimal(38,0)")) for i in range(2)]
        return tuple(pairs.agg(F.count(F.lit(1)), *h).first())

    seen = mark(e)
    for _ in range(max_rounds):
        e = star(star(e, large=True), large=False).checkpoint()
        last, seen = seen, mark(e)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = e.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__v"))
    return nodes.select(key).join(root, F.col(key) == F.col("__u"), "left").select(key, F.coalesce("__v", key).alias("component"))


def corpus_lint(pages: DataFrame, key: str, degrees: DataFrame, title: str, updated: str, required: Sequence[str], as_of: str, stale_days: int = 90) -> DataFrame:
    """One row per finding: orphan, stale, missing field, repeated title."""
    gap = F.lit(False)
    for c in required:
        gap = gap | F.col(c).isNull() | (F.col(c) == "")
    orphan = degrees.where("orphan").select(F.lit("orphan").alias("finding"), F.col(key).cast("string").alias("item"))
    stale = pages.where(F.col(updated) < F.date_sub(F.lit(as_of).cast("date"), stale_days)).select(F.lit("stale").alias("finding"), F.col(key).cast("string").alias("item"))
    missing = pages.where(gap).select(F.lit("missing_field").alias("finding"), F.col(key).cast("string").alias("item"))
    twice = pages.groupBy(title).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated_title").alias("finding"), F.col(title).alias("item"))
    return orphan.unionByName(stale).unionByName(missing).unionByName(twice)

