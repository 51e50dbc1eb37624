"""Search, evaluation, chunks and link graph on the test tables."""

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import retrieval as R
from millrace.operators import search as S
from millrace.plans.registry import query
from millrace.plans.scalars import EVAL_SQL
from millrace.plans.sets import ALNUM
from millrace.session import work_folder

POST = f"""
    dw AS (SELECT doc_id AS doc, {ALNUM} AS w FROM documents), dt AS (SELECT doc, len(w) AS length, unnest(w) AS term FROM dw), p AS (SELECT doc, term, count(*) AS tf, any_value(length) AS length FROM dt GROUP BY 1, 2),
    qw AS (SELECT item_id AS query, {ALNUM} AS w FROM benchmark), qt AS (SELECT query, len(w) AS qlen, unnest(w) AS term FROM qw), q AS (SELECT query, term, count(*) AS qtf, any_value(qlen) AS qlen FROM qt GROUP BY 1, 2),
    n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM dw), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
"""
TFIDF = """
    ti AS (SELECT query, doc, qtf / qlen * ln(n / df) AS a, tf / length * ln(n / df) AS b FROM q JOIN p USING (term) JOIN df USING (term), n),
    ts AS (SELECT query, doc, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS score FROM ti GROUP BY 1, 2 HAVING sum(a * a) > 0 AND sum(b * b) > 0 AND sum(a * b) > 0),
    tr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM ts)
"""
BM = """
    bs AS (SELECT query, doc, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) AS score FROM q JOIN p USING (term) JOIN df USING (term), n GROUP BY 1, 2),
    br AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM bs WHERE score > 0)
"""


#: Indexes of this process by session and input files.
INDEXES: dict[tuple, S.Index] = {}


def index(t):
    """The index of the documents, written once for all searches over the same files."""
    known = (t.spark.sparkContext.applicationId, *sorted(t.spark.read.parquet(t.path("documents")).inputFiles()))
    if known not in INDEXES:
        INDEXES[known] = S.build(t.documents, "doc_id", "text", work_folder(t.spark, "index"))
    return INDEXES[known]


def queries(t):
    return R.query_terms(t.benchmark, "item_id", "text")


def tfidf(t, k=10):
    return S.search(index(t), queries(t), S.tfidf(), k)


def bm25(t, k=10):
    return S.search(index(t), queries(t), S.bm25(), k)


@query("tfidf_search", f"WITH {POST}, {TFIDF} SELECT query, doc, score, rank::INT AS rank FROM tr WHERE rank <= 10", digits="score:6")
def tfidf_search(t):
    return tfidf(t)


@query("bm25_search", f"WITH {POST}, {BM} SELECT query, doc, score, rank::INT AS rank FROM br WHERE rank <= 10", digits="score:6")
def bm25_search(t):
    return bm25(t)


@query(
    "rank_fusion",
    f"WITH {POST}, {TFIDF}, {BM}, u AS (SELECT query, doc, 1.0 / (60 + rank) AS s FROM tr WHERE rank <= 10 UNION ALL SELECT query, doc, 1.0 / (60 + rank) FROM br WHERE rank <= 10) SELECT query, doc, sum(s)::DOUBLE AS score FROM u GROUP BY 1, 2",
    digits="score:8",
)
def rank_fusion(t):
    return R.rank_fusion([tfidf(t), bm25(t)])


def truth(t):
    """Documents that hold half of the five-word windows of a benchmark item: an equi join on windows, counted."""

    def windows(df, key, name):
        # the words are a column of their own: inside the lambda an expression would be split again for every window
        words = df.select(F.col(key).alias(name), X.white_words("text").alias("w"))
        # words are read by their place: a slice copies the whole array for every window
        grams = F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.concat_ws(" ", *[F.get("w", i + j) for j in range(5)])))
        return words.select(name, F.explode(F.array_distinct(grams)).alias("g"))

    items = windows(t.benchmark, "item_id", "query")
    size = items.groupBy("query").agg(F.count(F.lit(1)).alias("size"))
    shared = items.join(windows(t.documents, "doc_id", "doc"), "g").groupBy("query", "doc").agg(F.count(F.lit(1)).alias("n"))
    return shared.join(size, "query").where("2 * n >= size").select("query", "doc")


TRUTH = """
    ww AS (SELECT doc_id AS doc, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
    gr AS (SELECT DISTINCT doc, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM ww),
    iw AS (SELECT item_id AS query, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark),
    it AS (SELECT DISTINCT query, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM iw), iz AS (SELECT query, count(*) AS size FROM it GROUP BY 1),
    tru AS (SELECT query, doc FROM it JOIN gr USING (g) JOIN iz USING (query) GROUP BY query, doc, size HAVING 2 * count(*) >= size)
"""


def _metric_sql(over_k: bool):
    ks, cols = (1, 5, 10), []
    for k in ks:
        base = f"{k}" if over_k else f"least(returned, {k})"
        ideal = f"least(relevant, {k})" if over_k else f"least(relevant, returned, {k})"
        cols.append(
            f"CASE WHEN {base} > 0 THEN h{k} / {base} ELSE 0 END AS precision_{k}, h{k} / relevant AS recall_{k}, CASE WHEN {ideal} > 0 THEN d{k} / list_sum(list_transform(range(1, {ideal} + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg_{k}"
        )
    aggs = ", ".join(f"count(tru.doc) FILTER (WHERE rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= {k} AND tru.doc IS NOT NULL), 0) AS d{k}" for k in ks)
    return f"""
      re AS (SELECT query, count(*) AS relevant FROM tru GROUP BY 1), hi AS (SELECT r.query, count(*) AS returned, coalesce(max(1 / rank) FILTER (WHERE tru.doc IS NOT NULL), 0) AS rr, {aggs} FROM (SELECT * FROM tr WHERE rank <= 10) r LEFT JOIN tru ON tru.query = r.query AND tru.doc = r.doc GROUP BY 1),
      me AS (SELECT query, relevant, coalesce(returned, 0) AS returned, coalesce(rr, 0) AS reciprocal_rank, {', '.join(cols)} FROM re LEFT JOIN hi USING (query))
    """


MDIG = "reciprocal_rank:6 " + " ".join(f"{m}_{k}:6" for m in ("precision", "recall", "ndcg") for k in (1, 5, 10))


@query("retrieval_metrics", f"WITH {POST}, {TFIDF}, {TRUTH}, {_metric_sql(False)} SELECT * FROM me", digits=MDIG)
def retrieval_metrics(t):
    return R.retrieval_metrics(tfidf(t), truth(t), (1, 5, 10))


@query("retrieval_metrics_k", f"WITH {POST}, {TFIDF}, {TRUTH}, {_metric_sql(True)} SELECT * FROM me", digits=MDIG)
def retrieval_metrics_k(t):
    return R.retrieval_metrics(tfidf(t), truth(t), (1, 5, 10), over_k=True)


@query(
    "retrieval_failures",
    f"""WITH {POST}, {TFIDF}, {TRUTH}, {_metric_sql(False)}, s AS (SELECT item_id AS query, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM benchmark)
    SELECT CASE WHEN n <= 3 THEN 'short' WHEN n <= 7 THEN 'medium' ELSE 'long' END AS length_class, count(*) AS queries, avg(precision_5) AS mean_precision, count(*) FILTER (WHERE precision_5 < 0.2) AS poor_precision, count(*) FILTER (WHERE recall_5 < 0.3) AS poor_recall, count(*) FILTER (WHERE returned = 0) AS zero_results
    FROM me JOIN s USING (query) GROUP BY 1""",
    digits="mean_precision:6",
)
def retrieval_failures(t):
    return R.retrieval_failures(R.retrieval_metrics(tfidf(t), truth(t), (1, 5, 10)), t.benchmark, "item_id", "text")


@query(
    "vector_topk",
    """
    WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS c FROM x GROUP BY 1, 2),
    s AS (SELECT label AS query, vec_id AS doc, sum(v * c) / sqrt(sum(v * v)) / sqrt(sum(c * c)) AS score FROM x JOIN c USING (label, i) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc)::INT AS rank FROM s)
    SELECT * FROM r WHERE rank <= 5
    """,
    digits="score:6",
)
def vector_topk(t):
    """Nearest vectors to the mean vector of every label; the query keys lie outside the vector keys."""
    dims = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))
    q = means.select((F.lit(-1) - F.col("label")).cast("long").alias("vec_id"), "label", "embedding")
    out = R.vector_topk(t.embeddings, q, "vec_id", "embedding", "label", 5)
    return out.select((F.lit(-1) - F.col("query")).cast("int").alias("query"), "doc", "score", "rank")


def turns(t):
    """Neighbouring turns of a conversation: the earlier one is the question, the later one the answer."""
    a = t.conversations.select("conv_id", F.col("turn").alias("turn"), F.col("text").alias("question"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"])


TURNS = "tn AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def _tok(col):
    return f"list_filter(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({EVAL_SQL}))"


def _terms(col, k):
    return f"list_transform(list_sort(list_transform(list_distinct({col}), lambda w: {{'n': -len(list_filter({col}, lambda x: x = w)), 'p': list_position({col}, w), 'w': w}}))[1:{k}], lambda s: s.w)"


@query(
    "context_relevance",
    f"""WITH {TURNS}, k AS (SELECT conv_id, turn, {_tok('question')} AS q, {_tok('answer')} AS c FROM tn), m AS (SELECT *, {_terms('q', 15)} AS qt, {_terms('c', 30)} AS ct FROM k),
    s AS (SELECT conv_id, turn, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, ct)) / len(qt) ELSE 0 END AS term_cover, CASE WHEN len(q) > 0 AND len(c) > 0 THEN len(list_intersect(q, c)) / len(list_distinct(q || c)) ELSE 0 END AS token_overlap FROM m)
    SELECT *, 0.6 * term_cover + 0.4 * token_overlap AS relevance FROM s""",
    digits="term_cover:6 token_overlap:6 relevance:6",
)
def context_relevance(t):
    return R.context_relevance(turns(t), "question", "answer", ["conv_id", "turn"])


#: Longest common subsequences of the lists a and b of table k, by the places of a: one step per token of b.
LCS = """
    l(id, j, v, step) AS (SELECT id, unnest(range(1, len(a) + 1)), 0, 0 FROM k UNION ALL
      SELECT id, j, max(c) OVER (PARTITION BY id ORDER BY j), step + 1 FROM (SELECT l.id, l.j, l.step, greatest(l.v, coalesce(lag(l.v) OVER (PARTITION BY l.id ORDER BY l.j), 0) + (k.a[l.j] = k.b[l.step + 1])::INT) AS c FROM l JOIN k ON k.id = l.id WHERE l.step < len(k.b))),
    lc AS (SELECT id, max(v) AS lcs FROM l GROUP BY id),
    ro AS (SELECT k.*, CASE WHEN coalesce(lcs, 0) > 0 THEN 2.0 * lcs / (len(a) + len(b)) ELSE 0 END::DOUBLE AS rouge FROM k LEFT JOIN lc ON lc.id = k.id)
"""


@query(
    "faithfulness",
    f"""WITH RECURSIVE {TURNS}, cl AS (SELECT conv_id, turn, question, unnest(list_filter(list_transform(string_split_regex(answer, '[.!?]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10)) AS claim FROM tn),
    k AS (SELECT row_number() OVER () AS id, conv_id, turn, {_tok('question')} AS a, {_tok('claim')} AS b FROM cl), {LCS},
    su AS (SELECT conv_id, turn, len(b) = 0 AS none, CASE WHEN len(b) = 0 THEN 1 ELSE 0.5 * len(list_intersect(list_distinct(b), list_distinct(a))) / len(list_distinct(b)) + 0.5 * rouge END::DOUBLE AS support FROM ro)
    SELECT conv_id, turn, count(support) AS claims, coalesce(avg((none OR support > 0.3)::INT), 1.0) AS faithfulness, coalesce(avg(round_even(round(support, 10), 3)), 1.0) AS groundedness FROM tn LEFT JOIN su USING (conv_id, turn) GROUP BY ALL""",
    digits="faithfulness:6 groundedness:6",
)
def faithfulness(t):
    return R.faithfulness(turns(t), "answer", "question", ["conv_id", "turn"])


@query(
    "row_scorer_udf",
    f"WITH RECURSIVE {TURNS}, k AS (SELECT row_number() OVER () AS id, conv_id, turn, {_tok('question')} AS a, {_tok('answer')} AS b FROM tn), {LCS} SELECT conv_id, turn, rouge AS rouge_l FROM ro",
    digits="rouge_l:8",
)
def row_scorer_udf(t):
    return turns(t).select("conv_id", "turn", R.rouge_l(X.tokens("question", "eval"), X.tokens("answer", "eval")).alias("rouge_l"))


@query(
    "chunk_fixed",
    """
    WITH c AS (SELECT doc_id, 'char' AS unit, s, (s // 400)::INT AS chunk, substr(text, s + 1, 500) AS x FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS s FROM documents)),
    w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), v AS (SELECT doc_id, 'word' AS unit, s, (s // 90)::INT AS chunk, array_to_string(w[s + 1:s + 100], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, len(w), 90)) AS s FROM w))
    SELECT doc_id, unit, chunk, s::INT AS start, length(x)::INT AS size, md5(x) AS digest FROM (SELECT * FROM c UNION ALL SELECT * FROM v)
    """,
)
def chunk_fixed(t):
    cols = ["doc_id", "unit", "chunk", "start", "size", F.md5("text").alias("digest")]
    a = R.chunk_fixed(t.documents, "text", ["doc_id"], 500, 100).withColumn("unit", F.lit("char")).select(*cols)
    return a.unionByName(R.chunk_fixed(t.documents, "text", ["doc_id"], 100, 10, "word").withColumn("unit", F.lit("word")).select(*cols))


def _packed(limit: int, extra: int, joiner: str) -> str:
    """Chunks of ``parts`` packed in order, from the table p; the first part of a text counts its joiner too."""
    return f"""
    q AS (SELECT doc_id, list_reduce(list_transform(parts, lambda x, i: {{'done': []::VARCHAR[], 'part': x, 'size': length(x) + CASE WHEN i = 1 THEN {extra} ELSE 0 END}}),
      lambda a, e: CASE WHEN a.size + e.size > {limit} THEN {{'done': list_append(a.done, a.part), 'part': e.part, 'size': e.size}} ELSE {{'done': a.done, 'part': a.part || {joiner} || e.part, 'size': a.size + e.size + {extra}}} END) AS a FROM p WHERE len(parts) > 0),
    c AS (SELECT doc_id, list_append(a.done, a.part) AS chunks FROM q), o AS (SELECT doc_id, (generate_subscripts(chunks, 1) - 1)::INT AS chunk, unnest(chunks) AS text FROM c)
    SELECT doc_id, chunk, text, length(text)::INT AS size FROM o
    """


TRIMMED = "list_filter(list_transform({}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
SENTENCES = TRIMMED.format("string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))")
PARAGRAPHS = TRIMMED.format("string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n')")


@query("chunk_sentence", f"WITH p AS (SELECT doc_id, {SENTENCES} AS parts FROM documents), {_packed(1000, 0, "' '")}")
def chunk_sentence(t):
    return R.chunk_sentence(t.documents, "text", ["doc_id"], 1000)


@query(
    "chunk_paragraph",
    f"""WITH r AS (SELECT doc_id, {PARAGRAPHS} AS x FROM documents), p AS (SELECT doc_id, CASE WHEN len(x) > 1 THEN list_filter(x, lambda s: length(s) >= 50) ELSE x END AS parts FROM r),
    {_packed(1500, 2, "chr(10) || chr(10)")}""",
)
def chunk_paragraph(t):
    """The documents break paragraphs with one newline; they are doubled first."""
    return R.chunk_paragraph(t.documents.withColumn("text", F.regexp_replace("text", "\n", "\n\n")), "text", ["doc_id"], 1500)


@query(
    "chunk_heading",
    f"""WITH m AS (SELECT doc_id, replace(regexp_replace(text, '(?m)^(.{{1,25}})$', '# \\1', 'g'), chr(10), chr(10) || chr(10)) AS x FROM documents),
    u AS (SELECT doc_id, regexp_replace(regexp_replace(x, '(?m)^([^\\n]{{1,99}})\\n[=-]+[ \\t]*$', '# \\1', 'g'), '(?m)^(#{{1,6}}\\s)', chr(1) || '\\1', 'g') AS x FROM m),
    t AS (SELECT doc_id, list_filter(string_split(x, chr(1)), lambda s: regexp_replace(s, '\\s+', '', 'g') <> '') AS parts FROM u),
    e AS (SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INT AS section, unnest(parts) AS s FROM t),
    p AS (SELECT {{'d': doc_id, 's': section, 'h': trim(regexp_extract(s, '^#{{1,6}}\\s+([^\\n]*)', 1), ' ')}} AS doc_id, {TRIMMED.format("string_split_regex(regexp_replace(s, '^#{1,6}\\s[^\\n]*\\n?', ''), '\\n\\s*\\n')")} AS parts FROM e),
    z AS (SELECT * FROM (WITH {_packed(1500, 2, "chr(10) || chr(10)")}))
    SELECT doc_id.d AS doc_id, doc_id.s AS section, doc_id.h AS heading, chunk AS part, CASE WHEN chunk = 0 AND doc_id.h <> '' THEN doc_id.h || chr(10) || chr(10) || text ELSE text END AS text, length(CASE WHEN chunk = 0 AND doc_id.h <> '' THEN doc_id.h || chr(10) || chr(10) || text ELSE text END)::INT AS size FROM z""",
)
def chunk_heading(t):
    """Short lines become headings, so that the documents have sections."""
    text = F.regexp_replace(F.regexp_replace("text", r"(?m)^(.{1,25})$", "# $1"), "\n", "\n\n")
    return R.chunk_heading(t.documents.withColumn("text", text), "text", ["doc_id"], 1500)


@query("chunk_strategy_plugin", "SELECT doc_id, unnest(range(0, greatest(1, (length(text) + 799) // 800)))::INT AS chunk FROM documents WHERE length(text) > 0")
def chunk_strategy_plugin(t):
    """A user function that cuts every eight hundred characters."""
    return R.chunk_plugin(t.documents, "text", ["doc_id"], lambda s: [s[i : i + 800] for i in range(0, len(s), 800)]).select("doc_id", "chunk")


@query(
    "chunk_quality",
    """
    WITH c AS (SELECT doc_id, s, substr(text, s + 1, 500) AS x FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS s FROM documents)),
    w AS (SELECT *, length(x) AS size, list_distinct(regexp_extract_all(lower(x), '[\\p{L}\\p{N}_]+')) AS w, regexp_replace(x, '\\s+$', '') AS e FROM c), n AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY s) AS nx FROM w)
    SELECT count(*) AS chunks, avg(size) AS mean_size, stddev_samp(size) AS std_size, min(size)::INT AS min_size, max(size)::INT AS max_size, avg(regexp_matches(e, '[.!?]$')::INT) AS sentence_boundary, avg(regexp_matches(e, '[\\p{L}\\p{N}.!?]$')::INT) AS word_boundary,
      avg(CASE WHEN len(w) > 0 AND len(nx) > 0 THEN len(list_intersect(w, nx)) / len(list_distinct(w || nx)) END) AS coherence, avg(len(w)) AS mean_vocabulary, median(size) AS median_size FROM n
    """,
    digits="mean_size std_size sentence_boundary:6 word_boundary:6 coherence:6 mean_vocabulary median_size",
)
def chunk_quality(t):
    return R.chunk_quality(R.chunk_fixed(t.documents, "text", ["doc_id"], 500, 100), "doc_id", "chunk")


def _fixed(size: int, overlap: int) -> str:
    step = size - overlap
    return f"SELECT doc_id, (s // {step})::INT AS chunk, substr(text, s + 1, {size}) AS text, length(substr(text, s + 1, {size}))::INT AS size FROM (SELECT doc_id, text, unnest(range(0, length(text), {step})) AS s FROM documents)"


RAW_PARAGRAPHS = TRIMMED.format("string_split_regex(text, '\\n\\s*\\n')")
STRATEGIES = {
    "fixed_512_50": _fixed(512, 50), "fixed_1000_100": _fixed(1000, 100), "sentence_800": f"WITH p AS (SELECT doc_id, {SENTENCES} AS parts FROM documents), {_packed(800, 0, chr(39) + ' ' + chr(39))}",
    "paragraph_1500": f"WITH r AS (SELECT doc_id, {RAW_PARAGRAPHS} AS x FROM documents), p AS (SELECT doc_id, CASE WHEN len(x) > 1 THEN list_filter(x, lambda s: length(s) >= 50) ELSE x END AS parts FROM r), {_packed(1500, 2, 'chr(10) || chr(10)')}",
}


@query(
    "chunk_compare",
    f"""
    WITH k AS ({" UNION ALL ".join(f"SELECT '{n}' AS strategy, doc_id, chunk, text AS x, size FROM ({q})" for n, q in STRATEGIES.items())}),
    w AS (SELECT *, list_distinct(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+')) AS w, regexp_replace(x, '\\s+$', '') AS e FROM k), n AS (SELECT *, lead(w) OVER (PARTITION BY strategy, doc_id ORDER BY chunk) AS nx FROM w),
    q AS (SELECT strategy, count(*) AS chunks, avg(size) AS mean_size, coalesce(stddev_samp(size), 0) AS std_size, min(size)::INT AS min_size, max(size)::INT AS max_size, avg(regexp_matches(e, '[.!?]$')::INT) AS sentence_boundary, avg(regexp_matches(e, '[\\p{{L}}\\p{{N}}.!?]$')::INT) AS word_boundary,
      coalesce(avg(CASE WHEN len(w) > 0 AND len(nx) > 0 THEN len(list_intersect(w, nx)) / len(list_distinct(w || nx)) END), 0) AS coherence, avg(len(w)) AS mean_vocabulary, median(size) AS median_size FROM n GROUP BY 1),
    s AS (SELECT *, CASE WHEN mean_size > 0 THEN 1 - least(std_size / mean_size, 1) ELSE 0 END * 0.3 + (sentence_boundary + word_boundary) / 2 * 0.4 + coherence * 0.3 AS score FROM q)
    SELECT *, strategy = (SELECT arg_max(strategy, score) FROM s) AS best FROM s
    """,
    digits="mean_size std_size sentence_boundary:6 word_boundary:6 coherence:6 mean_vocabulary median_size score:6",
)
def chunk_compare(t):
    ways = {"fixed_512_50": R.fixed_parts("text", 512, 50), "fixed_1000_100": R.fixed_parts("text", 1000, 100), "sentence_800": R.sentence_parts("text", 800), "paragraph_1500": R.paragraph_parts("text", 1500)}
    return R.chunk_compare(t.documents, ways, "doc_id")


def wiki(t):
    """All pages, with the first word of their title as a name that several may share, and the paths of all their links."""
    name = F.lower(F.regexp_extract("html", r"<title>\s*([^\s<]+)", 1))
    links = F.transform(F.regexp_extract_all("html", F.lit(r'href="/?([^"]*)"'), F.lit(1)), lambda x: F.lower(x))
    return t.pages.select("page_id", name.alias("name"), links.alias("links"))


WIKI = """
    wk AS (SELECT page_id, lower(regexp_extract(html, '<title>\\s*([^\\s<]+)', 1)) AS name, list_transform(regexp_extract_all(html, 'href="/?([^"]*)"', 1), lambda x: lower(x)) AS links FROM pages),
    ed AS (SELECT DISTINCT page_id AS source, unnest(links) AS link FROM wk), er AS (SELECT DISTINCT source, link, wk.page_id AS target, wk.name FROM (SELECT * FROM ed WHERE link <> '') LEFT JOIN wk ON wk.name = link AND wk.name <> '')
"""


def links(t):
    return R.page_links(wiki(t), "page_id", "name", F.col("links"))


@query("link_graph", f"WITH {WIKI} SELECT source, link, name AS target, CASE WHEN name IS NULL THEN 'broken' ELSE 'key' END AS how, count(DISTINCT target) AS pages FROM er GROUP BY ALL")
def link_graph(t):
    return links(t)


DEG = "dg AS (SELECT page_id AS key, (SELECT count(DISTINCT target) FROM er WHERE source = page_id) AS outbound, (SELECT count(DISTINCT source) FROM er WHERE target = page_id) AS inbound FROM wk)"


@query("graph_degrees", f"WITH {WIKI}, {DEG} SELECT *, inbound = 0 AS orphan, outbound = 0 AS sink FROM dg")
def graph_degrees(t):
    return R.graph_degrees(wiki(t), "page_id", "name", links(t))


@query(
    "connected_components",
    f"""WITH RECURSIVE {WIKI}, bo AS (SELECT source AS a, target AS b FROM er WHERE target IS NOT NULL UNION SELECT target, source FROM er WHERE target IS NOT NULL),
    reach(k, x) AS (SELECT page_id, page_id FROM wk UNION SELECT reach.k, bo.b FROM reach JOIN bo ON bo.a = reach.x) SELECT k AS key, min(x) AS component FROM reach GROUP BY 1""",
)
def connected_components(t):
    edges = R.page_edges(wiki(t), "page_id", "name", links(t))
    return R.connected_components(wiki(t).select(F.col("page_id").alias("key")), "key", edges)


@query(
    "corpus_lint",
    f"""WITH {WIKI}, {DEG}, pg AS (SELECT page_id AS key, 'topic ' || (page_id % 40) AS title, DATE '2024-01-01' + (page_id % 300)::INT AS updated, CASE WHEN page_id % 9 <> 0 THEN 'summary' END AS summary FROM pages)
    SELECT 'orphan' AS finding, key::VARCHAR AS item FROM dg WHERE inbound = 0 UNION ALL SELECT 'stale', key::VARCHAR FROM pg WHERE updated < DATE '2024-12-01' - 90 UNION ALL SELECT 'missing_field', key::VARCHAR FROM pg WHERE summary IS NULL UNION ALL SELECT 'repeated_title', title FROM pg GROUP BY 2 HAVING count(*) > 1""",
)
def corpus_lint(t):
    p = F.col("page_id")
    pg = t.pages.select(p.alias("key"), F.concat(F.lit("topic "), p % 40).alias("title"), F.date_add(F.lit("2024-01-01").cast("date"), (p % 300).cast("int")).alias("updated"), F.when(p % 9 != 0, "summary").alias("summary"))
    deg = R.graph_degrees(wiki(t), "page_id", "name", links(t))
    return R.corpus_lint(pg, "key", deg, "title", "updated", ["title", "summary"], "2024-12-01")
