"""Queries over the ten operators, and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, language, lattice, leaks, manifest, near, neighbours, packing, pages, rtree, substring, suffixes, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (session, folder) under its name."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return wrap


@query()
def op1_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.main_text(_table(spark, folder, "pages"), pages.fit())


@query()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = language.fit(docs, "text", "lang", "doc_id", common.bucket("k", 4) != 2)
    out = language.identify(docs, model)
    return out.select("doc_id", (common.bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op3_lattice_score(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    held = common.bucket("doc_id", 7) == 2
    out = lattice.score(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"), common.bucket("k", 5) != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (common.bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query()
def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 50 = 0"))


@query()
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = leaks.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return out.select("doc_id", "item_id", "score", "start", "length")


NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query(NEAR_SQL)
def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = near.near_duplicates(_table(spark, folder, "documents"), width=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    out = packing.pack(_table(spark, folder, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Host, path and verdict of the listed rules.
LISTED = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

URL_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS s FROM pages),
p AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(s, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(s, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
l(h, f, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b AS (SELECT n, arg_max(h || f, length(h || f)) AS rule, arg_max(v, length(h || f)) AS v FROM p JOIN l
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(b.v, CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?(@WORDS@)[.-]')
  OR regexp_matches(host || path, '(/wp-login\.php|[.]exe|[.]apk)$|/cgi-bin/') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (n)
""".replace("@WORDS@", "|".join(urls.HOST_WORDS))


@query(URL_SQL)
def op9_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = urls.rule_table(spark, [urls.listed_rule(*r) for r in LISTED] + urls.pattern_rules())
    return urls.judge(_table(spark, folder, "pages"), rules)


REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS h FROM v),
g AS (SELECT doc_id, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
m AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM g),
c AS (SELECT doc_id, list(k) AS gone FROM m GROUP BY doc_id),
x AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM x),
t AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.k) AS kept FROM k ANTI JOIN m ON k.doc_id = m.doc_id AND k.k = m.k GROUP BY k.doc_id)
SELECT x.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM x LEFT JOIN t USING (doc_id)
"""


@query(REPEATS_SQL)
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring.drop_repeats(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: Length in bytes, colon and value of a column, ``-`` for null.
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"
_UP = "list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], '')))"
_STEPS = """list(CASE WHEN xor(p >> lvl, 1) >= len(hs) THEN '-' WHEN (p >> lvl) & 1 = 1 THEN 'L' || hs[xor(p >> lvl, 1) + 1]
  ELSE 'R' || hs[xor(p >> lvl, 1) + 1] END ORDER BY lvl)"""
MANIFEST_SQL = f"""
WITH RECURSIVE c AS (SELECT doc_id, lang, {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n="(n_chars + 1)")} AS changed,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 7 = 0 AS bad
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM c),
t AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY p) AS hs FROM l GROUP BY lang
  UNION ALL SELECT lang, lvl + 1, {_UP} FROM t WHERE len(hs) > 1),
s AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p FROM t WHERE len(hs) = 1),
u AS (SELECT 0 AS lvl, list(subroot ORDER BY p) AS hs FROM s UNION ALL SELECT lvl + 1, {_UP} FROM u WHERE len(hs) > 1),
a AS (SELECT doc_id, l.lang, leaf, p, changed, bad, {_STEPS} FILTER (len(hs) > 1) AS low FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang GROUP BY ALL),
b AS (SELECT lang, subroot, {_STEPS} FILTER (len(hs) > 1) AS high FROM s CROSS JOIN u GROUP BY lang, subroot),
w AS (SELECT doc_id, leaf, subroot, (SELECT hs[1] FROM u WHERE len(hs) = 1) AS root, list_concat(coalesce(low, []), coalesce(high, [])) AS steps,
  CASE WHEN bad THEN changed ELSE leaf END AS start FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang),
v AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(list_filter(steps, lambda x: x <> '-'), lambda x: x[2:]), ''), '')) AS proof_sha256,
  list_reduce(list_concat([start], steps), lambda h, x: CASE WHEN x = '-' THEN sha256(h) WHEN x[1] = 'L' THEN sha256(x[2:] || h) ELSE sha256(h || x[2:]) END) AS folded_root FROM w)
SELECT *, folded_root = root AS verified FROM v
"""


@query(MANIFEST_SQL)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest.manifest(_table(spark, folder, "documents"), changes={"n_chars": F.col("n_chars") + 1}, where=tampered)
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


BYTES_SQL = """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
q AS (SELECT doc_id, p, substr(h, 2 * p + 1, 1398) AS s, n FROM (SELECT *, unnest(range(0, n - 199, 500)) AS p FROM d WHERE n >= 200)),
v AS (SELECT doc_id, p + o AS i, md5_number(substr(s, 2 * o + 1, 400)) AS k FROM (SELECT *, unnest(range(0, least(500, n - 199 - p))) AS o FROM q)),
g AS (SELECT doc_id, i FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING count(*) > 1)),
e AS (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 200 AS fresh FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY doc_id, run),
z AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM r GROUP BY doc_id),
x AS (SELECT d.*, coalesce(starts, []) AS starts, coalesce(ends, []) AS ends FROM d LEFT JOIN z USING (doc_id))
SELECT doc_id, n AS n_bytes, coalesce(list_sum(ends) - list_sum(starts), 0)::BIGINT AS n_removed, len(starts) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, len(starts) + 1), lambda j: substr(h, 2 * coalesce(ends[j], 0) + 1, 2 * (coalesce(starts[j + 1], n) - coalesce(ends[j], 0)))), ''))) AS kept_sha256
FROM x
"""


@query(BYTES_SQL)
def op12_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffixes.drop_repeats(_table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


NEGATIVES_SQL = """
WITH r AS (SELECT DISTINCT vec_id AS id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, n.id, a.label = n.label AS same, list_dot_product(a.v, n.v)::BIGINT AS score
  FROM r a JOIN r n ON a.id <> n.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query(NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.hard_negatives(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, relabel=shifted)
