"""Text scores and scans on the document and conversation tables."""

from pyspark.sql import functions as F

from millrace.functions import text as TF
from millrace.operators import text as X
from millrace.operators import topics
from millrace.plans.registry import query
from millrace.plans.scalars import STEM, SYLL, WORDS

# SQL side: word borders of RE2 know ASCII only, so accented letters are swapped for a plain letter first.
PLAIN = "regexp_replace(text, '[À-ɏ]', '_', 'g')"
WW = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
ALPHA = f"list_filter({WORDS}, lambda w: regexp_full_match(w, '[a-z]+'))"
AFTER = "len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, E' \\t\\n\\r') <> ''))"


def q(s: str) -> str:
    return s.replace("'", "''")


def count_sql(col: str, word: str) -> str:
    return f"(length({col}) - length(replace({col}, '{q(word)}', ''))) // {len(word)}"


def hit_sql(words, col="l"):
    return "(" + " + ".join(f"contains({col}, '{q(w)}')::INT" for w in words) + ")"


READ = f"""
    b AS (SELECT doc_id, {ALPHA} AS w, greatest({AFTER}, 1) AS s FROM documents),
    r AS (SELECT doc_id, len(w) AS words, s AS sentences, len(w) / s AS avg_sentence, list_sum(list_transform(w, lambda x: length(x))) / len(w) AS avg_word,
      list_sum(list_transform(w, lambda w: {SYLL})) / len(w) AS avg_syllables FROM b WHERE len(w) > 0),
    e AS (SELECT *, greatest(0, least(100, 206.835 - 1.015 * avg_sentence - 84.6 * avg_syllables)) AS ease, greatest(0, 0.39 * avg_sentence + 11.8 * avg_syllables - 15.59) AS grade FROM r)
"""


@query(
    "readability",
    f"""WITH {READ} SELECT *, CASE WHEN round(ease, 1) >= 90 THEN 'Very Easy' WHEN round(ease, 1) >= 80 THEN 'Easy' WHEN round(ease, 1) >= 70 THEN 'Fairly Easy' WHEN round(ease, 1) >= 60 THEN 'Standard'
      WHEN round(ease, 1) >= 50 THEN 'Fairly Difficult' WHEN round(ease, 1) >= 30 THEN 'Difficult' ELSE 'Very Confusing' END AS label FROM e""",
    digits="avg_sentence:6 avg_word:6 avg_syllables:6 ease grade",
)
def readability(t):
    return X.readability(t.documents, "text", ["doc_id"])


@query(
    "style_counts",
    f"""
    WITH b AS (SELECT doc_id, {ALPHA} AS w, greatest({AFTER}, 1) AS s, lower({PLAIN}) AS l FROM documents),
    c AS (SELECT doc_id, len(w) AS n, s, len(regexp_extract_all(l, '{X.PASSIVE}')) AS passive, len(list_filter(regexp_extract_all(l, '\\b\\w+ly\\b'), lambda x: x NOT IN ('{"', '".join(X.NOT_ADVERBS)}'))) AS adverbs,
      len(list_filter(w, lambda x: x IN ('{"', '".join(X.FILLERS)}'))) AS fillers FROM b WHERE len(w) > 0)
    SELECT doc_id, passive, adverbs, fillers, passive / s * 100 AS passive_pct, adverbs / n * 100 AS adverb_density, fillers / n * 100 AS filler_density FROM c
    """,
    digits="passive_pct adverb_density filler_density",
)
def style_counts(t):
    return X.style_counts(t.documents, "text", ["doc_id"])


BURST = """
    bo AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\\A---.*?---\\s*', ''), '(?m)^#+\\s+.*$', '', 'g'), '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g') AS body FROM documents),
    se AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(body, '[^.!?]+[.!?]+'), lambda s: len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> ''))), lambda n: n >= 3) AS l FROM bo),
    cv AS (SELECT doc_id, text, len(l) AS sentences, CASE WHEN len(l) >= 5 THEN list_stddev_pop(l) / list_avg(l) ELSE 0 END AS cv FROM se),
    bu AS (SELECT *, CASE WHEN sentences < 5 THEN 50 WHEN cv >= 0.5 THEN least(100, greatest(0, 30 - (cv - 0.5) * 60)) WHEN cv >= 0.35 THEN 30 + (0.5 - cv) * 130 ELSE least(100, greatest(0, 50 + (0.35 - cv) * 250)) END AS burstiness FROM cv)
"""
TTR = """
    tw AS (SELECT doc_id, list_filter(regexp_extract_all(lower(regexp_replace(text, '(?s)\\A---.*?---\\s*', '')), '[a-z]+'), lambda w: length(w) > 2) AS w FROM documents),
    tn AS (SELECT doc_id, w, len(w) AS words, least(200, len(w)) AS win FROM tw),
    tt AS (SELECT doc_id, words, CASE WHEN words >= 50 THEN list_avg(list_transform(range(0, words - win + 1, greatest(win // 2, 1)), lambda i: len(list_distinct(w[i + 1:i + win])) / win)) ELSE 0 END AS ttr FROM tn),
    vo AS (SELECT *, CASE WHEN words < 50 THEN 50 WHEN ttr >= 0.6 THEN greatest(0, 25 - (ttr - 0.6) * 150) WHEN ttr >= 0.45 THEN 25 + (0.6 - ttr) * 330 ELSE least(100, 75 + (0.45 - ttr) * 250) END AS vocabulary FROM tt)
"""
PHR = f"""
    pm AS (SELECT doc_id, {' + '.join(f"len(regexp_extract_all(lower(text), '{q(p)}'))" for p in X.AI_PHRASES)} AS matches, len({WW}) AS n FROM documents),
    pd AS (SELECT doc_id, matches, CASE WHEN n > 0 THEN matches / (n / 1000) ELSE 0 END AS density FROM pm),
    ph AS (SELECT *, CASE WHEN density <= 2 THEN density * 15 WHEN density <= 5 THEN 30 + (density - 2) * 20 ELSE least(100, 90 + (density - 5) * 5) END AS phrases FROM pd)
"""


@query("burstiness", f"WITH {BURST} SELECT doc_id, sentences, cv, burstiness FROM bu", digits="cv:6 burstiness")
def burstiness(t):
    return X.burstiness(t.documents, "text", ["doc_id"])


@query("sliding_ttr", f"WITH {TTR} SELECT doc_id, words, ttr, vocabulary FROM vo", digits="ttr:6 vocabulary")
def sliding_ttr(t):
    return X.sliding_ttr(t.documents, "text", ["doc_id"])


@query("phrase_density", f"WITH {PHR} SELECT doc_id, matches, density, phrases FROM ph", digits="density:6 phrases")
def phrase_density(t):
    return X.phrase_density(t.documents, "text", ["doc_id"])


@query(
    "ai_text_score",
    f"""WITH {BURST}, {TTR}, {PHR}, j AS (SELECT doc_id, round_even(round(burstiness, 8), 1) AS burstiness, round_even(round(vocabulary, 8), 1) AS vocabulary, round_even(round(phrases, 8), 1) AS phrases FROM bu JOIN vo USING (doc_id) JOIN ph USING (doc_id)),
    c AS (SELECT *, round_even(round(least(100, greatest(0, burstiness * 0.35 + vocabulary * 0.3 + phrases * 0.35)), 8), 1) AS composite FROM j)
    SELECT *, CASE WHEN composite <= 20 THEN 'LIKELY_HUMAN' WHEN composite <= 50 THEN 'MIXED' ELSE 'LIKELY_AI' END AS verdict FROM c""",
    digits="burstiness:1 vocabulary:1 phrases:1 composite:1",
)
def ai_text_score(t):
    return X.ai_text_score(t.documents, "text", "doc_id")


@query(
    "humanity_score",
    f"""
    WITH a AS (SELECT doc_id, text, lower(text) AS l, lower({PLAIN}) AS p, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s, E' \\t\\n\\r')), lambda s: s <> '') AS s,
      list_transform(list_filter(string_split(text, E'\\n\\n'), lambda x: trim(x, E' \\t\\n\\r') <> '' AND NOT starts_with(x, '#')), lambda s: len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> ''))) AS g FROM documents),
    b AS (SELECT doc_id, {' + '.join(count_sql('l', w) for w in X.AI_WORDS)} AS h, {' + '.join(count_sql('l', w) for w in X.HEDGES)} AS he,
      list_filter(list_transform(s, lambda s: len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> ''))), lambda n: n >= 3) AS n,
      ({' + '.join(f"len(regexp_extract_all(p, '{p}'))" for p in X.PASSIVE_LOOSE)}) / greatest(len(s), 1) AS pr, (length(text) - length(replace(text, '—', '')) + (length(text) - length(replace(text, '--', ''))) // 2) / (greatest(1, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) / 100) AS d, g FROM a),
    c AS (SELECT doc_id, CASE WHEN h = 0 THEN 25 WHEN h <= 2 THEN 20 WHEN h <= 5 THEN 14 WHEN h <= 10 THEN 8 WHEN h <= 15 THEN 3 ELSE 0 END AS vocabulary,
      CASE WHEN len(n) < 3 THEN 10 WHEN list_stddev_pop(n) >= 12 THEN 20 WHEN list_stddev_pop(n) >= 8 THEN 16 WHEN list_stddev_pop(n) >= 5 THEN 10 WHEN list_stddev_pop(n) >= 3 THEN 5 ELSE 0 END AS variance,
      CASE WHEN pr < 0.1 THEN 20 WHEN pr < 0.2 THEN 16 WHEN pr < 0.3 THEN 10 WHEN pr < 0.4 THEN 5 ELSE 0 END AS passive, CASE he WHEN 0 THEN 15 WHEN 1 THEN 12 WHEN 2 THEN 8 WHEN 3 THEN 4 ELSE 0 END AS hedging,
      CASE WHEN d < 0.5 THEN 10 WHEN d < 1.5 THEN 8 WHEN d < 3 THEN 5 WHEN d < 5 THEN 2 ELSE 0 END AS dashes,
      CASE WHEN len(g) < 3 THEN 5 ELSE least(10, CASE WHEN list_stddev_pop(g) >= 30 THEN 5 WHEN list_stddev_pop(g) >= 15 THEN 3 WHEN list_stddev_pop(g) >= 5 THEN 1 ELSE 0 END + CASE WHEN list_min(g) <= 15 THEN 3 ELSE 0 END + CASE WHEN list_max(g) >= 80 AND list_stddev_pop(g) >= 15 THEN 2 ELSE 0 END) END AS paragraphs FROM b),
    e AS (SELECT *, vocabulary + variance + passive + hedging + dashes + paragraphs AS humanity FROM c)
    SELECT *, CASE WHEN humanity >= 85 THEN 'human' WHEN humanity >= 70 THEN 'mostly human' WHEN humanity >= 50 THEN 'mixed' WHEN humanity >= 30 THEN 'robotic' ELSE 'fingerprint' END AS label FROM e
    """,
)
def humanity_score(t):
    return X.humanity_score(t.documents, "text", ["doc_id"])


KW = ["the", "der", "que", "tion"]


@query(
    "keyword_density",
    f"WITH w AS (SELECT doc_id, lower(text) AS l, len({WW}) AS n, unnest({KW}) AS keyword FROM documents), c AS (SELECT *, (length(l) - length(replace(l, keyword, ''))) // length(keyword) AS occurrences FROM w) SELECT doc_id, keyword, occurrences, CASE WHEN n > 0 THEN occurrences / n * 100 ELSE 0 END AS density_pct FROM c",
    digits="density_pct:6",
)
def keyword_density(t):
    return X.keyword_density(t.documents, "text", ["doc_id"], KW)


def _clean_sql(stop, least):
    words = "', '".join(stop)
    return f"list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND length(x) >= {least} AND x NOT IN ('{words}'))"


PAIRS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"


@query(
    "corpus_keywords",
    f"WITH d AS (SELECT {_clean_sql(X.KEYWORD_STOP, 3)} AS w FROM documents), t AS (SELECT unnest(w || {PAIRS}) AS term FROM d) SELECT term, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, term LIMIT 50",
)
def corpus_keywords(t):
    return X.corpus_keywords(t.documents, "text")


@query(
    "theme_mining",
    f"WITH d AS (SELECT {_clean_sql(X.THEME_STOP, 4)} AS w FROM documents), t AS (SELECT 'word' AS kind, unnest(w) AS term FROM d UNION ALL SELECT 'phrase', unnest({PAIRS}) FROM d) SELECT kind, term, count(*) AS mentions FROM t GROUP BY 1, 2 HAVING count(*) >= 3",
)
def theme_mining(t):
    return X.theme_mining(t.documents, "text")


def reviews(t):
    """Labelled documents as reviews: rating from quality and toxicity."""
    j = t.documents.join(t.labels, "doc_id")
    return j.select("doc_id", "lang", "source", "text", (F.lit(2) + F.col("quality") * 2 + F.col("doc_id") % 2 - F.col("toxic")).cast("int").alias("rating"))


REV = f"""
    v AS (SELECT doc_id, lang, lower(text) AS l, (2 + quality * 2 + doc_id % 2 - toxic)::INT AS rating FROM documents JOIN labels USING (doc_id)),
    sc AS (SELECT *, least(1, greatest(-1, (rating - 3) / 2 * 0.6 + ({hit_sql(X.POSITIVE)} - {hit_sql(X.NEGATIVE)}) / 10 * 0.4)) AS sentiment_score FROM v),
    se AS (SELECT *, CASE WHEN round(sentiment_score, 9) > 0.3 THEN 'positive' WHEN round(sentiment_score, 9) < -0.3 THEN 'negative' ELSE 'neutral' END AS sentiment FROM sc)
"""


@query("sentiment_score", f"WITH {REV} SELECT doc_id, rating, sentiment_score, sentiment FROM se", digits="sentiment_score:6")
def sentiment_score(t):
    return X.sentiment(reviews(t), "text", "rating").select("doc_id", "rating", "sentiment_score", "sentiment")


@query(
    "sentiment_trend",
    f"WITH {REV} SELECT doc_id % 12 AS period, count(*) AS reviews, avg((sentiment = 'positive')::INT) * 100 AS positive, avg((sentiment = 'neutral')::INT) * 100 AS neutral, avg((sentiment = 'negative')::INT) * 100 AS negative FROM se GROUP BY 1",
    digits="positive neutral negative",
)
def sentiment_trend(t):
    return X.sentiment_trend(X.sentiment(reviews(t), "text", "rating").withColumn("period", F.col("doc_id") % 12), "period")


@query(
    "issue_mining",
    f"WITH {REV}, i AS (SELECT doc_id, unnest({X.ISSUES}) AS issue, l, rating FROM v) SELECT issue, count(*) AS reviews, count(*) / (SELECT count(*) FROM v) * 100 AS share FROM i WHERE rating <= 3 AND contains(l, issue) GROUP BY 1",
    digits="share",
)
def issue_mining(t):
    return X.issue_mining(reviews(t), "text", "rating")


@query(
    "feature_requests",
    "WITH c AS (SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in X.REQUESTS) + " END AS phrase FROM conversations) SELECT * FROM c WHERE phrase IS NOT NULL",
)
def feature_requests(t):
    return X.feature_requests(t.conversations, "text", ["conv_id", "turn"])


def _any(words):
    return "(" + " OR ".join(f"contains(l, '{q(w)}')" for w in words) + ")"


@query(
    "interview_signals",
    f"""
    WITH s AS (SELECT conv_id, lower(unnest(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: trim(s, E' \\t\\n\\r')), lambda s: s <> ''))) AS l FROM conversations)
    SELECT conv_id, count(*) AS sentences, count(*) FILTER (WHERE {_any(X.PAIN)}) AS pain, count(*) FILTER (WHERE {_any(X.DELIGHT)}) AS delight, count(*) FILTER (WHERE {_any(X.ASK)}) AS requests, count(*) FILTER (WHERE regexp_matches(l, '\\d')) AS with_numbers FROM s GROUP BY 1
    """,
)
def interview_signals(t):
    return X.interview_signals(t.conversations, "text", ["conv_id"])


@query(
    "citation_extract",
    """
    WITH f AS (SELECT doc_id, 'url' AS kind, unnest(list_filter(list_transform(regexp_extract_all(text, '(?i)https?://[^\\s,;}\\])\\"''>]+'), lambda v: rtrim(v, '.,;)')), lambda v: NOT contains(v, 'doi.org'))) AS r FROM documents
      UNION ALL SELECT doc_id, 'author_year', unnest(regexp_extract_all(text, '(?:^|\\(|\\s)([A-Z][a-z]+(?:\\s(?:&|and)\\s[A-Z][a-z]+)?(?:\\set\\sal\\.?)?\\s*\\(\\d{4}\\))', 1)) FROM documents
      UNION ALL SELECT doc_id, 'numbered', unnest(regexp_extract_all(text, '(?m)^(\\[\\d+\\]\\s+.+)$', 1)) FROM documents
      UNION ALL SELECT doc_id, 'doi', unnest(list_transform(regexp_extract_all(text, '(?i)(?:https?://doi\\.org/|doi:\\s*)(10\\.\\d{4,}/[^\\s,;}\\]]+)', 1), lambda v: rtrim(v, '.'))) FROM documents)
    SELECT DISTINCT doc_id, kind, lower(trim(r)) AS reference FROM f WHERE r <> ''
    """,
)
def citation_extract(t):
    return X.citations(t.documents, "text", ["doc_id"])


LINES = "li AS (SELECT doc_id, unnest(string_split(text, E'\\n')) AS t, generate_subscripts(string_split(text, E'\\n'), 1) AS line FROM (SELECT doc_id, " + PLAIN + " AS text FROM documents))"


@query(
    "pii_scan",
    f"WITH {LINES} " + " UNION ALL ".join(f"SELECT * FROM (SELECT doc_id, line::INT AS line, '{n}' AS pattern, '{c}' AS category, '{r}' AS risk, len(regexp_extract_all(t, '(?i){q(p)}'))::INT AS matches FROM li) WHERE matches > 0" for n, (p, c, r) in X.PII.items()),
)
def pii_scan(t):
    return X.pii_scan(t.documents, "text", ["doc_id"])


@query(
    "secret_scan",
    f"WITH {LINES} " + " UNION ALL ".join(f"SELECT doc_id, line::INT AS line, '{s}' AS severity, '{n}' AS pattern FROM li WHERE regexp_matches(t, '{q(p)}')" for n, (s, p) in X.SECRETS.items()),
)
def secret_scan(t):
    return X.secret_scan(t.documents, "text", ["doc_id"])


INJ = " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS family, '{s}' AS severity FROM conversations WHERE " + " OR ".join(f"regexp_matches(text, '(?i){q(p)}')" for p in ps) for n, (s, ps) in X.INJECTIONS.items())


@query(
    "prompt_injection_scan",
    f"WITH f AS ({INJ}), p AS (SELECT family, severity, count(*) AS prompts FROM f GROUP BY 1, 2) SELECT *, (SELECT count(*) FROM p) / 6 AS injection_score FROM p",
    digits="injection_score:6",
)
def prompt_injection_scan(t):
    return X.injection_score(X.injection_scan(t.conversations, "text", ["conv_id", "turn"]))


def _license_sql():
    out = "CASE "
    for n, ps in X.LICENSES.items():
        out += "WHEN " + " OR ".join(f"regexp_matches(text, '(?i){q(p)}')" for p in ps) + f" THEN '{n}' "
    for n, (a, b) in X.LICENSE_FALLBACK:
        out += f"WHEN contains(upper(text), '{a}') AND contains(upper(text), '{b}') THEN '{n}' "
    return out + "END"


@query("license_detect", f"SELECT * FROM (SELECT doc_id, {_license_sql()} AS license FROM documents) WHERE license IS NOT NULL")
def license_detect(t):
    return t.documents.select("doc_id", X.license_of(F.col("text")).alias("license")).where("license IS NOT NULL")


@query(
    "compat_matrix_join",
    f"WITH l AS (SELECT doc_id, {_license_sql()} AS license FROM documents) SELECT doc_id, license, 'GPL-2.0' AS project, license IN ('{chr(39).join([])}" + "', '".join(X.COMPATIBLE["GPL-2.0"]) + "') AS compatible FROM l WHERE license IS NOT NULL",
)
def compat_matrix_join(t):
    return X.license_conflicts(t.documents, "text", ["doc_id"], "GPL-2.0")


@query(
    "ambiguity_redundancy",
    f"""
    WITH li AS (SELECT conv_id, turn, unnest(string_split(text, E'\\n')) AS t FROM conversations), pl AS (SELECT conv_id, turn, lower(regexp_replace(t, '[À-ɏ]', '_', 'g')) AS t FROM li),
    v AS ({' UNION ALL '.join(f"SELECT conv_id, turn, '{k}' AS kind, len(regexp_extract_all(t, '{p}')) AS n FROM pl" for k, p in X.VAGUE.items())}),
    w AS (SELECT conv_id, turn, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') AS w FROM li), g AS (SELECT conv_id, turn, regexp_replace(lower(unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS phrase FROM w),
    r AS (SELECT conv_id, turn, phrase, count(*) - 1 AS n FROM g WHERE length(phrase) > 10 GROUP BY ALL HAVING count(*) > 1)
    SELECT conv_id, turn, kind, sum(n)::BIGINT AS findings FROM (SELECT * FROM v UNION ALL SELECT conv_id, turn, 'redundancy', n FROM r) GROUP BY 1, 2, 3 HAVING sum(n) > 0
    """,
)
def ambiguity_redundancy(t):
    keys = ["conv_id", "turn"]
    vague = X.ambiguity(t.conversations, "text", keys).groupBy(*keys, "kind").agg(F.sum("matches").alias("findings"))
    again = X.redundancy(t.conversations, "text", keys).groupBy(*keys).agg(F.lit("redundancy").alias("kind"), F.sum("repeats").alias("findings"))
    return vague.unionByName(again)


TTL = "trim(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))"


@query(
    "headline_score",
    f"""
    WITH h AS (SELECT page_id, regexp_replace({TTL}, '[À-ɏ]', '_', 'g') AS h FROM pages), t AS (SELECT *, regexp_extract_all(lower(h), '[\\p{{L}}\\p{{N}}_]+(?:[-''][\\p{{L}}\\p{{N}}_]+)*') AS t FROM h),
    p AS (SELECT page_id, len(list_filter(t, lambda x: x IN ('{"', '".join(X.POWER)}'))) AS pw, len(list_filter(t, lambda x: x IN ('{"', '".join(X.TRIGGERS)}'))) AS tr, len(list_filter(t, lambda x: x IN ('{"', '".join(X.JARGON)}'))) AS ja, len(t) AS n,
      regexp_matches(h, '\\b\\d+(?:[,\\.]\\d+)?%?\\b') AS nu, regexp_matches(h, '\\b\\d+\\b')::INT + regexp_matches(h, '(?i)\\b(?:in \\d+|within \\d+|\\d+ days?|\\d+ weeks?|\\d+ months?|\\d+ hours?|\\d+ minutes?)\\b')::INT
      + regexp_matches(h, '(?i)\\b(?:how to|step|guide|checklist|strategy|system|framework|formula)\\b')::INT + regexp_matches(h, '\\b\\d+%\\b')::INT AS sg FROM t),
    s AS (SELECT page_id, least(100, pw * 35 + CASE WHEN pw > 0 THEN 10 ELSE 0 END)::INT AS power_words, least(100, tr * 50)::INT AS triggers, CASE WHEN nu THEN 100 ELSE 0 END AS numbers, CASE WHEN n BETWEEN 6 AND 12 THEN 100 WHEN n < 6 THEN greatest(0, 40 + (n - 1) * 12) ELSE greatest(0, 100 - (n - 12) * 10) END::INT AS length,
      least(100, sg * 34)::INT AS specificity, greatest(0, 100 - ja * 30)::INT AS clarity FROM p),
    o AS (SELECT *, round_even(round((power_words * 0.25 + triggers * 0.15 + numbers * 0.15 + length * 0.2 + specificity * 0.15 + clarity * 0.1)::DOUBLE, 7), 0) AS overall FROM s)
    SELECT *, CASE WHEN overall >= 85 THEN 'A' WHEN overall >= 70 THEN 'B' WHEN overall >= 55 THEN 'C' WHEN overall >= 40 THEN 'D' ELSE 'F' END AS grade FROM o
    """,
    digits="overall:0",
)
def headline_score(t):
    title = F.trim(F.replace(F.replace(F.replace(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&")))
    return X.headline_score(t.pages.select("page_id", title.alias("title")), "title", ["page_id"])


def _voice_sql():
    parts = []
    for dim, cats in X.VOICE.items():
        (a, wa), (b, wb) = cats.items()
        parts.append(f"SELECT doc_id, '{dim}' AS dimension, {hit_sql(wa)} AS first_hits, {hit_sql(wb)} AS second_hits, CASE WHEN {hit_sql(wa)} >= {hit_sql(wb)} THEN '{a}' ELSE '{b}' END AS dominant FROM d")
    return " UNION ALL ".join(parts)


@query("voice_profile", f"WITH d AS (SELECT doc_id, lower(text) AS l FROM documents) SELECT * FROM ({_voice_sql()}) WHERE first_hits + second_hits > 0")
def voice_profile(t):
    return X.voice_profile(t.documents, "text", ["doc_id"])


@query(
    "quality_gates",
    f"""
    WITH b AS (SELECT doc_id, {PLAIN} AS text FROM documents), c AS (SELECT doc_id, text, regexp_replace(text, '(?s)\\A---.*?---\\s*', '') AS body, list_transform(regexp_extract_all(text, '(?m)^(#{{1,6}})\\s+.+$', 1), lambda x: length(x)) AS l FROM b),
    g AS (SELECT doc_id, len(list_filter(range(2, len(l) + 1), lambda i: l[i] > l[i - 1] + 1))::INT AS heading_hierarchy,
      len(list_filter(list_transform(string_split_regex(body, '\\n\\s*\\n'), lambda p: trim(p, E' \\t\\n\\r')), lambda p: NOT regexp_matches(p, '^(#|```|\\|)') AND len(list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '')) > 150))::INT AS paragraph_length,
      len(list_filter(regexp_extract_all(text, '!\\[([^\\]]*)\\]\\(', 1), lambda a: trim(a) = ''))::INT AS image_alt_text,
      len(list_filter(string_split(body, E'\\n'), lambda s: NOT regexp_matches(ltrim(s), '^(#|```)') AND regexp_matches(s, '{X.STATISTIC}') AND NOT regexp_matches(s, '{X.SOURCE_MARK}')))::INT AS source_citations,
      CASE WHEN length(trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1))) BETWEEN 50 AND 60 THEN 0 ELSE 1 END AS title_length, 0 AS meta_description, (len(regexp_extract_all(text, '{X.PROMOTION}')) > 1)::INT AS self_promotion, (NOT regexp_matches(text, '{X.FRESH}'))::INT AS freshness FROM c)
    SELECT *, (heading_hierarchy = 0)::INT + (paragraph_length = 0)::INT + (image_alt_text = 0)::INT + (source_citations = 0)::INT + (title_length = 0)::INT + (meta_description = 0)::INT + (self_promotion = 0)::INT + (freshness = 0)::INT AS passed FROM g
    """,
)
def quality_gates(t):
    return X.quality_gates(t.documents, "text", ["doc_id"])


@query("content_score")
def content_score(t):
    """The first line stands in for the title, a frequent word for the keyword; the tests hold a text with known points."""
    return X.content_score(t.documents.withColumn("title", F.substring_index("text", "\n", 1)), "text", "title", "the", ["doc_id"])

TOPIC_WORDS = WORDS.replace("text", "title")


@query(
    "topic_cluster",
    f"""
    WITH RECURSIVE t AS (SELECT page_id AS key, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
    w AS (SELECT DISTINCT key, unnest(list_filter({TOPIC_WORDS}, lambda w: regexp_full_match(w, '[a-z]+') AND length(w) >= 3 AND w NOT IN ({", ".join("'" + x + "'" for x in TF.TOPIC_STOP)}))) AS w FROM t),
    s AS (SELECT DISTINCT key, {STEM} AS stem FROM w), n AS (SELECT key, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.key AS x, b.key AS y, count(*) AS shared FROM s a JOIN s b ON a.stem = b.stem AND a.key <> b.key GROUP BY 1, 2),
    l AS (SELECT x, y FROM p JOIN n a ON a.key = x JOIN n b ON b.key = y WHERE shared / (a.n + b.n - shared) >= 0.15),
    r AS (SELECT key AS k, key AS x FROM t UNION SELECT r.k, l.y FROM r JOIN l ON l.x = r.x)
    SELECT k AS key, min(x) AS cluster FROM r GROUP BY 1
    """,
)
def topic_cluster(t):
    """Clusters of page titles."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return topics.topic_clusters(topics.title_stems(t.pages.select("page_id", title.alias("title")), "page_id", "title"))
