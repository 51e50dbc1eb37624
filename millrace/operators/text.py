"""Text scores and scans over document tables. Whole texts, array functions, no per-row Python."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import numeric as N
from millrace.functions import text as X

# Word lists and patterns of the text scores.
FILLERS = (
    "very really just actually basically literally honestly totally absolutely definitely certainly obviously clearly quite rather somewhat fairly pretty simply truly genuinely essentially"
).split()
NOT_ADVERBS = "family early only likely nearly really daily weekly monthly yearly friendly lovely lonely lively elderly costly".split()
PARTICIPLES = (
    "known written built made done seen given taken brought thought found put set cut read let hit hurt cost led felt kept left meant sent spent stood told wore won beat lost broke chose drove flew froze grew hid rang rode rose ran sank sang spoke swore swam threw woke wrote"
).split()
PASSIVE = r"\b(?:was|were|is|are|been|being|be|am)\s+(?:\w+ed|" + "|".join(PARTICIPLES) + r")\b"
AI_PHRASES = [
    "in today's digital landscape", "in today's fast-paced", "it's worth noting that", "it is important to note", "delve into", "dive deep into", "leverage", "game-changer", "game changer",
    "unlock the potential", "unlock the power", "harness the power", "at the end of the day", "in conclusion", "in summary", "navigating the complexities", "a comprehensive guide",
    "seamlessly integrate", "robust solution", "cutting-edge", "state-of-the-art", "empower you to", "take your .* to the next level", "in the realm of", "tapestry of", "multifaceted",
    "it's crucial to", "paramount", "foster a .* environment", "elevate your",
]
AI_WORDS = [
    "delve", "delve into", "delves", "delving", "landscape", "crucial", "vital", "pivotal", "leverage", "leveraging", "leveraged", "robust", "comprehensive", "holistic", "foster", "fosters", "fostering",
    "facilitate", "facilitates", "facilitating", "navigate", "navigating", "ensure", "ensures", "ensuring", "utilize", "utilizing", "utilizes", "furthermore", "moreover", "innovative", "cutting-edge",
    "seamless", "seamlessly", "empower", "empowers", "empowering", "streamline", "streamlines", "streamlining", "cultivate", "cultivating", "paradigm", "ecosystem", "synergy", "in conclusion", "in summary", "to summarize",
]
HEDGES = [
    "it is important to note", "it's important to note", "it should be noted", "it is worth mentioning", "it's worth mentioning", "it goes without saying", "needless to say", "in many cases", "in most cases",
    "in certain cases", "in most instances", "in many instances", "generally speaking", "for the most part", "this may vary", "results may differ", "one might argue", "it can be argued", "there are various",
    "there are many", "it is crucial to", "it's crucial to",
]
PASSIVE_LOOSE = [r"\b(?:is|are|was|were|be|been|being)\s+(?:being\s+)?\w+ed\b", r"\b(?:can|could|should|would|may|might|must)\s+be\s+\w+ed\b"]
POSITIVE = "great awesome excellent amazing love best perfect fantastic wonderful brilliant outstanding superb".split()
NEGATIVE = "bad terrible awful horrible hate worst useless broken crash bug slow disappointing frustrating".split()
ISSUES = ["crash", "bug", "error", "broken", "not working", "doesnt work", "freezes", "slow", "laggy", "glitch", "problem", "issue", "fail"]
REQUESTS = ["wish", "would be nice", "should add", "need", "want", "hope", "please add", "missing", "lacks", "feature request"]
KEYWORD_STOP = "the and for with this that from have but not you all can are was were been".split()
THEME_STOP = "the and for with this that from have app apps very really just but not you".split()
PAIN = ["frustrat", "annoy", "difficult", "hard", "confus", "slow", "problem", "issue", "struggle", "challeng", "pain", "waste", "manual", "repetitive", "tedious", "boring", "time-consuming", "complicated", "complex", "unclear", "wish", "need", "want"]
DELIGHT = ["love", "great", "awesome", "amazing", "perfect", "easy", "simple", "quick", "fast", "helpful", "useful", "valuable", "save", "efficient", "convenient", "intuitive", "clear"]
ASK = ["would be nice", "wish", "hope", "want", "need", "should", "could", "would love", "if only", "it would help", "suggest", "recommend", "idea", "what if", "have you considered"]
EXAMPLES = ["for example", "for instance", "such as", "like ", "e.g.", "case study", "imagine", "consider", "let's say", "here's", "specifically"]
CLOSINGS = ["conclusion", "summary", "final", "start ", "next step", "action"]
# Personal data patterns with category and risk.
PII = {
    "email": (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "contact_data", "medium"),
    "ip_address": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "online_identifier", "medium"),
    "phone_number": (r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", "contact_data", "medium"),
    "credit_card": (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "financial_data", "high"),
    "iban": (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}\b", "financial_data", "high"),
    "german_id": (r"\b[A-Z0-9]{9}\b", "government_id", "high"),
    "date_of_birth": (r"\b(?:birth|dob|geboren|geburtsdatum)\b", "demographic_data", "medium"),
    "health_data": (r"\b(?:diagnosis|treatment|medication|patient|medical|health|symptom|disease)\b", "special_category", "critical"),
    "biometric": (r"\b(?:fingerprint|facial|retina|biometric|voice_print)\b", "special_category", "critical"),
    "religion": (r"\b(?:religion|religious|faith|church|mosque|synagogue)\b", "special_category", "critical"),
}
# Key patterns with severity.
SECRETS = {
    "openai_key": ("critical", r"\bsk-[A-Za-z0-9]{20,}\b"),
    "github_pat": ("critical", r"\bghp_[A-Za-z0-9]{20,}\b"),
    "aws_access_key_id": ("critical", r"\bAKIA[0-9A-Z]{16}\b"),
    "slack_token": ("high", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    "private_key_block": ("high", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    "generic_secret_assignment": ("high", r"(?i)\b(?:secret|token|password|passwd|api[_-]?key)\b\s*[:=]\s*['\"]?[A-Za-z0-9_\-/.+=]{8,}"),
    "jwt_like": ("medium", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
}
# Signature families of prompt injection with severity.
INJECTIONS = {
    "direct_role_override": ("critical", [
        r"ignore (?:all |your |previous |prior )?(?:instructions|rules|constraints|system prompt)", r"disregard (?:your |all |previous )?(?:instructions|training|guidelines)",
        r"forget (?:your |all |previous )?(?:instructions|training|role|purpose)", r"you are now (?:a|an) (?:different|new|unrestricted|jailbroken)",
        r"act as (?:a|an) (?:unrestricted|uncensored|unfiltered|jailbroken)", r"your (?:new|true|real) (?:instructions|purpose|role|goal) (?:is|are)"]),
    "indirect_injection": ("high", [
        r"(?:the |this )?(?:document|article|webpage|note|file) (?:says|states|contains|instructs)", r"(?:hidden|invisible|secret) (?:instruction|command|directive)", r"<(?:system|admin|root|override)>",
        r"\[INST\].*\[/INST\]", r"###(?:system|instruction|override)###"]),
    "jailbreak_persona": ("high", [
        r"(?:DAN|STAN|DUDE|KEVIN|AIM|ANTI-DAN|BasedGPT)", r"jailbroken? (?:mode|version|ai|llm)", r"developer (?:mode|override|unlock)", r"no (?:restrictions|limits|guardrails|safety|filters)",
        r"(?:evil|dark|unrestricted|god) mode"]),
    "system_prompt_extraction": ("high", [
        r"(?:repeat|print|show|output|reveal|tell me|display|write out) (?:your |the )?(?:system prompt|instructions|initial prompt|context window)",
        r"what (?:are|were) (?:your|the) (?:instructions|system prompt|initial instructions)", r"(?:summarize|describe) (?:your|the) (?:system|initial) (?:message|prompt|instructions)"]),
    "tool_abuse": ("critical", [
        r"(?:call|invoke|execute|run|use) (?:the |a )?(?:tool|function|api|plugin|action) (?:to |and )?(?:delete|drop|remove|truncate|format)", r"(?:tool|function|api).*?(?:exfiltrate|send|upload|post|leak)",
        r"(?:bypass|circumvent|avoid) (?:the |tool )?(?:approval|confirmation|safety|check)"]),
    "data_poisoning_marker": ("high", [
        r"(?:training data|fine.?tuning|rlhf).*(?:backdoor|trojan|poisoned|malicious)", r"(?:inject|insert|embed).*(?:training|dataset|corpus).*(?:payload|trigger|pattern)"]),
}
# License text patterns in the order they are tried, and the compatible pairs (project, dependency).
LICENSES = {
    "MIT": ["MIT License", "Permission is hereby granted, free of charge", 'THE SOFTWARE IS PROVIDED "AS IS"'],
    "Apache-2.0": [r"Apache License, Version 2\.0", "Licensed under the Apache License", r"http://www\.apache\.org/licenses/LICENSE-2\.0"],
    "GPL-2.0": [r"GNU GENERAL PUBLIC LICENSE\s+Version 2", "This program is free software.*GPL.*version 2", r"http://www\.gnu\.org/licenses/gpl-2\.0"],
    "GPL-3.0": [r"GNU GENERAL PUBLIC LICENSE\s+Version 3", "This program is free software.*GPL.*version 3", r"http://www\.gnu\.org/licenses/gpl-3\.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "Redistributions of source code must retain", "Neither the name.*may be used to endorse"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Redistributions of source code must retain.*Redistributions in binary form"],
}
LICENSE_FALLBACK = [("MIT", ["MIT", "PERMISSION IS HEREBY GRANTED"]), ("Apache-2.0", ["APACHE LICENSE", "VERSION 2.0"]), ("GPL-2.0", ["GPL", "VERSION 2"]), ("GPL-3.0", ["GPL", "VERSION 3"])]
PERMISSIVE = ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0"]
COMPATIBLE = {
    "MIT": [*PERMISSIVE, "LGPL-2.1", "LGPL-3.0"],
    "Apache-2.0": [*PERMISSIVE, "LGPL-3.0", "GPL-3.0", "AGPL-3.0"],
    "GPL-2.0": ["MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC", "LGPL-2.1", "GPL-2.0"],
    "GPL-3.0": [*PERMISSIVE, "LGPL-3.0", "GPL-3.0", "AGPL-3.0"],
    "AGPL-3.0": [*PERMISSIVE, "LGPL-3.0", "GPL-3.0", "AGPL-3.0"],
}
# Vague wording by kind.
VAGUE = {
    "verb": r"\b(?:analyze|process|handle|deal with)\b", "subjective": r"\b(?:good|nice|appropriate|suitable)\b", "open_list": r"\b(?:etc\.|and so on|and more)\b",
    "condition": r"\b(?:if needed|as necessary|when appropriate)\b", "quantity": r"\b(?:some|several|many|few|various)\b",
}


def _matches(text: Column, pattern: str, flags: str = "(?U)") -> Column:
    return F.regexp_count(text, F.lit(flags + pattern))


def _sum_over(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _spread(lengths: Column) -> Column:
    """Population standard deviation of an array of numbers."""
    n = F.size(lengths)
    mean = _sum_over(lengths) / n
    return F.sqrt(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def _word_lengths(parts: Column, least: int) -> Column:
    """Words per part, short parts left out."""
    return F.filter(F.transform(parts, lambda s: F.size(X.white_words(s))), lambda n: n >= least)


def _ladder(x: Column, steps: Sequence[tuple[float, float]], other: float, *, below: bool = False) -> Column:
    out = None
    for bound, points in steps:
        test = x < bound if below else x >= bound
        out = F.when(test, points) if out is None else out.when(test, points)
    return out.otherwise(other)


def readability(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Flesch ease and grade with sentence, word and syllable means; texts without words are left out."""
    words = X.tokens(text, "alpha")
    base = df.select(*keys, text, words.alias("__w"), X.sentences(text, "after_mark").alias("__s")).where(F.size("__w") > 0)
    n, s = F.size("__w"), F.greatest(F.size("__s"), F.lit(1))
    base = base.select(
        *keys, n.cast("long").alias("words"), s.cast("long").alias("sentences"), (n / s).alias("avg_sentence"), (_sum_over(F.transform("__w", F.length)) / n).alias("avg_word"),
        (_sum_over(F.transform("__w", X.syllables)) / n).alias("avg_syllables"),
    )
    ease = N.clamp(206.835 - 1.015 * F.col("avg_sentence") - 84.6 * F.col("avg_syllables"))
    grade = F.greatest(F.lit(0.0), 0.39 * F.col("avg_sentence") + 11.8 * F.col("avg_syllables") - 15.59)
    out = base.withColumn("ease", ease).withColumn("grade", grade)
    steps = [(90, "Very Easy"), (80, "Easy"), (70, "Fairly Easy"), (60, "Standard"), (50, "Fairly Difficult"), (30, "Difficult")]
    return out.withColumn("label", N.threshold_label(F.round("ease", 1), steps, "Very Confusing"))


def style_counts(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Passive share of sentences, adverbs and fillers per hundred words."""
    words = X.tokens(text, "alpha")
    base = df.select(*keys, F.col(text).alias("__t"), words.alias("__w"), F.greatest(F.size(X.sentences(text, "after_mark")), F.lit(1)).alias("__s")).where(F.size("__w") > 0)
    adverbs = F.filter(F.regexp_extract_all(F.lower("__t"), F.lit(r"(?U)\b\w+ly\b"), F.lit(0)), lambda w: ~w.isin(NOT_ADVERBS))
    fillers = F.filter("__w", lambda w: w.isin(FILLERS))
    n = F.size("__w")
    return base.select(
        *keys, _matches(F.lower("__t"), PASSIVE).alias("passive"), F.size(adverbs).alias("adverbs"), F.size(fillers).alias("fillers"), (_matches(F.lower("__t"), PASSIVE) / F.col("__s") * 100).alias("passive_pct"),
        (F.size(adverbs) / n * 100).alias("adverb_density"), (F.size(fillers) / n * 100).alias("filler_density"),
    )


def _body(text: str) -> Column:
    """Prose without front matter, headings, code and link targets."""
    c = F.regexp_replace(text, r"(?s)\A---.*?---\s*", "")
    c = F.regexp_replace(c, r"(?dm)^#+\s+.*$", "")
    c = F.regexp_replace(c, r"(?s)```.*?```", "")
    c = F.regexp_replace(c, r"`[^`]+`", "")
    return F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")


def burstiness(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Population variation of sentence lengths to a 0-100 score; 50 under five sentences."""
    lengths = _word_lengths(X.sentences(_body(text), "closed"), 3)
    base = df.select(*keys, lengths.alias("__l"))
    base = base.withColumn("sentences", F.size("__l").cast("long")).withColumn("cv", F.when(F.size("__l") > 0, N.safe_divide(_spread(F.col("__l")), _sum_over(F.col("__l")) / F.size("__l"))))
    cv = F.col("cv")
    prob = F.when(cv >= 0.5, F.greatest(F.lit(0.0), 30 - (cv - 0.5) * 60)).when(cv >= 0.35, 30 + (0.5 - cv) * 130).otherwise(50 + (0.35 - cv) * 250)
    score = F.when(F.col("sentences") < 5, 50.0).otherwise(N.clamp(prob))
    return base.select(*keys, "sentences", F.when(F.col("sentences") < 5, 0.0).otherwise(cv).alias("cv"), score.alias("burstiness"))


def sliding_ttr(df: DataFrame, text: str, keys: Sequence[str], window: int = 200) -> DataFrame:
    """Type-token ratio over half-overlapping windows; 50 under fifty words."""
    words = F.filter(F.regexp_extract_all(F.lower(F.regexp_replace(text, r"(?s)\A---.*?---\s*", "")), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2)
    base = df.select(*keys, words.alias("__w")).withColumn("words", F.size("__w").cast("long"))
    w = F.least(F.lit(window), F.size("__w"))
    starts = F.sequence(F.lit(0), F.size("__w") - w, F.floor(w / 2).cast("int"))
    ratios = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice("__w", i + 1, w))) / w)
    mean = F.when(F.col("words") >= 50, _sum_over(ratios) / F.size(ratios)).otherwise(0.0)
    base = base.withColumn("ttr", mean)
    t = F.col("ttr")
    prob = F.when(t >= 0.60, F.greatest(F.lit(0.0), 25 - (t - 0.60) * 150)).when(t >= 0.45, 25 + (0.60 - t) * 330).otherwise(75 + (0.45 - t) * 250)
    return base.select(*keys, "words", "ttr", F.when(F.col("words") < 50, 50.0).otherwise(N.clamp(prob)).alias("vocabulary"))


def phrase_density(df: DataFrame, text: str, keys: Sequence[str], phrases: Sequence[str] = AI_PHRASES) -> DataFrame:
    """Phrase matches per thousand white-space words, and the score of that density."""
    low = F.lower(F.col(text))
    total = F.lit(0)
    for p in phrases:
        total = total + F.regexp_count(low, F.lit("(?d)" + p))
    words = F.size(X.white_words(text))
    base = df.select(*keys, total.alias("matches"), F.when(words > 0, total / (words / 1000)).otherwise(0.0).alias("density"))
    d = F.col("density")
    return base.withColumn("phrases", F.when(d <= 2, d * 15).when(d <= 5, 30 + (d - 2) * 20).otherwise(F.least(F.lit(100.0), 90 + (d - 5) * 5)))


def ai_text_score(df: DataFrame, text: str, key: str) -> DataFrame:
    """35% sentence variation, 30% vocabulary, 35% phrases, with the verdict; the parts are rounded to a tenth first."""
    parts = burstiness(df, text, [key, text])
    parts = sliding_ttr(parts, text, [key, text, "burstiness"])
    parts = phrase_density(parts, text, [key, "burstiness", "vocabulary"])
    r = lambda c: N.python_round(c, 1)
    out = parts.select(key, r("burstiness").alias("burstiness"), r("vocabulary").alias("vocabulary"), r("phrases").alias("phrases"))
    score = r(N.clamp(F.col("burstiness") * 0.35 + F.col("vocabulary") * 0.30 + F.col("phrases") * 0.35))
    out = out.withColumn("composite", score)
    return out.withColumn("verdict", N.upto_label("composite", [(20, "LIKELY_HUMAN"), (50, "MIXED")], "LIKELY_AI"))


def humanity_score(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Vocabulary 25, sentence variation 20, passive 20, hedging 15, dashes 10, paragraphs 10."""
    raw, low = F.col(text), F.lower(F.col(text))
    hits = F.lit(0)
    for w in AI_WORDS:
        hits = hits + X.count_of(low, w)
    hedges = F.lit(0)
    for w in HEDGES:
        hedges = hedges + X.count_of(low, w)
    marks = X.sentences(text, "marks")
    lengths = _word_lengths(marks, 3)
    passive = F.lit(0)
    for p in PASSIVE_LOOSE:
        passive = passive + _matches(low, p)
    words = F.greatest(F.lit(1), F.size(F.regexp_extract_all(raw, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))))
    dashes = X.count_of(raw, "—") + X.count_of(raw, "--")
    paras = F.filter(F.split(raw, "\n\n"), lambda p: (F.trim(F.regexp_replace(p, r"\s+", " ")) != "") & ~p.startswith("#"))
    base = df.select(*keys, hits.alias("h"), hedges.alias("g"), lengths.alias("l"), (passive / F.greatest(F.size(marks), F.lit(1))).alias("p"), (dashes / (words / 100)).alias("d"), _word_lengths(paras, 0).alias("q"))
    h, g, p, d = F.col("h"), F.col("g"), F.col("p"), F.col("d")
    vocab = F.when(h == 0, 25).when(h <= 2, 20).when(h <= 5, 14).when(h <= 10, 8).when(h <= 15, 3).otherwise(0)
    vary = F.when(F.size("l") < 3, 10).otherwise(_ladder(_spread(F.col("l")), [(12, 20), (8, 16), (5, 10), (3, 5)], 0))
    pas = _ladder(p, [(0.1, 20), (0.2, 16), (0.3, 10), (0.4, 5)], 0, below=True)
    hed = F.when(g == 0, 15).when(g == 1, 12).when(g == 2, 8).when(g == 3, 4).otherwise(0)
    dash = _ladder(d, [(0.5, 10), (1.5, 8), (3, 5), (5, 2)], 0, below=True)
    sd = _spread(F.col("q"))
    para = _ladder(sd, [(30, 5), (15, 3), (5, 1)], 0) + F.when(F.exists("q", lambda n: n <= 15), 3).otherwise(0) + F.when(F.exists("q", lambda n: n >= 80) & (sd >= 15), 2).otherwise(0)
    para = F.when(F.size("q") < 3, 5).otherwise(F.least(F.lit(10), para))
    out = base.select(*keys, vocab.alias("vocabulary"), vary.alias("variance"), pas.alias("passive"), hed.alias("hedging"), dash.alias("dashes"), para.alias("paragraphs"))
    out = out.withColumn("humanity", sum([F.col(c) for c in ("vocabulary", "variance", "passive", "hedging", "dashes", "paragraphs")], F.lit(0)))
    return out.withColumn("label", N.threshold_label("humanity", [(85, "human"), (70, "mostly human"), (50, "mixed"), (30, "robotic")], "fingerprint"))


def keyword_density(df: DataFrame, text: str, keys: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Substring occurrences of each keyword over white-space words, in percent and as a fraction."""
    low = F.lower(F.col(text))
    items = F.array(*[F.struct(F.lit(w).alias("keyword"), X.count_of(low, w.lower()).alias("occurrences")) for w in words])
    out = df.select(*keys, F.size(X.white_words(low)).alias("words"), F.inline(items))
    return out.withColumn("density_pct", F.when(F.col("words") > 0, F.col("occurrences") / F.col("words") * 100).otherwise(0.0)).drop("words")


def corpus_keywords(df: DataFrame, text: str, top: int = 50, shortest: int = 3) -> DataFrame:
    """Most frequent words and word pairs of the whole corpus; pairs do not cross texts. Ties by term."""
    w = X.clean_words(text, KEYWORD_STOP, shortest)
    terms = df.select(F.explode(F.concat(w, X.bigrams(w))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.orderBy(F.desc("n"), "term").limit(top)


def theme_mining(df: DataFrame, text: str, least: int = 3) -> DataFrame:
    """Words and pairs with at least ``least`` mentions."""
    w = X.clean_words(text, THEME_STOP, 4)
    kinds = F.concat(F.transform(w, lambda x: F.struct(F.lit("word").alias("kind"), x.alias("term"))), F.transform(X.bigrams(w), lambda x: F.struct(F.lit("phrase").alias("kind"), x.alias("term"))))
    return df.select(F.inline(kinds)).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("mentions")).where(F.col("mentions") >= least)


def sentiment(df: DataFrame, text: str, rating: str) -> DataFrame:
    """60% rating, 40% keyword balance over ten; substrings count. Classes beyond +-0.3."""
    low = F.lower(F.col(text))
    by_text = (X.hits(low, POSITIVE) - X.hits(low, NEGATIVE)) / 10.0
    score = N.clamp((F.col(rating) - 3) / 2.0 * 0.6 + by_text * 0.4, -1, 1)
    out = df.withColumn("sentiment_score", score)
    return out.withColumn("sentiment", F.when(F.col("sentiment_score") > 0.3, "positive").when(F.col("sentiment_score") < -0.3, "negative").otherwise("neutral"))


def sentiment_trend(scored: DataFrame, period: str) -> DataFrame:
    """Class shares by period."""
    share = lambda k: F.avg((F.col("sentiment") == k).cast("int")) * 100
    return scored.groupBy(period).agg(F.count(F.lit(1)).alias("reviews"), *[share(k).alias(k) for k in ("positive", "neutral", "negative")])


def issue_mining(df: DataFrame, text: str, rating: str, limit: int = 3) -> DataFrame:
    """Issue keywords in low ratings with their share of all low reviews."""
    low = df.where(F.col(rating) <= limit)
    words = F.filter(F.array(*[F.when(F.lower(F.col(text)).contains(w), F.lit(w)) for w in ISSUES]), lambda x: x.isNotNull())
    counts = low.select(F.explode(words).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("reviews"))
    total = df.agg(F.count(F.lit(1)).alias("t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("reviews") / F.col("t") * 100).drop("t")


def feature_requests(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Texts that ask for something, with the first request phrase."""
    low, first = F.lower(F.col(text)), None
    for w in REQUESTS:
        first = F.when(low.contains(w), w) if first is None else first.when(low.contains(w), w)
    return df.select(*keys, first.alias("phrase")).where("phrase IS NOT NULL")


def interview_signals(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Sentences with a pain, delight or request word, by interview."""
    s = df.select(*keys, F.explode(X.sentences(text, "marks")).alias("s")).withColumn("l", F.lower("s"))
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sentences"), F.count_if(X.any_of(F.col("l"), PAIN)).alias("pain"), F.count_if(X.any_of(F.col("l"), DELIGHT)).alias("delight"), F.count_if(X.any_of(F.col("l"), ASK)).alias("requests"),
        F.count_if(F.col("l").rlike(r"\d")).alias("with_numbers"),
    )


def citations(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """DOI, URL, author-year and numbered references, one row per kind and lower-case key and text."""
    c = F.col(text)

    def found(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(F.trim(v)).alias("reference")))

    doi = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)(?:https?://doi\.org/|doi:\s*)(10\.\d{4,}/[^\s,;}\]]+)"), F.lit(1)), lambda v: F.rtrim(v, F.lit(".")))
    url = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)https?://[^\s,;}\])\"'>]+"), F.lit(0)), lambda v: F.rtrim(v, F.lit(".,;)"))), lambda v: ~v.contains("doi.org"))
    author = F.regexp_extract_all(c, F.lit(r"(?:^|\(|\s)([A-Z][a-z]+(?:\s(?:&|and)\s[A-Z][a-z]+)?(?:\set\sal\.?)?\s*\(\d{4}\))"), F.lit(1))
    ref = F.regexp_extract_all(c, F.lit(r"(?dm)^(\[\d+\]\s+.+)$"), F.lit(1))
    rows = F.concat(found("doi", doi), found("url", url), found("author_year", author), found("numbered", ref))
    return df.select(*keys, F.inline(F.array_distinct(rows))).where("reference <> ''")


# ---- scans ------------------------------------------------------------------


def pii_scan(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Matches per text line and pattern, with category and risk."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "__t"))
    items = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(c).alias("category"), F.lit(r).alias("risk"), F.regexp_count("__t", F.lit("(?iU)" + p)).alias("matches")) for n, (p, c, r) in PII.items()])
    return lines.select(*keys, (F.col("line") + 1).alias("line"), F.inline(F.filter(items, lambda x: x["matches"] > 0)))


def secret_scan(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Lines with a key pattern and its severity."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\r\n|[\n\r]")).alias("line", "__t"))
    items = F.array(*[F.when(F.col("__t").rlike("(?U)" + p), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("pattern"))) for n, (s, p) in SECRETS.items()])
    return lines.select(*keys, (F.col("line") + 1).alias("line"), F.inline(F.filter(items, lambda x: x.isNotNull())))


def injection_scan(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """One row per prompt and signature family hit."""
    items = [F.when(F.col(text).rlike("(?id)(?:" + "|".join(f"(?:{p})" for p in ps) + ")"), F.struct(F.lit(n).alias("family"), F.lit(s).alias("severity"))) for n, (s, ps) in INJECTIONS.items()]
    return df.select(*keys, F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def injection_score(findings: DataFrame) -> DataFrame:
    """Families hit over all families, with the findings per family."""
    per = findings.groupBy("family", "severity").agg(F.count(F.lit(1)).alias("prompts"))
    n = per.agg((F.count(F.lit(1)) / float(len(INJECTIONS))).alias("injection_score"))
    return per.crossJoin(F.broadcast(n))


def license_of(text: Column) -> Column:
    """First license whose pattern or fallback words fit, else null."""
    out = None
    for name, patterns in LICENSES.items():
        test = text.rlike("(?id)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(test, name) if out is None else out.when(test, name)
    up = F.upper(text)
    for name, (a, b) in LICENSE_FALLBACK:
        out = out.when(up.contains(a) & up.contains(b), name)
    return out


def license_conflicts(df: DataFrame, text: str, keys: Sequence[str], project: str) -> DataFrame:
    """Detected license against the project's: an unlisted pair is incompatible."""
    rows = df.select(*keys, license_of(F.col(text)).alias("license")).where("license IS NOT NULL")
    pairs = [(p, d) for p, ds in COMPATIBLE.items() for d in ds]
    table = df.sparkSession.createDataFrame(pairs, "project string, license string").withColumn("ok", F.lit(True))
    out = rows.withColumn("project", F.lit(project)).join(F.broadcast(table), ["project", "license"], "left")
    return out.withColumn("compatible", F.coalesce("ok", F.lit(False))).drop("ok")


def ambiguity(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Vague terms by line and kind."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "__t"))
    items = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count("__t", F.lit("(?iU)" + p)).alias("matches")) for k, p in VAGUE.items()])
    return lines.select(*keys, (F.col("line") + 1).alias("line"), F.inline(F.filter(items, lambda x: x["matches"] > 0)))


def redundancy(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Three-word phrases of a line seen before in the same text, with how often."""
    lines = df.select(*keys, F.explode(F.split(text, "\n")).alias("t")).select(*keys, X.white_words("t").alias("w"))
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, F.lit(3)), " "))).otherwise(F.array().cast("array<string>"))
    rows = lines.select(*keys, F.explode(grams).alias("g")).select(*keys, F.regexp_replace(F.lower("g"), r"[^\p{L}\p{N}_\s]", "").alias("phrase"))
    out = rows.where(F.length("phrase") > 10).groupBy(*keys, "phrase").agg((F.count(F.lit(1)) - 1).alias("repeats"))
    return out.where("repeats > 0")



# Headline words, jargon, promotion, and the voice dimensions.
POWER = (
    "now today instantly immediately urgent limited exclusive last hurry deadline expires fast free save proven guaranteed results boost increase grow maximize unlock secret revealed transform master ultimate best top powerful "
    "discover uncover surprising shocking hidden unknown insider hack trick truth experts researchers scientists officially certified award-winning world-class easy simple effortless quick step-by-step foolproof beginner without "
    "avoid stop never mistake fail warning danger worst deadly risky"
).split()
TRIGGERS = (
    "love hate fear hope joy pain anger envy trust doubt regret pride shame relief success failure happiness frustration excitement anxiety lonely powerful confident inspired"
).split()
JARGON = "synergy leverage disruptive paradigm scalable bandwidth ping holistic ecosystem utilize facilitate ideate incentivize stakeholders deliverables actionable bespoke granular".split()
VOICE = {
    "formality": {"formal": ["hereby", "therefore", "furthermore", "pursuant", "regarding"], "casual": ["hey", "cool", "awesome", "stuff", "yeah", "gonna"]},
    "tone": {"professional": ["expertise", "solution", "optimize", "leverage", "strategic"], "friendly": ["happy", "excited", "love", "enjoy", "together", "share"]},
    "perspective": {"authoritative": ["proven", "research shows", "experts agree", "data indicates"], "conversational": ["you might", "let's explore", "we think", "imagine if"]},
}
STATISTIC = r"(?i)\b\d+(?:\.\d+)?%|\$\d+|\d+(?:,\d{3})+|\d+x\b"
SOURCE_MARK = r"(?i)\[(?:source|citation|ref|via|from)\b.*?\]|\(https?://\S+\)"
PROMOTION = r"(?i)\b(?:our product|we offer|sign up|try free|get started|our platform|our solution)\b"
FRESH = r"(?im)^(?:date_?modified|updated|last_updated):\s*\d{4}|(?:updated|modified|reviewed|published).*?\d{4}"


def headline_score(df: DataFrame, headline: str, keys: Sequence[str]) -> DataFrame:
    """Power words 25, triggers 15, numbers 15, length 20, specificity 15, clarity 10, and the grade."""
    h = F.col(headline)
    base = df.select(*keys, h.alias("__h"), F.regexp_extract_all(F.lower(h), F.lit(r"[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"), F.lit(0)).alias("__t"))
    count = lambda words: F.size(F.filter("__t", lambda t: t.isin(list(words))))
    n, p = F.size("__t"), count(POWER)
    has = lambda pattern: F.col("__h").rlike("(?iU)" + pattern).cast("int")
    signals = has(r"\b\d+\b") + has(r"\b(?:in \d+|within \d+|\d+ days?|\d+ weeks?|\d+ months?|\d+ hours?|\d+ minutes?)\b") + has(r"\b(?:how to|step|guide|checklist|strategy|system|framework|formula)\b") + has(r"\b\d+%\b")
    parts = {
        "power_words": F.least(F.lit(100), p * 35 + F.when(p > 0, 10).otherwise(0)), "triggers": F.least(F.lit(100), count(TRIGGERS) * 50), "numbers": F.when(has(r"\b\d+(?:[,\.]\d+)?%?\b") == 1, 100).otherwise(0),
        "length": F.when(n.between(6, 12), 100).when(n < 6, F.greatest(F.lit(0), 40 + (n - 1) * 12)).otherwise(F.greatest(F.lit(0), 100 - (n - 12) * 10)), "specificity": F.least(F.lit(100), signals * 34), "clarity": F.greatest(F.lit(0), 100 - count(JARGON) * 30),
    }
    out = base.select(*keys, *[v.cast("int").alias(k) for k, v in parts.items()])
    weights = {"power_words": 0.25, "triggers": 0.15, "numbers": 0.15, "length": 0.20, "specificity": 0.15, "clarity": 0.10}
    out = out.withColumn("overall", N.python_round(N.weighted_score(weights, bound=False), 0))
    return out.withColumn("grade", N.threshold_label("overall", [(85, "A"), (70, "B"), (55, "C"), (40, "D")], "F"))


def voice_profile(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Keyword hits by voice category and the dominant one of every dimension with a hit."""
    low = F.lower(F.col(text))
    items = []
    for dim, cats in VOICE.items():
        (a, wa), (b, wb) = cats.items()
        na, nb = X.hits(low, wa), X.hits(low, wb)
        items.append(F.when(na + nb > 0, F.struct(F.lit(dim).alias("dimension"), na.alias("first_hits"), nb.alias("second_hits"), F.when(na >= nb, a).otherwise(b).alias("dominant"))))
    return df.select(*keys, F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def quality_gates(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Findings of eight document gates; a gate passes without findings."""
    c = F.col(text)
    base = df.select(*keys, c.alias("__c"), F.regexp_replace(c, r"(?s)\A---.*?---\s*", "").alias("__b"), F.transform(F.regexp_extract_all(c, F.lit(r"(?dm)^(#{1,6})\s+.+$"), F.lit(1)), F.length).alias("__l"))
    skips = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("__l") - 1, F.lit(1))), lambda i: (i < F.size("__l")) & (F.get("__l", i) > F.get("__l", i - 1) + 1)))
    paras = F.filter(F.transform(F.split("__b", r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: ~p.rlike(r"^(#|```|\|)"))
    long = F.size(F.filter(paras, lambda p: F.size(X.white_words(p)) > 150))
    alts = F.size(F.filter(F.regexp_extract_all("__c", F.lit(r"!\[([^\]]*)\]\("), F.lit(1)), lambda a: F.trim(a) == ""))
    lines = F.filter(F.split("__b", "\r\n|[\n\r]"), lambda s: ~F.ltrim(s).rlike(r"^(#|```)") & s.rlike("(?U)" + STATISTIC) & ~s.rlike(SOURCE_MARK))
    title = F.trim(F.regexp_extract("__c", r"(?dm)^#\s+(.+)$", 1))
    desc = F.trim(F.regexp_extract("__c", r"(?dm)^description:\s*[\"']?(.+?)[\"']?\s*$", 1))
    promo = F.regexp_count("__c", F.lit("(?U)" + PROMOTION))
    gates = {
        "heading_hierarchy": skips, "paragraph_length": long, "image_alt_text": alts, "source_citations": F.size(lines), "title_length": F.when(F.length(title).between(50, 60), 0).otherwise(1),
        "meta_description": F.when((desc == "") | F.length(desc).between(150, 160), 0).otherwise(1), "self_promotion": F.when(promo > 1, 1).otherwise(0), "freshness": F.when(F.col("__c").rlike("(?d)" + FRESH), 0).otherwise(1),
    }
    out = base.select(*keys, *[v.cast("int").alias(k) for k, v in gates.items()])
    return out.withColumn("passed", sum([(F.col(g) == 0).cast("int") for g in gates], F.lit(0)))


def content_score(df: DataFrame, text: str, title: str, keyword: str, keys: Sequence[str]) -> DataFrame:
    """Readability, search, structure and engagement at 25 points each, and the grade."""
    c, low = F.col(text), F.lower(F.col(text))
    base = df.select(
        *keys, c.alias("__c"), low.alias("__l"), F.coalesce(F.col(title), F.lit("")).alias("__t"), X.sentences(text, "marks").alias("__s"), X.tokens(text, "alpha").alias("__a"),
        F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("__w"), F.filter(F.transform(F.split(c, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "").alias("__p"),
    )
    vowels = lambda w: F.greatest(F.lit(1), F.when(w.endswith("e") & (F.length(w) > 2), F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - 1)).otherwise(F.regexp_count(w, F.lit("[aeiouy]+"))))
    count = lambda p: F.size(X.white_words(p))
    kw = keyword.lower()
    k, size = kw.split(), len(kw.split())
    # single elements are read by their place: a slice copies the whole array for every word
    here = lambda i: reduce(lambda a, b: a & b, [F.get("__w", i + j) == w for j, w in enumerate(k)], F.lit(True))
    first, last, plain = F.get("__p", 0), F.get("__p", F.size("__p") - 1), F.filter("__p", lambda p: ~p.startswith("#"))
    samples = F.lit(0)
    for e in EXAMPLES:
        samples = samples + X.count_of(F.col("__l"), e)
    # what a ladder asks for several times is a column, computed once
    facts = {
        "alpha": F.greatest(F.lit(1), F.size("__a")), "sentences": F.greatest(F.lit(1), F.size("__s")), "syllables": _sum_over(F.transform("__a", vowels)), "lengths": _word_lengths(F.col("__s"), 3), "words": F.size("__w"),
        "seen": F.when(F.size("__w") >= size, F.size(F.filter(F.sequence(F.lit(0), F.size("__w") - size), here))).otherwise(0), "early": F.array_join(F.slice("__w", 1, 100), " ").contains(kw), "titled": F.lower("__t").contains(kw), "title": F.length("__t"),
        "first": first, "first_words": count(first), "last": F.lower(last), "last_words": count(last), "plain": F.transform(plain, count), "h2": F.regexp_count("__c", F.lit(r"(?dm)^## .+")), "h2s": F.regexp_count("__c", F.lit(r"(?dm)^## ")),
        "asks": X.count_of(F.col("__c"), "?"), "numbers": F.regexp_count("__c", F.lit(r"(?U)\b\d+(?:\.\d+)?%?\b")), "samples": samples, "items": F.regexp_count("__c", F.lit(r"(?dm)^\s*[-*•]\s+.+|^\s*\d+\.\s+.+")),
    }
    base = base.select(*keys, *[v.alias(f"__{name}") for name, v in facts.items()])
    at = {name: F.col(f"__{name}") for name in facts}
    ease = N.python_round(N.clamp(206.835 - 1.015 * at["alpha"] / at["sentences"] - 84.6 * at["syllables"] / at["alpha"]), 1)
    density = at["seen"] * size / F.greatest(F.lit(1), at["words"]) * 100
    mean = F.when(F.size(at["plain"]) > 0, _sum_over(at["plain"]) / F.size(at["plain"]))
    spread = F.when(F.size(at["lengths"]) > 1, F.least(F.lit(10), F.floor(_spread(at["lengths"])))).otherwise(0)
    base = base.select("*", ease.alias("__ease"), density.alias("__density"), mean.alias("__mean"), spread.alias("__spread"))
    read = F.least(F.lit(25), _ladder(F.col("__ease"), [(65, 15), (55, 12), (45, 8), (35, 4)], 0) + F.col("__spread"))
    seo = F.least(
        F.lit(25), F.when(at["titled"], 7).otherwise(0) + F.when(at["early"], 5).otherwise(0) + F.when(F.col("__density").between(0.5, 2.5), 5).when(at["seen"] > 0, 2).otherwise(0)
        + F.when(at["h2"] >= 3, 5).when(at["h2"] >= 1, 2).otherwise(0) + F.when(at["title"].between(30, 65), 3).otherwise(0),
    )
    structure = F.least(
        F.lit(25),
        F.when(at["first"].isNotNull() & ~at["first"].startswith("#"), F.when(at["first_words"].between(30, 200), 7).when(at["first_words"] > 0, 3).otherwise(0)).otherwise(0) + F.when(at["h2s"] >= 4, 8).when(at["h2s"] >= 2, 5).when(at["h2s"] >= 1, 2).otherwise(0)
        + F.when(at["last"].isNotNull(), F.when(X.any_of(at["last"], CLOSINGS) & (at["last_words"] >= 20), 7).when(at["last_words"] >= 30, 4).otherwise(0)).otherwise(0) + F.when(F.col("__mean") <= 80, 3).otherwise(0),
    )
    engage = F.least(
        F.lit(25), F.when(at["asks"] >= 3, 6).when(at["asks"] >= 1, 3).otherwise(0) + F.when(at["numbers"] >= 5, 7).when(at["numbers"] >= 2, 4).when(at["numbers"] >= 1, 2).otherwise(0) + F.when(at["samples"] >= 3, 6).when(at["samples"] >= 1, 3).otherwise(0)
        + F.when(at["items"] >= 5, 6).when(at["items"] >= 2, 3).otherwise(0),
    )
    out = base.select(*keys, read.cast("int").alias("readability"), seo.cast("int").alias("seo"), structure.cast("int").alias("structure"), engage.cast("int").alias("engagement"))
    out = out.withColumn("total", F.col("readability") + F.col("seo") + F.col("structure") + F.col("engagement"))
    return out.withColumn("grade", N.threshold_label("total", [(90, "A+"), (80, "A"), (70, "B"), (60, "C")], "D"))
