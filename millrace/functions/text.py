"""Text column helpers. Patterns are written so that Java and RE2 read them alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the keyword search tokens.
SEARCH_STOP = (
    "the a an and or but if then so to of in on at for by with from is are was were be been being this that these "
    "those it its as we you they their our us i not no yes do does did will would can could should about into than "
    "out up down over under also"
).split()
# Stop words of the answer-evaluation tokens.
EVAL_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall "
    "can to of in for on with at by from as into through during before after above below up down out off over under "
    "again further then once here there when where why how all each few more most other some such no nor not only own "
    "same so than too very just and but if or because until while it this that these those i you he she we they"
).split()
# Stop words of the topic stems.
TOPIC_STOP = (
    "a an the and or but in on at to for of with by from is are was were be been how what why when where who which "
    "that this it its do does your our my their we you get make use using used can will should best"
).split()
# Suffixes in the order they are tried.
SUFFIXES = (
    "ization isation ational fulness ousness iveness ingness ations nesses ators ation ating alism ality alize alise "
    "ator ness ment less tion sion ing ers ies ied ily ful ous ive ize ise est ed er ly al ic s"
).split()

#: Token rule -> (pattern, stop words, shortest kept token).
TOKEN_RULES = {
    "alnum": (r"[a-z0-9]+", [], 1),
    "search": (r"[a-z0-9][a-z0-9_\-']+", SEARCH_STOP, 2),
    "eval": (r"[\p{L}\p{N}_]+", EVAL_STOP, 3),
    "alpha": (r"[a-z]+", [], 1),
    "topic": (r"[a-z]+", TOPIC_STOP, 3),
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def tokens(text, rule: str = "alnum") -> Column:
    """Lower-case tokens in text order under one of the token rules."""
    pattern, stop, shortest = TOKEN_RULES[rule]
    if rule in ("alnum", "alpha", "topic"):
        # a run of letters only counts when no other word character touches it
        found = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        found = F.filter(found, lambda w: w.rlike("^" + pattern + "$"))
    else:
        found = F.regexp_extract_all(F.lower(_c(text)), F.lit(pattern), F.lit(0))
    if stop:
        found = F.filter(found, lambda w: ~w.isin(stop))
    if shortest > 1:
        found = F.filter(found, lambda w: F.length(w) >= shortest)
    return found


def white_words(text) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def clean_words(text, stop: Sequence[str] = (), shortest: int = 1) -> Column:
    """Punctuation to blanks, then white-space words without stop words."""
    words = white_words(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}_\s]", " "))
    return F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(list(stop)) if stop else F.length(w) >= shortest)


def sentences(text, rule: str = "after_mark") -> Column:
    """``after_mark``: split on blanks after . ! ?; ``marks``: split on the marks; ``closed``: only parts that end in a mark."""
    c = _c(text)
    if rule == "after_mark":
        parts = F.split(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), r"(?<=[.!?])\s+")
    elif rule == "marks":
        parts = F.split(c, r"[.!?]+")
    else:
        # cut after every run of marks: linear, where a search for "text then mark" rescans an open tail
        parts = F.filter(F.split(c, r"(?<=[.!?])(?![.!?])"), lambda s: s.rlike(r"^[^.!?]") & s.rlike(r"[.!?]$"))
    parts = F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def syllables(word: Column) -> Column:
    """Vowel groups after dropping a final e of words longer than two letters; at least 1."""
    w = F.lower(word)
    bare = F.when(w.endswith("e") & (F.length(w) > 2), F.left(w, F.length(w) - 1)).otherwise(w)
    return F.greatest(F.lit(1), F.regexp_count(bare, F.lit("[aeiou]+")))


def stem(word: Column) -> Column:
    """Cut the first suffix of the ordered list that leaves three letters or more; short words stay."""
    out = None
    for suffix in SUFFIXES:
        n = len(suffix)
        test = word.endswith(suffix) & (F.length(word) >= n + 3)
        cut = F.left(word, F.length(word) - n)
        out = F.when(test, cut) if out is None else out.when(test, cut)
    return F.when(F.length(word) <= 3, word).otherwise(out.otherwise(word))


def bigrams(words: Column) -> Column:
    """Adjacent pairs inside one text."""
    return F.when(
        F.size(words) >= 2,
        F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)),
    ).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; 0 when one side is empty."""
    union = F.size(F.array_union(a, b))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    n = len(needle)
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(n)).cast("int")


def any_of(text: Column, words: Sequence[str]) -> Column:
    """True when one of the literals occurs in the text."""
    test = F.lit(False)
    for w in words:
        test = test | text.contains(w)
    return test


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the literals occur at least once."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(text.contains(w), 1).otherwise(0)
    return total


def estimated_tokens(text, chars_per_token: float = 4.0) -> Column:
    return F.floor(F.length(_c(text)) / F.lit(chars_per_token)).cast("long")


def estimated_cost(token_count: Column, per_thousand: float = 0.01) -> Column:
    return token_count / F.lit(1000.0) * F.lit(per_thousand)


def url_path(url) -> Column:
    """Path without query and fragment, '' when there is none."""
    return F.regexp_extract(_c(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def path_pattern(path: Column) -> Column:
    """Static lower-case segments stay, every other segment becomes {slug}."""
    parts = F.transform(
        path_parts(path),
        lambda p: F.when(p.rlike("^[a-z][-a-z]+$") & (F.length(p) < 30), p).otherwise(F.lit("{slug}")),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def prefixed(columns) -> Column:
    """The columns as one text that can be taken apart again: length, colon and value each, a hyphen for null."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.char_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
