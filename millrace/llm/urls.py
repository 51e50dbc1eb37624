"""URL rules looked up by their rarest literal token; only fetched rules run their regular expressions.

DataFrame functions only. A rule states tokens that every URL it fits must hold; of these, the one that the
given URLs hold least often is its entry in the index. The distinct tokens of a URL fetch candidate rules by an equi
join, so a URL meets few rules however many there are, and a frequent token fetches only rules that have no rarer one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words of a host that mark adverts, gambling, pills and spam, and paths of logins and programs.
HOST_WORDS = ("ads", "adserver", "banner", "bets", "betting", "casino", "doubleclick", "jackpot", "loans", "phishing", "pills", "poker", "popunder", "porn", "slots", "spam", "torrent", "tracker", "viagra", "warez", "xxx")
BLOCKED_PATHS = ((r"/wp-login\.php$", ("wp", "login", "php")), (r"/cgi-bin/", ("cgi", "bin")), (r"\.exe$", ("exe",)), (r"\.apk$", ("apk",)))

RULE_SCHEMA = "name string, pattern string, tokens array<string>, verdict string, weight int, listed boolean"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _quoted(text: str) -> str:
    """A literal inside a regular expression, without engine-specific quoting."""
    return "".join(c if c.isalnum() or c in "/-_" else f"[{c}]" for c in text)


def listed_rule(host: str, path: str, verdict: str) -> tuple:
    """A rule for a host and its subdomains, on paths that start with ``path``; longer rules win."""
    tokens = [t for t in host.split(".") if t.isascii() and t.isalnum()] + [t for t in path.split("/")[1:-1] if t.isascii() and t.isalnum()]
    return host + path, f"^([^/]*[.])?{_quoted(host)}{_quoted(path)}", [_lower(t) for t in tokens], verdict, len(host + path), True


def _lower(t: str) -> str:
    return t.translate(str.maketrans(UPPER, LOWER))


def pattern_rules() -> list[tuple]:
    """The method's own rules: what they fit is blocked, everything else allowed."""
    hosts = [(f"host word {w}", f"^([^/]*[.-])?{w}[.-]", [w], "block", 0, False) for w in HOST_WORDS]
    return hosts + [(f"path {p}", p, list(tokens), "block", 0, False) for p, tokens in BLOCKED_PATHS]


def rule_table(spark: SparkSession, rules: Sequence[tuple]) -> DataFrame:
    """Rules as rows; a rule needs a token, as it could not be looked up else."""
    for r in rules:
        if not r[2]:
            raise ValueError(f"rule {r[0]} has no literal token")
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(_ascii_lower(c), "[^a-z0-9]+"), lambda t: t != ""))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: ``key``, ``host``, ``path``, ``rule``, ``verdict``.

    The longest listed rule that fits gives ``rule`` and ``verdict``; without one, ``rule`` is null and the
    verdict is ``block`` if any pattern rule fits, ``allow`` else. Rules of equal length go by name. A null URL
    or one without ``://`` has empty host and path and is allowed. Repeated rows are each judged alike; null keys stay.
    """
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    parts = pages.select(
        F.col(key).alias("__key"), F.xxhash64(key, url).alias("__row"),
        F.coalesce(_ascii_lower(F.regexp_extract(after, "^[^/?#]*", 0)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    target = F.concat("host", "path")
    held = parts.select("__row", target.alias("target"), F.explode(_tokens(target)).alias("token"))
    wanted = rules.select("name", F.explode("tokens").alias("token"))
    seen = held.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(seen, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
    index = rules.join(rarest.select("name", F.col("r.token").alias("token")), "name").drop("tokens")
    fits = held.join(index, "token").where(F.expr("regexp_like(target, pattern)"))
    best = F.max(F.when(F.col("listed"), F.struct("weight", "name", "verdict")))
    found = fits.groupBy("__row").agg(best.alias("best"), F.max(F.when(~F.col("listed"), F.col("verdict"))).alias("method"))
    out = parts.join(found, "__row", "left")
    return out.select(F.col("__key").alias(key), "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", "method", F.lit("allow")).alias("verdict"))
