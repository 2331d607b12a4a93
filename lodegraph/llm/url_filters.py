r"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every URL matching it must contain. The index holds each
rule once, under the token that the fewest rules have. A URL's tokens fetch the candidate rules by an equality join and
only those rules run their regular expressions. The rule of the greatest weight that fits wins (of host-and-path rules the
longest), of equal weights the one whose name and then verdict is greater; rules of `weight` 0 decide only where no other
does and are not named; a URL that nothing fits gets `default`. `parsed` reads rules from a list in the common syntax of ad
blockers.

Every distinct URL is judged once. The rule index is broadcast only while it has at most `broadcast` rows, and is
joined by shuffle beyond (adaptive execution then splits hot tokens). Rules without a token of their own are tried on
every URL.

Null URLs and those without "://" have an empty host and path, fit no host-and-path rule and still get a verdict. URLs of
any length are judged whole. Repeated rows stay repeated, null ids pass, an empty table gives none. Columns of the input
named like the new ones are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.common import set_aside

BROADCAST_RULES = 10_000
#: Characters of tokens (capitals are lowered first); the same at the boundaries of word rules and in the index.
INSIDE = "a-z0-9_-"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = f"[{INSIDE}]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    #: Java regular expression over "host" + "path", the host lower-cased.
    pattern: str
    #: Literal tokens of every URL that fits.
    tokens: tuple[str, ...]
    weight: int


def host_rule(verdict: str, rule: str) -> Rule:
    """From `host/path`: fits the host and its subdomains where the path starts so."""
    host, _, path = rule.partition("/")
    tokens = tuple(t for t in host.lower().split(".") if t)
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?\Q{host.lower()}\E\Q/{path}\E", tokens, len(rule))


def word_rule(verdict: str, word: str) -> Rule:
    """Fits where a whole token of the host or path is `word`."""
    return Rule("", verdict, rf"(?i)(?<![{INSIDE}])\Q{word}\E(?![{INSIDE}])", (word.lower(),), 0)


def _tokens(pattern: str, starts: bool, ends: bool) -> tuple[str, ...]:
    """Tokens that are whole in whatever fits a pattern of *, ^ and literals: on each side a literal that is no part of
    tokens, a separator, or an end that the pattern is tied to."""
    found = []
    for m in re.finditer(TOKEN, pattern.lower()):
        left = starts if m.start() == 0 else pattern[m.start() - 1] != "*"
        right = ends if m.end() == len(pattern) else pattern[m.end()] != "*"
        if left and right:
            found.append(m.group())
    return tuple(dict.fromkeys(found))


def parsed(lines: Iterable[str]) -> list[Rule]:
    """Rules of a list: `||host^path` (a host and its subdomains), `|` at either end (tied to it), `*` (anything), `^` (a
    separator or the end), `@@` before (an exception: allow), `/.../` (a regular expression). They are matched, whatever
    the case, with host and path, without scheme and query; options after `$` are not supported and their lines are left
    out, as are comments (`!`, `#`), headers and blank lines. Exceptions weigh more than what blocks; else longer rules do."""
    out = []
    for raw in lines:
        line = raw.strip()
        name, allow = line, line.startswith("@@")
        line = line.removeprefix("@@")
        if not line or line[0] in "![#" or "##" in line or re.search(r"\$[a-z~]", line):
            continue
        weight = len(line) + (1 << 20) * allow
        verdict = "allow" if allow else "block"
        if len(line) > 2 and line[0] == "/" == line[-1]:
            out.append(Rule(name, verdict, f"(?i){line[1:-1]}", (), weight))
            continue
        hosted, tied = line.startswith("||"), line.endswith("|")
        body = line.removeprefix("||").removesuffix("|") if hosted else line.removesuffix("|")
        start = hosted or body.startswith("|")
        body = re.sub(r"^\|?(?:[a-z]+://)?", "", body) if not hosted else body
        cut = {"*": ".*", "^": f"(?:[^.%{INSIDE}]|$)"}
        pattern = "".join(cut.get(c, re.escape(c)) for c in body)
        before = r"^(?:[^/]*\.)?" if hosted else "^" if start else ""
        out.append(Rule(name, verdict, f"(?i){before}{pattern}{'$' if tied else ''}", _tokens(body, start, tied), weight))
    return out


#: What judges URLs that no host-and-path rule fits.
WORD_RULES = tuple(word_rule("block", w) for w in ("cheap-pills", "spam-farm", "casino", "xxx", "porn"))


def host(url: str | Column) -> Column:
    rest = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: str | Column) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def rule_index(spark: SparkSession, rules: list[Rule]) -> tuple[DataFrame, int]:
    """(token, name, verdict, pattern, weight), a row for each rule under its rarest token, and the number of rows."""
    seen = Counter(t for r in rules for t in set(r.tokens))
    rows = [(min(r.tokens, key=lambda t: (seen[t], -len(t), t)) if r.tokens else "", r.name, r.verdict, r.pattern, r.weight) for r in rules]
    return spark.createDataFrame(rows, "token string, name string, verdict string, pattern string, weight int"), len(rows)


def with_verdicts(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", broadcast: int = BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule (null where none fits) and verdict."""
    index, n = rule_index(df.sparkSession, rules)
    df, restored = set_aside(df, ("__url",))
    index = F.broadcast(index) if n <= broadcast else index
    distinct = df.select(F.col(url).alias("__url")).distinct().select("__url", host("__url").alias("__host"), path("__url").alias("__path"))
    where = F.concat("__host", "__path")
    tokens = F.array_distinct(F.regexp_extract_all(F.translate(where, UPPER, LOWER), F.lit("(" + TOKEN + ")"), F.lit(1)))
    tokens = F.concat(F.array(F.lit("")), tokens)  # the empty token fetches rules without tokens
    fetched = distinct.select("__url", where.alias("__where"), F.explode(tokens).alias("token")).join(index, "token")
    fits = fetched.where(F.expr("rlike(__where, pattern)"))
    best = fits.groupBy("__url").agg(F.max(F.struct("weight", F.struct("name", "verdict").alias("is"))).alias("__best"))
    judged = distinct.join(best.withColumnRenamed("__url", "__key"), F.col("__url").eqNullSafe(F.col("__key")), "left").select(
        F.col("__url"),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.when(F.col("__best.weight") > 0, F.col("__best.is.name")).alias("rule"),
        F.coalesce("__best.is.verdict", F.lit(default)).alias("verdict"),
    )
    kept = df.drop("host", "path", "rule", "verdict")
    return restored(kept.join(judged, kept[url].eqNullSafe(judged["__url"]), "left").drop("__url"))
