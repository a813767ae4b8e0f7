"""URL filters: pattern rules found through their rarest literal token.

A rule's literal tokens are runs of letters and digits that the rule bounds on both sides, so each stands whole in every URL the
rule fits. Every rule is filed under that one of its tokens which the fewest URLs hold, counted over all of them. The tokens of a
URL fetch the rules filed under them by a join, and only fetched rules run their regular expression; rules without a token are
fetched by every URL. Which rules fit does not depend on the choice of tokens.

Two kinds of rules:

* host rules ``host/path``: they fit the host and its subdomains if the path starts with the rule's; the longest wins.
* patterns, for URLs that no host rule fits, matched without regard to the case of a-z: ``*`` any characters, ``^`` a separator
  (none of letters, digits, ``_ . % -``) or the end, ``|`` at the start or end that of the URL, ``||`` at the start that of the
  host or of one of its labels. A fitting allow pattern beats all block patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.tables import only, stored

BLOCK, ALLOW = "block", "allow"

# The host rules of the query, as (action, rule).
HOST_RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))

#: The patterns of the query: names of hosts that a corpus does without, and a file that is never content.
PATTERNS = (
    (BLOCK, "||adult-"),
    (BLOCK, "||ads-"),
    (BLOCK, "||casino-"),
    (BLOCK, "||spam-"),
    (BLOCK, "||*-pills."),
    (BLOCK, "||*-bets."),
    (BLOCK, "/wp-login.php^"),
    (ALLOW, "/robots.txt|"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[0-9a-z]+")
RULES = "rule string, kind string, action string, regex string, tokens array<string>"


def _lowered(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def _quoted(text: str) -> str:
    """Literal text as a regular expression that the JVM and others read alike."""
    return "".join(c if re.match(r"[0-9A-Za-z]", c) else f"\\x{{{ord(c):x}}}" for c in text)


def _tokens_in(text: str, open_left: bool, open_right: bool) -> list[str]:
    """Tokens of a literal text that no neighbour can lengthen; an open side is one where any character may follow."""
    found = []
    for m in _TOKEN.finditer(text):
        if not (open_left and m.start() == 0) and not (open_right and m.end() == len(text)):
            found.append(m[0])
    return found


def host_rule(action: str, rule: str) -> tuple[str, str, str, str, list[str]]:
    """A row of RULES; its expression is for host and path, one behind the other."""
    host, slash, path = rule.partition("/")
    if not host or action not in (BLOCK, ALLOW):
        raise ValueError(f"{rule!r} needs a host, {action!r} is block or allow")
    host = _lowered(host)
    tokens = _tokens_in(host, False, False) + _tokens_in(_lowered(slash + path), False, True)
    end = _quoted(slash + path) if slash else "(?:/|$)"
    return rule, "host", action, f"^(?:[^/]*\\.)?{_quoted(host)}{end}", sorted(set(tokens))


def pattern_rule(action: str, pattern: str) -> tuple[str, str, str, str, list[str]]:
    """A row of RULES; its expression is for the whole URL in small letters."""
    if action not in (BLOCK, ALLOW):
        raise ValueError(f"{action!r} is block or allow")
    body = _lowered(pattern)
    start, ends = "", body.endswith("|") and body != "|" and body != "||"
    if body.startswith("||"):
        start, body = "^[^:/?#]+://(?:[^/?#]*\\.)?", body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    body = body[:-1] if ends else body
    pieces = re.split(r"([*^])", body)
    regex, tokens = start, []
    for k, piece in enumerate(pieces):
        if piece == "*":
            regex += "(?s:.*)"
        elif piece == "^":
            regex += "(?:[^0-9a-z_.%-]|$)"
        else:
            regex += _quoted(piece)
            left = pieces[k - 1] == "*" if k else not start
            right = pieces[k + 1] == "*" if k + 1 < len(pieces) else not ends
            tokens += _tokens_in(piece, left, right)
    return pattern, "pattern", action, regex + ("$" if ends else ""), sorted(set(tokens))


def rules_table(
    spark: SparkSession, host_rules: Iterable[Sequence[str]] = HOST_RULES, patterns: Iterable[Sequence[str]] = PATTERNS
) -> DataFrame:
    """Rules given as (action, rule) -> the columns of RULES. Lists of any size may come as a table of that form instead."""
    rows = [host_rule(*r) for r in host_rules] + [pattern_rule(*r) for r in patterns]
    return spark.createDataFrame(rows, RULES)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: from the first ``://`` up to ``/ ? #``, A-Z in small letters, and on up to ``? #``; else both empty."""
    given = F.coalesce(url, F.lit(""))
    at = F.instr(given, "://")
    rest = F.when(at > 0, given.substr(at + 3, F.length(given))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def url_tokens(lowered: Column) -> Column:
    """The distinct tokens of a URL in small letters, and the empty one, which fetches the rules without a token."""
    return F.array_distinct(F.concat(F.split(lowered, "[^0-9a-z]+"), F.array(F.lit(""))))


def token_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``token`` and the columns of RULES: each rule under that of its tokens which the fewest rows of ``urls`` hold."""
    listed = rules.select("rule", "kind", "action", "regex", F.explode_outer("tokens").alias("token")).distinct()
    named = listed.withColumn("token", F.coalesce("token", F.lit("")))
    wanted = named.select("token").distinct()
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    order = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest")
    chosen = named.join(counts, "token", "left").groupBy("rule", "kind", "action", "regex").agg(order)
    return chosen.select(F.col("rarest.token").alias("token"), "rule", "kind", "action", "regex")


def fitting_rules(urls: DataFrame, index: DataFrame) -> DataFrame:
    """``row, rule, kind, action`` of every rule that fits; ``urls`` has ``row, host, path, lowered, tokens``.

    The index is joined by its token; Spark broadcasts it while it is small and splits frequent tokens when it is not.
    """
    subjects = urls.select("row", F.concat("host", "path").alias("place"), "lowered", F.explode("tokens").alias("token"))
    fetched = subjects.join(index, "token")
    fits = F.expr("CASE WHEN kind = 'host' THEN place RLIKE regex ELSE lowered RLIKE regex END")
    return fetched.filter(fits).select("row", "rule", "kind", "action")


def judged_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = ALLOW) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern``: one row per row of ``pages`` (``page_id, url``).

    ``rule`` is the longest fitting host rule (of equally long ones the greater), else null; ``pattern`` the deciding pattern where
    no host rule fits, the first by name, else null; ``default`` is the verdict of URLs that nothing fits. A null URL or one without
    ``://`` has an empty host and path, and patterns see it as it is (null: empty). Repeated rows and rows without an id are judged
    each; an empty table gives an empty table; without rules all have the default. Other columns are ignored.
    """
    spark = pages.sparkSession
    rules = rules_table(spark) if rules is None else rules
    host, path = url_parts(F.col("url"))
    lowered = F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)
    named = only(pages, ["page_id", "url"]).select(
        F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"), lowered.alias("lowered")
    )
    urls = stored(named, "urls")
    with_tokens = urls.withColumn("tokens", url_tokens(F.col("lowered")))
    index = stored(token_index(with_tokens, rules), "rules")
    fits = fitting_rules(with_tokens, index)
    longest = F.max(F.when(F.col("kind") == "host", F.struct(F.length("rule").alias("size"), "rule", "action"))).alias("longest")
    allowed, blocked = (
        F.min(F.when((F.col("kind") == "pattern") & (F.col("action") == a), F.col("rule"))).alias(a) for a in (ALLOW, BLOCK)
    )
    best = fits.groupBy("row").agg(longest, allowed, blocked)
    joined = urls.drop("lowered").join(best, "row", "left")
    free = F.col("longest").isNull()
    by_pattern = F.when(F.col(ALLOW).isNotNull(), ALLOW).when(F.col(BLOCK).isNotNull(), BLOCK).otherwise(default)
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("longest.rule").alias("rule"),
        F.when(free, by_pattern).otherwise(F.col("longest.action")).alias("verdict"),
        F.when(free, F.coalesce(ALLOW, BLOCK)).alias("pattern"),
    )
