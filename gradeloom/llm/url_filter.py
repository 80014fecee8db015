"""Verdicts on urls by many pattern rules, of which each url meets only a few.

Every rule needs some whole tokens (runs of a-z and 0-9) in a url. It is filed
under the one of them that is rarest in the table's urls. The tokens of a url
fetch the rules filed under them, and only these run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

#: Host and path, verdict. They hold on the host, its subdomains and all paths that begin alike.
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Subjects that a text corpus leaves out, as they name their sites. ``^`` is anything but a letter or digit, or an end.
BLOCKED_WORDS = (
    "adult", "porn", "porno", "sex", "xxx", "nude", "escort", "escorts", "webcam", "hentai",
    "casino", "casinos", "bet", "bets", "betting", "gambling", "poker", "slots", "jackpot", "lottery",
    "pill", "pills", "viagra", "cialis", "spam", "phishing", "malware", "warez", "torrent", "torrents",
    "ad", "ads", "adserver", "adservice", "banner", "banners", "track", "tracker", "tracking", "clickbait",
)
PATTERN_RULES = tuple((f"^{word}^", "block") for word in BLOCKED_WORDS)

#: Which verdict wins: a host rule, then a pattern that allows, then one that blocks.
BY_HOST, ALLOWED, BLOCKED = 2, 1, 0


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    rank: int
    regex: str
    tokens: tuple[str, ...]


def host_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the url's path begins with the rule's."""
    host, _, path = text.partition("/")
    host, path = host.lower(), f"/{path}"
    tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", f"{host}{path}".lower())
    return Rule(text, verdict, BY_HOST, rf"^[^/]*\.{_quoted(host)}{_quoted(path)}", tuple(tokens))


def pattern_rule(text: str, verdict: str) -> Rule:
    """``*`` any characters, ``^`` no letter or digit or an end, ``|`` at either end the url's end, ``||`` a host label.

    Everything else stands for itself, whatever its case. Only tokens with
    something other than a letter, digit or ``*`` on either side are whole
    tokens of every url that fits.
    """
    lower = text.lower()
    start, rest = "", lower
    if rest.startswith("||"):
        start, rest = r"://(?:[^/?#]*\.)?", rest[2:]
    elif rest.startswith("|"):
        start, rest = "^", rest[1:]
    stop = r"\z" if rest.endswith("|") else ""
    rest = rest.removesuffix("|")
    special = {"*": "(?s:.*)", "^": r"(?:^|[^a-z0-9]|\z)"}
    regex = start + "".join(special.get(c) or _quoted(c) for c in rest) + stop
    return Rule(text, verdict, ALLOWED if verdict == "allow" else BLOCKED, regex, tuple(re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", lower)))


def _quoted(text: str) -> str:
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", text)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; empty where the url is null or has no ``://``."""
    known = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.char_length(rest) + 4)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise("")
    return F.when(known, ascii_lower(host)).otherwise(""), F.when(known, path).otherwise("")


def _tokens(urls: DataFrame) -> DataFrame:
    """One row per url and different token."""
    return urls.select("*", F.explode(F.array_distinct(F.regexp_extract_all("lower", F.lit("[a-z0-9]+"), 0))).alias("token"))


def rule_index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rules by the token they are filed under; the empty token for rules that need no whole token."""
    spark = urls.sparkSession
    needed = sorted({t for r in rules for t in r.tokens})
    words = materialise(spark.createDataFrame([(t,) for t in needed], "token string"))
    found = _tokens(urls.select("lower")).join(words, "token", "left_semi").groupBy("token").count()
    rows = [(i, r.text, r.verdict, r.rank, r.regex, list(r.tokens) or [""]) for i, r in enumerate(rules)]
    schema = "rule_id int, rule_text string, verdict string, rank int, regex string, tokens array<string>"
    filed = spark.createDataFrame(rows, schema).select("*", F.explode("tokens").alias("token")).drop("tokens")
    order = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token")
    rarest = filed.join(found, "token", "left").groupBy("rule_id", "rule_text", "verdict", "rank", "regex").agg(
        F.min(order).alias("least")
    )
    return materialise(rarest.select("rule_text", "verdict", "rank", "regex", F.col("least.token").alias("token")))


def winning_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rule that decides each different url; urls that no rule fits are missing."""
    index = rule_index(urls, rules)
    tokens = _tokens(urls.withColumn("subject", F.concat(F.lit("."), "host", "path")))
    if any(not r.tokens for r in rules):
        tokens = tokens.unionByName(urls.select("*", F.concat(F.lit("."), "host", "path").alias("subject"), F.lit("").alias("token")))
    fetched = tokens.join(index, "token")
    text = F.when(F.col("rank") == BY_HOST, F.col("subject")).otherwise(F.col("lower"))
    fits = fetched.where(F.rlike(text, F.col("regex")))
    winner = F.max(F.struct("rank", F.char_length("rule_text").alias("length"), "rule_text", "verdict")).alias("winner")
    return fits.groupBy("url").agg(winner).select("url", "winner.rank", "winner.rule_text", "winner.verdict")


def judge(
    pages: DataFrame, host_rules: Sequence[tuple[str, str]] = HOST_RULES,
    pattern_rules: Sequence[tuple[str, str]] = PATTERN_RULES, otherwise: str = "allow",
) -> DataFrame:
    """page_id, host, path, the host rule that fits (else null), the verdict, and the pattern that decided it.

    Of several host rules the longest wins (of equally long ones the greatest
    in byte order). Without one, a pattern that allows wins over one that
    blocks, and a url that no rule fits gets ``otherwise``, also a null or empty
    one. One row per row of ``pages``: repeated rows are judged alike, and each
    different url once, however many pages a host or url has. Long urls are read
    whole, an empty table gives no rows, further columns are not read.
    """
    spark = pages.sparkSession
    rules = [*(host_rule(*r) for r in host_rules), *(pattern_rule(*r) for r in pattern_rules)]
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url")
    urls = materialise(rows.select("url").where("url IS NOT NULL").distinct())
    parsed = urls.select("url", host.alias("host"), path.alias("path"), ascii_lower(F.col("url")).alias("lower"))
    if rules:
        winners = materialise(winning_rules(parsed, rules))
    else:
        winners = spark.createDataFrame([], "url string, rank int, rule_text string, verdict string")
    by_host = F.col("rank") == BY_HOST
    return rows.join(winners, "url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), F.when(by_host, F.col("rule_text")).alias("rule"),
        F.coalesce("verdict", F.lit(otherwise)).alias("verdict"), F.when(~by_host, F.col("rule_text")).alias("pattern"),
    )
