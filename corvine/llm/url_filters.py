"""URL filters [native]: pattern rules indexed by their rarest literal token.

Every rule names the literal tokens ([a-z0-9]+ runs) that any URL it matches must hold. The tokens'
document frequencies are counted over the whole table, each rule is filed under its rarest token, the
tokens of a URL fetch the rules filed under them, and only those rules' regular expressions run.

Two kinds of rules: host rules like ``example.net/en/`` (they fit the host, its subdomains and paths
that start with the rule's; the longest wins), and patterns over the lower-cased URL. A host rule
decides first; then any allowing pattern; then any blocking pattern; else the URL is allowed.

Defined results: null URLs and URLs without ``://`` have empty host and path, no rule, and are allowed;
repeated rows are judged one by one; an empty table gives no rows; extra columns of the input are ignored.
The number of rules is bounded (``MAX_RULES``): the index is a literal in the plan, so nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_RULES = 5000

#: The contract's host rules.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class Pattern:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def _words(verdict: str, *words: str) -> list[Pattern]:
    """One rule for each word as a whole token anywhere in the URL."""
    return [Pattern(w, verdict, rf"(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)", (w,)) for w in words]


PATTERNS: tuple[Pattern, ...] = (
    *_words("block", "casino", "poker", "betting", "jackpot", "porn", "xxx", "escort", "viagra", "cialis",
            "torrent", "warez", "crack", "keygen", "malware", "phishing", "doorway", "payday"),
    Pattern("login page", "block", r"://[^?#]*/(?:user/)?login(?:[/?#.]|$)", ("login",)),
    Pattern("sign-up page", "block", r"://[^?#]*/signup(?:[/?#.]|$)", ("signup",)),
    Pattern("cart", "block", r"://[^?#]*/cart/(?:add|checkout)(?:[/?#]|$)", ("cart",)),
    *(Pattern("ad server", "block", rf"://{w}\.[^/]*/", (w,)) for w in ("ads", "adserver", "doubleclick")),
    Pattern("feed click", "block", r"[?&]utm_source=ads(?:&|#|$)", ("utm", "source", "ads")),
    Pattern("session in query", "block", r"[?&]phpsessid=[0-9a-f]{16,}", ("phpsessid",)),
    Pattern("calendar trap", "block", r"/calendar/[0-9]{4}/[0-9]{1,2}(?:[/?#]|$)", ("calendar",)),
    Pattern("search results", "block", r"/search[/]?\?(?:.*&)?q=", ("search", "q")),
    Pattern("deep pager", "block", r"[?&]page=[0-9]{4,}(?:&|#|$)", ("page",)),
    Pattern("archive listing", "block", r"/tag/[^/]+/page/[0-9]+", ("tag", "page")),
    Pattern("raw download", "block", r"/download/[^?#]*\.(?:exe|zip|rar|iso|dmg)(?:[?#]|$)", ("download",)),
    Pattern("encyclopedia", "allow", r"://(?:[^/?#]*\.)?wiki\.[^/]*/", ("wiki",)),
    Pattern("documentation", "allow", r"://(?:[^/?#]*\.)?docs\.[^/]*/", ("docs",)),
    Pattern("responsible gaming", "allow", r"/help/(?:casino|betting|poker)-addiction(?:[/?#.]|$)", ("help", "addiction")),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract cuts them; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)))


def token_frequencies(pages: DataFrame, wanted: list[str]) -> dict[str, int]:
    """How many URLs hold each wanted token, over the whole table; at most ``len(wanted)`` rows come back."""
    url = F.translate(F.coalesce(F.col("url"), F.lit("")), UPPER, LOWER)
    hits = pages.select(F.explode(F.array_intersect(_tokens(url), F.array(*map(F.lit, wanted)))).alias("token"))
    return {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (name of the deciding pattern, else null), n_candidates."""
    if len(host_rules) + len(patterns) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rules = [(rule, verdict, rf"^(?:[^/]*\.)?{re.escape(rule)}", tuple(re.findall("[a-z0-9]+", rule.lower())), True) for verdict, rule in host_rules]
    rules += [(p.name, p.verdict, p.regex, p.tokens, False) for p in patterns]
    df = token_frequencies(pages, sorted({t for r in rules for t in r[3]}))
    index: dict[str, list[int]] = {}
    always = [i for i, r in enumerate(rules) if not r[3]]
    for i, r in enumerate(rules):
        if r[3]:
            index.setdefault(min(r[3], key=lambda t: (df.get(t, 0), t)), []).append(i)

    host, path = split_url(F.col("url"))
    low = F.translate(F.coalesce(F.col("url"), F.lit("")), UPPER, LOWER)
    base = pages.select("page_id", host.alias("host"), path.alias("path"), low.alias("low"))
    base = base.withColumn("hp", F.concat("host", "path"))
    keys = F.array(*map(F.lit, index))
    slots = F.create_map(*[x for k, v in index.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fetched = F.transform(F.array_intersect(_tokens(F.col("low")), keys), lambda t: F.element_at(slots, t))
    base = base.withColumn("cand", F.array_union(F.array_distinct(F.flatten(fetched)), F.array(*map(F.lit, always)) if always else F.array().cast("array<int>")))

    def runs(i: Column) -> Column:
        out = F.lit(False)
        for k, r in enumerate(rules):
            out = F.when(i == k, F.col("hp" if r[4] else "low").rlike(r[2])).otherwise(out)
        return out

    base = base.withColumn("hit", F.filter("cand", runs))
    by_length = sorted(range(len(host_rules)), key=lambda i: -len(rules[i][0]))

    def first(order: list[int]) -> Column:
        out = F.lit(None).cast("int")
        for i in reversed(order):
            out = F.when(F.array_contains("hit", i), i).otherwise(out)
        return out

    allow = [i for i, r in enumerate(rules) if not r[4] and r[1] == "allow"]
    block = [i for i, r in enumerate(rules) if not r[4] and r[1] == "block"]
    base = base.withColumn("h", first(by_length)).withColumn("p", F.when(F.col("h").isNull(), first(allow + block)))
    names, verdicts = F.array(*[F.lit(r[0]) for r in rules]), F.array(*[F.lit(r[1]) for r in rules])
    return base.select(
        "page_id", "host", "path", F.get(names, F.col("h")).alias("rule"),
        F.coalesce(F.get(verdicts, F.coalesce("h", "p")), F.lit("allow")).alias("verdict"),
        F.get(names, F.col("p")).alias("pattern"), F.size("cand").cast("long").alias("n_candidates"),
    )
