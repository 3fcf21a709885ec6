"""Operator 11, URL filters: rules are indexed by their rarest literal token; a URL's tokens fetch candidate rules, and only those run their regular expressions.

Two kinds of rules. A place rule is a host and the beginning of a path; it fits the host, its subdomains and all paths that begin so, and the longest one decides.
A pattern rule is written as filter lists write them: `||` stands for the beginning of a label of the host, `^` for a character that is no letter, digit,
`_`, `-`, `.` or `%` or for the end, `*` for anything, a leading `@@` for an exception. Patterns decide where no place rule does: an exception allows, any other match blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents

# The contract's place rules, longest match wins.
PLACES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# The query's own list of patterns for adult, gambling, drug, spam and advertising hosts and paths.
PATTERNS = (
    "||adult.", "||adult-", "||porn.", "||porn-", "||xxx.", "||xxx-", "||sex-", "||escort-", "||casino.", "||casino-", "||poker-", "||bets.", "-bets.", "||betting-", "-casino.",
    "||pills.", "-pills.", "||viagra-", "||pharma-", "||spam.", "||spam-", "-spam.", "||linkfarm.", "||link-farm.", "||ads.", "||ads-", "||adserver.", "||tracker.", "-tracker.", "||doorway-",
    "/banner/ads/", "/affiliate^", "/popunder^", "^wp-login.php^", "/login?redirect=*", "@@||adult-education.", "@@||sex-education.", "@@||ads-txt.",
)
#: A rule list up to this many bytes is broadcast; beyond it the index is joined by a shuffle.
BROADCAST_BYTES = 4_000_000
#: No more than this many tokens count as hot and have their rules copied, so the list of them is small at any size.
HOT_TOKENS, HOT_ROWS = 1000, 100_000
_HOST, _PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
_LABEL, _SEPARATOR = r"^(?:[^/?#]*\.)?", r"(?:[^a-z0-9_.%\-]|$)"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "rule string, kind string, verdict string, regex string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    """A rule as text, its kind, verdict and regular expression, and the literal tokens that every URL it matches must have."""

    rule: str
    kind: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def _literals(text: str, open_left: bool, open_right: bool) -> list[str]:
    """Letter and digit runs of a literal that are whole tokens in any URL it matches: a run at an open end may go on there."""
    runs = [("".join(g), word) for word, g in groupby(text, lambda c: c.isascii() and c.isalnum())]
    last = len(runs) - 1
    return [run.lower() for k, (run, word) in enumerate(runs) if word and not (open_left and k == 0) and not (open_right and k == last)]


def place_rule(host: str, path: str, verdict: str) -> Rule:
    """Matched against lower-case host and path as it is."""
    return Rule(host + path, "place", verdict, _LABEL + re.escape(host + path), tuple(_literals(host.lower() + path, False, True)))


def pattern_rule(text: str) -> Rule:
    """Matched against the lower-case rest of the URL behind ://, host, path, query and fragment."""
    body = text.removeprefix("@@")
    anchored = body.startswith("||")
    parts = re.split(r"([*^])", body.removeprefix("||").lower())
    regex, tokens = _LABEL if anchored else "", []
    for k, part in enumerate(parts):
        if part == "*":
            regex += ".*"
        elif part == "^":
            regex += _SEPARATOR
        elif part:
            bound_left, bound_right = (anchored if k == 0 else parts[k - 1] == "^"), k + 1 < len(parts) and parts[k + 1] == "^"
            regex += re.escape(part)
            tokens += _literals(part, not bound_left, not bound_right)
    return Rule(text, "pattern", "allow" if body != text else "block", "(?s)" + regex, tuple(tokens))


def rules(places=PLACES, patterns=PATTERNS) -> list[Rule]:
    return [place_rule(*p) for p in places] + [pattern_rule(p) for p in patterns]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _CAPITALS, _SMALL)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, _CAPITALS, _SMALL), F.lit("[a-z0-9]+"), F.lit(0)))


def _small(found: DataFrame, size: int) -> DataFrame:
    return F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("merge")


def index(urls: DataFrame, found: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rules under their rarest token ('' for a rule without one, which every URL fetches), and how many copies the rules of a hot token have.

    Tokens are counted over all distinct URLs; a token that none has counts 0, so its rules never run.
    """
    wanted = found.select(F.explode("tokens").alias("token")).distinct()
    every = urls.select(F.explode(F.array_append(_tokens("tail"), "")).alias("token"))
    counts = every.join(_small(wanted.union(urls.sparkSession.createDataFrame([("",)], "token string")), size), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(HOT_ROWS, total // HOT_TOKENS + 1)
    hot = counts.where(F.col("n") > share).select("token", F.ceil(F.col("n") / F.lit(share)).cast("int").alias("copies"))
    each = found.select("rule", "kind", "verdict", "regex", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    ranked = each.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("rule", "kind", "verdict", "regex").agg(F.min(F.struct("n", "token")).alias("best")).select("rule", "kind", "verdict", "regex", "best.token")
    return rarest, hot


def judge(pages: DataFrame, found: list[Rule] | DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Host, path, deciding place rule and verdict of every URL. found: rules, or a table of them (columns of RULES) that may be of any size.

    Each distinct URL is judged once: its tokens fetch rules through the index (a hot token's rules are copied and its URLs dealt among the copies, a rule list
    of a proven size is broadcast), candidates run their expressions, and verdicts join the pages again.

    Defined results: null URLs and those without :// have empty host and path and are matched by nothing, so they are allowed; equal URLs fare alike; place rules
    of equal length go by their text; null ids are carried; other columns are ignored; an empty table gives no rows; without rules all is allowed.
    Returns the id, host, path, rule, verdict.
    """
    spark = pages.sparkSession
    if isinstance(found, DataFrame):
        size = found.select(F.sum(F.length("rule") + F.length("regex") + 64)).first()[0] or 0
    else:
        size = sum(len(r.rule) + len(r.regex) + 64 for r in found)
        found = spark.createDataFrame([(r.rule, r.kind, r.verdict, r.regex, list(r.tokens)) for r in found], RULES)
    rows = pages.select(F.col(id_column).alias("_id"), F.col(url_column).cast("string").alias("_url"))
    urls = rows.where(F.instr("_url", "://") > 0).select("_url").distinct()
    urls = urls.select("_url", F.concat(host(F.col("_url")), path(F.col("_url"))).alias("site"), F.regexp_extract("_url", r"(?s)^.*?://(.*)$", 1).alias("tail"))
    rarest, hot = index(urls, found, size)
    copies = rarest.join(F.broadcast(hot), "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    fetch = urls.withColumn("token", F.explode(F.array_append(_tokens("tail"), ""))).join(F.broadcast(hot), "token", "left")  # at most HOT_TOKENS rows
    fetch = fetch.withColumn("part", F.pmod(F.xxhash64("_url"), F.coalesce("copies", F.lit(1))).cast("int"))
    text = F.when(F.col("kind") == "place", F.col("site")).otherwise(F.translate("tail", _CAPITALS, _SMALL))
    hits = fetch.join(_small(copies, size), ["token", "part"]).where(F.rlike(text, F.col("regex")))
    longest = F.max(F.when(F.col("kind") == "place", F.struct(F.length("rule").alias("size"), F.col("rule"), F.col("verdict"))))
    of = lambda verdict: F.coalesce(F.max((F.col("kind") == "pattern") & (F.col("verdict") == verdict)), F.lit(False))
    judged = hits.groupBy("_url").agg(longest.alias("place"), of("allow").alias("excepted"), of("block").alias("blocked"))
    out = rows.join(judged, "_url", "left")
    verdict = F.when(F.col("place").isNotNull(), F.col("place.verdict")).when(F.col("blocked") & ~F.col("excepted"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(F.col("_id").alias(id_column), host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), F.col("place.rule").alias("rule"), verdict.alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages"), rules())


def _sql() -> str:
    """All patterns against all URLs, without tokens or index."""
    quote = lambda x: x.replace("'", "''")
    listed = ", ".join(f"('{quote(r.regex)}', '{r.verdict}')" for r in rules(()))
    places = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in PLACES)
    return f"""
WITH u AS (SELECT page_id, url, coalesce(instr(url, '://'), 0) AS place FROM pages),
t AS (SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS tail FROM u),
s AS (SELECT page_id, tail, translate(regexp_extract(tail, '^[^/?#]*'), '{_CAPITALS}', '{_SMALL}') AS host, regexp_extract(tail, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM t),
places(h, p, v) AS (VALUES {places}),
hit AS (SELECT page_id, max(struct_pack(size := length(h || p), rule := h || p, verdict := v)) AS best
        FROM s JOIN places ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
patterns(x, v) AS (VALUES {listed}),
m AS (SELECT page_id, bool_or(v = 'allow') AS excepted, bool_or(v = 'block') AS blocked
      FROM s JOIN patterns ON tail <> '' AND regexp_matches(translate(tail, '{_CAPITALS}', '{_SMALL}'), x) GROUP BY page_id)
SELECT s.page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN blocked AND NOT excepted THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN hit ON s.page_id = hit.page_id LEFT JOIN m ON s.page_id = m.page_id
"""


SQL = {"op11_url_filters": _sql()}
QUERIES = {"op11_url_filters": op11_url_filters}
