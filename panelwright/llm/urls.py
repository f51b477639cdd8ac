"""URL filters: host-suffix and path-prefix expressions meet rules by short hash prefixes, then by full digests.

A rule has a host, a path and a verdict; it fits the urls whose host is its own or a subdomain and whose
path starts with its path.  Of the rules that fit, the longest wins (host and path together, then the
longer host).  Each distinct (host, path) is expanded into the expressions that some rule could equal:
for each pair of label count and path length that rules have, the suffix of so many labels followed by
the prefix of that length.  An expression's SHA-256 meets those of the rules in an equi-join on its first
hex digits; the whole digest then decides.

- Null urls and urls without `://` have an empty host and path and fit no rule; neither does a path that is
  shorter than the rule's.  Without a rule the verdict is `allow`, or `block` where there is no host.
- Rules that repeat a host and path count once, `block` winning; rules without host, path or verdict go.
- Pages of any column may be null or repeat: each row has a row in the result.  No rules, no page: no failure.

Only DataFrame functions; a (host, path) is judged once however often it stands in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import LOWER, UPPER

#: The rules as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Hex digits of a digest that are joined on; shapes of rules that are expanded at most (more are refused aloud).
SHORT, MOST_SHAPES = 8, 4096
#: Up to so many rules (of at most so many characters in all) are broadcast; more are joined by a shuffle, each hash dealt to SALTS tasks.
MOST_RULES, MOST_CHARACTERS, SALTS = 50_000, 8_000_000, 16


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url, both empty without `://`."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(verdict, host, path) of a list of rules."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _keyed(rules: DataFrame, short: int) -> DataFrame:
    """One row for each rule: its text, verdict, digest, the digest's first digits, label count and lengths."""
    given = rules.select(F.col("verdict").cast("string"), lowered(F.col("host").cast("string")).alias("host"), F.col("path").cast("string")).where("host <> '' and path is not null and verdict in ('allow', 'block')")
    one = given.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    text = F.concat("host", "path")
    sha = F.sha2(text.cast("binary"), 256)
    return one.select(text.alias("rule"), "verdict", sha.alias("digest"), F.substring(sha, 1, short).alias("short"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("size"), F.length(text).alias("long"), F.length("host").alias("wide"))


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The array of a url's expressions of the given (label count, path length)s."""
    labels, size = F.size(F.split(host, r"\.")), F.length(path)
    table = F.array(*(F.struct(F.lit(k).alias("labels"), F.lit(n).alias("size")) for k, n in shapes))
    fits = F.filter(table, lambda s: (s["labels"] <= labels) & (s["size"] <= size))
    suffix = lambda s: F.array_join(F.slice(F.split(host, r"\."), -s["labels"], s["labels"]), ".")
    return F.transform(fits, lambda s: F.concat(suffix(s), F.substring(path, F.lit(1), s["size"])))


def best_rules(keys: DataFrame, rules: DataFrame, short: int = SHORT, most_rules: int = MOST_RULES) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path)s that a rule fits, with the longest one."""
    table = _keyed(rules, short)
    shapes = [(r.labels, r.size) for r in table.select("labels", "size").distinct().orderBy("labels", "size").limit(MOST_SHAPES + 1).collect()]
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"the rules have more than {MOST_SHAPES} pairs of label count and path length")
    some = F.explode(expressions(F.col("host"), F.col("path"), shapes)) if shapes else F.explode(F.array().cast("array<string>"))
    asked = keys.select("host", "path", some.alias("text")).select("host", "path", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).withColumn("short", F.substring("sha", 1, short))
    n, size = table.agg(F.count("*"), F.coalesce(F.sum("long"), F.lit(0))).first()
    if n <= most_rules and size <= MOST_CHARACTERS:
        met = asked.join(F.broadcast(table), "short")
    else:
        dealt = table.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(dealt, ["short", "salt"])
    won = F.max(F.struct("long", "wide", "rule", "verdict"))
    return met.where("sha = digest").groupBy("host", "path").agg(won.alias("won")).select("host", "path", "won.rule", "won.verdict")


def judge(pages: DataFrame, rules: DataFrame | None = None, short: int = SHORT, most_rules: int = MOST_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rules = rule_table(pages.sparkSession) if rules is None else rules
    best = best_rules(rows.where("host <> ''").select("host", "path").distinct(), rules, short, most_rules)
    other = F.when(F.col("host") == "", "block").otherwise("allow")
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", other).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The rows of pages, with all their columns, whose urls are allowed."""
    host, path = parts(F.col("url"))
    keys = pages.select("url").select(host.alias("host"), path.alias("path")).where("host <> ''").distinct()
    best = best_rules(keys, rule_table(pages.sparkSession) if rules is None else rules).where("verdict = 'block'")
    own_host, own_path = parts(pages["url"])
    return pages.where(own_host != "").join(best, (own_host == best["host"]) & (own_path == best["path"]), "left_anti")
