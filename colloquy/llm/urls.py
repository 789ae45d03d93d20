"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

A rule is (host, path, verdict). It fits its host and all subdomains where the url's path starts with the rule's path; of
several the longest wins, of equally long ones the one that blocks, then the smaller string. Everything is DataFrame
functions:

1. Distinct urls are expanded into expressions host suffix + path prefix. Suffixes are cut at dots. Prefixes are cut where a
   rule path can end: after each slash, or at a length that some rule path without a closing slash has. Both are limited to the
   most labels and slashes that any rule has, so a hostile url gives no more expressions than the rules can use.
2. Expressions meet rules in an equality join on the first 32 bits of their SHA-256; a pair counts only if the
   digests agree in full.
3. The best rule of each url goes back to its rows.

Very common expressions (`com/` is one of every third url) are one row only after the distinct step, and `salts` copies of the rules let
several tasks share the join on one expression.

Defined results: a null url or one without `://` has an empty host and path; no rule fits it. An empty rule table leaves every
verdict to `default`. Repeated rows keep one result each. Other columns of the input are kept, unless their name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8
NEW = ("host", "path", "rule", "verdict")


def host_of(url: Column) -> Column:
    """After the first `://` up to a slash, question mark, hash or the end; A-Z in lower case; empty without `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, labels: int, slashes: int, lengths: list[int]) -> Column:
    """Array of (expression, digest) for one url."""
    parts = F.split(host, r"\.", -1)
    last = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), last), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    folders = F.split(path, "/", -1)
    deep = F.least(F.size(folders) - 1, F.lit(slashes))
    closed = F.when(deep >= 1, F.transform(F.sequence(F.lit(1), deep), lambda n: F.concat(F.array_join(F.slice(folders, 1, n), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    open_ = F.array(*(F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    prefixes = F.array_distinct(F.array_compact(F.concat(closed, open_)))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", salts: int = 8) -> DataFrame:
    """All columns of pages, and host, path, rule (null where none fits) and verdict.

    rules: host, path, verdict (allow or block); null hosts or paths are left out.
    """
    rules = rules.where("host is not null and path is not null and verdict in ('allow', 'block')").select("host", "path", "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of equal rules the one that blocks
    # The shape of the rules: two numbers and the distinct lengths of open-ended rule paths (at most the longest path).
    shape = rules.agg(
        F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.max(F.size(F.split("path", "/", -1)) - 1).alias("slashes"),
        F.sort_array(F.collect_set(F.when(~F.col("path").endswith("/"), F.char_length("path")))).alias("lengths"),
    ).head()
    keyed = rules.select(F.concat("host", "path").alias("rule"), "verdict", F.sha2(F.concat("host", "path"), 256).alias("rule_digest"))
    keyed = keyed.select("*", F.substring("rule_digest", 1, PREFIX_DIGITS).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    parsed = pages.select(*(c for c in pages.columns if c.lower() not in NEW), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = parsed.where("host <> ''").select("host", "path").distinct()
    expanded = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shape["labels"] or 0, shape["slashes"] or 0, list(shape["lengths"] or []))).alias("expression"))
    hashed = expanded.withColumn("digest", F.sha2("expression", 256)).withColumn("key", F.substring("digest", 1, PREFIX_DIGITS))
    hashed = hashed.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int"))
    hits = hashed.join(keyed, (hashed["key"] == keyed["key"]) & (hashed["salt"] == keyed["salt"])).where("digest = rule_digest and expression = rule")
    # Longest first; of equal length block before allow, then the string itself.
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), F.col("verdict"), F.col("rule"))).alias("best"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(*(c for c in parsed.columns if c not in NEW), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
