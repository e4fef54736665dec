"""URL filter: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

Every distinct (host, path) is expanded into the expressions that a rule could be filed under: each suffix of the host at a
label boundary, joined with each prefix of the path that ends in a slash (and the empty one). Rules are filed under their host
and their path up to its last slash. The two meet on the first bytes of SHA-256 of the expression; the full digest, host and
path are then compared, so that a collision of prefixes never decides. Of the rules that fit, the longest wins.

Defined cases: a null url, or one without "://", has an empty host and path; repeated urls are judged once and joined back;
rules that agree in length are ranked by host length, then block before allow, then by text; rules with a null host are
ignored, a null path counts as empty. No rules: every url gets the default verdict. Input columns of the same names as the
output's are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_fresh

#: Hex digits of the digest that the join is on, as short lists of a public safe-browsing service have (4 bytes).
PREFIX_HEX = 8
#: Rules of up to so many bytes, with their digests, are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _directory(path: Column) -> Column:
    """The path up to its last slash; without one, nothing."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _suffixes(host: Column, most_labels: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    n = F.least(F.size(labels), most_labels)
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))


def _prefixes(path: Column, most_slashes: Column) -> Column:
    parts = F.split(path, "/", -1)
    n = F.least(F.size(parts) - 1, most_slashes)
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rules: host, path, verdict (all string)."""
    spark = pages.sparkSession
    rules = (
        rules.where(F.col("host").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .withColumn("r_expression", F.concat("r_host", F.lit("\n"), _directory(F.col("r_path"))))
        .withColumn("digest", F.sha2("r_expression", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    # Scalars of the rule set bound the expansion of every url; deeper expressions cannot meet a rule.
    bounds = rules.agg(F.count("*").alias("n"), F.sum(2 * (F.octet_length("r_host") + F.octet_length("r_path")) + 200).alias("bytes"), F.max(F.size(F.split("r_host", r"\.", -1))).alias("labels"), F.max(F.size(F.split("r_path", "/", -1)) - 1).alias("slashes")).first()
    keyed = with_fresh(pages, {"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if not bounds["n"]:
        return with_fresh(keyed, {"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    expressions = (
        keyed.select(F.col("host").alias("u_host"), F.col("path").alias("u_path"))
        .distinct()
        .withColumn("suffix", F.explode(_suffixes(F.col("u_host"), F.lit(bounds["labels"]))))
        .withColumn("prefix", F.explode(_prefixes(F.col("u_path"), F.lit(bounds["slashes"]))))
        .withColumn("u_digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256))
        .select("u_host", "u_path", "u_digest", F.substring("u_digest", 1, PREFIX_HEX).alias("short"))
    )
    fits = (
        expressions.join(F.broadcast(rules) if bounds["bytes"] <= BROADCAST_BYTES else rules, "short")
        .where(F.col("u_digest") == F.col("digest"))
        .where((F.col("u_host") == F.col("r_host")) | F.col("u_host").endswith(F.concat(F.lit("."), F.col("r_host"))))
        .where(F.col("u_path").startswith(F.col("r_path")))
    )
    length = F.length("r_host") + F.length("r_path")
    best = fits.groupBy("u_host", "u_path").agg(
        F.max(F.struct(length.alias("l"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best")
    )
    joined = keyed.join(best, (F.col("host") == F.col("u_host")) & (F.col("path") == F.col("u_path")), "left")
    return with_fresh(joined, {"rule": F.col("best.rule"), "verdict": F.coalesce("best.verdict", F.lit(default))}).drop("u_host", "u_path", "best")
