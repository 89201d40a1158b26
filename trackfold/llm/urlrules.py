"""URL rules by hashed expressions: host suffixes and path prefixes, joined on short hash prefixes.

Only DataFrame functions are used.  A URL's expressions are its host suffixes with as many labels as rules' hosts have,
combined with its path prefixes of the lengths that rules' paths have.  Expressions meet rules on the first
``PREFIX`` hex digits of their SHA-256; a hit counts if the whole digests are equal, and the longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits that are joined on, rules that are broadcast at most, and the verdict of a URL that no rule fits.
PREFIX, BROADCAST_RULES, DEFAULT = 8, 100_000, "allow"


def lower_ascii(column):
    """A-Z in lower case, all else as it is."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url):
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; empty for null or without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, verdict, digest, prefix) of (host, path, verdict) rules; a rule stated twice counts once, block before allow."""
    once: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        once[host.lower(), path] = "block" if "block" in (verdict, once.get((host.lower(), path))) else verdict
    rows = spark.createDataFrame([(h + p, len(h), v) for (h, p), v in once.items()], "rule string, host_chars int, rule_verdict string")
    return rows.withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))


def with_verdict(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced, all others stay.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins, of equally long
    ones that with the longer host.  Null URLs and URLs without ``://`` have empty host and path.  Repeated rows are
    judged one by one.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    base = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    if not rules:
        return base.select("__row.*", F.col("__host").alias("host"), F.col("__path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    suffixes = F.array_distinct(F.array(*[F.substring_index("__host", ".", -k) for k in labels]))
    prefixes = F.array_distinct(F.array(*[F.substring("__path", 1, n) for n in lengths]))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("text"), F.length(s).alias("chars")))))
    spread = base.withColumn("__id", F.monotonically_increasing_id()).withColumn("__e", F.explode(expressions))
    spread = spread.withColumn("__digest", F.sha2("__e.text", 256)).withColumn("__prefix", F.substring("__digest", 1, PREFIX))
    table = rule_table(spark, rules)
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    met = spread.join(table, F.col("__prefix") == F.col("prefix"), "left")
    sure = (F.col("digest") == F.col("__digest")) & (F.col("__e.chars") == F.col("host_chars"))
    # the rows of a page are neighbours, so the partial aggregation leaves one row for each before the exchange
    best = F.max(F.when(sure, F.struct(F.length("rule").alias("n"), F.col("host_chars").alias("h"), F.col("rule").alias("rule"), F.col("rule_verdict").alias("verdict"))))
    judged = met.groupBy("__id").agg(F.first("__row").alias("__row"), F.first("__host").alias("host"), F.first("__path").alias("path"), best.alias("__best"))
    return judged.select("__row.*", "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """The pages that are not blocked, with their own columns."""
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), F.col(url).alias("url"))
    return with_verdict(packed, rules).where("verdict <> 'block'").select("page.*")
