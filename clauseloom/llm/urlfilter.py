"""URL rules by host suffix and path prefix, matched as hashed expressions.

A rule names a host, which stands for itself and its subdomains, and the start of a path.
Each URL is expanded into expressions, every suffix of its host at a dot with every
prefix of its path whose length some rule has; rules and expressions meet in an
equi-join on the first four bytes of a digest, the whole digest confirms, and the longest
rule that fits decides (of equally long ones the longer host, then a block). Different
URLs with one host and path are judged once.

Defined cases: a null URL or one without ``://`` has an empty host and path, which no
rule fits; a URL no rule fits gets the default verdict; repeated rows are judged alike;
null ids stay; with no rules every URL gets the default; empty tables give empty results;
other columns go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are sent to all executors at most; more are joined by shuffle.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    ascii_lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(ascii_lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their expression, digest and rank; the strongest of equal ones stays."""
    text = F.concat("host", "path")
    known = rules.select(text.alias("rule"), "verdict", F.length("host").alias("host_length"), F.length("path").alias("path_length"),
                         F.sha2(text, 256).alias("digest"))
    # a block of the same expression outranks an allow
    known = known.groupBy("rule", "digest", "host_length", "path_length").agg(F.max("verdict").alias("verdict"))
    return known.withColumn("short", F.substring("digest", 1, 8)).withColumn(
        "strength", F.struct(F.length("rule").alias("a"), F.col("host_length").alias("b"), (F.col("verdict") == "block").alias("c")))


def expressions(host: Column, path: Column, lengths: Column) -> Column:
    """array<struct<host, path>>: host suffixes at dots x path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict to the rows; columns of these names are replaced."""
    host, path = host_and_path(F.col(url))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    table = rule_table(rules)
    # one row; its array is as long as the longest rule path at most
    lengths = table.agg(F.collect_set("path_length").alias("lengths"))
    few = table.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    urls = pages.select("host", "path").groupBy("host", "path").agg(F.lit(1).alias("one")).crossJoin(F.broadcast(lengths))
    expanded = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), F.col("lengths"))).alias("expression"))
    expanded = expanded.select("host", "path", "expression", F.sha2("expression", 256).alias("whole")).withColumn("short", F.substring("whole", 1, 8))
    hits = expanded.join(F.broadcast(table) if few else table, "short").where(F.col("whole") == F.col("digest"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct("strength", "rule", "verdict")).alias("__best"))
    best = best.select(F.col("host").alias("__best_host"), F.col("path").alias("__best_path"), "__best")
    return (pages.join(best, (F.col("host") == F.col("__best_host")) & (F.col("path") == F.col("__best_path")), "left")
            .withColumn("rule", F.col("__best.rule")).withColumn("verdict", F.coalesce("__best.verdict", F.lit(default)))
            .drop("__best_host", "__best_path", "__best"))
