"""URL rules by hash prefixes.

A URL is expanded into the host-suffix and path-prefix expressions of the shapes that the rules have. Expressions meet
rules in an equi-join on a short hash prefix; full digests confirm, and among the rules that fit the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of op2: (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules are broadcast up to this number; more are joined by a shuffle, hot expressions salted.
BROADCAST_RULES = 200_000
SALTS = 32


def host_of(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; null or no `://`: empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def prefix(digest: Column) -> Column:
    """The first four bytes of a hexadecimal digest."""
    return F.substring(digest, 1, 8)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of `pages` (page_id, url; other columns are not read).

    `rules` has action (block or allow), host and path, none null. A rule fits its host and all subdomains if the path
    starts with the rule's. The longest rule (host and path, in characters) wins, then the longer host; between equal
    rules block wins. Without a fitting rule the rule is null and the verdict is `default`. Null ids and repeated rows
    are kept as they are. Null urls and those without a host get the default and are joined with nothing, so they never
    meet in one task; a frequent url's join is split. Without rules every page gets the default; without pages there are
    no rows. Urls of any length are read whole; bytes that aren't UTF-8 match no rule that is.

    A url is hashed once for each shape (labels, path length) that it can have; the rules' shapes, of which there are at
    most as many as a host has labels (127) times the rules' path lengths, are held by the driver.
    """
    spark = pages.sparkSession
    rules = rules.where("host <> '' AND path IS NOT NULL AND action IN ('block', 'allow')")
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action"))  # 'block' > 'allow'
    rules = rules.withColumn("rule", F.concat("host", "path")).withColumn("labels", F.size(F.split("host", r"\.")))
    shapes = [(r["labels"], r["n"]) for r in rules.select("labels", F.length("path").alias("n")).distinct().collect()]
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\0"), path), 256)
    rules = rules.select("action", "rule", F.length("host").alias("host_length"), digest(F.col("host"), F.col("path")).alias("full")).withColumn("short", prefix(F.col("full")))
    # Each distinct host and path is judged once.
    asked = split.select("host", "path").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    expressions = F.filter(
        F.array(
            *(
                F.when((F.size(parts) >= k) & (F.length("path") >= n), digest(F.substring_index("host", ".", -k), F.substring("path", 1, n)))
                for k, n in sorted(shapes)
            )
        ),
        lambda x: x.isNotNull(),
    )
    expanded = asked.select("host", "path", F.explode(expressions).alias("full")).withColumn("short", prefix(F.col("full")))
    if rules.count() <= BROADCAST_RULES:
        hits = expanded.join(F.broadcast(rules.withColumnRenamed("full", "rule_full")), "short")
    else:
        salted = rules.withColumnRenamed("full", "rule_full").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = expanded.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    hits = hits.where("full = rule_full")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", "rule", "action")).alias("best"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), "best.rule", "best.action")
    best = best.hint("rebalance")  # an exchange of its own, so that a hot url's join can be split
    out = split.where("host <> ''").join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    out = out.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
    return out.union(split.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
       coalesce((SELECT action FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM s
"""
