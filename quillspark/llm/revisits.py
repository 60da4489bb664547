"""Resolution of not-modified revisits in web archives.

A revisit record (status 304) has no payload: it refers to the latest earlier full response of its canonical URL. The
as-of join runs in two levels, so that a hot URL is spread over many tasks: records are dealt into CHUNK-second chunks of
a URL's time, each chunk is filled forward by itself, and what a chunk opens with comes from the last response of the
chunks before it, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 3600
#: Headers that a 304 response may update; the others describe the stored payload and stay (RFC 9111, section 3.2).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning")


def canonical(url: Column) -> Column:
    """One form of a URL: scheme and default port dropped, host lowered and without `www.`, no fragment, `/` for an empty path, query parameters sorted. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, "(?s)^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    query = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def lowered(headers: Column) -> Column:
    """The header map by lower-case names. Values of names that differ in case only are joined by `, ` (RFC 9110,
    section 5.3), in ascending order as a map has none, equal ones once, nulls left out. A null map is empty."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))

    def together(name: Column) -> Column:
        values = F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == name), lambda e: e["value"]), lambda v: v.isNotNull())))
        return F.when(F.size(values) > 0, F.array_join(values, ", "))

    plain = F.map_from_entries(F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.when(F.size(names) == F.size(entries), plain).otherwise(F.map_from_arrays(names, F.transform(names, together)))


def resolve(records: DataFrame) -> DataFrame:
    """record_id, url_key, response_id, status, headers: one row for each revisit in `records`.

    `records`: record_id (unique), url, ts (seconds), kind (response or revisit), headers (map, names in any case).
    A response at the revisit's own second is not earlier; of responses at one second the one with the largest record_id
    counts. status: no_response (none earlier), no_validator (the revisit has neither ETag nor Last-Modified),
    mismatch (one of those that it has differs from the response's or lacks there; the response is named yet not
    merged), resolved. headers of resolved ones: the response's, with PERMITTED ones of the revisit in place; else null.
    Records without url, ts or kind are left out, as they can be placed nowhere; a null header map is empty; see lowered()
    for repeated names. Repeated rows give repeated results; an empty table gives none. Other columns are not read.
    Urls and values of any length are read whole. A URL's captures within CHUNK seconds are sorted in one task, which
    spills; all else of a hot URL is spread.
    """
    rows = records.where("url IS NOT NULL AND ts IS NOT NULL AND kind IN ('response', 'revisit')")
    rows = rows.select("record_id", canonical(F.col("url")).alias("url_key"), F.col("ts").cast("bigint").alias("ts"), (F.col("kind") == "response").alias("full"), lowered(F.col("headers")).alias("headers"))
    rows = rows.withColumn("chunk", F.floor(F.col("ts") / CHUNK))
    validators = F.struct("record_id", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"))
    # Responses before revisits' own second: within a second, revisits come first.
    order = [F.col("ts"), F.col("full"), F.col("record_id")]
    inside = Window.partitionBy("url_key", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("found", F.last(F.when(F.col("full"), validators), ignorenulls=True).over(inside)).where("NOT full")
    chunks = rows.groupBy("url_key", "chunk").agg(F.max(F.when(F.col("full"), F.struct("ts", "record_id"))).alias("final"))
    earlier = Window.partitionBy("url_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    opening = chunks.withColumn("opening", F.last("final", ignorenulls=True).over(earlier)["record_id"]).select("url_key", "chunk", "opening")
    placed = filled.join(opening, ["url_key", "chunk"]).withColumn("response_id", F.coalesce("found.record_id", "opening"))
    responses = rows.where("full").dropDuplicates(["record_id"]).select(F.col("record_id").alias("response_id"), F.col("headers").alias("stored"))
    responses = responses.hint("rebalance")  # an exchange of its own, so that a hot response's join can be split
    placed = placed.select("record_id", "url_key", "response_id", "headers")
    # Revisits without a response join nothing: as nulls they would all meet in one task.
    joined = placed.where("response_id IS NOT NULL").join(responses, "response_id", "left")
    joined = joined.unionByName(placed.where("response_id IS NULL").withColumn("stored", F.lit(None).cast("map<string,string>")))
    has = lambda name: F.col("headers")[name].isNotNull()
    same = lambda name: ~has(name) | F.coalesce(F.col("headers")[name] == F.col("stored")[name], F.lit(False))
    status = F.when(F.col("response_id").isNull(), "no_response").when(~has("etag") & ~has("last-modified"), "no_validator").when(~(same("etag") & same("last-modified")), "mismatch").otherwise("resolved")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(allowed, k))
    joined = joined.withColumn("status", status)
    return joined.select("record_id", "url_key", "response_id", "status", F.when(F.col("status") == "resolved", F.map_concat(kept, allowed)).alias("headers"))


def header_lines(headers: Column) -> Column:
    """`name: value` lines in order of name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def variant(url: Column, n: Column) -> Column:
    """The URL written in another way, by n: with `www.` and port, in capitals with a fragment, or with its parameters turned round."""
    rest = F.regexp_replace(url, "(?s)^[^:]*://", "")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    bare = F.regexp_replace(host, r"^www\.", "")
    query = F.regexp_extract(tail, r"(?s)^[^?#]*\?([^#]*)", 1)
    turned = F.concat(F.regexp_extract(tail, "(?s)^[^?#]*", 0), F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.reverse(F.split(query, "&")), "&"))))
    return F.when(n % 3 == 0, F.concat(F.lit("https://www."), bare, F.lit(":443"), tail)).when(n % 3 == 1, F.concat(F.lit("http://"), F.upper(bare), tail, F.lit("#again"))).otherwise(F.concat(F.lit("http://"), bare, turned))


def captures(pages: DataFrame) -> DataFrame:
    """Records made from `pages` (page_id, url, html; other columns are not read), three a page, over many hours.

    The page's full response at second 10 * page_id; a revisit of it under another form of the url, seconds or hours
    later or before it; and the host's root, which all pages of a host capture, four at one second: every third time as a
    response, else as a revisit. By page_id, some carry a stale ETag or none. A null url or html stays null or is empty;
    an empty table gives no records.
    """
    i, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    tag, host = F.md5(html.cast("binary")), F.regexp_extract(F.regexp_replace("url", "(?s)^[^:]*://", ""), "^[^/?#]*", 0)

    def record(n: int, url: Column, ts: Column, kind: Column, etag: Column, size: Column, name: str, cache: str) -> Column:
        headers = F.create_map(F.lit(name), etag, F.lit("Content-Length"), size, F.lit("Date"), F.concat(F.lit("t"), ts.cast("string")), F.lit("Cache-Control"), F.lit(cache))
        return F.struct((i * 3 + n).alias("record_id"), url.alias("url"), ts.alias("ts"), kind.alias("kind"), headers.alias("headers"))

    own, later, root = i * 10, i * 10 + F.when(i % 7 == 0, -5).when(i % 4 == 1, 7200).otherwise(5), F.expr("page_id div 4 * 400")
    records = F.array(
        record(0, F.col("url"), own, F.lit("response"), tag, F.length(html).cast("string"), "ETag", "no-cache"),
        record(1, variant(F.col("url"), i), later, F.lit("revisit"), F.when(i % 5 == 0, None).when(i % 4 == 3, "stale").otherwise(tag), F.lit("0"), "etag", "max-age=60"),
        record(2, F.concat(F.lit("http://"), host, F.lit("/")), root, F.when(i % 3 == 0, "response").otherwise("revisit"), F.when(i % 5 == 0, F.lit("old")).otherwise(F.md5(host.cast("binary"))), F.lit("1"), "ETAG", "no-store"),
    )
    return pages.select(F.explode(records).alias("r")).select("r.*")


SQL = r"""
WITH c AS (SELECT page_id AS i, url, md5(coalesce(html, '')) AS tag, length(coalesce(html, '')) AS size, regexp_replace(url, '(?s)^[^:]*://', '') AS bare0 FROM pages),
h AS (SELECT *, regexp_extract(bare0, '^[^/?#]*') AS host FROM c),
t AS (SELECT *, substr(bare0, length(host) + 1) AS tail, regexp_replace(host, '^www\.', '') AS bare FROM h),
q AS (SELECT *, regexp_extract(tail, '(?s)^[^?#]*\?([^#]*)', 1) AS asked, regexp_extract(tail, '(?s)^[^?#]*') AS page FROM t),
r AS (
  SELECT i * 3 AS record_id, url, i * 10 AS ts, true AS is_full, tag AS etag, size::VARCHAR AS size, 'no-cache' AS cache FROM q
  UNION ALL SELECT i * 3 + 1, CASE WHEN i % 3 = 0 THEN 'https://www.' || bare || ':443' || tail WHEN i % 3 = 1 THEN 'http://' || upper(bare) || tail || '#again'
      ELSE 'http://' || bare || page || CASE WHEN asked = '' THEN '' ELSE '?' || array_to_string(list_reverse(string_split(asked, '&')), '&') END END,
    i * 10 + CASE WHEN i % 7 = 0 THEN -5 WHEN i % 4 = 1 THEN 7200 ELSE 5 END, false, CASE WHEN i % 5 = 0 THEN NULL WHEN i % 4 = 3 THEN 'stale' ELSE tag END, '0', 'max-age=60' FROM q
  UNION ALL SELECT i * 3 + 2, 'http://' || host || '/', i // 4 * 400, i % 3 = 0, CASE WHEN i % 5 = 0 THEN 'old' ELSE md5(host) END, '1', 'no-store' FROM q),
s AS (SELECT *, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '(?i)^[a-z][a-z0-9+.-]*://', '') AS rest FROM r WHERE url IS NOT NULL),
k AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '') AS host,
  regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1) AS path, regexp_extract(rest, '(?s)\?(.*)$', 1) AS query FROM s),
u AS (SELECT record_id, ts, is_full, etag, size, cache, host || CASE WHEN path = '' THEN '/' ELSE path END ||
  CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS url_key FROM k),
f AS (SELECT * FROM u WHERE is_full QUALIFY row_number() OVER (PARTITION BY url_key, ts ORDER BY record_id DESC) = 1),
j AS (SELECT v.record_id, v.url_key, v.ts, v.etag, v.cache, f.record_id AS response_id, f.etag AS tag, f.size FROM (SELECT * FROM u WHERE NOT is_full) v ASOF LEFT JOIN f ON v.url_key = f.url_key AND v.ts > f.ts)
SELECT record_id, url_key, response_id,
  CASE WHEN response_id IS NULL THEN 'no_response' WHEN etag IS NULL THEN 'no_validator' WHEN etag <> tag THEN 'mismatch' ELSE 'resolved' END AS status,
  CASE WHEN response_id IS NOT NULL AND etag = tag THEN 'cache-control: ' || cache || chr(10) || 'content-length: ' || size || chr(10) || 'date: t' || ts || chr(10) || 'etag: ' || etag END AS headers
FROM j"""
