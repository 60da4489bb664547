"""The driver's tables in the roles of the archive's, as DataFrames and as the same CTEs in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A clock for every query that needs one: 2024-01-29 00:00 UTC.
NOW_MS = 1_706_486_400_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(c: str):
    return F.unix_millis(F.col(c).cast("timestamp_ntz").cast("timestamp"))


def books(spark, sf_dir) -> DataFrame:
    """Customers; debtors are deleted, and merged into the customer of half their key."""
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), (F.col("c_acctbal") * 100).cast("bigint").alias("created_at"), (F.col("c_acctbal") < 0).alias("deleted"), F.when((F.col("c_acctbal") < 0) & (F.col("c_custkey") % 3 != 0), F.expr("cast(c_custkey div 2 AS string)")).alias("merged_into"))


BOOKS = "books AS (SELECT c_custkey AS id, c_name AS title, trunc(c_acctbal * 100)::BIGINT AS created_at, c_acctbal < 0 AS deleted, CASE WHEN c_acctbal < 0 AND c_custkey % 3 <> 0 THEN (c_custkey // 2)::VARCHAR END AS merged_into FROM customer)"


def notes(spark, sf_dir) -> DataFrame:
    """Orders; those with status F are deleted. Tags are words of the priority, one of them twice for every 11th."""
    o = load(spark, sf_dir, "orders")
    tags = F.split(F.col("o_orderpriority"), "[- ]")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("book_id"),
        F.col("o_orderpriority").alias("text"),
        F.when(F.col("o_orderkey") % 13 == 0, None).when(F.col("o_orderkey") % 11 == 0, F.concat(tags, F.slice(tags, 1, 1))).otherwise(tags).alias("tags"),
        millis("o_orderdate").alias("created_at"),
        millis("o_orderdate").alias("updated_at"),
        (F.col("o_orderstatus") == "F").alias("deleted"),
    )


NOTES = """notes AS (SELECT o_orderkey AS id, o_custkey AS book_id, o_orderpriority AS text,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN list_concat(regexp_split_to_array(o_orderpriority, '[- ]'), list_slice(regexp_split_to_array(o_orderpriority, '[- ]'), 1, 1))
       ELSE regexp_split_to_array(o_orderpriority, '[- ]') END AS tags,
  epoch_ms(o_orderdate) AS created_at, epoch_ms(o_orderdate) AS updated_at, o_orderstatus = 'F' AS deleted FROM orders)"""


def memberships(spark, sf_dir) -> DataFrame:
    """Line items put orders into collections, the parts; returned ones are deleted. The same pair can occur again."""
    x = load(spark, sf_dir, "lineitem")
    return x.select(F.col("l_partkey").alias("collection_id"), F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").cast("bigint").alias("id"), millis("l_shipdate").alias("created_at"), (F.col("l_returnflag") == "R").alias("deleted"))


MEMBERSHIPS = "memberships AS (SELECT l_partkey AS collection_id, l_orderkey AS note_id, l_linenumber::BIGINT AS id, epoch_ms(l_shipdate) AS created_at, l_returnflag = 'R' AS deleted FROM lineitem)"


def links(spark, sf_dir) -> DataFrame:
    """One link for each order and part among the line items, from the part's number to the order's."""
    x = load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("o"), F.min("l_returnflag").alias("f"))
    return x.select(
        F.format_string("%08d-%06d", F.col("l_partkey"), F.col("l_suppkey")).alias("id"), F.col("l_partkey").alias("from_note_id"), (F.col("l_suppkey") * 2).alias("to_note_id"), F.col("f").alias("relation_type"), (F.col("o") % 5 == 0).alias("deleted")
    )


LINKS = """links AS (SELECT lpad(l_partkey::VARCHAR, 8, '0') || '-' || lpad(l_suppkey::VARCHAR, 6, '0') AS id, l_partkey AS from_note_id, l_suppkey * 2 AS to_note_id,
  min(l_returnflag) AS relation_type, min(l_orderkey) % 5 = 0 AS deleted FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def texts(spark, sf_dir) -> DataFrame:
    """Documents as notes: tags are language and source, the content tag is a digest of the text."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", F.array("lang", "source").alias("tags"), F.md5(F.col("text").cast("binary")).alias("content_tag"), (F.col("doc_id") * 1000).alias("created_at"), (F.col("doc_id") * 1000).alias("updated_at"), (F.col("doc_id") % 17 == 0).alias("deleted"))


TEXTS = "texts AS (SELECT doc_id AS id, text, [lang, source] AS tags, md5(text) AS content_tag, doc_id * 1000 AS created_at, doc_id * 1000 AS updated_at, doc_id % 17 = 0 AS deleted FROM documents)"


def feed(spark, sf_dir) -> DataFrame:
    """Events as a change feed: out of order, with ties; errors are tombstones."""
    e = load(spark, sf_dir, "events")
    stamp = F.expr("(unix_millis(cast(ts AS timestamp)) - (event_id * 7919) % 864000000) div 86400000")
    return e.select((F.col("user_id") * 1000 + F.col("event_id") % 37).alias("id"), F.col("event_id").alias("change_seq"), stamp.alias("updated_at"), (F.col("event_type") == "error").alias("deleted"), F.col("value").alias("payload"))


FEED = "feed AS (SELECT user_id * 1000 + event_id % 37 AS id, event_id AS change_seq, (epoch_us(ts) // 1000 - (event_id * 7919) % 864000000) // 86400000 AS updated_at, event_type = 'error' AS deleted, value AS payload FROM events)"


def local(spark, sf_dir) -> DataFrame:
    """Some records that are there before the feed."""
    f = feed(spark, sf_dir)
    return f.where("change_seq % 10 = 0").groupBy("id").agg(F.min("updated_at").alias("updated_at"))


LOCAL = "local AS (SELECT id, min(updated_at) AS updated_at FROM feed WHERE change_seq % 10 = 0 GROUP BY id)"
