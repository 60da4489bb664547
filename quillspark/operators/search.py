"""Fuzzy lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import match_weight, stem, stems, tokens
from quillspark.operators.reads import live


def search_docs(notes: DataFrame, ideas: DataFrame) -> DataFrame:
    """kind, ref_id, title, content, created_at: readable live notes, then live ideas."""
    a = live(notes).where(F.trim("text") != "").select(F.lit("note").alias("kind"), F.col("id").alias("ref_id"), F.lit("").alias("title"), F.trim("text").alias("content"), "created_at")
    b = live(ideas).select(F.lit("custom_idea").alias("kind"), F.col("id").alias("ref_id"), F.col("name").alias("title"), F.col("description").alias("content"), "created_at")
    return a.unionByName(b)


def stem_tally(texts: DataFrame, text: str = "text") -> DataFrame:
    """stem, n: how often each stem occurs. Tokens are counted first, so that each distinct one is stemmed once."""
    words = texts.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return words.groupBy(stem(F.col("token")).alias("stem")).agg(F.sum("n").alias("n"))


def query_terms(spark, query: str) -> list[str]:
    """Distinct stems of the query, in order."""
    found = spark.range(1).select(stems(F.lit(query)).alias("t")).first()["t"]
    return list(dict.fromkeys(found))


def scored(docs: DataFrame, query: str, keys: tuple[str, ...] = ("kind", "ref_id")) -> DataFrame:
    """keys, score for the documents that match: over the query's terms, the sum of the better of twice the title's and once the content's weight, times the number of terms that match.

    Every token is a row, which keeps its stem and weights in generated code; a document's rows are combined where they
    are made, so one row for each document is shuffled.
    """
    terms = query_terms(docs.sparkSession, query)
    if not terms:
        return docs.select(*keys).withColumn("score", F.lit(0.0)).limit(0)
    fields = F.array(F.struct(tokens(F.col("title")).alias("tokens"), F.lit(2.0).alias("factor")), F.struct(tokens(F.col("content")).alias("tokens"), F.lit(1.0).alias("factor")))
    rows = docs.select(*keys, F.explode(fields).alias("f")).select(*keys, "f.factor", F.explode("f.tokens").alias("token"))
    rows = rows.select(*keys, "factor", stem(F.col("token")).alias("stem"))
    names = [f"__w{i}" for i in range(len(terms))]
    rows = rows.select(*keys, *((match_weight(F.lit(t), F.col("stem")) * F.col("factor")).alias(n) for t, n in zip(terms, names, strict=True)))
    best = rows.groupBy(*keys).agg(*(F.max(n).alias(n) for n in names)).where(" OR ".join(f"{n} > 0" for n in names))
    total, matched = F.lit(0.0), F.lit(0)
    for n in names:
        total, matched = total + F.col(n), matched + (F.col(n) > 0).cast("int")
    return best.select(*keys, (total * matched).alias("score"))


def search(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """The best documents; equal scores keep the corpus order: notes before ideas, each newest first. (kind, ref_id) is unique in `docs`."""
    if limit <= 0 or not query.strip():
        return docs.withColumn("score", F.lit(0.0)).withColumn("snippet", F.lit("")).limit(0)
    order = [F.desc("score"), F.desc(F.col("kind") == "note"), F.desc("created_at"), F.desc("ref_id")]
    found = scored(docs, query, ("kind", "ref_id", "created_at")).orderBy(*order).limit(limit)
    rows = docs.join(F.broadcast(found.drop("created_at")), ["kind", "ref_id"])  # `limit` rows
    return rows.withColumn("snippet", F.when(F.col("content") == "", F.col("title")).otherwise(F.col("content"))).orderBy(*order)
