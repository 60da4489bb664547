"""Small tables for the corpus operators."""

import random

import public_tokenizers

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns with names that operators use inside.
WIDE = DOCS + ", band string, score string, kept string, component_id string, place string, copies string, slot string, shard string"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, texts, schema=DOCS):
    rows = [(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) if not isinstance(t, tuple) else t for i, t in texts]
    if schema == WIDE:
        rows = [(*r, *["x"] * 8) for r in rows]
    return spark.createDataFrame(rows, schema)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "   \n"), (4, words(1, 60)), (5, words(1, 60)), (6, "one"), (7, "one"), (None, words(2, 30)), (None, words(2, 30)), (8, words(3, 30_000)), (4, words(1, 60)), (9, "é " * 40)]
#: Not UTF-8; strings of Spark can hold that.
BROKEN = b"ab\xff\xfe cd \xe2\x82 ef"


def with_broken(df):
    """The table with one row more, doc_id -5, whose text isn't UTF-8."""
    from pyspark.sql import functions as F

    row = df.limit(1).withColumn("doc_id", F.lit(-5).cast("bigint")).withColumn("text", F.lit(BROKEN).cast("string"))
    return df.union(row)
