"""From raw documents to sharded training data, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on; all but the last return the columns of
`docs`. Between stages the documents are written as Parquet to the cluster's shared folder and read again; a stage's
table goes once the next one has been written.

In every stage null, empty and blank texts are documents like others (not toxic, alike with none, not contaminated),
rows that repeat are judged alike, null ids and extra columns of any name stay as they are, texts of any length are read
whole, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, mixing, near_dedup, shard, toxicity
from quillspark.llm.common import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; repeated rows score alike, and a text without features scores the prior."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group, of five-word shingles alike by 0.8; all its rows if the id repeats."""
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark; without a benchmark all of them."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, in the order of the mixture; documents of small sources repeat, up to twice as often as
    those of the largest. A null source is one of its own; rows of one id and source are read alike."""
    return mixing.mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its slot and shard; rows of one id share a shard, and so do those without an id."""
    return shard.place(docs, "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: A fitted classifier and banded hashing stand at the start, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        paths: list[str] = []
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", paths)
        discard(spark, before)
        before = paths
    return STAGES[-1][1](spark, docs, sf_dir)
