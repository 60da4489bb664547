"""Token ids in ORC files: one row a document, in ascending doc_id order.

The files of a store are ORC with run-length encoded integers, row indexes and a Bloom filter on doc_id. A shard holds
a range of ids in order; its rows have the id count of the shard's documents before them. Shards are counted in the
store's second table, so a document's place in the whole is its shard's base plus its own. Readers split files by
stripes, and look a document up by the stripes' statistics, row indexes and Bloom filters.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import decoded, scratch, small_batches, texts
from quillspark.llm.ordered import bounds, range_of

END_ID = 1
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "10000", "orc.create.index": "true", "orc.stripe.size": str(64 << 20), "compression": "zstd"}
ROWS = "shard int, doc_id bigint, start_in_shard bigint, n_tokens int, ids array<int>"
#: Bytes of text that the library encodes in one call, about.
CALL_BYTES = 1 << 20
#: Words that the library's own cache holds in a process (10,000 by its default); the ids are the same with any number.
CACHED_WORDS = 1 << 16


@lru_cache(maxsize=1)
def loaded(path: str, size: int, changed_ns: int):
    """The tokenizer of a file as it was at that size and time: a worker process keeps it, and the words it has met, from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if hasattr(tokenizer.model, "_resize_cache"):  # BPE and Unigram have a cache
        tokenizer.model._resize_cache(CACHED_WORDS)
    return tokenizer


def encoder(path: str):
    """Whole texts to their ids as little-endian bytes, by the library's own pipeline. Equal texts of a batch are encoded once."""
    now = os.stat(path)
    tokenizer = loaded(path, now.st_size, now.st_mtime_ns)

    def encode(raw: list[bytes]) -> list[bytes]:
        ids: dict[bytes, bytes] = {}
        call, size = [], 0
        for k, x in enumerate(distinct := list(dict.fromkeys(raw)), 1):
            call.append(x)
            size += len(x)
            if size >= CALL_BYTES or k == len(distinct):
                found = tokenizer.encode_batch_fast([decoded(x) for x in call], add_special_tokens=False)
                ids |= {x: np.array(e.ids, "<u4").tobytes() for x, e in zip(call, found, strict=True)}
                call, size = [], 0
        return [ids[x] for x in raw]

    return encode


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes the store of `docs` (doc_id, text; other columns are not read) at `path`.

    Any tokenizer file of the library will do. A null or empty text has the end id only; bytes that aren't UTF-8 are read
    as U+FFFD. Order: nulls first, then by doc_id, ties by text; repeated rows stay. An empty table gives an empty store.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = bounds(docs)
    ordered = docs.withColumn("shard", range_of(cuts).cast("int")).repartition("shard").sortWithinPartitions("shard", "doc_id", "text").select("shard", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, before, end = encoder(tokenizer), None, 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [x + end for x in encode(texts(batch))]
            starts, lengths = [], []
            for s, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                if s != shard:
                    shard, before = s, 0
                starts.append(before)
                lengths.append(len(x) // 4)
                before += lengths[-1]
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                ["shard", "doc_id", "start_in_shard", "n_tokens", "ids"],
            )

    ordered.mapInArrow(run, ROWS).write.options(**ORC).orc(f"{path}/ids")
    counts = rows(docs.sparkSession, path).groupBy("shard").agg(F.sum(F.col("n_tokens").cast("bigint")).alias("n_ids"))
    counts.coalesce(1).write.orc(f"{path}/shards")  # one row a shard


def rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromDDL(ROWS)).orc(f"{path}/ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document in the store; start counts the ids of all documents before it."""
    counts = sorted((r["shard"], r["n_ids"]) for r in spark.read.schema("shard int, n_ids bigint").orc(f"{path}/shards").collect())  # at most MOST_RANGES rows
    base, total = [], 0
    for shard, n in counts:
        base.append((shard, total))
        total += n
    bases = F.broadcast(spark.createDataFrame(base, "shard int, base bigint"))
    return rows(spark, path).join(bases, "shard").select("doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; statistics and Bloom filters leave out the stripes without them."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            offsets, flat = column.offsets.to_numpy(), np.asarray(column.values).astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(3)] + [pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes a store in the shared folder and reads the documents' places and digests back from its files; see write() for odd rows."""
    path = scratch(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    small_batches(docs.sparkSession)
    return digests(read(docs.sparkSession, path))
