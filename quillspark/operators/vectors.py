"""Vector search and the queue of texts to embed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scores import content_token, dot, normalize
from quillspark.operators.reads import live

MOST_DIMS = 4096


def pending(notes: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Live notes without a vector of this model for this content, newest first."""
    have = vectors.select(F.col("note_id").alias("id"), F.lit(True).alias("__has"), F.col("model_version").alias("__key"), F.col("content_token").alias("__token"))
    token = content_token(F.col("content_tag"), F.col("updated_at"))
    rows = live(notes).withColumn("token", token).join(have, "id", "left")
    stale = F.col("__has").isNull() | ~F.col("__key").eqNullSafe(key) | ~F.col("__token").eqNullSafe(F.col("token"))
    return rows.where(stale).drop("__has", "__key", "__token").orderBy(F.desc("created_at"), F.desc("id"))


def next_batch(queue: DataFrame, failed: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """(rows to embed, whether failures were forgotten): those that failed as they are now wait until nothing else is left."""
    fresh = queue.join(failed.select("id", "token"), ["id", "token"], "left_anti")
    forget = fresh.isEmpty()
    return (queue if forget else fresh).orderBy(F.desc("created_at"), F.desc("id")).limit(limit), forget


def current(notes: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return vectors.where((F.col("model_version") == key) & F.col("embedding").isNotNull()).join(live(notes).select(F.col("id").alias("note_id")), "note_id", "left_semi")


def without_stale(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.where(F.col("model_version").eqNullSafe(key))


def after_rows(vectors: DataFrame, applied: DataFrame) -> DataFrame:
    """Vectors after notes were applied: those of deleted ones go."""
    return vectors.join(applied.where("deleted = true").select(F.col("id").alias("note_id")), "note_id", "left_anti")


def accepted(results: DataFrame, notes: DataFrame) -> DataFrame:
    """Vectors whose note is live and still has the content they were made from."""
    now = live(notes).select(F.col("id").alias("note_id"), content_token(F.col("content_tag"), F.col("updated_at")).alias("content_token"))
    return results.join(now, ["note_id", "content_token"], "left_semi")


def top_k(vectors: DataFrame, probe: list[float], k: int, id_column: str = "note_id", vector: str = "embedding") -> DataFrame:
    """The k vectors with the greatest dot product; ties by id."""
    if k <= 0:
        return vectors.withColumn("score", F.lit(0.0)).limit(0)
    if not probe or not np.isfinite(probe).all() or not np.any(probe):
        raise ValueError("the probe needs a finite length above 0")
    scored = vectors.withColumn("score", dot(F.col(vector), F.array(*map(F.lit, map(float, probe)))))
    return scored.orderBy(F.desc("score"), F.asc(id_column)).limit(k)


def similar(vectors: DataFrame, probe_id, k: int, id_column: str = "note_id", vector: str = "embedding") -> DataFrame:
    """Like top_k for a stored vector, itself left out; empty without one."""
    row = vectors.where(F.col(id_column) == F.lit(probe_id)).select(vector).first()
    if row is None or row[0] is None:
        return vectors.withColumn("score", F.lit(0.0)).limit(0)
    return top_k(vectors.where(F.col(id_column) != F.lit(probe_id)), list(row[0]), k, id_column, vector)


@dataclass(frozen=True)
class Descriptor:
    """What an embedder says of itself; one that can't key a corpus is refused."""

    model: str
    dims: int
    quantization: str = ""
    layout: str = ""

    def __post_init__(self):
        if not self.model or "|" in self.model or "|" in self.quantization:
            raise ValueError("an embedder needs a name, and no `|` in it or its quantization")
        if not 1 <= self.dims <= MOST_DIMS:
            raise ValueError(f"an embedder's vectors have 1 to {MOST_DIMS} dimensions")

    @property
    def key(self) -> str:
        return f"{self.model}|{self.dims}|{self.quantization}|{self.layout}"


class Unavailable(Exception):
    """Raised by an embedder whose runtime is gone: the pass ends, and no note is to blame."""


def register(descriptor: Descriptor, notes: DataFrame, vectors: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(the vectors that another corpus left are dropped, {invalidated, pending}) as an embedder takes over."""
    kept = without_stale(vectors, descriptor.key)
    invalidated = vectors.where(~F.col("model_version").eqNullSafe(descriptor.key)).count()
    return kept, {"invalidated": invalidated, "pending": pending(notes, kept, descriptor.key).count()}


def embed(queue: DataFrame, embedder: Callable[[str], list[float]], dims: int) -> DataFrame:
    """id, token, embedding, status of each row, by Arrow batches.

    A blank text is skipped. An error, a wrong length and a vector of no direction are failed. Once an embedder is
    Unavailable, its task tries no further text: these are unavailable, which is no failure of theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = False
        for batch in batches:
            vectors, status = [], []
            for text in batch.column(2).to_pylist():
                made = None
                if not (text or "").strip():
                    status.append("skipped")
                elif gone:
                    status.append("unavailable")
                else:
                    try:
                        made = [float(x) for x in embedder(text.strip())]
                        length = float(np.sqrt(np.square(np.asarray(made, np.float64)).sum()))
                        ok = len(made) == dims and 0 < length < np.inf
                        status.append("embedded" if ok else "failed")
                        made = made if ok else None
                    except Unavailable:
                        gone = True
                        status.append("unavailable")
                    except Exception:  # noqa: BLE001 - whatever an embedder raises concerns this text
                        status.append("failed")
                vectors.append(made)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.float32())), pa.array(status, pa.string())], ["id", "token", "embedding", "status"])

    kind = queue.schema["id"].dataType.simpleString()
    made = queue.select("id", "token", "text").mapInArrow(run, f"id {kind}, token string, embedding array<float>, status string")
    return made.withColumn("embedding", normalize(F.col("embedding")))


def embed_pending(notes: DataFrame, vectors: DataFrame, failed: DataFrame, descriptor: Descriptor, embedder: Callable[[str], list[float]], limit: int, now_ms: int, put: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(vectors, failures to remember, summary) after one pass over the queue; vectors: note_id, model_version,
    content_token, embedding, updated_at.

    Vectors without a live note go. A skipped text leaves a row without a vector, so that it leaves the queue. What was
    edited meanwhile is not stored. `put` writes what the embedder made, so that it runs once.
    """
    vectors = current_notes(vectors, notes)
    batch, forget = next_batch(pending(notes, vectors, descriptor.key), failed, limit)
    made = put(embed(batch, embedder, descriptor.dims))
    rows = made.where("status IN ('embedded', 'skipped')").select(F.col("id").alias("note_id"), F.lit(descriptor.key).alias("model_version"), F.col("token").alias("content_token"), "embedding", F.lit(now_ms).cast("bigint").alias("updated_at"))
    stored = accepted(rows, notes)
    after = vectors.join(stored.select("note_id"), "note_id", "left_anti").unionByName(stored.select(*vectors.columns))
    new = made.where("status = 'failed'").select("id", "token")
    remembered = new if forget else failed.select("id", "token").join(new.select("id"), "id", "left_anti").unionByName(new)
    n = {r["status"]: r["n"] for r in made.groupBy("status").agg(F.count("*").alias("n")).collect()}
    gone = n.get("unavailable", 0)
    summary = {"attempted": sum(n.values()) - max(gone - 1, 0), "embedded": n.get("embedded", 0), "skipped": n.get("skipped", 0), "failed": n.get("failed", 0) + min(gone, 1), "pending": pending(notes, after, descriptor.key).count()}
    return after, remembered, summary


def current_notes(vectors: DataFrame, notes: DataFrame) -> DataFrame:
    """Vectors whose note is live."""
    return vectors.join(live(notes).select(F.col("id").alias("note_id")), "note_id", "left_semi")


def to_bytes(vector):
    """A float column as little-endian bytes."""

    @F.arrow_udf("binary")
    def pack(v: pa.Array) -> pa.Array:
        flat = np.asarray(v.flatten().cast(pa.float32()), "<f4").tobytes()
        ends = np.concatenate([[0], np.cumsum(np.where(np.asarray(v.is_valid()), np.asarray(v.value_lengths().fill_null(0)), 0))]) * 4
        made = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
        return pc.if_else(v.is_valid(), made, pa.scalar(None, pa.binary()))

    return pack(vector)


def from_bytes(raw, dims: int):
    """The floats, or null if the length is not the dimensions' own."""

    @F.arrow_udf("array<float>")
    def unpack(b: pa.Array) -> pa.Array:
        right = pc.fill_null(pc.equal(pc.binary_length(b), 4 * dims), False)
        flat = np.frombuffer(b"".join(b.filter(right).to_pylist()), "<f4")
        ends = np.concatenate([[0], np.cumsum(np.asarray(right, int))]) * dims
        made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.float32()))
        return pc.if_else(right, made, pa.scalar(None, made.type))

    return unpack(raw)
