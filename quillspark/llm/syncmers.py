"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its inner s-mers lies at its first or last s-mer.
Whether it is one depends on its own characters only, so texts that share a passage share its anchors wherever it
stands. A fingerprint keeps all anchors with their first positions, however long the text is. A text without any (a short
one) has its whole self for its only anchor.

Likeness: of the anchors of both fingerprints together, the share that both have in the same order (the longest chain
of common anchors whose positions rise in both).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import decoded, small_batches, texts
from quillspark.llm.ordered import bounds, range_of

K, S = 16, 6
#: Characters of fingerprints that a batch of results holds before it goes to Spark.
BATCH_CHARS = 1 << 23


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _rolled(codes: np.ndarray, width: int) -> np.ndarray:
    n = len(codes) - width + 1
    out = codes[:n].copy()
    for i in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return _mix(out)


def whole(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text as its own anchor, at 0."""
    return (_rolled(codes, len(codes)) >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)


def syncmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of the text's closed syncmers; a text without any has one anchor, its whole, an empty text none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(codes):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    if len(codes) < K:
        return whole(codes)
    inner = _rolled(codes, S)
    n = len(codes) - K + 1
    first, last = inner[:n], inner[K - S : K - S + n]
    least = first.copy()
    for i in range(1, K - S + 1):
        np.minimum(least, inner[i : i + n], out=least)
    at = np.nonzero((first == least) | (last == least))[0]
    if not len(at):  # all windows have their minimum inside
        return whole(codes)
    # the k-mer's hash from three of its s-mers, which cover it
    kmers = _mix(inner[at] * np.uint64(3) + inner[at + S] * np.uint64(5) + inner[at + K - S] * np.uint64(7))
    return (kmers >> np.uint64(32)).astype(np.uint32), at


def sketch(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The anchors' hashes, ascending, each with its first position."""
    h, at = syncmers(text)
    h, first = np.unique(h, return_index=True)
    return h, at[first]


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1; two empty fingerprints are alike."""
    if not len(x[0]) and not len(y[0]):
        return 1.0
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    p, q = x[1][i], y[1][j]
    tails: list[int] = []
    for v in q[np.lexsort((q, p))].tolist():
        if not tails or v > tails[-1]:
            tails.append(v)
        else:
            tails[bisect_left(tails, v)] = v
    return len(tails) / (len(x[0]) + len(y[0]) - len(both))


def written(x: tuple[np.ndarray, np.ndarray]) -> str:
    """Per anchor: eight hexadecimal digits, `@`, the position; in order of hash."""
    return " ".join(f"{h:08x}@{p}" for h, p in zip(x[0].tolist(), x[1].tolist(), strict=True))


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [x.split("@") for x in fingerprint.split()]
    return np.array([int(h, 16) for h, _ in parts], np.uint32), np.array([int(p) for _, p in parts], np.int64)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points give way to the first as many of the following text, or all of it."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """OUT, one row for each row of `docs` (doc_id, text; other columns are not read).

    The next document is the next row by doc_id (nulls first, ties by text), after the last the first; a lone row is
    its own next. A null text is empty: its fingerprint is empty, its likeness to another empty one 1 and else 0. Bytes that
    aren't UTF-8 are read as U+FFFD. Repeated rows follow each other; an empty table gives no rows.
    Ranges of ids are dealt to the tasks; the first row of a range also closes the range before it.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = bounds(docs)
    dealt = docs.withColumn("range", range_of(cuts)).withColumn("closing", F.lit(False))
    starts = dealt.groupBy("range").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("null"))
    starts = sorted((r["range"], None if r["null"] else r["least"]) for r in starts.collect())  # one row a range
    if not starts:
        return docs.sparkSession.createDataFrame([], OUT)
    heads = docs.sparkSession.createDataFrame([(*s, starts[i - 1][0]) for i, s in enumerate(starts)], "at int, head bigint, before int")
    found = dealt.join(F.broadcast(heads), (F.col("range") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("head")))
    closing = found.groupBy("before", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("before").alias("range"), F.lit(True).alias("closing"))
    ordered = dealt.union(closing).repartition("range").sortWithinPartitions("range", "closing", "doc_id", "text").select("doc_id", "text", "closing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, chars = None, [], 0
        names, kinds = OUT.replace(",", "").split()[::2], [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

        def flush() -> pa.RecordBatch:
            nonlocal chars
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
            rows.clear()
            chars = 0
            return out

        for batch in batches:
            for doc_id, raw, closing in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
                text = decoded(raw)
                own = sketch(text)
                if held is not None:
                    other = edited(held[1], text)
                    changed = sketch(other)
                    rows.append((held[0], len(held[1]), sha256(other.encode()).hexdigest(), written(held[2]), written(changed), likeness(held[2], changed), likeness(held[2], own)))
                    chars += len(rows[-1][3]) + len(rows[-1][4])
                    if chars >= BATCH_CHARS:
                        yield flush()
                held = None if closing else (doc_id, text, own)
            yield flush()

    return ordered.mapInArrow(run, OUT)
