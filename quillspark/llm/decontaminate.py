"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask that ignores some token positions, so a substituted token spoils only the windows in which a mask
reads it. The window hashes of the benchmark are a table. Documents are read once: their distinct window hashes that pass
a bit filter of that table are joined with it, and each text and item that share a hash are compared: along every
diagonal with an equal window, any run of aligned tokens, mismatches allowed, may decide.

Texts are known by their digest in between, so copies are compared once, and only texts with a hit are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from hashlib import md5
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import decoded, discard, materialize, small_batches, texts

#: Masks of weight 5. Every run that the default thresholds count, of an item of SHORT tokens or more, has an equal window
#: under one of them wherever its mismatches lie; a test goes through all of them.
MASKS = ((0, 1, 2, 3, 5), (0, 4, 5, 6, 7), (0, 2, 3, 6, 7))
#: Shorter items have masks of their own: all of their tokens but as many as may differ, for each choice of these.
SHORT = 10
#: Aligned equal tokens that make an overlap (at most the share of the item's), and the least share of them in the run.
MIN_MATCHES, MIN_IDENTITY = 12, 0.8
#: Items of fewer tokens are taken for no evidence; 1 searches all.
MIN_ITEM = 5
#: Benchmark hashes that are broadcast to the documents' hashes (about 40 bytes each); more are joined by a shuffle, salted.
BROADCAST_SEEDS, SALTS = 500_000, 16
#: Bits of the filter a hash, and the filter's least and most bits as powers of two (8 MB at most).
BITS_A_SEED, FILTER_BITS = 256, (20, 26)
#: Elements of a block of diagonals that are compared at once.
BLOCK = 1 << 22
MEMO = 200_000
TOKEN = re.compile(r"[^\W_]+")

FOUND = "digest binary, item binary, n_matched bigint, n_aligned bigint, identity double, doc_start bigint"


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


def token_hashes(text: str, memo: TokenHashes) -> np.ndarray:
    tokens = TOKEN.findall(text.lower())
    return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))


#: A factor for each place in a mask, so that order counts.
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(SHORT)]

Mask = tuple[tuple[int, ...], int]  # the positions that count, and the window's width


def masks_of(n: int, share: Fraction) -> list[Mask]:
    """The masks that find an item of n tokens."""
    if n >= SHORT:
        return [(m, m[-1] + 1) for m in MASKS]
    return [(tuple(o for o in range(n) if o not in left), n) for left in combinations(range(n), n - max(1, ceil(share * n)))]


def padding(n: int, share: Fraction) -> int:
    """Places before and after a document that windows of such an item may reach: its odd tokens can lie outside."""
    return 0 if n >= SHORT else n - max(1, ceil(share * n))


def scaled(h: np.ndarray, pad: int = 0) -> list[np.ndarray]:
    """The tokens' hashes times each place's factor, which all masks share; padded with zeros, which equal no token."""
    h = np.concatenate([np.zeros(pad, np.uint64), h, np.zeros(pad, np.uint64)]) if pad else h
    return [h * f for f in FACTORS]


def window_hashes(places: list[np.ndarray], mask: Mask) -> np.ndarray:
    """A hash of the tokens under the mask for each window: their hashes times the factors of their places in it."""
    offsets, width = mask
    n = max(len(places[0]) - width + 1, 0)
    out = np.full(n, xxhash.xxh3_64_intdigest(repr(mask)), np.uint64)
    for place, o in zip(places, offsets, strict=False):
        out += place[o : o + n]
    return out


def item_seeds(share: Fraction, min_item: int):
    """(text, item) to (hash, item, n): the distinct window hashes of each item that is searched, n its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = TokenHashes()
        for batch in batches:
            hashes, items, sizes = [], [], []
            for item, raw in zip(batch.column(1).to_pylist(), texts(batch), strict=True):
                h = token_hashes(decoded(raw), memo)
                if len(h) >= max(1, min_item):
                    places = scaled(h)
                    found = np.unique(np.concatenate([window_hashes(places, m) for m in masks_of(len(h), share)]))
                    hashes.append(found.view(np.int64))
                    items += [item] * len(found)
                    sizes += [len(h)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*hashes, np.empty(0, np.int64)])), pa.array(items, pa.binary()), pa.array(sizes, pa.int32())], ["hash", "item", "n"])

    return run


def document_seeds(lengths: list[int], share: Fraction, bits: int, passing):
    """(doc_id, text) to (doc_id, digest, hashes): the documents with window hashes that pass the filter, and these."""
    masks = [(m, padding(n, share)) for n in lengths for m in masks_of(n, share)]
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = TokenHashes()
        flags = np.unpackbits(np.frombuffer(passing.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            at, digests, hashes = [], [], []
            for i, raw in enumerate(texts(batch)):
                h = token_hashes(decoded(raw), memo)
                places = {pad: scaled(h, pad) for pad in {pad for _, pad in masks}}
                found = []
                for mask, pad in masks:
                    w = window_hashes(places[pad], mask)
                    w = w[flags[w >> shift]]
                    if len(w):
                        found.append(w)
                if found:
                    at.append(i)
                    digests.append(md5(raw).digest())
                    hashes.append(np.unique(np.concatenate(found)).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in hashes])]).astype(np.int32)
            flat = pa.array(np.concatenate([*hashes, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "digest", "hashes"])

    return run


def diagonals(h: np.ndarray, item: np.ndarray, share: Fraction) -> np.ndarray:
    """Document position minus item position of every equal window, ascending. Each window of the item is met once with all of its likes."""
    pad = padding(len(item), share)
    mine, theirs = scaled(h, pad), scaled(item)
    marks = np.zeros(len(h) + len(item) + 2 * pad + 1, bool)
    for mask in masks_of(len(item), share):
        w, v = window_hashes(mine, mask), window_hashes(theirs, mask)
        if not len(w) or not len(v):
            continue
        order = np.argsort(v, kind="stable")
        low, high = np.searchsorted(v[order], w, "left"), np.searchsorted(v[order], w, "right")
        at = np.nonzero(high > low)[0]
        first = low[at]
        for start in np.unique(first).tolist():
            here = at[first == start]
            for p in order[start : high[here[0]]].tolist():
                marks[here - pad - p + len(item) + pad] = True
    return np.nonzero(marks)[0] - len(item) - pad


def best_overlap(h: np.ndarray, item: np.ndarray, min_matches: int, share: Fraction) -> tuple[int, int, int] | None:
    """Equal tokens, aligned tokens and start in the document of the best overlap, if one is good enough.

    The best has the most equal tokens, of these the fewest aligned, of these the first start. Diagonals are tried by
    their number of equal tokens, and those that can't be better are not tried.
    """
    need, n = min(min_matches, ceil(share * len(item))), len(item)
    d = diagonals(h, item, share)
    framed = np.concatenate([np.zeros(n, np.uint64), h, np.zeros(n, np.uint64)])
    rows = max(1, BLOCK // max(1, n))
    equal = lambda x: framed[x[:, None] + np.arange(n, 2 * n)] == item
    counts = np.concatenate([equal(d[i : i + rows]).sum(axis=1) for i in range(0, len(d), rows)] or [np.empty(0, np.int64)])
    best = None
    for k in np.lexsort((d, -counts)).tolist():
        if counts[k] < (need if best is None else best[0]) or (best and best[0] == best[1] == counts[k] and max(0, int(d[k])) >= best[2]):
            break
        m, length, at = best_run(equal(d[k : k + 1])[0], share)
        if m >= need and (best is None or (m, -length, -(at + int(d[k]))) > (best[0], -best[1], -best[2])):
            best = m, length, at + int(d[k])
    return best


def best_run(equal: np.ndarray, share: Fraction) -> tuple[int, int, int]:
    """Equal tokens, length and start of the run with the most equal tokens of all with at least `share` of them equal.

    Ties go to the shortest, then the first. In whole numbers: such a run's end has a balance not below its start's, so
    each end's best start is the first with a balance that low.
    """
    count = np.concatenate([[0], np.cumsum(equal)])
    balance = share.denominator * count - share.numerator * np.arange(len(count))
    start = np.searchsorted(-np.minimum.accumulate(balance), -balance)
    n = count - count[start]
    most = int(n.max())
    if not most:
        return 0, 0, 0
    where = np.nonzero(equal)[0]
    # a run's first and last tokens are equal ones: the one after its start, the one before its end
    ends = np.nonzero(n == most)[0]
    first, last = where[count[start[ends]]], where[count[ends] - 1]
    k = int(np.argmin(last - first))
    return most, int(last[k] - first[k]) + 1, int(first[k])


def verifier(min_matches: int, share: Fraction):
    """Rows (digest, kind, item, text) in order of digest and kind, the document's text first, then its items', to FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, now, h = TokenHashes(), None, None
        for batch in batches:
            rows = []
            for digest, kind, item, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), texts(batch), strict=True):
                said = token_hashes(decoded(raw), memo)
                if kind == 0:
                    now, h = digest, said
                elif now == digest and (best := best_overlap(h, said, min_matches, share)):
                    rows.append((digest, item, best[0], best[1], best[0] / best[1], best[2]))
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], FOUND.replace(",", "").split()[::2])

    return run


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def search(docs: DataFrame, benchmark: DataFrame, min_matches: int, min_identity: float, min_item: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits: doc_id, digest for each row that may have an overlap; found: FOUND, one row for each text and item that have; items: item_id, item)."""
    spark, paths, share = docs.sparkSession, [], Fraction(str(min_identity))
    put = lambda df, tag: materialize(df, tag, paths)
    small_batches(spark)
    named = benchmark.select("item_id", digest_of(benchmark["text"]).alias("item"), F.col("text").alias("text"))
    items = put(named.dropDuplicates(["item"]).select("text", "item"), "items")
    try:
        seeds = put(items.mapInArrow(item_seeds(share, min_item), "hash bigint, item binary, n int"), "seeds")
        n_seeds = seeds.count()
        sizes = sorted({r["n"] for r in seeds.select(F.least("n", F.lit(SHORT)).alias("n")).distinct().collect()})  # at most SHORT numbers
        bits = min(max(FILTER_BITS[0], (n_seeds * BITS_A_SEED).bit_length()), FILTER_BITS[1])
        place = F.shiftrightunsigned("hash", 64 - bits)  # the filter's bits are set on the executors, 32,768 a row
        words = seeds.groupBy((place / F.lit(32_768)).cast("int").alias("at")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32_768))).alias("bits")).collect()
        passing = bytearray((1 << bits) // 8)
        for r in words:
            passing[r["at"] * 4096 : (r["at"] + 1) * 4096] = r["bits"]
        flags = spark.sparkContext.broadcast(bytes(passing))  # 2 ** FILTER_BITS[1] bits at most
        hits = materialize(docs.select("doc_id", "text").mapInArrow(document_seeds(sizes, share, bits, flags), "doc_id bigint, digest binary, hashes array<bigint>"), "hits")
        asked = hits.select("digest", F.explode("hashes").alias("hash"))
        table = seeds.select("hash", "item")
        if n_seeds <= BROADCAST_SEEDS:
            met = asked.join(F.broadcast(table), "hash")
        else:
            salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = asked.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
        pairs = put(met.select("digest", "item").distinct(), "pairs")
        wanted = put(pairs.select("digest").distinct(), "wanted")  # read back, it has an exchange of its own: a hot text's join can be split
        whole = docs.select(digest_of(docs["text"]).alias("digest"), F.col("text")).join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
        rows = whole.select("digest", F.lit(0).alias("kind"), F.lit(b"").alias("item"), "text").union(pairs.join(items, "item").select("digest", F.lit(1).alias("kind"), "item", "text"))
        ordered = rows.repartition("digest").sortWithinPartitions("digest", "kind", "item")
        found = materialize(ordered.mapInArrow(verifier(min_matches, share), FOUND), "found")
    finally:
        discard(spark, paths)
    return hits.select("doc_id", "digest"), found, named.select("item_id", "item").distinct()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_matches: int = MIN_MATCHES, min_identity: float = MIN_IDENTITY, min_item: int = MIN_ITEM) -> DataFrame:
    """doc_id, item_id, n_matched, n_aligned, identity, doc_start (in tokens): every overlap, one row a pair.

    Tokens are lower-cased runs of letters and digits; bytes that aren't UTF-8 are read as U+FFFD, which is none. A pair
    counts if some run aligned without gaps has at least min_matches equal tokens (or min_identity of the item's tokens,
    if that is fewer) and at least min_identity equal ones. Of several runs the one with most equal tokens is given.
    With the default thresholds none is missed; with lower ones a run also needs an equal window under some mask.
    Items of under min_item tokens are not searched: so few are no evidence. min_item=1 searches every item with a token.
    Null, empty and token-free texts match nothing; with an empty table there are no rows. Null ids and repeated rows
    are like others: a repeated document row gives its rows again, a repeated item_id and text none. Only doc_id, item_id
    and the texts are read, so names of other columns do not matter. Texts of any length are read whole.
    """
    hits, found, items = search(docs, benchmark, min_matches, min_identity, min_item)
    return hits.join(found, "digest").join(items, "item").select("doc_id", "item_id", "n_matched", "n_aligned", "identity", "doc_start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_matches: int = MIN_MATCHES, min_identity: float = MIN_IDENTITY, min_item: int = MIN_ITEM) -> DataFrame:
    """The rows of `docs`, all columns, without an overlap; null and empty texts stay, and so do repeated rows. See contaminated_pairs.

    Rows are left out by the digests of the texts found, which Spark broadcasts if they are few.
    """
    _, found, _ = search(docs, benchmark, min_matches, min_identity, min_item)
    gone = materialize(found.select(F.col("digest").alias("__digest")).distinct(), "contaminated")
    return docs.join(gone, digest_of(docs["text"]) == gone["__digest"], "left_anti")


def summary(pairs: DataFrame) -> DataFrame:
    """doc_id, n_items, most_matched: one row for each document with an overlap."""
    return pairs.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("n_matched").alias("most_matched"))


def oracle(min_matches: int = MIN_MATCHES, share: tuple[int, int] = (4, 5), min_item: int = MIN_ITEM) -> str:
    """The same in DuckDB SQL, without seeds: every diagonal with enough equal tokens, and every run on it."""
    a, b = share
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents)),
b AS MATERIALIZED (SELECT item_id, len(w) AS n, unnest(w) AS w, unnest(range(len(w))) AS q FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark) WHERE len(w) >= {min_item}),
m AS (SELECT doc_id, item_id, n, p - q AS d, list(q ORDER BY q) AS qs FROM d JOIN b USING (w) GROUP BY ALL HAVING count(*) >= least({min_matches}, ({a} * n + {b} - 1) // {b})),
e AS MATERIALIZED (SELECT doc_id, item_id, n, d, unnest(qs) AS q, unnest(range(len(qs))) AS i FROM m),
r AS (SELECT x.doc_id, x.item_id, y.i - x.i + 1 AS n_matched, y.q - x.q + 1 AS n_aligned, x.q + x.d AS doc_start
      FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.d = y.d AND y.i >= x.i
      WHERE {b} * (y.i - x.i + 1) >= {a} * (y.q - x.q + 1) AND y.i - x.i + 1 >= least({min_matches}, ({a} * x.n + {b} - 1) // {b}))
SELECT doc_id, item_id, n_matched::BIGINT AS n_matched, n_aligned::BIGINT AS n_aligned, n_matched / n_aligned AS identity, doc_start::BIGINT AS doc_start
FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, n_aligned, doc_start) = 1"""
