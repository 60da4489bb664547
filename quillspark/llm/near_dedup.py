"""MinHash near-duplicate components with sequential Bayesian verification.

Documents with equal shingle sets form one class; only classes are compared. Banded MinHash proposes candidates. A
candidate pair's signatures are compared in batches of hashes, and the pair is dropped once the posterior probability
that its similarity reaches the threshold falls under a bound; what is left is verified on the full shingle sets. The
bound is such that a pair at the threshold is dropped with probability `miss` at most over all batches.

No bucket is expanded into all its pairs. Three passes find the links that matter for the components:

1. each class against one pivot (one pair a class). A bucket's pivot is its class with the most bucket mates, and so
   the one nearest to the others; a class takes the best pivot of its buckets;
2. each class against the pivots of its other buckets, where the components still differ;
3. in each bucket that still holds several components, every class outside the bucket's largest component against
   every class of another component. Large buckets are cut into blocks of BLOCK_X by BLOCK_Y classes, and a block gives
   only the pairs that DEEP hashes leave. After this pass no candidate pair between two components is unverified, so
   the components are those that verifying all candidate pairs would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import binary_rows, discard, materialize, small_batches, texts

HASHES, BANDS, ROWS, STEP = 128, 24, 4, 32
#: Hashes that the third pass compares in large buckets, the classes of a block, and the pairs up to which a bucket is small.
DEEP, BLOCK_X, BLOCK_Y, FEW = 2048, 256, 1024, 4096
MEMO = 200_000

SIGNATURE = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, signature binary"


class WordHashes(dict):
    """Word -> 64-bit hash, with a bound on how many words it remembers."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, size: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words; a shorter text is one shingle, an empty none."""
    words = text.lower().split()  # on bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    span = min(size, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - span + 1 + i])
    return np.unique(out)


def coefficients(n: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20_240_601 + n)
    draw = lambda: r.randint(0, 2**32, n, dtype=np.uint64) << np.uint64(32) | r.randint(0, 2**32, n, dtype=np.uint64)  # noqa: E731
    return draw() | np.uint64(1), draw()


def minhash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 2048):
        best = np.minimum(best, (hashes[i : i + 2048, None] * a + b).min(axis=0))
    return best


def signer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (a, b) = WordHashes(), coefficients()
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            n, keys, sigs = [], [], np.zeros((batch.num_rows, HASHES), np.uint64)
            for i, text in enumerate(texts(batch)):
                s = shingle_set(text, size, memo)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    sigs[i] = minhash(s, a, b)
            parts = sigs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
            bands = np.broadcast_to(salt, parts.shape[:2]).copy()
            for j in range(ROWS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
            low = (mix(sigs) >> np.uint64(56)).astype(np.uint8)
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * BANDS, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel())),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "signature"],
            )

    return run


def set_maker(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            raw = [shingle_set(x, size, memo).tobytes() for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())], ["set_key", "shingles"])

    return run


def deep_signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = coefficients(DEEP)
    for batch in batches:
        deep = [(mix(minhash(np.frombuffer(x, np.uint64), a, b)) >> np.uint64(56)).astype(np.uint8).tobytes() for x in binary_rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deep, pa.binary())], ["set_key", "deep"])


def missed(least: list[int], similarity: float) -> float:
    """The probability that a pair of this similarity has too few equal hashes after some STEP of them."""
    c = similarity + (1 - similarity) / 256
    step = np.array([comb(STEP, m) * c**m * (1 - c) ** (STEP - m) for m in range(STEP + 1)])
    alive, lost = np.ones(1), 0.0
    for m in least:
        alive = np.convolve(alive, step)
        lost += alive[:m].sum()
        alive[:m] = 0
    return float(lost)


def least_matches(threshold: float, miss: float, hashes: int = HASHES) -> list[int]:
    """For n = STEP, 2 STEP ... hashes: the fewest equal ones at which P(similarity >= threshold) reaches a bound.

    The bound is `miss`, lowered by tenths until a pair at the threshold is lost with
    probability `miss` at most over all the looks together. The similarity has a uniform prior; two unequal hashes
    agree in their eight kept bits once in 256.
    """
    s = np.linspace(0.0005, 0.9995, 2000)
    c = s + (1 - s) / 256
    tails = []
    for n in range(STEP, hashes + 1, STEP):
        tail = []
        for m in range(n + 1):
            log = m * np.log(c) + (n - m) * np.log(1 - c)
            p = np.exp(log - log.max())
            tail.append(p[s >= threshold].sum() / p.sum())
        tails.append(tail)
    bound = miss
    while missed(out := [next(m for m, p in enumerate(tail) if p >= bound) for tail in tails], threshold) > miss:
        bound *= 0.9
    return out


def pruner(threshold: float, miss: float):
    least = least_matches(threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(binary_rows(batch.column(k))), np.uint8).reshape(-1, HASHES) for k in (2, 3))
            alive, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for k, m in enumerate(least):
                part = slice(k * STEP, (k + 1) * STEP)
                equal[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[equal[alive] >= m]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(alive)) for k in (0, 1)], ["a", "b"])

    return run


def blockwise(threshold: float, miss: float):
    """Pairs of a block that survive the comparison in steps: of two components, and in their first common bucket."""
    least = least_matches(threshold, miss, DEEP)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        (kx, lx, bx, dx, at, top), (ky, ly, by, dy, _, _) = ([t.column(c).to_pylist() for c in ("set_key", "label", "bands", "deep", "pos", "largest")] for t in (x, y))
        top, pos = top[0], at[0]
        number = {k: i for i, k in enumerate({*lx, *ly})}
        lx, ly = (np.array([number[k] for k in labels]) for labels in (lx, ly))
        open_ = lx[:, None] != ly
        order = {k: i for i, k in enumerate(sorted({*kx, *ky}))}
        after = np.array([order[k] for k in kx])[:, None] < np.array([order[k] for k in ky])
        open_ &= after | (ly == number.get(top, -1))
        bx, by = np.array(bx, np.int64), np.array(by, np.int64)
        for j in range(pos):
            open_ &= bx[:, j, None] != by[:, j]
        i, j = np.nonzero(open_)
        dx, dy = (np.frombuffer(b"".join(d), np.uint8).reshape(-1, DEEP) for d in (dx, dy))
        equal = np.zeros(len(i), np.int64)
        for k, m in enumerate(least):
            part = slice(k * STEP, (k + 1) * STEP)
            equal += (dx[i, part] == dy[j, part]).sum(axis=1)
            keep = equal >= m
            i, j, equal = i[keep], j[keep], equal[keep]
        return pa.table({"a": pa.array([kx[p] for p in i], pa.binary()), "b": pa.array([ky[p] for p in j], pa.binary())})

    return run


def verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (binary_rows(batch.column(k)) for k in (2, 3))
            keep = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) * 100 >= percent * max(len(p), len(q)) else 0
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    return run


def attach(pairs: DataFrame, what: DataFrame, column: str) -> DataFrame:
    """a, b and the column's values for both; a hot a or b is split by adaptive execution's skew join."""
    left = what.select(F.col("set_key").alias("a"), F.col(column).alias("x"))
    right = what.select(F.col("set_key").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def components(links: DataFrame, put: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """node, label: the least node that undirected links (a, b) reach, by least labels and pointer jumps."""
    edges = put(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("a", "b"), "edges")
    labels = put(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hop = put(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "hop")
        up = hop.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jump = put(hop.join(up, "label").select("node", "old", F.col("top").alias("label")), "labels")
        labels = jump.select("node", "label")
        if jump.where("old <> label").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs` (doc_id, text; other columns are ignored).

    Two documents are linked if 100 * intersection >= percent * union of their sets of distinct `shingle`-word shingles
    (words are runs outside 0x20 and 0x09-0x0D, A-Z lowered). A text with fewer words is one shingle. A null, empty or
    blank text has no shingles and is linked with nothing, other empty texts included: it is its own component. Rows
    with equal texts are one class, whatever their ids; rows that repeat a doc_id are judged by their own text each.
    component_id is the least doc_id of the component; nulls do not count, and a component of null ids only has null.
    kept: doc_id is component_id (for such a null component: true). An empty table gives an empty result. Texts of any
    length are read whole, as bytes: what isn't UTF-8 is part of its word.
    """
    paths: list[str] = []
    small_batches(docs.sparkSession)
    try:
        return materialize(_components_of(docs, shingle, percent, miss, lambda df, tag: materialize(df, tag, paths)), "near-duplicates")
    finally:
        discard(docs.sparkSession, paths)


def _components_of(docs: DataFrame, shingle: int, percent: int, miss: float, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What near_duplicates returns, as a plan over tables that `put` wrote."""
    docs = docs.select("doc_id", "text")
    signed = put(docs.mapInArrow(signer(shingle), SIGNATURE), "signatures")
    classes = put(
        signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), *(F.first(c).alias(c) for c in ("bands", "signature"))), "classes"
    )
    member = classes.select("set_key", F.explode("bands").alias("band"))
    apart = lambda df: df.hint("rebalance")  # an exchange of its own beside an aggregate, so that a hot key's join can be split  # noqa: E731
    buckets = apart(member.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    mates = put(member.join(buckets, "band"), "buckets")
    weights = mates.groupBy("set_key").agg(F.sum("n").alias("weight"))
    pivots = apart(mates.join(weights, "set_key").groupBy("band").agg(F.max(F.struct("weight", "set_key")).alias("best")))
    shared = put(mates.select("set_key", "band").join(pivots, "band").selectExpr("set_key", "band", "best", "best.set_key AS pivot"), "pivots")

    compared = shared.select("set_key").distinct()
    first_ids = put(classes.join(compared, "set_key", "left_semi").select("first_id"), "compared").hint("merge")
    source = docs.join(first_ids, docs.doc_id.eqNullSafe(first_ids.first_id), "left_semi")
    sets = put(source.mapInArrow(set_maker(shingle), "set_key binary, shingles binary"), "sets")
    if not sets.groupBy("set_key").count().where("count > 1").isEmpty():  # rows that repeat an id: each set once
        sets = put(sets.dropDuplicates(["set_key"]), "sets")

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        return exact(attach(pairs, classes, "signature").mapInArrow(pruner(percent / 100, miss), "a binary, b binary"), tag)

    def exact(survivors: DataFrame, tag: str) -> DataFrame:
        survivors = put(survivors, f"survivors-{tag}")
        links = attach(survivors, sets, "shingles").mapInArrow(verifier(percent), "a binary, b binary")
        return put(links.distinct(), f"links-{tag}")

    merged: list[DataFrame] = []  # each pass's components, over the labels of those before

    def labelled(rows: DataFrame, node: str, name: str) -> DataFrame:
        rows = rows.withColumn(name, F.col(node))
        for labels in merged:
            rows = rows.join(labels.select(F.col("node").alias(name), F.col("label").alias("__to")), name, "left").withColumn(name, F.coalesce("__to", name)).drop("__to")
        return rows

    def merge(links: DataFrame) -> None:
        ends = labelled(labelled(links, "a", "la"), "b", "lb").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        merged.append(components(ends, put))

    nearest = shared.where("set_key <> pivot").groupBy("set_key").agg(F.max("best").alias("best"))
    merge(verified(nearest.selectExpr("best.set_key AS a", "set_key AS b"), "1"))

    stars = shared.where("set_key <> pivot").select(F.col("pivot").alias("a"), F.col("set_key").alias("b")).distinct()
    stars = labelled(labelled(stars, "a", "la"), "b", "lb").where("la <> lb").select("a", "b")
    merge(verified(stars, "2"))

    placed = put(labelled(shared.select("set_key", "band"), "set_key", "label").select("set_key", "band", "label"), "placed")
    sizes = placed.groupBy("band", "label").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("band").agg(F.count("*").alias("k"), F.sum("n").alias("ny"), F.max(F.struct("n", "label")).alias("top")).where("k > 1")
    mixed = apart(mixed.selectExpr("band", "ny - top.n AS nx", "ny", "top.label AS largest"))
    full = placed.join(mixed, "band").join(classes.select("set_key", "bands"), "set_key")
    full = put(full.withColumn("pos", F.expr("cast(array_position(bands, band) - 1 AS int)")), "mixed")
    few = full.where(F.col("nx") * F.col("ny") <= FEW).withColumn("earlier", F.expr("slice(bands, 1, pos)"))
    x = few.where("label <> largest").select("band", F.col("set_key").alias("a"), F.col("label").alias("la"), F.col("earlier").alias("ea"))
    y = few.select("band", F.col("set_key").alias("b"), F.col("label").alias("lb"), F.col("earlier").alias("eb"), "largest")
    once = "la <> lb AND (lb = largest OR a < b) AND NOT arrays_overlap(ea, eb)"  # a pair counts in its first bucket
    rest = x.join(y, "band").where(once).select("a", "b")
    many = full.where(F.col("nx") * F.col("ny") > FEW)
    deep = sets.join(many.select("set_key").distinct(), "set_key", "left_semi").select("set_key", "shingles").mapInArrow(deep_signer, "set_key binary, deep binary")
    many = many.join(deep, "set_key").withColumns({"wx": F.ceil(F.col("nx") / BLOCK_X), "wy": F.ceil(F.col("ny") / BLOCK_Y)})
    deal = lambda rows, own, other, n, m: rows.withColumn(own, F.pmod(F.xxhash64("set_key"), F.col(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))  # noqa: E731
    columns = lambda: [F.col(c).alias(c) for c in ("set_key", "label", "bands", "deep", "pos", "largest", "band", "i", "j")]  # noqa: E731
    x = deal(many.where("label <> largest"), "i", "j", "wx", "wy").select(*columns()).groupBy("band", "i", "j")
    y = deal(many, "j", "i", "wy", "wx").select(*columns()).groupBy("band", "i", "j")
    blocks = x.cogroup(y).applyInArrow(blockwise(percent / 100, miss), "a binary, b binary")
    merge(exact(blocks, "4").union(verified(rest, "3")))

    keyed = labelled(classes.select("set_key", "first_id"), "set_key", "label")
    least = put(keyed.groupBy("label").agg(F.min("first_id").alias("component_id")), "least")  # so that a hot label's join can be split
    of = keyed.join(least, "label").select("set_key", "component_id")
    linked = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key").join(of, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.expr("doc_id <=> component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, whose doc_id is the least of its component; an empty table stays empty.

    Rows of one doc_id all stay if any is kept; among rows without an id, those outside any component with ids stay.
    Null, empty and blank texts stay. Names of other columns do not matter.
    """
    kept = near_duplicates(docs, shingle, percent).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    kept = materialize(kept, "kept").hint("merge")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__kept_id"]), "left_semi")


def oracle(size: int = 2, percent: int = 80) -> str:
    """The same in DuckDB SQL: every pair with a common shingle, then the components. Small tables only."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	

]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(greatest(len(w) - {size} + 1, 1)), lambda i: array_to_string(list_slice(w, i + 1, i + {size}), ' '))) END AS s FROM w),
u AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""
