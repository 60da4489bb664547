"""Temperature mixing of sources to target weights, in DataFrame operations only.

A source's weight is its token share to the power of an exponent from 0 (all sources alike) to 1 (as they are). The
exponent is bisected, PROBES points a round, to the least at which no source is read more than `max_repeats` times as
often as another, or to the largest at which the weights' entropy is at least `entropy`. Weights times the token budget
are the sources' targets.

Targets are realised as block permutations. Each pass over a source has a permutation of its own, from a digest of the
pass and the id. A source is read whole as often as its target holds it; of the next pass it is read up to its target:
documents are dealt by digest into 4096 parts, and only within the part in which the target ends are they ordered and
cut. The passes of a source fill the whole run evenly, however many they are, so each of the run's BLOCKS blocks has all
sources at their weights, in the order of the digests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize

MAX_REPEATS = 2.0
PROBES, ROUNDS = 32, 6
#: Hexadecimal digits of the digest that name a part of a pass: 4096 parts.
DIGITS = 3
#: Blocks of the run, and about how many tokens a partition of mixed documents has (of whole blocks, at most one each).
BLOCKS, TOKENS_A_PARTITION = 1 << 18, 5_000_000
#: Sources up to which their few numbers are broadcast to the documents.
BROADCAST_SOURCES = 100_000


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def source_key(source: Column) -> Column:
    """Null is a source of its own, apart from the empty name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def place_of(doc_id: Column, turn: Column) -> Column:
    """A document's place in the permutation of a pass: equal ids stand at one place; null ids at that of the empty text."""
    return F.md5(F.concat(turn.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def block_of(place: Column, turn: Column, reads: Column) -> Column:
    """The run's block in which a place of a pass falls, if the source is read `reads` times over the run."""
    share = F.conv(F.substring(place, 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))
    return F.least(F.lit(BLOCKS - 1).cast("bigint"), F.floor((turn - 1 + share) / reads * F.lit(float(BLOCKS))))


def exponent(totals: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> float:
    """The least exponent that keeps to max_repeats, or the largest that has the entropy (0 if none has); totals: key, tokens."""
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give either max_repeats or entropy")
    shares = totals.where("tokens > 0").crossJoin(F.broadcast(totals.agg(F.sum("tokens").alias("all")))).select((F.col("tokens") / F.col("all")).alias("p"))  # one row beside each
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        probes = shares.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(PROBES))))
        probes = probes.withColumn("a", F.lit(low) + F.lit(high - low) * F.col("k") / F.lit(PROBES))
        probes = probes.withColumn("w", F.pow("p", "a"))
        met = probes.groupBy("k").agg(
            F.first("a").alias("a"),
            F.max(F.col("w") / F.col("p")).alias("most"),
            F.min(F.col("w") / F.col("p")).alias("least"),
            F.sum("w").alias("z"),
            F.sum(F.col("w") * F.log("w")).alias("wlogw"),
        )
        ok = F.col("most") <= F.lit(max_repeats) * F.col("least") if entropy is None else F.log("z") - F.col("wlogw") / F.col("z") >= F.lit(entropy)
        # repeats and entropy fall as the exponent rises: for repeats the limit holds above some exponent, for entropy below
        best = met.where(ok).agg(F.min("a").alias("first"), F.max("a").alias("last")).first()
        step = (high - low) / PROBES
        if entropy is None:
            high = best["first"] if best["first"] is not None else high
            low = max(low, high - step)
        else:
            low = best["last"] if best["last"] is not None else low
            high = min(high, low + step)
    return high if entropy is None else low


def planned(docs: DataFrame, budget_tokens: int | None, max_repeats: float | None, entropy: float | None, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, key of each row; per source key, tokens, target, whole, reads, cut, exponent); see `mixed`."""
    keyed = materialize(docs.select("doc_id", "source", token_count(docs["text"]).alias("n_tokens"), source_key(docs["source"]).alias("key")), "mixing", paths)
    totals = materialize(keyed.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "totals", paths)
    alpha = exponent(totals, max_repeats, entropy)
    shares = totals.crossJoin(F.broadcast(totals.agg(F.sum("tokens").alias("all"))))  # one row beside each
    raw = shares.withColumn("w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("all"), F.lit(alpha))).otherwise(0.0))
    norm = raw.agg(F.sum("w").alias("z"), F.max(F.when(F.col("w") > 0, F.col("tokens") / F.col("w"))).alias("cover"))
    raw = raw.crossJoin(F.broadcast(norm))
    total = F.col("cover") * F.col("z") if budget_tokens is None else F.lit(float(budget_tokens))
    aims = raw.withColumn("target", F.round(F.coalesce(total * F.col("w") / F.col("z"), F.lit(0.0))).cast("bigint"))
    aims = aims.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(F.lit(1).cast("bigint")))
    reads = F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens")).otherwise(1.0)
    aims = materialize(aims.select("key", "tokens", "target", "whole", (F.col("target") - F.col("whole") * F.col("tokens")).alias("rest"), reads.alias("reads")), "aims", paths)
    # The part in which a source's last, partial pass ends, and the last place in it that still fits.
    placed = keyed.join(few(aims.where("tokens > 0")), "key").withColumn("place", place_of(F.col("doc_id"), F.col("whole") + 1))
    placed = placed.select("key", "n_tokens", "rest", "place", F.substring("place", 1, DIGITS).alias("part"))
    parts = materialize(placed.groupBy("key", "part").agg(F.sum("n_tokens").alias("in_part"), F.first("rest").alias("rest")), "parts", paths)
    upto = parts.withColumn("upto", F.sum("in_part").over(Window.partitionBy("key").orderBy("part")))
    ends = upto.where("upto > rest").groupBy("key").agg(F.min_by(F.struct("part", (F.col("upto") - F.col("in_part")).alias("before")), "part").alias("end"))
    ends = materialize(ends.select("key", "end.part", "end.before"), "ends", paths)
    inside = placed.join(few(ends), ["key", "part"]).groupBy("key", "part", "place").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("t").over(Window.partitionBy("key", "part").orderBy("place")))
    cuts = inside.where("upto <= rest").groupBy("key").agg(F.max("place").alias("cut"))
    plan = aims.join(ends.select("key", "part"), "key", "left").join(cuts, "key", "left")
    # Places up to `cut` are read once more; with none in the last part, those of the parts before it.
    plan = plan.select("key", "tokens", "target", "whole", "reads", F.coalesce("cut", "part").alias("cut"), F.lit(alpha).alias("exponent"))
    return keyed, materialize(plan, "plan")  # a row a source


def few(per_source: DataFrame) -> DataFrame:
    """Beside documents: broadcast, if its rows are few."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def read(rows: DataFrame, doc_id: str, whole: str = "whole", reads: str = "reads", cut: str = "cut", names: tuple[str, ...] = ("copies", "pass", "block", "place")) -> DataFrame:
    """`rows` once for each time that they are read, with how often that is, the pass, its block of the run and its place in it."""
    copies, turn, block, place = names
    once_more = place_of(F.col(doc_id), F.col(whole) + 1) <= F.col(cut)
    rows = rows.withColumn(copies, F.col(whole) + F.when(once_more, 1).otherwise(0)).where(F.col(copies) > 0)
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies))))
    rows = rows.withColumn(place, place_of(F.col(doc_id), F.col(turn)))
    return rows.withColumn(block, block_of(F.col(place), F.col(turn), F.col(reads)))


def mixed(docs: DataFrame, budget_tokens: int | None = None, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, copies, pass, block, place, exponent: a row for each time that a row of `docs` is read.

    Read in the order of block and place, this is the mixture. copies says how often the row is read, pass (from 1) which
    time this is. Tokens are runs of characters outside ASCII white space. Without a budget, it is the least at which
    every source is read whole, so no document is left out; with one, what does not fit has no row. Rows of one doc_id
    and source share a place, and are read alike. A null source is a source of its own. Null and empty texts have no
    tokens and follow their source; a source without any token is read once. An empty table gives an empty result. Only
    doc_id, text and source are read.
    """
    paths: list[str] = []
    try:
        keyed, plan = planned(docs, budget_tokens, max_repeats, entropy, paths)
        rows = read(keyed.join(few(plan), "key"), "doc_id")
        return materialize(rows.select("doc_id", "source", "n_tokens", "copies", "pass", "block", "place", F.round("exponent", 6).alias("exponent")), "mixed")
    finally:
        discard(docs.sparkSession, paths)


def mix(docs: DataFrame, budget_tokens: int | None = None, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> DataFrame:
    """The rows of `docs`, all columns, each as often and in the order that `mixed` says; see there for odd rows.

    Each partition holds a stretch of blocks, sorted, and partitions follow each other; copies of a document stand as far
    apart as their places. This shuffles the texts once, as the order is new. Names of other columns do not matter.
    """
    paths: list[str] = []
    spark = docs.sparkSession
    names = [f"__{i}_{uuid.uuid4().hex[:8]}" for i in range(8)]
    key, whole, reads, cut, copies, turn, block, place = names
    try:
        _, plan = planned(docs, budget_tokens, max_repeats, entropy, paths)
    finally:
        discard(spark, paths)
    tokens = plan.agg(F.sum(F.greatest("tokens", "target"))).first()[0] or 0
    most = min(BLOCKS, max(spark.sparkContext.defaultParallelism, -(-tokens // TOKENS_A_PARTITION)))
    known = plan.select(F.col("key").alias(key), F.col("whole").alias(whole), F.col("reads").alias(reads), F.col("cut").alias(cut))
    identity = f"__id_{uuid.uuid4().hex[:8]}"
    rows = docs.join(few(known), source_key(docs["source"]) == known[key]).withColumn(identity, docs["doc_id"])
    rows = read(rows, identity, whole, reads, cut, (copies, turn, block, place))
    rows = rows.repartitionById(most, (F.col(block) * most / F.lit(float(BLOCKS))).cast("int")).sortWithinPartitions(block, place)
    return rows.select(*(docs[c] for c in docs.columns))


def oracle() -> str:
    """The same in DuckDB SQL, for the default limits."""
    rounds = ["p AS (SELECT tokens / (SELECT sum(tokens) FROM totals) AS p FROM totals WHERE tokens > 0), r0 AS (SELECT 0.0::DOUBLE AS low, 1.0::DOUBLE AS high)"]
    for i in range(ROUNDS):
        rounds.append(
            f"m{i} AS (SELECT a FROM (SELECT k, a, pow(p, a) AS w, p FROM (SELECT k, low + (high - low) * k / {PROBES} AS a FROM r{i}, range(1, {PROBES + 1}) AS t(k)), p) "
            f"GROUP BY k, a HAVING max(w / p) <= {MAX_REPEATS} * min(w / p)), "
            f"r{i + 1} AS (SELECT greatest(low, coalesce((SELECT min(a) FROM m{i}), high) - (high - low) / {PROBES}) AS low, coalesce((SELECT min(a) FROM m{i}), high) AS high FROM r{i})"
        )
    return (
        r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n_tokens, coalesce('=' || source, '') AS key, coalesce(doc_id::VARCHAR, '') AS id FROM documents),
totals AS (SELECT key, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY key), """
        + ", ".join(rounds)
        + f""",
x AS (SELECT high AS alpha FROM r{ROUNDS}),
w AS (SELECT key, tokens, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM totals), alpha) ELSE 0 END AS w FROM totals, x),
t AS (SELECT key, tokens::BIGINT AS tokens, coalesce(round((SELECT max(tokens / w) FROM w WHERE w > 0) * w), 0)::BIGINT AS target FROM w),
n AS (SELECT *, CASE WHEN tokens > 0 THEN target // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN target / tokens ELSE 1.0 END AS reads FROM t),
c AS (SELECT d.*, whole, reads, whole + CASE WHEN tokens > 0 AND sum(n_tokens) OVER (PARTITION BY key ORDER BY md5((whole + 1) || ':' || id)) <= target - whole * tokens THEN 1 ELSE 0 END AS copies FROM d JOIN n USING (key)),
e AS (SELECT *, unnest(range(1, copies + 1)) AS pass FROM c),
f AS (SELECT *, md5(pass || ':' || id) AS place FROM e)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, copies::BIGINT AS copies, pass::BIGINT AS pass,
  least({BLOCKS - 1}, floor((pass - 1 + ('0x' || substr(place, 1, 13))::BIGINT / {float(16**13)}) / reads * {float(BLOCKS)}))::BIGINT AS block, place, round(alpha, 6) AS exponent FROM f, x"""
    )
