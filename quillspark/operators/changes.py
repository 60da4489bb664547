"""Change feeds and pending edits: last-write-wins merge, collapse, hold-back, redirects, throttled signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOPS = 20


def lww_winners(feed: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """The feed row that each record ends with; feed: key, change_seq, updated_at, deleted, ...; local: key, updated_at.

    As if rows were applied one by one in change_seq order: a tombstone for an absent record is skipped, and a row
    applies only if strictly newer than what is there; a missing stamp is 0. Set-based: of the rows from the first live
    one on (all, if the record is there), the greatest stamp wins, among equals the earliest, if newer than local.
    `merged` counts the rows that would have been applied on the way.
    """
    stamped = feed.where(F.col(key).isNotNull()).withColumn("__at", F.coalesce("updated_at", F.lit(0)))
    known = local.select(key, F.coalesce("updated_at", F.lit(0)).alias("__local"))
    rows = stamped.join(known, key, "left")
    per = Window.partitionBy(key)
    rows = rows.withColumn("__live", F.min(F.when(~F.coalesce("deleted", F.lit(False)), F.col("change_seq"))).over(per))
    rows = rows.where("__local IS NOT NULL OR change_seq >= __live")
    before = per.orderBy("change_seq").rowsBetween(Window.unboundedPreceding, -1)
    bar = F.greatest(F.max("__at").over(before), F.col("__local"))
    rows = rows.withColumn("__applied", (bar.isNull() | (F.col("__at") > bar)).cast("bigint"))
    rows = rows.withColumn("merged", F.sum("__applied").over(per)).where("merged > 0 AND __applied = 1")
    rank = F.row_number().over(per.orderBy(F.desc("__at"), F.asc("change_seq")))
    return rows.withColumn("__rn", rank).where("__rn = 1").drop("__rn", "__at", "__local", "__live", "__applied")


def merged_state(local: DataFrame, winners: DataFrame, key: str) -> DataFrame:
    """Local rows, those with a winner replaced whole."""
    return local.join(winners.select(key), key, "left_anti").unionByName(winners.select(*local.columns))


def page_watermark(feed: DataFrame) -> DataFrame:
    """The greatest change_seq over all keyed rows, skipped and losing ones included."""
    return feed.agg(F.max("change_seq").alias("cursor"))


def oldest_first(outbox: DataFrame) -> DataFrame:
    """Queued edits in the order in which they were made."""
    return outbox.orderBy("created_at", "id")


def rebase_outbox(outbox: DataFrame, winners: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, the newest discarded stamp by record): queued edits at or under the winner's stamp go; those without a stamp stay. If both have a table_name, it counts too."""
    stamp = F.get_json_object("payload", "$.updated_at").try_cast("bigint")
    by = ["record_id"] + (["table_name"] if {"table_name"} <= set(winners.columns) & set(outbox.columns) else [])
    won = winners.select(F.col(key).cast("string").alias("record_id"), *by[1:], F.coalesce("updated_at", F.lit(0)).alias("__won"))
    queued = outbox.withColumn("__at", stamp)
    joined = queued.join(won, by, "left").withColumn("__gone", F.coalesce(F.col("__at") <= F.col("__won"), F.lit(False)))
    return joined.where("NOT __gone").select(*outbox.columns), joined.where("__gone").groupBy("record_id").agg(F.max("__at").alias("discarded_at"))


def collapse(edits: DataFrame, sticky: str = "deleted") -> DataFrame:
    """record, field, value: of each record's pending edits the last value of each field, explicit nulls too; a delete stays.

    edits: record, created_at, id, fields (map<string,string>).
    """
    from quillspark.functions.text import truthy

    rows = edits.select("record", "created_at", "id", F.explode("fields").alias("field", "value"))
    last = rows.groupBy("record", "field").agg(
        F.max_by("value", F.struct("created_at", "id")).alias("value"),
        F.max(truthy(F.coalesce("value", F.lit("null")))).alias("__ever"),
    )
    return last.select("record", "field", F.when((F.col("field") == sticky) & F.col("__ever"), "true").otherwise(F.col("value")).alias("value"))


def redirect_targets(edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """id, target: where up to `hops` redirects lead; edges: id, next (functional: one row an id). Cycles and self-loops end the chase.

    Each round doubles the reach where it can, so the chase takes few joins; the last hops are single.
    """
    step = edges.where("next IS NOT NULL AND cast(next AS string) <> ''").select(F.col("id"), F.when(F.col("next") == F.col("id"), None).otherwise(F.col("next")).alias("next")).where("next IS NOT NULL")
    doubled, left, at = step, hops, step.select("id", F.col("id").alias("target"))
    while left:
        if left & 1:
            hop = doubled.select(F.col("id").alias("target"), F.col("next").alias("__next"))
            at = at.join(hop, "target", "left").select("id", F.coalesce("__next", "target").alias("target"))
        left >>= 1
        if left:
            onward = doubled.select(F.col("id").alias("next"), F.col("next").alias("__then"))
            doubled = doubled.join(onward, "next", "left").select("id", F.coalesce("__then", "next").alias("next"))
    return at


def redirects(books: DataFrame, local: DataFrame | None = None) -> DataFrame:
    """id, next: where a book leads; its own merged_into counts before the local redirects (id, next), with which absent books lead on too."""
    own = books.where("coalesce(merged_into, '') <> ''").select("id", F.col("merged_into").alias("next"))
    return own if local is None else own.union(local.join(own.select("id"), "id", "left_anti").select("id", "next"))


def held_back(tables: dict[str, DataFrame], failed: dict[str, DataFrame], order: list) -> dict[str, DataFrame]:
    """The ids that wait by table: those of which some parent failed or waits; tables come parents first."""
    bad: dict[str, DataFrame] = {}
    for t in order:
        if t.name not in tables:
            continue
        found = failed.get(t.name)
        for column, parent in t.parents:
            if parent in bad:
                child = tables[t.name].join(bad[parent].withColumnRenamed("id", column), column, "left_semi").select(F.col(t.key).alias("id"))
                found = child if found is None else found.union(child)
        if found is not None:
            bad[t.name] = found.distinct()
    return bad


def sparse(fields, required: list[str]):
    """Whether a partial row lacks a column that an insert needs; a null that is there counts as there."""
    return F.exists(F.array(*map(F.lit, required)), lambda c: ~F.map_contains_key(fields, c))


def apply_partial(current, partial):
    """A map with the partial's keys over the current ones, nulls set too."""
    return F.map_concat(F.map_filter(current, lambda k, v: ~F.map_contains_key(partial, k)), partial)


def import_accepted(candidates: DataFrame, local: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """Candidates strictly newer than both the local and the server row, tombstones included."""
    rows = candidates.join(local.select(key, F.col("updated_at").alias("__l")), key, "left").join(server.select(key, F.col("updated_at").alias("__s")), key, "left")
    bar = F.greatest("__l", "__s")
    return rows.where(bar.isNull() | (F.col("updated_at") > bar)).drop("__l", "__s")


def batch_stamp(compared: DataFrame, now_ms: int) -> DataFrame:
    """One stamp over everything compared, and not before now."""
    return compared.agg(F.greatest(F.lit(now_ms).cast("bigint"), F.max("updated_at") + F.lit(1)).alias("stamp"))


def invalid_feed_rows(feed: DataFrame, key: str) -> DataFrame:
    """Rows that abort an import: no key, a missing or not rising change_seq, or no stamp or deletion mark."""
    previous = F.lag("change_seq").over(Window.partitionBy("page").orderBy("place"))
    return feed.withColumn("__p", previous).where(
        F.coalesce(F.col(key).cast("string"), F.lit("")).eqNullSafe("") | F.col("change_seq").isNull() | (F.col("change_seq") < 0) | (F.col("change_seq") <= F.col("__p")) | F.col("updated_at").isNull() | F.col("deleted").isNull()
    ).drop("__p")


def stalled(feed: DataFrame, after: int, size: int) -> DataFrame:
    """One row, `stalled`: a full page that does not move the cursor."""
    return feed.agg(((F.count("*") >= size) & (F.coalesce(F.max("change_seq"), F.lit(after)) <= after)).alias("stalled"))
