"""Merging an archive into a store: newer rows win, and what wins is staged in one commit under one stamp."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.schema import OUTBOX, TABLES, Table, conform
from quillspark.sources.store import Store


def compared(candidates: DataFrame, local: DataFrame, server: DataFrame, key: str) -> DataFrame:
    """The candidates with `accepted` (strictly newer than both, tombstones included) and `newest`, the greatest stamp of the three."""
    rows = candidates.join(local.select(key, F.col("updated_at").alias("__l")), key, "left").join(server.select(key, F.col("updated_at").alias("__s")), key, "left")
    bar = F.greatest("__l", "__s")
    return rows.withColumn("accepted", bar.isNull() | (F.col("updated_at") > bar)).withColumn("newest", F.greatest("updated_at", "__l", "__s")).drop("__l", "__s")


def stamped(rows: DataFrame, stamp: int, table: Table) -> DataFrame:
    """Whole live rows under the batch's stamp."""
    return conform(rows.withColumn("updated_at", F.lit(stamp).cast("bigint")).withColumn("deleted", F.lit(False)), table)


def payload_of(rows: DataFrame, table: Table) -> DataFrame:
    """record_id, payload: whole rows as queued edits, nulls and all."""
    return rows.select(F.col(table.key).alias("record_id"), F.to_json(F.struct(*(F.col(c) for c in table.columns)), {"ignoreNullFields": "false"}).alias("payload"))


def queued(outbox: DataFrame, rows: dict[str, DataFrame], now_ms: int) -> DataFrame:
    """The outbox without queued tombstones of the rows' records, and with the rows as its latest edits."""
    new = None
    for name, part in rows.items():
        part = payload_of(part, TABLES[name]).withColumn("table_name", F.lit(name))
        new = part if new is None else new.unionByName(part)
    if new is None:
        return outbox
    dead = F.lower(F.get_json_object("payload", "$.deleted")).isin("true", "1")
    gone = outbox.where(dead).join(new.select("record_id", "table_name"), ["record_id", "table_name"], "left_semi").select("id")
    last = outbox.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    new = new.crossJoin(F.broadcast(last)).withColumn("id", F.col("__last") + 1 + F.monotonically_increasing_id()).withColumn("created_at", F.lit(now_ms).cast("bigint"))  # one row
    return outbox.join(gone, "id", "left_anti").select(*OUTBOX.names).unionByName(new.select(*OUTBOX.names))


def summary(judged: dict[str, DataFrame]) -> DataFrame:
    """table_name, imported, skipped_stale: a row for each table."""
    out = None
    for name, rows in judged.items():
        part = rows.agg(F.count_if("accepted").alias("imported"), F.count_if(~F.col("accepted")).alias("skipped_stale")).select(F.lit(name).alias("table_name"), "imported", "skipped_stale")
        out = part if out is None else out.union(part)
    return out


def batch_stamp_of(judged: dict[str, DataFrame], now_ms: int) -> int | None:
    """Now, or one more than the newest stamp that an accepted row was compared with; None if nothing was accepted."""
    newest = None
    for rows in judged.values():
        part = rows.where("accepted").agg(F.max("newest").alias("newest"))
        newest = part if newest is None else newest.union(part)
    top = newest.agg(F.max("newest")).first()[0]
    if top is None:
        return None
    if top >= 2**63 - 1:
        raise OverflowError("no stamp is greater than that of a compared row")
    return max(now_ms, top + 1)


def import_merge(store: Store, tables: dict[str, DataFrame], server: Callable[[str, DataFrame], DataFrame], now_ms: int, seal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stages the archive's rows (Archive.checked()) that are newer than the store's and the server's; returns the summary.

    `server(table, ids)` gives the server's rows of some ids. `seal` turns open notes into the store's form: text and
    content tag; without a text both are null. All tables and the outbox change in one commit.
    """
    judged = {}
    for name, rows in tables.items():
        key = TABLES[name].key
        judged[name] = compared(rows, store.table(name).select(key, "updated_at"), server(name, rows.select(key)), key)
    counts = store.spark.createDataFrame(summary(judged).collect(), "table_name string, imported bigint, skipped_stale bigint")  # a row a table
    stamp = batch_stamp_of(judged, now_ms)
    if stamp is None:
        return counts
    writes = {}
    for name, rows in judged.items():
        rows = rows.where("accepted")
        if name == "notes" and seal is not None:
            rows = seal(rows)
        writes[name] = stamped(rows, stamp, TABLES[name])
    state = store.state()
    if not store.apply(state["batch"] + 1, writes, {"outbox": queued(store.table("outbox"), writes, stamp)}):
        raise RuntimeError("another writer committed meanwhile; nothing was imported")
    return counts
