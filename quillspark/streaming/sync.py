"""Pulling, reconciling and flushing a store against a server, in this order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.changes import invalid_feed_rows, redirect_targets, stalled
from quillspark.operators.staging import flush_groups, lacking
from quillspark.schema import TABLES
from quillspark.sources.server import Server
from quillspark.sources.store import Store
from quillspark.streaming.merge import merge_page

PAGE = 1000
REMAP = "bookIdRemap"


class SyncError(RuntimeError):
    """A run that stopped before anything was sent."""


@dataclass
class Pulled:
    """Numbers of a pull, and the tables that failed with their errors."""

    pulled: int = 0
    merged: int = 0
    skipped: int = 0
    superseded: int = 0
    failed: dict[str, str] = field(default_factory=dict)


@dataclass
class Flushed:
    """Queued edits that were sent, and those that stay."""

    ok: int = 0
    failed: int = 0


def pull_table(store: Store, server: Server, table: str, page: int = PAGE, strict: bool = False) -> Pulled:
    """Reads on from the table's cursor, page by page, until a page isn't full. Each page is one commit with its cursor.

    A full page that doesn't move the cursor is an error; with `strict` so is any row out of form (for an import).
    """
    out, key = Pulled(), TABLES[table].key
    while True:
        after = store.get(f"cursor:{table}", 0)
        with store.scratch(server.fetch_page(table, after, page), f"page-{table}") as rows:
            if strict and not invalid_feed_rows(rows.withColumn("page", F.lit(0)).withColumn("place", F.col("change_seq")), key).isEmpty():
                raise SyncError(f"{table}: a row of the page is out of form")
            n = rows.count()
            if stalled(rows, after, page).first()["stalled"] and n:
                raise SyncError(f"{table}: a full page does not move the cursor {after}")
            if n:
                counts = merge_page(store, table, rows, store.state()["batch"] + 1)
                if counts is None:
                    raise SyncError(f"{table}: another writer committed meanwhile")
                for name, number in counts.items():
                    setattr(out, name, getattr(out, name) + number)
        if n < page:
            return out


def pull_all(store: Store, server: Server, tables: Iterable[str] = tuple(TABLES), page: int = PAGE, strict: bool = False) -> Pulled:
    """Every table by itself: one that fails keeps its cursor, and the others go on."""
    out = Pulled()
    for table in tables:
        try:
            one = pull_table(store, server, table, page, strict)
        except Exception as e:  # noqa: BLE001 - whatever a connector raises concerns its table only
            out.failed[table] = f"{type(e).__name__}: {e}"
            continue
        out = Pulled(out.pulled + one.pulled, out.merged + one.merged, out.skipped + one.skipped, out.superseded + one.superseded, out.failed)
    return out


def flush(store: Store, server: Server, user: str) -> Flushed:
    """Sends the queued edits, one record's as one, tables with parents first; clears those that arrived.

    A record waits, and so do its children, if a parent failed or waits in this run. One that lacks a column an insert
    needs patches the row that is there. A book that the server keeps under another id (`server_id`) is remembered
    before its notes are sent, which then go to that id.
    """
    remap: dict[str, str] = dict(store.get(REMAP, {}))
    failed: dict[str, DataFrame] = {}
    done = None
    with store.scratch(flush_groups(store.table("outbox")).where(F.col("table_name").isin(*TABLES)), "flush") as groups:
        for t in TABLES.values():
            rows = groups.where(F.col("table_name") == t.name).select(F.col("record_id").alias(t.key), "fields", "ids")
            if rows.isEmpty():
                continue
            if t.name == "notes" and remap:
                rows = repointed(rows, remap)
            waits = None
            for column, parent in t.parents:
                if parent in failed:
                    part = rows.join(failed[parent].select(F.col("id").alias("__p")), F.col("fields")[column] == F.col("__p"), "left_semi").select(F.col(t.key).alias("id"))
                    waits = part if waits is None else waits.union(part)
            go = rows if waits is None else rows.join(waits.select(F.col("id").alias(t.key)), t.key, "left_anti")
            short = lacking(F.col("fields"), F.lit(t.name))
            refused = server.upsert(t.name, go.where(~short).select(t.key, "fields"), user)
            without_key = go.where(short).select(t.key, F.map_filter("fields", lambda k, v: k != t.key).alias("fields"))
            refused = refused.union(server.patch(t.name, without_key)).select("id")
            bad = (refused if waits is None else refused.union(waits)).distinct()
            failed[t.name] = store.spark.createDataFrame(bad.collect(), "id string")  # what one flush could not send
            sent = go.join(refused.select(F.col("id").alias(t.key)), t.key, "left_anti")
            done = sent.select("ids") if done is None else done.union(sent.select("ids"))
            if t.name == "books":
                named = sent.where(F.col("fields")["server_id"].isNotNull() & (F.col("fields")["server_id"] != F.col("id"))).select("id", F.col("fields")["server_id"].alias("to"))
                if new := {r["id"]: r["to"] for r in named.collect()}:
                    remap |= new
                    store.set(**{REMAP: remap})
        if done is None:
            return Flushed()
        with store.scratch(done.select(F.explode("ids").alias("id")), "sent") as sent:
            result = Flushed(sent.count(), groups.select(F.sum(F.size("ids"))).first()[0])
            result.failed -= result.ok
            if not store.apply(store.state()["batch"] + 1, {}, {"outbox": store.table("outbox").join(sent, "id", "left_anti")}):
                raise SyncError("another writer committed meanwhile; sent edits stay queued")
        return result


def repointed(rows: DataFrame, remap: dict[str, str]) -> DataFrame:
    """Edits of notes with the book that redirects lead to."""
    edges = rows.sparkSession.createDataFrame(list(remap.items()), "id string, next string")
    ends = redirect_targets(edges).select(F.col("id").alias("__book"), F.col("target").alias("__to"))
    moved = rows.join(ends, F.col("fields")["book_id"] == F.col("__book"), "left")
    book = F.create_map(F.lit("book_id"), F.col("__to"))
    return moved.withColumn("fields", F.when(F.col("__to").isNotNull(), F.map_concat(F.map_filter("fields", lambda k, v: k != "book_id"), book)).otherwise(F.col("fields"))).drop("__book", "__to")


Reconcile = Callable[[Store, Server], dict[str, int]]


def sync(store: Store, server: Server, user: str, reconcile: Reconcile | None = None, tables: Iterable[str] = tuple(TABLES), page: int = PAGE) -> tuple[Pulled, dict[str, int], Flushed]:
    """Pull, reconcile, flush. If any table failed to pull, nothing is reconciled or sent: an edit that the missing page
    supersedes would overwrite it. A reconciliation that fails stops nothing."""
    pulled = pull_all(store, server, tables, page)
    if pulled.failed:
        raise SyncError(f"pull failed for {', '.join(pulled.failed)}: {pulled.failed}")
    return pulled, _reconciled(store, server, reconcile), flush(store, server, user)


def pull_and_reconcile(store: Store, server: Server, reconcile: Reconcile | None = None, tables: Iterable[str] = tuple(TABLES), page: int = PAGE) -> tuple[Pulled, dict[str, int]]:
    """Like sync without the flush; if a table failed, its error is reported and nothing is reconciled."""
    pulled = pull_all(store, server, tables, page)
    return pulled, {} if pulled.failed else _reconciled(store, server, reconcile)


def _reconciled(store: Store, server: Server, reconcile: Reconcile | None) -> dict[str, int]:
    try:
        return reconcile(store, server) if reconcile else {}
    except Exception:  # noqa: BLE001 - it is tried again after the next pull
        return {}
