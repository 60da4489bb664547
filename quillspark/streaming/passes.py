"""The reconciliation after a pull: passes over a store, in order, each by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import reconcile
from quillspark.operators.changes import redirects
from quillspark.operators.staging import as_partials, stage
from quillspark.schema import TABLES, conform
from quillspark.sources.canon import canon
from quillspark.sources.server import Covers, Server
from quillspark.sources.store import Store

MERGED = "mergedBookIds"


def _partials(rows: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    return as_partials(rows, TABLES[table], columns)


def backfill_books(store: Store, server: Server) -> int:
    """Books that live notes name and the store lacks, fetched by id; they are the server's, so nothing is queued."""
    missing = reconcile.missing_books(store.table("notes"), store.table("books"))
    rows = conform(server.fetch_by_ids("books", missing), TABLES["books"])
    n = rows.count()
    if n:
        store.apply(store.state()["batch"] + 1, {"books": rows})
    return n


def rehome_stranded(store: Store, now_ms: int) -> int:
    """Live notes on deleted books move to where these lead, or lose their book; those whose way is unknown wait."""
    books = store.table("books")
    local = store.spark.createDataFrame(list(store.get(MERGED, {}).items()), "id string, next string")
    led = redirects(books, local).withColumnRenamed("next", "__next")
    books = books.join(led, "id", "left").withColumn("merged_into", F.coalesce("__next", "merged_into")).drop("__next")
    rows = reconcile.stranded_notes(store.table("notes"), books).where("action <> 'defer'")
    rows = rows.select("id", F.col("target").alias("book_id"), F.lit(None).cast("string").alias("content_tag"), F.lit(now_ms).cast("bigint").alias("updated_at"))
    return _staged(store, "notes", rows, now_ms)


def _staged(store: Store, table: str, rows: DataFrame, now_ms: int, columns: list[str] | None = None) -> int:
    n = rows.count()
    if n:
        stage(store, {table: _partials(rows, table, columns)}, now_ms)
    return n


def keep_dropped_tags(store: Store, now_ms: int, prefix: str) -> int:
    ideas = reconcile.dropped_ideas(store.table("notes"), canon(store.spark), store.table("custom_ideas"), prefix, now_ms)
    return _staged(store, "custom_ideas", ideas, now_ms)


def merge_duplicates(store: Store, now_ms: int) -> int:
    """Live notes of one content tag fold into one; links and memberships move before the others are deleted, all in one commit."""
    notes = store.table("notes")
    clusters = reconcile.duplicate_clusters(notes).select("id", "survivor")
    moved = clusters.where("id <> survivor")
    n = moved.count()
    if n:
        folded = reconcile.merge_notes(notes, clusters, now_ms)
        lists = reconcile.moved_memberships(store.table("collection_memberships"), moved, now_ms)
        writes = {
            "notes": _partials(folded["survivors"], "notes", ["id", "tags", "image_path", "updated_at"]).union(_partials(folded["losers"], "notes", ["id", "deleted", "updated_at"])),
            "note_links": _partials(reconcile.retired_links(store.table("note_links"), moved, now_ms), "note_links"),
            "collection_memberships": _partials(lists["deleted"], "collection_memberships").union(_partials(lists["ensured"], "collection_memberships")),
        }
        stage(store, writes, now_ms)
    return n


def retire_signals(store: Store, now_ms: int) -> int:
    rows = reconcile.orphan_signals(store.table("note_signals"), store.table("notes")).withColumn("deleted", F.lit(True)).withColumn("updated_at", reconcile.later(now_ms))
    return _staged(store, "note_signals", rows, now_ms)


def heal_tags(store: Store, key: bytes, opened: Callable[[DataFrame], DataFrame], now_ms: int) -> int:
    """Content tags of live notes without one, from their open text; stamps stay."""
    rows = reconcile.tag_heal(opened(store.table("notes")), key)
    return _staged(store, "notes", rows.select("id", "content_tag"), now_ms, ["id", "content_tag"])


def resolve_covers(store: Store, server: Server, covers: Covers, base: str, source: str, flag: str, now_ms: int, budget: int = 10) -> int:
    """Covers are searched for unless the server's setting says false; a setting that can't be read is no reason not to."""
    try:
        enabled = (server.setting(flag) or "true").strip().lower() != "false"
    except Exception:  # noqa: BLE001
        enabled = True
    return _staged(store, "books", reconcile.resolved_covers(store.table("books"), covers, base, source, now_ms, budget, enabled), now_ms)


def reconcile_all(passes: dict[str, Callable[[], int]]) -> dict[str, int]:
    """Runs the passes in order, and counts what each changed; one that fails counts -1 and stops no other."""
    out = {}
    for name, run in passes.items():
        try:
            out[name] = run()
        except Exception:  # noqa: BLE001 - it is tried again after the next pull
            out[name] = -1
    return out


def passes(store: Store, server: Server, now_ms: int, prefix: str, key: bytes | None = None, opened: Callable[[DataFrame], DataFrame] = lambda x: x, covers: Covers | None = None, base: str = "", source: str = "", flag: str = "") -> dict[str, Callable[[], int]]:
    """The passes in their order: books, stranded notes, dropped tags, content tags, duplicates, signals, covers."""
    out = {"books": lambda: backfill_books(store, server), "stranded": lambda: rehome_stranded(store, now_ms), "dropped_tags": lambda: keep_dropped_tags(store, now_ms, prefix)}
    if key is not None:
        out["content_tags"] = lambda: heal_tags(store, key, opened, now_ms)
    out |= {"duplicates": lambda: merge_duplicates(store, now_ms), "signals": lambda: retire_signals(store, now_ms)}
    if covers is not None:
        out["covers"] = lambda: resolve_covers(store, server, covers, base, source, flag, now_ms)
    return out
