"""Pulling a change feed into a store: last write wins, pending edits rebased, in one commit a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.changes import lww_winners, rebase_outbox
from quillspark.schema import TABLES
from quillspark.sources.store import Store


def merge_page(store: Store, table: str, feed: DataFrame, batch: int, meta: dict | None = None) -> dict[str, int] | None:
    """Applies a page of changes; running it again changes nothing (None). Only the parts of the table that winners fall into are rewritten.

    Returns the run's numbers: rows pulled, rows that applied on the way, rows skipped, and queued edits superseded.
    """
    key, state = TABLES[table].key, store.state()
    if batch <= state["batch"]:
        return None
    have, struct = feed.columns, TABLES[table].struct
    feed = feed.select(*(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in struct), "change_seq")
    local = store.table(table).join(feed.select(key).distinct(), key, "left_semi").select(key, "updated_at")
    with store.scratch(lww_winners(feed, local, key), f"winners-{table}") as winners:  # they are read several times
        replaced, lost = {}, None
        if "outbox" in state["tables"]:
            kept, lost = rebase_outbox(store.table("outbox"), winners.withColumn("table_name", F.lit(table)), key)
            replaced["outbox"] = kept
        pulled = feed.agg(F.max("change_seq").alias("cursor"), F.count("*").alias("n")).first()
        merged = winners.agg(F.coalesce(F.sum("merged"), F.lit(0))).first()[0]
        counts = {"pulled": pulled["n"], "merged": merged, "skipped": pulled["n"] - merged, "superseded": lost.count() if lost is not None else 0}
        cursor = {f"cursor:{table}": pulled["cursor"]} if pulled["cursor"] is not None else {}
        return counts if store.apply(batch, {table: winners}, replaced, cursor | (meta or {})) else None


def merge_batch(store: Store, table: str, feed: DataFrame, batch: int) -> bool:
    """merge_page, as whether it changed anything."""
    return merge_page(store, table, feed, batch) is not None


def pull(store: Store, table: str, changes: DataFrame, checkpoint: str) -> StreamingQuery:
    """The same as a stream, one batch of files at a time, until what is there has been read. No watermark: late rows lose by their stamp alone.

    The store remembers the stream's last batch, so one that is replayed after a crash is known and does nothing.
    """
    mark = f"stream:{table}:{checkpoint}"

    def each(rows: DataFrame, batch: int) -> None:
        state = store.state()
        if batch > state["meta"].get(mark, -1) and merge_page(store, table, rows, state["batch"] + 1, {mark: batch}) is None:
            raise RuntimeError(f"another writer committed to {store.path}; the batch is tried again")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
