"""The read API: every query is a plan over the tables' DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK_MS = 604_800_000


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not deleted; an unknown `deleted` is not live."""
    return rows.where("deleted = false")


def newest_first(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc("created_at"), F.desc(key))


def page(rows: DataFrame, limit: int = -1, offset: int = 0) -> DataFrame:
    """A negative limit has no end."""
    rows = rows.offset(max(offset, 0)) if offset > 0 else rows
    return rows.limit(limit) if limit >= 0 else rows


def list_live(rows: DataFrame, key: str = "id", where: dict | None = None, limit: int = -1, offset: int = 0) -> DataFrame:
    for c, v in (where or {}).items():
        rows = rows.where(F.col(c) == F.lit(v))
    return page(newest_first(live(rows), key), limit, offset)


def get_row(rows: DataFrame, key: str, value) -> DataFrame:
    """Deleted rows included."""
    return rows.where(F.col(key) == F.lit(value))


def count_live(rows: DataFrame, where: dict | None = None) -> DataFrame:
    for c, v in (where or {}).items():
        rows = rows.where(F.col(c) == F.lit(v))
    return live(rows).agg(F.count("*").alias("n"))


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def notes_by_idea(notes: DataFrame, idea: str, limit: int = -1, offset: int = 0) -> DataFrame:
    return page(newest_first(live(notes).where(F.array_contains("tags", idea))), limit, offset)


def untagged(notes: DataFrame) -> DataFrame:
    return live(notes).where(F.coalesce(F.size(F.filter("tags", lambda t: t.isNotNull())), F.lit(0)) <= 0)


def untagged_notes(notes: DataFrame, limit: int = -1, offset: int = 0) -> DataFrame:
    return page(newest_first(untagged(notes)), limit, offset)


def links_of(links: DataFrame, note_id) -> DataFrame:
    return live(links).where((F.col("from_note_id") == F.lit(note_id)) | (F.col("to_note_id") == F.lit(note_id)))


def fresh_notes(notes: DataFrame, now_ms: int, failed: Column | None = None) -> DataFrame:
    """Created in the last seven days, the first instant included, with a text that is not blank."""
    rows = live(notes).where(F.col("created_at") >= now_ms - WEEK_MS).where(F.trim("text") != "")
    return rows if failed is None else rows.where(~failed)


def ordinal(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The row at place n modulo the number of rows, newest first; none of no rows.

    The place is narrowed by counts a day, then an hour, then a second, so that no task ranks all rows.
    """
    total = rows.count()
    if not total:
        return rows.limit(0)
    place = n % total
    for width in (86_400_000, 3_600_000, 1_000):  # one count for each day, then at most 24 and 3600
        bucket = F.floor(F.col("created_at") / width)
        sizes = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("b")).collect()
        for b, size in sizes:
            if place < size:
                rows = rows.where(bucket.eqNullSafe(F.lit(b)))
                break
            place -= size
    return newest_first(rows, key).offset(place).limit(1)


def tag_tally(notes: DataFrame) -> DataFrame:
    """idea, n: every occurrence counts, also within a note."""
    return live(notes).select(F.explode("tags").alias("idea")).where("idea IS NOT NULL").groupBy("idea").agg(F.count("*").alias("n")).orderBy("idea")


def counts(books: DataFrame, notes: DataFrame, ideas: DataFrame) -> DataFrame:
    """One row: live books, notes and custom ideas, and distinct tags."""
    one = lambda rows, name: live(rows).agg(F.count("*").alias(name))
    tags = live(notes).select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("active_ideas"))
    return one(books, "books").crossJoin(one(notes, "notes")).crossJoin(one(ideas, "custom_ideas")).crossJoin(tags)  # one row each


def books_with_counts(books: DataFrame, notes: DataFrame, limit: int = -1, offset: int = 0) -> DataFrame:
    """The page first, then the count of live notes for its books."""
    shown = list_live(books, limit=limit, offset=offset)
    if limit >= 0:  # the page's few ids first, so that only its books' notes are shuffled
        notes = notes.join(F.broadcast(shown.select(F.col("id").alias("book_id"))), "book_id", "left_semi")
    n = live(notes).groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("note_count"))
    return shown.join(n, "id", "left").withColumn("note_count", F.coalesce("note_count", F.lit(0).cast("bigint")))


def collection_note_counts(memberships: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct live pairs whose note is live."""
    pairs = live(memberships).join(live(notes).select(F.col("id").alias("note_id")), "note_id", "left_semi").select("collection_id", "note_id").distinct()
    return pairs.groupBy("collection_id").agg(F.count("*").alias("n")).orderBy("collection_id")


def first_seen(rows: DataFrame, value: str, *order: Column) -> DataFrame:
    """One row for each value: the first in the order."""
    w = Window.partitionBy(value).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def notes_of_collection(memberships: DataFrame, collection_id) -> DataFrame:
    rows = live(memberships).where(F.col("collection_id") == F.lit(collection_id))
    return newest_first(first_seen(rows, "note_id", F.desc("created_at"), F.desc("id"))).select("note_id")


def collections_of_note(memberships: DataFrame, note_id) -> DataFrame:
    rows = live(memberships).where(F.col("note_id") == F.lit(note_id))
    return newest_first(first_seen(rows, "collection_id", F.desc("created_at"), F.desc("id"))).select("collection_id")


def setting(config: DataFrame, key: str) -> DataFrame:
    """One row, `on`: false only if the key is there and says so (fails open)."""
    return config.where(F.col("key") == key).agg(F.coalesce(F.min(F.lower("value") != "false"), F.lit(True)).alias("on"))
