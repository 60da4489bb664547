"""A note's margins: handwritten children, replaced as a set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scores import importance, source_prior
from quillspark.operators.reads import links_of, live
from quillspark.operators.reconcile import still_linked
from quillspark.operators.snapshot import ANNOTATION
from quillspark.operators.staging import as_partials, stage
from quillspark.schema import TABLES

HANDWRITTEN = "handwritten"


@dataclass(frozen=True)
class Margin:
    """A child note to write, and the link that leads to it from its parent."""

    id: str
    link_id: str
    text: str
    ink_crop_path: str | None = None


def is_margin(relation: Column) -> Column:
    """A link without a relation is a margin's."""
    return F.coalesce(relation, F.lit(ANNOTATION)) == ANNOTATION


def born_or_stored(signals: DataFrame, notes: DataFrame, now_ms: int) -> DataFrame:
    """Whole signal rows for notes (id, source): the stored ones, deleted or not, or new ones with their origin's prior. `was` is the stored row's importance, null if it wasn't live."""
    old = signals.select(*(F.col(c).alias(f"__{c}") for c in TABLES["note_signals"].columns))
    rows = notes.select(F.col("id").alias("note_id"), "source").join(old, F.col("note_id") == F.col("__note_id"), "left")
    zero = lambda c: F.coalesce(f"__{c}", F.lit(0).cast("bigint")).alias(c)
    return rows.select(
        "note_id",
        F.coalesce("__source_prior", source_prior(F.col("source"))).alias("source_prior"),
        zero("return_visits"),
        F.coalesce("__has_annotation", F.lit(False)).alias("has_annotation"),
        zero("stitch_spawns"),
        zero("exposure_recency_at"),
        zero("engagement_recency_at"),
        F.col("__importance").alias("importance"),
        F.coalesce("__created_at", F.lit(now_ms).cast("bigint")).alias("created_at"),
        F.coalesce("__updated_at", F.lit(0).cast("bigint")).alias("updated_at"),
        (F.col("__note_id").isNotNull() & ~F.coalesce("__deleted", F.lit(False))).alias("was_live"),
        F.col("__note_id").isNotNull().alias("there"),
    )


def scored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("importance", importance(F.col("source_prior"), F.col("return_visits"), F.col("has_annotation"), F.col("stitch_spawns")))


def refused(parent: str, margins: list[Margin], notes: DataFrame, links: DataFrame) -> str | None:
    """Why a set of margins can't be written: an id that repeats, is the parent's, or belongs to something else."""
    ids = [x for m in margins for x in (m.id, m.link_id)]
    if parent in ids:
        return "an id is the parent's"
    if len(set(ids)) < len(ids):
        return "an id repeats"
    asked = notes.sparkSession.createDataFrame([(m.id, m.link_id) for m in margins], "child string, link string")  # as many as a page has margins
    own = (F.col("from_note_id") == parent) & is_margin(F.col("relation_type"))
    named = asked.join(links, F.col("link") == links["id"])
    if not named.where(~own).isEmpty():
        return "a link id is another link's"
    touching = asked.join(live(links), (F.col("child") == F.col("from_note_id")) | (F.col("child") == F.col("to_note_id")))
    mine = own & (F.col("to_note_id") == F.col("child"))
    if not touching.where(~mine).isEmpty():
        return "a child is still linked elsewhere"
    there = asked.join(notes.select("id", "source"), F.col("child") == notes["id"])
    if not there.where(~F.coalesce(F.col("source") == HANDWRITTEN, F.lit(False))).isEmpty():
        return "a child id is another note's"
    paired = named.where(F.col("to_note_id") == F.col("child")).select("child").union(touching.where(mine).select("child"))
    if not there.join(paired, "child", "left_anti").isEmpty():
        return "a child is another parent's margin"
    return None


def replaced(parent: DataFrame, margins: list[Margin], notes: DataFrame, links: DataFrame, signals: DataFrame, now_ms: int, seal: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The partial rows, by table, that give the parent (one row) these margins and retire those it had.

    New ones are created a millisecond apart, in order. Of the old ones every link goes, and a child that is a live
    margin which no link outside these touches. The parent's signals say that it has margins and was engaged with.
    """
    spark, row = parent.sparkSession, parent.first()
    rows = spark.createDataFrame([(m.id, m.link_id, m.text, m.ink_crop_path, i) for i, m in enumerate(margins)], "id string, link_id string, text string, ink_crop_path string, i bigint")
    created = F.lit(now_ms).cast("bigint") + F.col("i")
    null = F.lit(None).cast("string")
    new = rows.select(
        "id",
        F.lit(row["book_id"]).cast("string").alias("book_id"),
        "text",
        F.lit("").alias("page"),
        F.array().cast("array<string>").alias("tags"),
        null.alias("image_path"),
        "ink_crop_path",
        F.lit(HANDWRITTEN).alias("source"),
        null.alias("source_id"),
        F.lit("{}").alias("source_meta"),
        null.alias("chapter"),
        null.alias("content_tag"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.lit(False).alias("deleted"),
    )
    edges = rows.select(F.col("link_id").alias("id"), F.lit(row["id"]).alias("from_note_id"), F.col("id").alias("to_note_id"), F.lit(ANNOTATION).alias("relation_type"), created.alias("created_at"), created.alias("updated_at"), F.lit(False).alias("deleted"))
    old = links_of(links, row["id"]).where((F.col("from_note_id") == row["id"]) & is_margin(F.col("relation_type")))
    retired = old.join(edges.select("id"), "id", "left_anti").select("id", "from_note_id", "to_note_id", F.lit(ANNOTATION).alias("relation_type"), "created_at", F.lit(now_ms).cast("bigint").alias("updated_at"), F.lit(True).alias("deleted"))
    children = old.select(F.col("to_note_id").alias("id")).distinct().where(F.col("id") != row["id"]).join(rows.select("id"), "id", "left_anti")
    spent = live(notes).where(F.col("source") == HANDWRITTEN).join(children, "id", "left_semi").join(still_linked(links, old).select(F.col("note_id").alias("id")), "id", "left_anti")
    gone = spent.select("id", F.lit(True).alias("deleted"), F.lit(now_ms).cast("bigint").alias("updated_at"))
    mark = born_or_stored(signals, parent, now_ms).withColumn("has_annotation", F.lit(True)).withColumn("engagement_recency_at", F.lit(now_ms).cast("bigint"))
    mark = scored(mark).withColumn("updated_at", F.lit(now_ms).cast("bigint")).withColumn("deleted", F.lit(False))
    n, e, s = (TABLES[x] for x in ("notes", "note_links", "note_signals"))
    return {
        "notes": as_partials(seal(new), n).union(as_partials(gone, n)),
        "note_links": as_partials(edges, e).union(as_partials(retired, e)),
        "note_signals": as_partials(mark, s),
    }


def replace_annotations(store, parent: str, margins: list[Margin], now_ms: int, seal: Callable[[DataFrame], DataFrame] = lambda x: x) -> int:
    """Gives a live note these margins in place of those it has, in one commit; returns how many. Blank ones don't count, and without any nothing changes.

    `seal` turns open notes into the store's form (text and content tag).
    """
    margins = [Margin(m.id, m.link_id, m.text.strip(), m.ink_crop_path) for m in margins if m.text.strip()]
    if not margins:
        return 0
    notes, links = store.table("notes"), store.table("note_links")
    row = live(notes).where(F.col("id") == parent)
    if row.isEmpty():
        raise LookupError(f"the note {parent} is absent or deleted")
    if why := refused(parent, margins, notes, links):
        raise ValueError(why)
    stage(store, replaced(row, margins, notes, links, store.table("note_signals"), now_ms, seal), now_ms)
    return len(margins)
