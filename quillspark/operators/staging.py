"""Local writes: partial rows staged onto tables and into the outbox, and the plan of a flush."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scores import importance, source_prior
from quillspark.functions.text import membership_id
from quillspark.operators.changes import collapse, held_back, sparse
from quillspark.operators.reads import live
from quillspark.schema import TABLES, Table

#: What a full write of a row has where the caller gave nothing.
DEFAULTS = {
    "notes": {"source": "manual"},
    "note_links": {"relation_type": "handwritten_annotation"},
    "lenses": {"combinator": "AND", "threshold": "100"},
    "custom_ideas": {"description": ""},
}
#: Columns that an explicit clear may empty.
CLEARABLE = {"books": {"author", "isbn", "cover_url"}, "notes": {"book_id", "page", "chapter", "image_path", "ink_crop_path", "source_id"}}


def checked_clear(table: str, values: dict, clear: list[str]) -> dict:
    """The partial row with explicit nulls; setting and clearing one column, or clearing one that must stay, is an error."""
    if wrong := [c for c in clear if c not in CLEARABLE.get(table, set())]:
        raise ValueError(f"{table}: can't clear {', '.join(wrong)}")
    if both := [c for c in clear if c in values]:
        raise ValueError(f"{table}: set and cleared: {', '.join(both)}")
    return values | dict.fromkeys(clear)


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    """Full rows with the table's defaults, and a membership's derived id."""
    for c, v in DEFAULTS.get(table, {}).items():
        if c in rows.columns:
            rows = rows.withColumn(c, F.coalesce(c, F.lit(v).cast(rows.schema[c].dataType)))
    if table == "collection_memberships":
        rows = rows.withColumn("id", membership_id(F.col("collection_id"), F.col("note_id")))
    return rows


def apply_rows(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Insert or replace whole rows; of repeated keys in `rows` any one has to be chosen before."""
    return current.join(rows.select(key), key, "left_anti").unionByName(rows.select(*current.columns))


def patched(current: DataFrame, partials: DataFrame, table: Table) -> DataFrame:
    """The rows that partial rows (key, fields: map<string,string>) make of the current ones: an absent field stays, a null clears. New keys make new rows."""
    patch = partials.select(F.col(table.key).alias("__key"), "fields")
    joined = patch.join(current, current[table.key] == F.col("__key"), "left")
    kinds = dict(current.dtypes)
    field = lambda c, kind: (F.from_json(F.col("fields")[c], "array<string>") if kind == "strings" else F.col("fields")[c].try_cast(kinds[c]))
    columns = []
    for c, kind in table.columns.items():
        has = F.coalesce(F.map_contains_key("fields", c), F.lit(False))
        columns.append((F.col("__key") if c == table.key else F.when(has, field(c, kind)).otherwise(current[c])).alias(c))
    return joined.select(*columns)


def apply_partials(current: DataFrame, partials: DataFrame, table: Table) -> DataFrame:
    """All current rows, those with a partial row as patched() makes them."""
    return apply_rows(current, patched(current, partials, table), table.key)


def merged_partials(partials: DataFrame, table: Table) -> DataFrame:
    """One partial row a key, of several in the order of `place`: each field's last value."""
    rows = partials.select(table.key, "place", F.explode("fields").alias("field", "value"))
    last = rows.groupBy(table.key, "field").agg(F.max_by("value", "place").alias("value"))
    return last.groupBy(table.key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def as_partials(rows: DataFrame, table: Table, columns: list[str] | None = None) -> DataFrame:
    """Typed rows as partial rows of all their columns of the table, or some."""
    kept = columns or [c for c in table.columns if c in rows.columns]
    value = lambda c: (F.to_json(c) if table.columns[c] == "strings" else F.col(c).cast("string"))
    pairs = [x for c in kept for x in (F.lit(c), value(c))]
    return rows.select(table.key, F.create_map(*pairs).alias("fields"))


def json_fields(fields: Column, table: Table) -> Column:
    """A partial row as a JSON object, in the types of its columns; keys that are no columns are strings."""
    quoted = lambda v: F.to_json(F.create_map(F.lit("x"), v), {"ignoreNullFields": "false"})

    def one(k: Column, v: Column) -> Column:
        raw = F.lit(False)
        for c, kind in table.columns.items():
            if kind in ("int", "real", "bool", "strings", "json"):
                raw = raw | (k == c)
        text = F.substring(quoted(v), F.lit(6), F.length(quoted(v)) - 6)
        return F.concat(F.lit('"'), k, F.lit('":'), F.when(v.isNull(), "null").when(raw, v).otherwise(text))

    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: one(e["key"], e["value"])), ","), F.lit("}"))


def stage(store, writes: dict[str, DataFrame], now_ms: int, existing_live: dict[str, DataFrame] | None = None) -> None:
    """Partial rows by table (key, fields) go onto the tables and into the outbox, in one commit or not at all.

    A live write drops the record's queued tombstones. With `existing_live` (ids by table) nothing is staged unless all
    these rows are there and live.
    """
    for name, ids in (existing_live or {}).items():
        key = TABLES[name].key
        if not missing_or_deleted(store.table(name), ids.select(F.col(key).alias("id")), key).isEmpty():
            raise LookupError(f"{name}: a row to change is absent or deleted")
    changes, outbox = {}, store.table("outbox")
    for name, partials in writes.items():
        t = TABLES[name]
        current = store.table(name).join(partials.select(t.key), t.key, "left_semi")
        changes[name] = patched(current, partials, t)
        outbox = enqueue(outbox, partials, t, now_ms)
    if not store.apply(store.state()["batch"] + 1, changes, {"outbox": outbox}):
        raise RuntimeError("another writer committed meanwhile; nothing was staged")


def enqueue(outbox: DataFrame, partials: DataFrame, table: Table, now_ms: int) -> DataFrame:
    """The outbox with the partials as its latest edits; a live write drops the record's queued tombstones first."""
    deleted = F.coalesce(F.col("fields")["deleted"].isin("true", "1"), F.lit(False))
    alive = partials.where(~deleted).select(F.col(table.key).cast("string").alias("record_id"), F.lit(table.name).alias("table_name"))
    tombs = outbox.where(F.lower(F.get_json_object("payload", "$.deleted")).isin("true", "1")).join(alive, ["record_id", "table_name"], "left_semi").select("id")
    kept = outbox.join(tombs, "id", "left_anti")
    last = outbox.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    new = partials.select(
        F.lit(table.name).alias("table_name"), F.col(table.key).cast("string").alias("record_id"), json_fields(F.col("fields"), table).alias("payload"), F.lit(now_ms).cast("bigint").alias("created_at")
    ).crossJoin(F.broadcast(last))  # one row
    new = new.withColumn("id", F.col("__last") + 1 + F.monotonically_increasing_id()).select(*outbox.columns)
    return kept.unionByName(new)


def missing_or_deleted(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The ids that a write to existing live rows must refuse."""
    return ids.join(live(current).select(F.col(key).alias("id")), "id", "left_anti")


def membership_tombstones(memberships: DataFrame, wanted: DataFrame, now_ms: int) -> DataFrame:
    """Live memberships among `wanted` (collection_id, note_id), deleted; created_at stays."""
    return live(memberships).join(wanted, ["collection_id", "note_id"], "left_semi").withColumn("deleted", F.lit(True)).withColumn("updated_at", F.greatest(F.lit(now_ms).cast("bigint"), F.col("updated_at") + 1))


def prior_of_import(signals: DataFrame, notes: DataFrame) -> DataFrame:
    """Signals with the prior of their note's origin, and the importance that follows from it."""
    origin = notes.select(F.col("id").alias("note_id"), "source")
    rows = signals.drop("source_prior", "importance").join(origin, "note_id", "left").withColumn("source_prior", source_prior(F.col("source")))
    return rows.withColumn("importance", importance(F.col("source_prior"), F.col("return_visits"), F.col("has_annotation"), F.col("stitch_spawns"))).drop("source")


def flush_groups(outbox: DataFrame) -> DataFrame:
    """table_name, record_id, fields, ids: the queued edits of each record as one; unreadable payloads are left out."""
    parsed = outbox.withColumn("fields", F.from_json("payload", "map<string,string>")).where("fields IS NOT NULL")
    record = F.coalesce(F.col("record_id"), F.col("fields")["id"], F.lit(""))
    edits = parsed.select(F.struct("table_name", record.alias("record_id")).alias("record"), "created_at", "id", "fields")
    merged = collapse(edits).groupBy("record").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    ids = edits.groupBy("record").agg(F.collect_list("id").alias("ids"))
    return merged.join(ids, "record").select("record.table_name", "record.record_id", "fields", "ids")


def lacking(fields: Column | None = None, table_name: Column | None = None) -> Column:
    """Whether a record's edits lack a column that an insert into its table needs, and so can only patch the row that is there."""
    fields, table_name = F.col("fields") if fields is None else fields, F.col("table_name") if table_name is None else table_name
    out = F.lit(False)
    for t in TABLES.values():
        out = F.when(table_name == t.name, sparse(fields, [*t.required])).otherwise(out)
    return out


def flush_plan(outbox: DataFrame, failed: dict[str, DataFrame] | None = None) -> DataFrame:
    """table_name, record_id, fields, action for what a flush sends: upsert, patch (an insert would lack columns) or hold (a parent failed or waits).

    Unreadable payloads are left in the outbox. Tables go in the order of TABLES, parents first.
    """
    order = F.create_map(*(F.lit(x) for i, t in enumerate(TABLES) for x in (t, i)))
    out = flush_groups(outbox).withColumn("__order", order[F.col("table_name")]).withColumn("action", F.when(lacking(), "patch").otherwise("upsert"))
    if failed:
        rows = {t.name: out.where(F.col("table_name") == t.name).select(F.col("record_id").alias(t.key), *(F.col("fields")[c].alias(c) for c, _ in t.parents if c != t.key)) for t in TABLES.values()}
        waits = held_back(rows, failed, list(TABLES.values()))
        for name, ids in waits.items():
            held = ids.select(F.col("id").alias("record_id"), F.lit(name).alias("table_name"), F.lit(True).alias("__held")).distinct()
            out = out.join(held, ["record_id", "table_name"], "left").withColumn("action", F.when(F.col("__held"), "hold").otherwise(F.col("action"))).drop("__held")
    return out.orderBy("__order", "record_id").select("table_name", "record_id", "fields", "action")


def cover_candidates(books: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(books with an ISBN, the books to search for, at most `budget`): live, not set by hand, without a cover, never looked up or edited since."""
    open_ = live(books).where("coalesce(cover_source, '') <> 'manual' AND coalesce(cover_url, '') = '' AND (cover_resolved_at IS NULL OR updated_at > cover_resolved_at)")
    has: Column = F.coalesce(F.col("isbn"), F.lit("")) != ""
    return open_.where(has), open_.where(~has).orderBy("created_at", "id").limit(budget)


def summary(before: DataFrame, winners: DataFrame, discarded: DataFrame) -> DataFrame:
    """One row: rows pulled, merged and skipped, and edits superseded."""
    pulled = before.agg(F.count("*").alias("pulled"))
    merged = winners.agg(F.coalesce(F.sum("merged"), F.lit(0)).alias("merged"))
    lost = discarded.agg(F.count("*").alias("superseded"))
    return pulled.crossJoin(merged).crossJoin(lost).withColumn("skipped", F.col("pulled") - F.col("merged"))  # one row each
