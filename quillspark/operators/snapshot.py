"""Versioned JSON snapshots: export of live rows, validation, defaults and migration on import.

An archive is a JSON object with a marker, a version, a time and an array of rows for each table. Rows are validated and
given their defaults as columns of their variant values; one wrong row rejects the whole archive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.scores import importance, source_prior
from quillspark.functions.text import iso_millis, remap_tags
from quillspark.operators.reads import live
from quillspark.schema import TABLES, conform

#: Archive arrays by table, in the archive's order. Fixed values.
ARRAYS = {
    "books": "books",
    "notes": "notes",
    "custom_ideas": "customIdeas",
    "note_links": "noteLinks",
    "lenses": "lenses",
    "collections": "collections",
    "collection_memberships": "collectionMemberships",
    "note_signals": "noteSignals",
}
NEWEST = 19
ANNOTATION = "handwritten_annotation"
#: Columns that are not exported.
KEPT_BACK = {"books": ("merged_into",)}

#: Names of ideas that changed, for archives before versions 11 and 14. Fixed values.
EARLY_RENAMES = {
    "Good": "Good and Evil",
    "Custom": "Custom and Convention",
    "Pleasure": "Pleasure and Pain",
    "Virtue": "Virtue and Vice",
    "Sign": "Sign and Symbol",
    "War": "War and Peace",
    "Tyranny": "Tyranny and Despotism",
    "Life": "Life and Death",
    "Memory": "Memory and Imagination",
    "Necessity": "Necessity and Contingency",
    "Universal": "Universal and Particular",
}
LATE_RENAMES = {
    "Cause": "Causation",
    "Chance": "Probability",
    "Liberty": "Freedom",
    "Honor": "Status",
    "Virtue and Vice": "Virtue",
    "Animal": "Life",
    "Aristocracy": "Power",
    "Monarchy": "Power",
    "Oligarchy": "Power",
    "Tyranny and Despotism": "Power",
    "Constitution": "Institutions",
    "Government": "Institutions",
    "State": "Institutions",
    "Citizen": "Institutions",
    "Custom and Convention": "Institutions",
    "Courage": "Virtue",
    "Dialectic": "Reasoning",
    "Induction": "Reasoning",
    "Logic": "Reasoning",
    "Duty": "Obligation",
    "Education": "Learning",
    "Experience": "Learning",
    "Family": "Community",
    "Form": "Beauty",
    "God": "the Sacred",
    "Religion": "the Sacred",
    "Theology": "the Sacred",
    "Prophecy": "the Sacred",
    "Immortality": "the Sacred",
    "Hypothesis": "Evidence",
    "Labor": "Productivity",
    "Mind": "Consciousness",
    "Soul": "Consciousness",
    "Sense": "Consciousness",
    "Poetry": "Art",
    "Property": "Markets",
    "Wealth": "Markets",
    "Prudence": "Strategy",
    "Punishment": "Justice",
    "Revolution": "Conflict",
    "Rhetoric": "Narrative",
    "Sign and Symbol": "Language",
    "Sin": "Morality",
    "Temperance": "Discipline",
    "Wisdom": "Judgment",
    "Opinion": "Judgment",
    "Will": "Motivation",
    "World": "Nature",
    "Man": "Identity",
    "Good and Evil": "Morality",
    "Happiness": "Purpose",
    "Knowledge": "Truth",
    "Law": "Institutions",
    "Life and Death": "Life",
    "Memory and Imagination": "Memory",
    "Pleasure and Pain": "Emotion",
    "Slavery": "Freedom",
    "War and Peace": "Conflict",
}

#: The kinds of the fields that an import reads, by table, with their defaults; see _read(). Fixed values.
KINDS = {
    "books": {"title": "text", "author": "text?", "isbn": "text?", "cover_url": "text?", "cover_source": "text?", "cover_resolved_at": "int?", "created_at": "int", "updated_at": "stamp"},
    "notes": {
        "book_id": "text?",
        "text": "text?",
        "page": "text?",
        "image_path": "text?",
        "ink_crop_path": "text?",
        "source_id": "text?",
        "created_at": "int",
        "content_tag": "text?",
        "source": "text? manual",
        "chapter": "text?",
        "source_meta": "object",
        "tags": "texts",
        "updated_at": "stamp",
    },
    "custom_ideas": {"name": "text", "description": "text?", "created_at": "int", "updated_at": "stamp"},
    "note_links": {"from_note_id": "text", "to_note_id": "text", "relation_type": "word handwritten_annotation", "created_at": "stamp", "updated_at": "stamp"},
    "lenses": {"name": "text", "leaf_ids": "texts", "combinator": "word AND", "threshold": "count 100", "created_at": "stamp", "updated_at": "stamp"},
    "collections": {"name": "text", "created_at": "stamp", "updated_at": "stamp"},
    "collection_memberships": {"note_id": "text", "collection_id": "text", "created_at": "stamp", "updated_at": "stamp"},
    "note_signals": {
        "source_prior": "number",
        "return_visits": "count 0",
        "stitch_spawns": "count 0",
        "has_annotation": "bool",
        "exposure_recency_at": "count 0",
        "engagement_recency_at": "count 0",
        "importance": "number",
        "created_at": "stamp",
        "updated_at": "stamp",
    },
}


class InvalidArchive(ValueError):
    """An archive that is not to be imported, whole."""


def camel(name: str) -> str:
    return re.sub(r"_(\w)", lambda m: m[1].upper(), name)


# Export


def exported(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Live rows under their archive names, `deleted` as 0."""
    return live(rows).select(*(F.col(c).alias(camel(c)) for c in columns), F.lit(0).alias("deleted"))


def fields_of(table: str) -> list[str]:
    """The columns that an archive has of a table, in its order; `deleted` comes last."""
    return [c for c in TABLES[table].columns if c not in KEPT_BACK.get(table, ()) and c != "deleted"]


def ordered_texts(rows: DataFrame, key: str, text: str, *order: str) -> DataFrame:
    """key, texts: each key's texts in the order of some columns; null texts are left out."""
    one = F.struct(*order, F.col(text).alias("__text"))
    return rows.where(F.col(text).isNotNull()).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["__text"]).alias("texts"))


def annotations(links: DataFrame, notes: DataFrame, relation: str = ANNOTATION) -> DataFrame:
    """id, texts: for each note the texts of the live notes that its live links of this relation lead to, by the link's time, then id."""
    edges = live(links).where(F.col("relation_type") == relation).select(F.col("from_note_id").alias("id"), "to_note_id", F.coalesce("created_at", F.lit(0)).alias("__at"), F.coalesce(F.col("id"), F.lit("")).alias("__edge"))
    said = live(notes).select(F.col("id").alias("to_note_id"), F.col("text").alias("__said"))
    return ordered_texts(edges.join(said, "to_note_id"), "id", "__said", "__at", "__edge")


def export_lines(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """array, json: one line a row, for archives of any size. Notes have their annotations if links are given.

    Texts have to be open: if `notes` has a column decrypt_failed, a true one stops the whole export.
    """
    out = None
    for name, array in ARRAYS.items():
        if name not in tables:
            continue
        rows, fields = tables[name], (columns or {}).get(name) or fields_of(name)
        extra = F.lit("")
        if name == "notes" and "decrypt_failed" in rows.columns:
            stop = F.when(F.col("decrypt_failed") & (F.col("deleted") == F.lit(False)), F.raise_error(F.lit("a note could not be opened: nothing is exported")).cast("string"))
            rows = rows.withColumn("text", F.coalesce(stop, F.col("text")))
        if name == "notes" and "note_links" in tables:
            rows = rows.join(annotations(tables["note_links"], rows), "id", "left")
            extra = F.when(F.size("texts") > 0, F.concat(F.lit(',"user_metadata":'), F.to_json(F.struct(F.col("texts").alias("user_annotation"))))).otherwise("")
        shown = live(rows).withColumn("__extra", extra)
        if name == "notes" and "source_meta" in fields:
            shown = shown.withColumn("source_meta", F.try_parse_json("source_meta"))
        body = F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in fields), F.lit(0).alias("deleted")), {"ignoreNullFields": "false"})
        part = shown.select(F.lit(array).alias("array"), F.concat(F.substring(body, F.lit(1), F.length(body) - 1), "__extra", F.lit("}")).alias("json"))
        out = part if out is None else out.unionByName(part)
    return out


def document(lines: DataFrame, exported_at: str, marker: str) -> str:
    """The archive as one document. It is one string by its format, so it is meant for a person's archive."""
    arrays: dict[str, list[str]] = {a: [] for a in ARRAYS.values()}
    for row in lines.orderBy("array", "json").toLocalIterator():
        arrays[row["array"]].append(row["json"])
    body = ",".join(f'"{a}":[{",".join(rows)}]' for a, rows in arrays.items())
    return f'{{"{marker}":true,"schemaVersion":{NEWEST},"exportedAt":"{exported_at}",{body}}}'


def exported_at(spark: SparkSession, now_ms: int) -> str:
    return spark.range(1).select(iso_millis(F.lit(now_ms)).alias("x")).first()["x"]


# Import


def valid_row(raw: Column, kinds: dict[str, str]) -> Column:
    """Whether a JSON row has the fields in their kinds: text, stamp, int, number, bool, texts; `?` after a kind allows null or absence."""
    v = F.try_parse_json(raw)
    ok = v.isNotNull()
    types = {"text": "^STRING$", "stamp": "^BIGINT$", "int": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "bool": "^BOOLEAN$", "texts": "^ARRAY<(STRING|VOID)>$"}
    for field, kind in kinds.items():
        found = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        loose = kind.endswith("?") or kind == "stamp"
        ok &= (F.lit(loose) & (found.isNull() | (found == "VOID"))) | F.coalesce(found.rlike(types[kind.rstrip("?")]), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def stamp_or(value: Column, now_ms: int) -> Column:
    """A missing or zero time is now."""
    return F.when(value.isNull() | (value == 0), F.lit(now_ms).cast("bigint")).otherwise(value)


def migrated_tags(tags: Column, version: int, early: dict[str, str] = EARLY_RENAMES, late: dict[str, str] = LATE_RENAMES, early_until: int = 11, late_until: int = 14) -> Column:
    """Tags of an archive of an old version, renamed stage by stage; from the last stage's version on they stay as they are."""
    if version < early_until:
        tags = remap_tags(tags, early)
    return remap_tags(tags, late) if version < late_until else tags


def _read(found: Column, is_: Column, kind: str, now_ms: int) -> tuple[Column, Column]:
    """(whether the value is right, the value) of a field: a variant and its schema, null if the field is absent.

    text: a string, or absent. text?: null too, and then the default. word: empty too. int: a whole number, or absent;
    int?: null too. count: null or absent is the default. stamp: so is zero, and the default is now. number: finite or
    null. bool: null is false. texts: strings only, null is none. object: null is empty.
    """
    kind, _, default = kind.partition(" ")
    absent = is_.isNull()
    empty = absent | (is_ == "VOID")
    as_ = lambda t: F.try_variant_get(found, "$", t)
    if kind in ("text", "text?", "word"):
        said = F.when(is_ == "STRING", as_("string"))
        if default:
            said = F.coalesce(F.when(said != "", said) if kind == "word" else said, F.lit(default))
        return (absent if kind == "text" else empty) | (is_ == "STRING"), said
    if kind in ("int", "int?", "count", "stamp"):
        n = F.when(is_ == "BIGINT", as_("bigint"))
        n = stamp_or(n, now_ms) if kind == "stamp" else F.coalesce(n, F.lit(int(default)).cast("bigint")) if kind == "count" else n
        return (absent if kind == "int" else empty) | (is_ == "BIGINT"), n
    if kind == "number":
        return empty | (is_.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.abs(as_("double")) < F.lit(float("inf")))), as_("double")
    if kind == "bool":
        return empty | (is_ == "BOOLEAN"), F.coalesce(F.when(is_ == "BOOLEAN", as_("boolean")), F.lit(False))
    if kind == "texts":
        items = as_("array<variant>")
        strings = F.when(is_.startswith("ARRAY"), F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))
        return empty | (is_.startswith("ARRAY") & F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")), F.coalesce(strings, F.array().cast("array<string>"))
    return empty | is_.startswith("OBJECT"), F.when(is_.startswith("OBJECT"), F.to_json(found)).otherwise("{}")


def normalized(rows: DataFrame, table: str, version: int, now_ms: int, sources: DataFrame | None = None) -> DataFrame:
    """The table's columns and `problem` (null: none) of raw archive rows in a variant column `row`.

    `sources` (note_id, source) are the archive's own notes, from which signals without a prior have theirs.
    """
    t = TABLES[table]
    # Each field is taken out of its row once, and its schema once; what is used more than once is not computed again.
    fields = [t.key, "deleted", *KINDS[table]]
    rows = rows.select(F.schema_of_variant("row").startswith("OBJECT").alias("__object"), *(F.try_variant_get("row", f"$.{camel(c)}", "variant").alias(f"__{c}") for c in fields))
    rows = rows.select("*", *(F.schema_of_variant(f"__{c}").alias(f"__is_{c}") for c in fields))
    read = lambda c, kind: _read(F.col(f"__{c}"), F.col(f"__is_{c}"), kind, now_ms)
    key_ok, key = read(t.key, "text")
    gone, mark = F.col("__is_deleted"), F.col("__deleted")
    alive = gone.isNull() | (gone == "VOID") | ((gone == "BOOLEAN") & ~F.try_variant_get(mark, "$", "boolean")) | (gone.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (F.try_variant_get(mark, "$", "double") == 0))
    right = F.coalesce("__object", F.lit(False))
    problem = F.when(~right, "not an object").when(~F.coalesce(alive, F.lit(False)), "deleted").when(~F.coalesce(key_ok & (key != ""), F.lit(False)), camel(t.key))
    values = {}
    for column, kind in KINDS[table].items():
        ok, values[column] = read(column, kind)
        problem = problem.when(~F.coalesce(ok, F.lit(False)), camel(column))
    if table == "notes":
        values["tags"] = migrated_tags(values["tags"], version)
        values["content_tag"] = F.lit(None).cast("string")  # it is derived anew
    out = rows.select(key.alias(t.key), *(x.alias(c) for c, x in values.items()), F.lit(False).alias("deleted"), problem.alias("problem"))
    if table == "note_signals":
        if sources is not None:
            out = out.join(sources.select("note_id", F.col("source").alias("__source")), "note_id", "left")
        else:
            out = out.withColumn("__source", F.lit(None).cast("string"))
        out = out.withColumn("source_prior", F.coalesce("source_prior", source_prior(F.col("__source"))))
        out = out.withColumn("importance", importance(F.col("source_prior"), F.col("return_visits"), F.col("has_annotation"), F.col("stitch_spawns")))
    twice = out.groupBy(t.key).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(t.key).alias("__twice"))
    out = out.join(twice, out[t.key] == F.col("__twice"), "left")
    problem = F.coalesce("problem", F.when(F.col("__twice").isNotNull(), "a repeated key"))
    have = set(out.columns)
    return out.select(*((F.col(c) if c in have else F.lit(None).cast(f.dataType)).alias(c) for c, f in zip(t.columns, t.struct, strict=True)), problem.alias("problem"))


@dataclass(frozen=True)
class Archive:
    """A read archive: its version, and each table's rows with their `problem`."""

    version: int
    tables: dict[str, DataFrame]

    def checked(self) -> dict[str, DataFrame]:
        """The tables' rows, if none has a problem; one wrong row rejects the whole archive."""
        wrong = None
        for name, rows in self.tables.items():
            part = rows.where("problem IS NOT NULL").select(F.lit(name).alias("table"), "problem")
            wrong = part if wrong is None else wrong.union(part)
        if (first := wrong.first()) is not None:
            raise InvalidArchive(f"{first['table']}: {first['problem']}")
        return {name: conform(rows, TABLES[name]) for name, rows in self.tables.items()}


def opened(texts: DataFrame, marker: str, now_ms: int) -> Archive:
    """The archive in the one row of `texts` (text). A wrong marker, version or array raises InvalidArchive."""
    root = texts.select(F.try_parse_json("text").alias("root"))
    kind = lambda f: F.schema_of_variant(F.try_variant_get("root", f"$.{f}", "variant"))
    found = root.select(
        F.coalesce(F.schema_of_variant("root").startswith("OBJECT"), F.lit(False)).alias("object"),
        F.coalesce((kind(marker) == "BOOLEAN") & F.try_variant_get("root", f"$.{marker}", "boolean"), F.lit(False)).alias("marked"),
        kind("schemaVersion").alias("kind"),
        F.when(kind("schemaVersion") == "BIGINT", F.try_variant_get("root", "$.schemaVersion", "bigint")).alias("version"),
        *(kind(a).alias(f"is_{a}") for a in ARRAYS.values()),
    ).first()
    if found is None or not found["object"]:
        raise InvalidArchive("the archive is not a JSON object")
    if not found["marked"]:
        raise InvalidArchive("the marker has to be true")
    version = 1 if found["kind"] in (None, "VOID") else found["version"]
    if version is None or not 1 <= version <= NEWEST:
        raise InvalidArchive(f"the version has to be a whole number from 1 to {NEWEST}")
    if wrong := [a for a in ARRAYS.values() if found[f"is_{a}"] not in (None, "VOID") and not found[f"is_{a}"].startswith("ARRAY")]:
        raise InvalidArchive(f"{wrong[0]} has to be an array")
    raw = {name: root.select(F.explode(F.try_variant_get("root", f"$.{array}", "array<variant>")).alias("row")) for name, array in ARRAYS.items()}
    sources = raw["notes"].select(F.try_variant_get("row", "$.id", "string").alias("note_id"), F.try_variant_get("row", "$.source", "string").alias("source")).dropDuplicates(["note_id"])
    return Archive(version, {name: normalized(rows, name, version, now_ms, sources) for name, rows in raw.items()})


def rejected(rows: DataFrame, kinds: dict[str, str], raw: str = "raw") -> bool:
    """One bad row rejects the whole archive."""
    return not rows.where(~valid_row(F.col(raw), kinds)).isEmpty()
