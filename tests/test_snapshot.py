import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import imports, snapshot
from quillspark.schema import TABLES
from quillspark.sources import store as stores
from quillspark.sources.store import Store

MARK = "_archive"


def opened(spark, archive, now=1000):
    text = archive if isinstance(archive, str) else json.dumps({MARK: True, "schemaVersion": 19} | archive)
    return snapshot.opened(spark.createDataFrame([(text,)], "text string"), MARK, now)


def frame(spark, table, *rows):
    t = TABLES[table]
    return spark.createDataFrame([tuple(({"created_at": 1, "updated_at": 1, "deleted": False} | r).get(c) for c in t.columns) for r in rows], t.struct)


def one(rows):
    found = rows.collect()
    assert len(found) == 1
    return found[0].asDict()


def test_roots(spark):
    for bad in ("no json", "[1]", json.dumps({MARK: 1}), json.dumps({"other": True}), *(json.dumps({MARK: True, "schemaVersion": v}) for v in (0, 20, "3", 1.5)), json.dumps({MARK: True, "books": {}})):
        with pytest.raises(snapshot.InvalidArchive):
            opened(spark, bad)
    assert opened(spark, {"schemaVersion": None, "books": None}).version == 1
    assert all(rows.count() == 0 for rows in opened(spark, {}).checked().values())


def test_defaults(spark):
    read = opened(spark, {
        "books": [{"id": "b", "title": "T", "extra": [1]}],
        "notes": [{"id": "n", "source": None, "updatedAt": 0, "tags": None, "sourceMeta": {"a": [1, None]}, "contentTag": "old"}],
        "noteLinks": [{"id": "l", "fromNoteId": "n", "toNoteId": "n", "relationType": ""}],
        "lenses": [{"id": "z", "name": "x", "threshold": None, "combinator": "", "leafIds": ["a", "a"]}],
        "noteSignals": [{"noteId": "n", "returnVisits": 2, "importance": 99}, {"noteId": "other", "sourcePrior": 0.1}],
    }).checked()
    assert one(read["books"]) == dict.fromkeys(TABLES["books"].columns) | {"id": "b", "title": "T", "updated_at": 1000, "deleted": False}
    n = one(read["notes"])
    assert (n["source"], n["tags"], n["source_meta"], n["content_tag"], n["updated_at"], n["created_at"]) == ("manual", [], '{"a":[1,null]}', None, 1000, None)
    assert one(read["note_links"])["relation_type"] == "handwritten_annotation"
    z = one(read["lenses"])
    assert (z["combinator"], z["threshold"], z["leaf_ids"], z["created_at"]) == ("AND", 100, ["a", "a"], 1000)
    s = {r.note_id: (r.source_prior, r.has_annotation, round(r.importance, 6)) for r in read["note_signals"].collect()}
    assert s == {"n": (0.5, False, round(0.5 * 2 ** (-0.2 / 1.5) + 0.2, 6)), "other": (0.1, False, 0.1)}  # the archive names no source


@pytest.mark.parametrize(
    "rows",
    [
        {"books": [{"id": "a", "title": None}]},
        {"books": [{"id": "a", "createdAt": None}]},
        {"books": [{"id": ""}]},
        {"books": [{"title": "x"}]},
        {"books": [{"id": "a"}, {"id": "a"}]},
        {"books": ["a"]},
        {"books": [{"id": "a", "deleted": True}]},
        {"books": [{"id": "a", "coverResolvedAt": 1.5}]},
        {"notes": [{"id": "a", "tags": ["x", None]}]},
        {"notes": [{"id": "a", "tags": ["x", 1]}]},
        {"notes": [{"id": "a", "sourceMeta": []}]},
        {"notes": [{"id": "a", "contentTag": 1}]},
        {"noteSignals": [{"noteId": "a", "hasAnnotation": 1}]},
        {"noteSignals": [{"noteId": "a", "importance": "x"}]},
        {"collections": [{"id": "a", "name": "x", "updatedAt": "now"}]},
    ],
)
def test_one_wrong_row_rejects_the_archive(spark, rows):
    with pytest.raises(snapshot.InvalidArchive):
        opened(spark, {"customIdeas": [{"id": "fine", "name": "x"}]} | rows).checked()


def test_old_tags_move_in_two_stages(spark):
    note = {"notes": [{"id": "n", "tags": ["Good", "Virtue", "Virtue", "Sin", "Mine"]}]}
    tags = {v: one(opened(spark, {"schemaVersion": v} | note).checked()["notes"])["tags"] for v in (10, 11, 13, 14)}
    # before 11 `Good` became `Good and Evil`, and that, like `Sin`, `Morality` before 14
    assert tags == {10: ["Morality", "Virtue", "Mine"], 11: ["Good", "Virtue", "Morality", "Mine"], 13: ["Good", "Virtue", "Morality", "Mine"], 14: ["Good", "Virtue", "Virtue", "Sin", "Mine"]}


def test_export_comes_back(spark):
    tables = {
        "books": frame(spark, "books", {"id": "b", "title": 'a "b" \\ é'}, {"id": "dead", "title": "x", "deleted": True}),
        "notes": frame(spark, "notes", {"id": "p", "book_id": "b", "text": None, "source_meta": '{"k":1}', "tags": ["Memory"]}, {"id": "c", "text": "second"}, {"id": "d", "text": "first"}, {"id": "e", "text": None}),
        "note_links": frame(spark, "note_links", *({"id": i, "from_note_id": "p", "to_note_id": c, "relation_type": r, "created_at": at} for i, c, r, at in (("1", "c", snapshot.ANNOTATION, 9), ("2", "d", snapshot.ANNOTATION, 3), ("3", "e", snapshot.ANNOTATION, 1), ("4", "c", "related", 1)))),
        "note_signals": frame(spark, "note_signals", {"note_id": "p", "source_prior": 0.7, "return_visits": 1, "has_annotation": True, "stitch_spawns": 0, "exposure_recency_at": 0, "engagement_recency_at": 0, "importance": 1.0}),
    }
    text = snapshot.document(snapshot.export_lines(tables), snapshot.exported_at(spark, 0), MARK)
    archive = json.loads(text)
    assert (archive[MARK], archive["schemaVersion"], archive["exportedAt"]) == (True, 19, "1970-01-01T00:00:00.000Z")
    assert [list(b) for b in archive["books"]] == [["id", "title", "author", "isbn", "coverUrl", "coverSource", "coverResolvedAt", "createdAt", "updatedAt", "deleted"]]
    notes = {n["id"]: n for n in archive["notes"]}
    assert notes["p"]["user_metadata"] == {"user_annotation": ["first", "second"]} and "user_metadata" not in notes["c"] and notes["p"]["sourceMeta"] == {"k": 1}
    back = opened(spark, text).checked()
    for name in ("books", "notes"):
        want = tables[name].where("NOT deleted")
        if name == "notes":
            want = want.withColumn("source", F.lit("manual")).withColumn("source_meta", F.coalesce("source_meta", F.lit("{}"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        assert sorted(map(tuple, back[name].collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="could not be opened"):
        snapshot.export_lines({"notes": tables["notes"].withColumn("decrypt_failed", F.col("id") == "c")}).collect()


def test_import_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PARTS", 2)
    store = Store(spark, str(tmp_path / "s"))
    tomb = spark.createDataFrame([(4, "books", "gone", '{"deleted":true}', 1), (5, "books", "old", '{"title":"q"}', 1)], "id bigint, table_name string, record_id string, payload string, created_at bigint")
    store.commit(0, {"books": frame(spark, "books", {"id": "old", "title": "local", "updated_at": 50}, {"id": "gone", "title": "x", "updated_at": 10, "deleted": True}), "outbox": tomb})
    read = opened(spark, {
        "books": [{"id": "old", "title": "A", "updatedAt": 50}, {"id": "gone", "title": "back", "updatedAt": 11}, {"id": "new", "title": "N", "updatedAt": 7000}, {"id": "there", "title": "S", "updatedAt": 5}],
        "notes": [{"id": "n", "bookId": "new", "text": "open", "updatedAt": 3}, {"id": "blank", "text": None, "updatedAt": 3}],
    }).checked()
    server = lambda name, ids: frame(spark, "books", {"id": "there", "updated_at": 6}) if name == "books" else frame(spark, name).select("*")
    seal = lambda rows: rows.withColumn("content_tag", F.when(F.col("text").isNotNull(), F.lit("tag"))).withColumn("text", F.concat(F.lit("sealed:"), "text"))
    counts = {r.table_name: (r.imported, r.skipped_stale) for r in imports.import_merge(store, read, server, 1000, seal).collect()}
    assert (counts["books"], counts["notes"], counts["lenses"]) == ((2, 2), (2, 0), (0, 0))
    books = {r.id: (r.title, r.updated_at, r.deleted) for r in store.table("books").collect()}
    assert books == {"old": ("local", 50, False), "gone": ("back", 7001, False), "new": ("N", 7001, False)}
    assert sorted((r.id, r.text, r.content_tag) for r in store.table("notes").collect()) == [("blank", None, None), ("n", "sealed:open", "tag")]
    box = store.outbox().collect()
    assert [r.id for r in box][0] == 5 and sorted((r.table_name, r.record_id) for r in box[1:]) == [("books", "gone"), ("books", "new"), ("notes", "blank"), ("notes", "n")]
    assert all(json.loads(r.payload)["updated_at"] == 7001 and list(json.loads(r.payload)) == list(TABLES[r.table_name].columns) for r in box[1:])
    state = store.state()
    again = imports.import_merge(store, {"books": read["books"]}, server, 1000)
    assert again.first().imported == 0 and store.state() == state  # nothing newer: nothing is written
    with pytest.raises(OverflowError):
        imports.import_merge(store, {"books": read["books"].withColumn("updated_at", F.lit(2**63 - 1))}, server, 1000)
