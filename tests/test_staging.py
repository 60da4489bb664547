import pytest
from pyspark.sql import functions as F

from quillspark.operators import reconcile, staging
from quillspark.schema import TABLES

OUTBOX = "id bigint, table_name string, record_id string, payload string, created_at bigint"


def test_clear_rules():
    assert staging.checked_clear("notes", {"text": "t"}, ["page"]) == {"text": "t", "page": None}
    for values, clear in (({}, ["text"]), ({"page": "1"}, ["page"])):
        with pytest.raises(ValueError):
            staging.checked_clear("notes", values, clear)


def test_partials_are_three_state(spark):
    t = TABLES["books"]
    current = spark.createDataFrame([("a", "T", "A", *[None] * 5, 1, 1, False), ("z", "Z", *[None] * 6, 1, 1, False)], t.struct)
    partials = spark.createDataFrame([("a", {"author": None, "updated_at": "2"}), ("b", {"title": "N", "created_at": "5"})], "id string, fields map<string,string>")
    got = {r.id: (r.title, r.author, r.created_at, r.updated_at) for r in staging.apply_partials(current, partials, t).collect()}
    assert got == {"a": ("T", None, 1, 2), "b": ("N", None, 5, None), "z": ("Z", None, 1, 1)}


def test_live_write_drops_the_queued_tombstone(spark):
    box = spark.createDataFrame([(1, "books", "a", '{"deleted":true}', 1), (2, "books", "b", '{"deleted":true}', 1), (3, "books", "a", '{"title":"x"}', 1)], OUTBOX)
    got = staging.enqueue(box, spark.createDataFrame([("a", {"title": "y"})], "id string, fields map<string,string>"), TABLES["books"], 9)
    rows = sorted((r.record_id, r.payload) for r in got.collect())
    assert rows == [("a", '{"title":"x"}'), ("a", '{"title":"y"}'), ("b", '{"deleted":true}')] and got.agg(F.max("id")).first()[0] > 3


def test_flush_plan(spark):
    box = spark.createDataFrame(
        [
            (1, "notes", "n1", '{"id":"n1","book_id":"b1","created_at":1}', 1),
            (2, "notes", "n1", '{"text":"t"}', 2),
            (3, "notes", "n2", '{"text":"only"}', 1),
            (4, "books", "b1", '{"id":"b1","title":"T","created_at":1}', 1),
            (5, "books", "b2", "no json", 1),
            (6, "note_links", "l", '{"id":"l","created_at":1,"from_note_id":"n1","to_note_id":"n2"}', 1),
        ],
        OUTBOX,
    )
    got = [(r.table_name, r.record_id, r.action) for r in staging.flush_plan(box).collect()]
    assert got == [("books", "b1", "upsert"), ("notes", "n1", "upsert"), ("notes", "n2", "patch"), ("note_links", "l", "upsert")]
    failed = {"books": spark.createDataFrame([("b1",)], "id string")}
    held = {(r.table_name, r.record_id): r.action for r in staging.flush_plan(box, failed).collect()}
    assert held[("notes", "n1")] == held[("note_links", "l")] == "hold" and held[("notes", "n2")] == "patch"


def test_covers(spark):
    rows = [("isbn", "123", None, None, None, 1), ("search", None, None, None, None, 1), ("done", None, None, None, 5, 1), ("edited", None, None, None, 5, 6), ("own", None, None, "manual", None, 1), ("has", None, "u", None, None, 1)]
    b = spark.createDataFrame(rows, "id string, isbn string, cover_url string, cover_source string, cover_resolved_at bigint, updated_at bigint").withColumn("created_at", F.lit(1)).withColumn("deleted", F.lit(False))
    direct, searched = staging.cover_candidates(b, 10)
    assert [r.id for r in direct.collect()] == ["isbn"] and sorted(r.id for r in searched.collect()) == ["edited", "search"]
    assert staging.cover_candidates(b, 1)[1].count() == 1


def test_merge_notes_and_memberships(spark):
    n = spark.createDataFrame([("a", ["x", "x"], None, 1), ("b", ["y", None, "x"], "img", 2), ("c", ["z", "y"], "later", 3)], "id string, tags array<string>, image_path string, created_at bigint").withColumn("updated_at", F.lit(5).cast("bigint")).withColumn("deleted", F.lit(False))
    clusters = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "id string, survivor string")
    got = reconcile.merge_notes(n, clusters, 3)
    kept = got["survivors"].first()
    assert (kept.id, kept.tags, kept.image_path, kept.updated_at) == ("a", ["x", "x", "y", "z"], "img", 6)
    assert sorted(r.id for r in got["losers"].collect()) == ["b", "c"]
    m = spark.createDataFrame([("k:b", "b", "k", 4, 1, False), ("k:c", "c", "k", 3, 1, False), ("j:b", "b", "j", 4, 1, False), ("j:a", "a", "j", 2, 1, True), ("i:a", "a", "i", 2, 1, False), ("i:b", "b", "i", 2, 1, False)], "id string, note_id string, collection_id string, created_at bigint, updated_at bigint, deleted boolean")
    moved = reconcile.moved_memberships(m, clusters.where("id <> survivor"), 9)
    assert sorted(r.id for r in moved["deleted"].collect()) == ["i:b", "j:b", "k:b", "k:c"]
    assert sorted((r.id, r.created_at) for r in moved["ensured"].collect()) == [("j:a", 2), ("k:a", 3)]


def test_heal_and_unmerge(spark):
    n = spark.createDataFrame([("a", "Text!", None, None, False), ("b", None, None, None, False), ("c", "t", "x", None, False)], "id string, text string, content_tag string, book_id string, deleted boolean")
    got = reconcile.tag_heal(n, bytes(64)).collect()
    assert [r.id for r in got] == ["a"] and len(got[0].content_tag) == 64
    b = spark.createDataFrame([("l", True, "k", 1), ("m", True, "other", 1)], "id string, deleted boolean, merged_into string, updated_at bigint")
    back = reconcile.unmerge_books(b, spark.createDataFrame([("l", "k"), ("m", "k")], "id string, survivor string"), 9).collect()
    assert [(r.id, r.deleted, r.merged_into, r.updated_at) for r in back] == [("l", False, None, 9)]
