import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import margins, reconcile, staging, vectors
from quillspark.plans.writes import toy_embedder
from quillspark.schema import TABLES, missing_columns
from quillspark.sources import store as stores
from quillspark.sources.server import FrameCovers, StoreServer
from quillspark.sources.store import Store, change_stream
from quillspark.streaming import passes, sync
from quillspark.streaming.merge import merge_batch, pull

ROW = {"created_at": 1, "updated_at": 1, "deleted": False}


def frame(spark, table, *rows):
    t = TABLES[table]
    return spark.createDataFrame([tuple((ROW | r).get(c) for c in t.columns) for r in rows], t.struct)


@pytest.fixture()
def place(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PARTS", 3)
    return Store(spark, str(tmp_path / "store")), StoreServer(Store(spark, str(tmp_path / "server")), {"covers": "maybe"})


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def edits(spark, key, *pairs):
    return spark.createDataFrame([(k, {c: None if v is None else str(v) for c, v in f.items()}) for k, f in pairs], f"{key} string, fields map<string,string>")


def queue(store):
    return rows(store.table("outbox"), "table_name", "record_id")


def test_store_rewrites_touched_parts_only(spark, place):
    store = place[0]
    assert store.commit(0, {"books": frame(spark, "books", *({"id": str(i), "title": "t"} for i in range(12)))})
    before = store.state()["tables"]["books"]
    assert store.apply(1, {"books": frame(spark, "books", {"id": "3", "title": "new"}, {"id": "x", "title": "x"})}, meta={"a": 1})
    after = store.state()["tables"]["books"]
    touched = {str(r[0]) for r in spark.createDataFrame([("3",), ("x",)], "id string").select(stores.part_of("id")).collect()}
    assert {p for p in after if after[p] != before.get(p)} == touched
    assert store.table("books").count() == 13 and rows(store.table("books").where("title = 'new'"), "id") == [("3",)]
    assert not store.apply(1, {"books": frame(spark, "books", {"id": "3"})})  # the batch is there
    store.set(a=None, b=2)
    assert store.get("a") is None and store.get("b") == 2
    store.vacuum(1)
    assert store.table("books").count() == 13 and len(store._pointers()) == 1


def test_older_files_gain_columns(spark, place):
    store = place[0]
    frame(spark, "collections", {"id": "a", "name": "x"}).drop("name").write.parquet(f"{store.path}/collections/v=0-old")
    store._point(0, store.state(), {"collections": {"0": "collections/v=0-old"}}, None)
    assert "name" not in store.columns("collections") and store.exists("collections") and not store.exists("books") and store.columns("books") == {}
    assert rows(store.table("collections"), "id", "name") == [("a", None)] and missing_columns(list(store.columns("collections")), TABLES["collections"]) == ["name"]


def test_a_failed_pointer_move_is_an_error(spark, place, monkeypatch):
    store = place[0]

    class Broken:
        def __getattr__(self, name):
            return (lambda *a: False) if name == "rename" else getattr(real, name)

    real = store._fs
    monkeypatch.setattr(store, "_fs", Broken())
    with pytest.raises(OSError):
        store.commit(0, {"books": frame(spark, "books", {"id": "1"})})


def test_a_replayed_stream_batch_is_known(spark, place, tmp_path):
    store, feed = place[0], tmp_path / "feed"
    schema = "id string, name string, updated_at bigint, deleted boolean, change_seq bigint"
    spark.createDataFrame([("a", "A", 2, False, 1)], schema).coalesce(1).write.parquet(str(feed))
    go = lambda: pull(store, "collections", change_stream(spark, str(feed), spark.createDataFrame([], schema).schema), str(tmp_path / "cp")).awaitTermination(120)
    go()
    batch = store.state()["batch"]
    for commit in (tmp_path / "cp" / "commits").glob("[0-9]*"):  # as after a crash between the store's commit and the checkpoint's
        commit.unlink()
    for crc in (tmp_path / "cp" / "commits").glob(".*crc"):
        crc.unlink()
    go()
    assert store.state()["batch"] == batch and rows(store.table("collections"), "id", "name") == [("a", "A")]


def test_server_upserts_and_patches(spark, place):
    server = place[1]
    whole = edits(spark, "id", ("b1", {"title": "T", "created_at": 1, "updated_at": 5}), ("b2", {"title": "only"}))
    assert rows(server.upsert("books", whole, "me"), "id") == [("b2",)]  # an insert lacks created_at
    assert rows(server.patch("books", edits(spark, "id", ("b1", {"author": "A", "updated_at": 6}), ("no", {"author": "x"}))), "id") == [("no",)]
    assert rows(server.patch("books", edits(spark, "id", ("b1", {"author": "old", "updated_at": 2}))), "id") == []  # older: taken, no change
    orphan = edits(spark, "id", ("n", {"book_id": "none", "text": "t", "created_at": 1}))
    assert rows(server.upsert("notes", orphan, "me"), "id") == [("n",)]
    assert rows(server.rows("books"), "id", "title", "author", "user_id", "updated_at") == [("b1", "T", "A", "me", 6)]
    first = server.fetch_page("books", 0, 10).first().change_seq
    assert server.fetch_page("books", first, 10).count() == 0 and first > 1


def test_flush_holds_children_and_clears_what_arrived(spark, place):
    store, server = place
    for table, pairs in (
        ("books", [("b1", {"id": "b1", "title": "T", "created_at": 1}), ("b2", {"id": "b2", "author": "sparse"})]),
        ("notes", [("n1", {"id": "n1", "book_id": "b1", "text": "t", "created_at": 1}), ("n2", {"id": "n2", "book_id": "b2", "text": "t", "created_at": 1})]),
        ("note_links", [("l", {"id": "l", "from_note_id": "n1", "to_note_id": "n2", "created_at": 1})]),
        ("lenses", [("z", {"id": "z", "name": "x", "created_at": 1})]),
    ):
        staging.stage(store, {table: edits(spark, "id", *pairs)}, 9)
    done = sync.flush(store, server, "me")
    assert (done.ok, done.failed) == (3, 3)
    assert queue(store) == [("books", "b2"), ("note_links", "l"), ("notes", "n2")]
    assert rows(server.rows("notes"), "id", "book_id", "user_id") == [("n1", "b1", "me")]
    staging.stage(store, {"books": edits(spark, "id", ("b2", {"title": "T2", "created_at": 2}))}, 10)
    assert sync.flush(store, server, "me").failed == 0 and queue(store) == []
    assert rows(server.rows("books"), "id", "title", "author") == [("b1", "T", None), ("b2", "T2", "sparse")]
    assert sync.flush(store, server, "me").ok == 0


def test_a_book_kept_under_another_id_moves_its_notes(spark, place):
    store, server = place
    server.upsert("books", edits(spark, "id", ("kept", {"title": "T", "created_at": 1})), "me")
    staging.stage(store, {"books": edits(spark, "id", ("temp", {"id": "temp", "title": "T", "created_at": 1, "server_id": "kept"})), "notes": edits(spark, "id", ("n", {"id": "n", "book_id": "temp", "text": "t", "created_at": 1}))}, 9)
    sync.flush(store, server, "me")
    assert store.get("bookIdRemap") == {"temp": "kept"} and rows(server.rows("notes"), "book_id") == [("kept",)]


def test_sync_pulls_first_and_stops_if_a_table_fails(spark, place):
    store, server = place
    server.upsert("books", edits(spark, "id", *((f"b{i}", {"title": "server", "created_at": 1, "updated_at": 50}) for i in range(7))), "me")
    staging.stage(store, {"books": edits(spark, "id", ("b1", {"title": "mine", "created_at": 1, "updated_at": 20}), ("b2", {"title": "newer", "updated_at": 90}))}, 9)
    pulled = sync.pull_all(store, server, page=3)
    assert (pulled.pulled, pulled.merged, pulled.skipped, pulled.superseded, pulled.failed) == (7, 6, 1, 1, {})
    assert queue(store) == [("books", "b2")] and store.get("cursor:books") == server.rows("books").agg(F.max("change_seq")).first()[0]

    class Failing:
        def __getattr__(self, name):
            return getattr(server, name)

        def fetch_page(self, table, after, limit):
            if table == "lenses":
                raise ConnectionError("gone")
            return server.fetch_page(table, after, limit)

    ran = []
    with pytest.raises(sync.SyncError, match="lenses"):
        sync.sync(store, Failing(), "me", lambda *a: ran.append(1) or {})
    assert not ran and queue(store) == [("books", "b2")]
    assert sync.pull_and_reconcile(store, Failing(), lambda *a: ran.append(1) or {})[1] == {} and not ran

    def broken(store, server):
        raise RuntimeError("a pass")

    pulled, counts, flushed = sync.sync(store, server, "me", broken)
    assert counts == {} and flushed.ok == 1 and queue(store) == []


def test_a_full_page_that_stands_still_is_an_error(spark, place):
    store, server = place
    store.set(**{"cursor:lenses": 9})

    class Still:
        def fetch_page(self, table, after, limit):
            return frame(spark, "lenses", {"id": "a", "name": "x"}, {"id": "b", "name": "x"}).withColumn("change_seq", F.lit(5).cast("bigint"))

    pulled = sync.pull_all(store, Still(), ["lenses"], page=2)
    assert "does not move" in pulled.failed["lenses"] and store.get("cursor:lenses") == 9
    strict = sync.pull_all(store, Still(), ["lenses"], page=9, strict=True)
    assert "out of form" in strict.failed["lenses"]


def test_reconciliation_in_order(spark, place):
    store, server = place
    server.upsert("books", edits(spark, "id", ("far", {"title": "Far", "created_at": 1})), "me")
    store.commit(0, {
        "books": frame(spark, "books", {"id": "old", "title": "x", "deleted": True, "merged_into": "new"}, {"id": "new", "title": "Known", "created_at": 3}, {"id": "gone", "title": "y", "deleted": True}, {"id": "way", "title": "z", "deleted": True}),
        "notes": frame(
            spark,
            "notes",
            {"id": "a", "book_id": "far", "text": "one", "tags": ["Memory", "Odd one"], "content_tag": "k"},
            {"id": "b", "book_id": "old", "text": "one", "tags": ["x"], "content_tag": "k", "created_at": 2},
            {"id": "c", "book_id": "gone", "text": "open", "tags": []},
            {"id": "d", "text": "t", "deleted": True},
            {"id": "e", "book_id": "way", "text": "w", "content_tag": "w"},
        ),
        "note_links": frame(spark, "note_links", {"id": "l", "from_note_id": "b", "to_note_id": "c", "relation_type": "r"}),
        "note_signals": frame(spark, "note_signals", {"note_id": "d", "updated_at": 99}),
    }, {"mergedBookIds": {"way": "new"}})
    down = FrameCovers(spark.createDataFrame([("Known", 7, None, False)], "title string, cover_id bigint, isbn string, down boolean"))
    run = lambda: passes.reconcile_all(passes.passes(store, server, 50, "idea_", bytes(64), covers=down, base="c", source="s", flag="covers"))
    first = run()
    assert first == {"books": 1, "stranded": 3, "dropped_tags": 2, "content_tags": 3, "duplicates": 0, "signals": 1, "covers": 2}
    notes = {r.id: r for r in store.table("notes").collect()}
    assert (notes["b"].book_id, notes["c"].book_id, notes["e"].book_id) == ("new", None, "new") and len(notes["c"].content_tag) == 64
    assert rows(store.table("custom_ideas"), "id", "name") == [("idea_odd_one", "Odd one"), ("idea_x", "x")]
    assert rows(store.table("note_signals"), "deleted", "updated_at") == [(True, 100)]
    covers = {r.id: (r.cover_url, r.cover_resolved_at) for r in store.table("books").where("NOT deleted").collect()}
    assert covers == {"far": (None, 50), "new": ("c/id/7-L.jpg", 50)}
    assert run() == dict.fromkeys(first, 0)

    class Gone:
        def fetch_by_ids(self, table, ids):
            raise ConnectionError

        def setting(self, key):
            raise ConnectionError

    store.apply(store.state()["batch"] + 1, {"notes": frame(spark, "notes", {"id": "f", "book_id": "none"}, {"id": "g", "content_tag": notes["c"].content_tag, "tags": ["a"]})})
    again = passes.reconcile_all(passes.passes(store, Gone(), 60, "idea_", covers=down, base="c", source="s", flag="covers"))
    assert again["books"] == -1 and again["duplicates"] == 1 and again["covers"] == 0


def test_stage_is_all_or_nothing(spark, place):
    store = place[0]
    store.commit(0, {"notes": frame(spark, "notes", {"id": "n", "text": "t"}, {"id": "dead", "deleted": True})})
    writes = {"notes": edits(spark, "id", ("n", {"text": "new", "tags": '["x"]'})), "books": edits(spark, "id", ("b", {"title": "B", "created_at": 2}))}
    with pytest.raises(LookupError):
        staging.stage(store, writes, 5, {"notes": spark.createDataFrame([("n",), ("dead",)], "id string")})
    assert store.table("books").count() == 0 and store.table("outbox").count() == 0
    staging.stage(store, writes, 5, {"notes": spark.createDataFrame([("n",)], "id string")})
    assert rows(store.table("notes"), "id", "text", "tags") == [("dead", None, None), ("n", "new", ["x"])]
    assert {r.record_id: json.loads(r.payload) for r in store.table("outbox").collect()} == {"n": {"text": "new", "tags": ["x"]}, "b": {"title": "B", "created_at": 2}}


def test_margins(spark, place):
    store = place[0]
    hand = {"source": "handwritten"}
    store.commit(0, {
        "notes": frame(spark, "notes", {"id": "p", "book_id": "b", "source": "share"}, {"id": "m1"} | hand, {"id": "m2"} | hand, {"id": "kept"} | hand, {"id": "plain", "source": "manual"}),
        "note_links": frame(
            spark, "note_links", *({"id": f"l{c}", "from_note_id": "p", "to_note_id": c} for c in ("m1", "m2", "kept", "plain")), {"id": "other", "from_note_id": "plain", "to_note_id": "kept", "relation_type": "related"}, {"id": "rel", "from_note_id": "p", "to_note_id": "plain", "relation_type": "related"}
        ),
    })
    put = lambda *ms: margins.replace_annotations(store, "p", list(ms), 100)
    M = margins.Margin
    assert put(M("x", "y", "  ")) == 0
    for bad, why in (([M("p", "y", "t")], "parent"), ([M("a", "a", "t")], "repeats"), ([M("a", "rel", "t")], "link"), ([M("plain", "k", "t")], "linked elsewhere|another"), ([M("kept", "k", "t")], "linked elsewhere")):
        with pytest.raises(ValueError, match=why):
            put(*bad)
    with pytest.raises(LookupError):
        margins.replace_annotations(store, "none", [M("a", "b", "t")], 1)
    assert put(M("m2", "lm2", " again "), M("new", "k", "second", "crop")) == 2
    notes = {r.id: r for r in store.table("notes").collect()}
    assert {i: n.deleted for i, n in notes.items()} == {"p": False, "m1": True, "m2": False, "kept": False, "plain": False, "new": False}
    assert (notes["m2"].text, notes["m2"].book_id, notes["m2"].created_at, notes["new"].created_at, notes["new"].ink_crop_path) == ("again", "b", 100, 101, "crop")
    links = {r.id: r.deleted for r in store.table("note_links").collect()}
    assert links == {"lm1": True, "lm2": False, "lkept": True, "lplain": True, "other": False, "rel": False, "k": False}
    s = store.table("note_signals").first()
    assert (s.note_id, s.has_annotation, s.engagement_recency_at, s.source_prior) == ("p", True, 100, 0.75) and s.importance == pytest.approx(0.75 * 2 ** (-0.3 / 1.5) + 0.3)


def test_merge_and_unmerge_books(spark):
    books = frame(spark, "books", {"id": "k", "created_at": 5}, {"id": "l", "created_at": 2}, {"id": "r", "created_at": 1}, {"id": "dead", "deleted": True})
    notes = frame(spark, "notes", {"id": "n", "book_id": "l", "content_tag": "t"}, {"id": "o", "book_id": "r"})
    pairs = spark.createDataFrame([("l", "k"), ("r", "k"), ("k", "k"), ("", "k"), ("x", "dead")], "id string, survivor string")
    known = spark.createDataFrame([("r", "elsewhere")], "id string, next string")
    out = reconcile.merge_books(books, notes, pairs, 9, known)
    assert rows(out["undo_books"], "id", "survivor", "prior_created_at") == [("l", "k", 5)] and rows(out["undo_notes"], "id", "prior_book_id") == [("n", "l")]
    assert rows(out["redirects"], "id", "next") == [("l", "k"), ("r", "k")] and rows(out["survivors"], "id", "created_at") == [("k", 1)]
    loop = reconcile.merge_books(books, notes, spark.createDataFrame([("l", "k")], "id string, survivor string"), 9, spark.createDataFrame([("k", "l")], "id string, next string"))
    assert rows(loop["cycles"], "id") == [("l",)] and loop["losers"].count() == 0
    merged = books.join(out["losers"].unionByName(out["survivors"]).select("id"), "id", "left_anti").unionByName(out["losers"]).unionByName(out["survivors"])
    moved = out["notes"]
    back = reconcile.unmerge(merged, moved, out["redirects"], out["undo_books"], out["undo_notes"], 20)
    assert rows(back["losers"], "id", "deleted", "merged_into") == [("l", False, None)] and rows(back["notes"], "id", "book_id") == [("n", "l")]
    assert rows(back["survivors"], "id", "created_at") == [("k", 1)] and rows(back["redirects"], "id") == [("r",)]  # r is merged still


def test_content_merge_checks(spark):
    notes = frame(spark, "notes", {"id": "a", "content_tag": "t", "tags": ["x"]}, {"id": "b", "content_tag": "t", "tags": ["y"], "image_path": "i"}, {"id": "c", "content_tag": "u"}, {"id": "d", "content_tag": "t", "deleted": True}, {"id": "e"}, {"id": "f"})
    links = frame(spark, "note_links", {"id": "1", "from_note_id": "b", "to_note_id": "c", "relation_type": "r"}, {"id": "2", "from_note_id": "a", "to_note_id": "b", "relation_type": "r"})
    members = frame(spark, "collection_memberships", {"id": "k:b", "note_id": "b", "collection_id": "k", "created_at": 4})
    go = lambda s, ls, cross=False: reconcile.merge_content_duplicates(notes, links, members, s, ls, 9, cross)
    assert go("a", ["a", ""]) == {}
    for s, ls in (("a", ["c"]), ("a", ["d"]), ("a", ["no"]), ("e", ["f"]), ("", ["a"])):
        with pytest.raises(ValueError):
            go(s, ls)
    out = go("a", ["b"])
    assert rows(out["notes"], "id", "deleted", "tags", "image_path") == [("a", False, ["x", "y"], "i"), ("b", True, ["y"], "i")]
    assert rows(out["note_links"], "id", "from_note_id", "deleted") == [("1", "a", False), ("2", "a", True)]
    assert rows(out["collection_memberships"], "id", "created_at", "deleted") == [("a", 0, 0)] or rows(out["collection_memberships"], "id", "created_at", "deleted") == [("k:a", 4, False), ("k:b", 4, True)]
    assert len(go("a", ["c"], True)) == 3


def test_embedding_pass(spark, tmp_path):
    d = vectors.Descriptor("m", 2)
    for bad in (("", 2), ("a|b", 2), ("m", 0), ("m", 5000)):
        with pytest.raises(ValueError):
            vectors.Descriptor(*bad)
    notes = frame(spark, "notes", {"id": "ok", "text": "four"}, {"id": "bad", "text": "sevenxx"}, {"id": "blank", "text": " "}, {"id": "long", "text": "elevenchars"}, {"id": "dead", "text": "t", "deleted": True})
    have = spark.createDataFrame([("dead", d.key, "u:1", [1.0, 0.0], 1), ("ok", "old", "u:1", [1.0, 0.0], 1)], "note_id string, model_version string, content_token string, embedding array<float>, updated_at bigint")
    failed = spark.createDataFrame([], "id string, token string")
    count = iter(range(99))

    def put(df):
        at = str(tmp_path / f"e{next(count)}")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    go = lambda v, f, e=toy_embedder: vectors.embed_pending(notes, v, f, d, e, 10, 9, put)
    after, failed, n = go(have, failed)
    assert n == {"attempted": 4, "embedded": 1, "skipped": 1, "failed": 2, "pending": 2}
    assert rows(after, "note_id", "model_version", "content_token") == [("blank", d.key, "u:1"), ("ok", d.key, "u:1")]
    assert rows(after.where("note_id = 'ok'"), "embedding") == [([pytest.approx(0.5**0.5)] * 2,)] and rows(failed, "id") == [("bad",), ("long",)]
    after, failed, n = go(put(after), put(failed))  # only failures are left: they are tried again
    assert n["attempted"] == 2 and rows(failed, "id") == [("bad",), ("long",)]

    def gone(text):
        raise vectors.Unavailable

    _, kept, n = go(have, spark.createDataFrame([], "id string, token string"), gone)
    assert n["embedded"] == 0 and n["failed"] >= 1 and kept.count() == 0
    kept, n = vectors.register(d, notes, have)
    assert n == {"invalidated": 1, "pending": 4} and rows(kept, "note_id") == [("dead",)]


def test_vector_bytes_keep_nulls(spark):
    v = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, [0.0, 3.0])], "i int, v array<float>")
    b = v.select("i", vectors.to_bytes(F.col("v")).alias("b"))
    assert [bytes(r.b).hex() if r.b is not None else None for r in b.orderBy("i").collect()] == ["0000803f000020c0", None, "0000000000004040"]
    odd = b.union(spark.createDataFrame([(4, b"123")], "i int, b binary"))
    assert [r.v for r in odd.select("i", vectors.from_bytes(F.col("b"), 2).alias("v")).orderBy("i").collect()] == [[1.0, -2.5], None, [0.0, 3.0], None]


def test_merge_batch_tells_what_it_did(spark, place):
    store = place[0]
    feed = spark.createDataFrame([("a", "A", 2, False, 1)], "id string, name string, updated_at bigint, deleted boolean, change_seq bigint")
    assert merge_batch(store, "collections", feed, 0) and not merge_batch(store, "collections", feed, 0)
