import pytest
from pyspark.sql import functions as F

from quillspark.operators import changes, reads, reconcile, search, snapshot, vectors
from quillspark.schema import TABLES, conform

NOTE = "id string, book_id string, text string, tags array<string>, created_at bigint, updated_at bigint, deleted boolean, content_tag string"


def notes(spark, *rows):
    base = {"book_id": None, "text": "t", "tags": [], "created_at": 1, "updated_at": 1, "deleted": False, "content_tag": None}
    return spark.createDataFrame([tuple((base | {"id": r["id"]} | r)[c.split()[0]] for c in NOTE.split(", ")) for r in rows], NOTE)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_live_and_pages(spark):
    n = notes(spark, {"id": "a"}, {"id": "b", "deleted": None}, {"id": "c", "deleted": True}, {"id": "d", "created_at": 5}, {"id": "e"})
    assert [r.id for r in reads.list_live(n).collect()] == ["d", "e", "a"]
    assert [r.id for r in reads.list_live(n, limit=1, offset=1).collect()] == ["e"]
    assert reads.get_row(n, "id", "c").count() == 1


def test_week_window(spark):
    now = 10 * reads.WEEK_MS
    n = notes(spark, {"id": "in", "created_at": now - reads.WEEK_MS}, {"id": "out", "created_at": now - reads.WEEK_MS - 1}, {"id": "blank", "created_at": now, "text": "  "})
    assert [r.id for r in reads.fresh_notes(n, now).collect()] == ["in"]


def test_tally_counts_each_occurrence(spark):
    n = notes(spark, {"id": "a", "tags": ["x", "x"]}, {"id": "b", "tags": ["x", None]}, {"id": "c", "tags": None}, {"id": "d", "tags": ["y"], "deleted": True})
    assert rows(reads.tag_tally(n)) == [("x", 3)]
    assert [r.id for r in reads.untagged_notes(n).collect()] == ["c"]


def test_ordinal(spark):
    n = notes(spark, *({"id": f"{i:02d}", "created_at": t} for i, t in enumerate([None, 5, 5, 86_400_000, 86_400_001, 90_000_000, 90_000_000, 9])))
    order = [r.id for r in reads.newest_first(n).collect()]
    assert [reads.ordinal(n, 8 + i).first().id for i in range(8)] == order
    assert reads.ordinal(n.limit(0), 3).count() == 0


FEED = "id string, change_seq bigint, updated_at bigint, deleted boolean"


def sequential(feed, local):
    state, applied = dict(local), {}
    for i, seq, at, gone in sorted(feed, key=lambda r: r[1]):
        if (i not in state and gone) or (i in state and (at or 0) <= state[i]):
            continue
        state[i] = at or 0
        applied.setdefault(i, []).append(seq)
    return {i: (s[-1], len(s)) for i, s in applied.items()}


def test_lww_matches_one_by_one(spark):
    import random

    r = random.Random(5)
    feed = [(f"k{r.randrange(60)}", seq, r.choice([None, *range(6)]), r.random() < 0.4) for seq in range(600)]
    local = {f"k{i}": r.randrange(5) for i in range(0, 60, 3)}
    got = changes.lww_winners(spark.createDataFrame(feed, FEED), spark.createDataFrame(list(local.items()), "id string, updated_at bigint"), "id")
    # a missing stamp of a first live row applies as 0
    assert {x.id: (x.change_seq, x.merged) for x in got.collect()} == sequential(feed, local)


def test_lww_tie_keeps_local_and_absent_tombstone_is_skipped(spark):
    local = spark.createDataFrame([("a", 5)], "id string, updated_at bigint")
    feed = spark.createDataFrame([("a", 1, 5, False), ("b", 2, 9, True), ("b", 3, 1, False)], FEED)
    assert rows(changes.lww_winners(feed, local, "id").select("id", "change_seq")) == [("b", 3)]


def test_collapse_is_sticky_and_keeps_nulls(spark):
    e = spark.createDataFrame([("r", 1, 1, {"deleted": "true", "x": "1"}), ("r", 2, 2, {"deleted": "false", "x": None}), ("r", 0, 3, {"y": "2"})], "record string, created_at bigint, id bigint, fields map<string,string>")
    assert rows(changes.collapse(e).select("field", F.coalesce("value", F.lit("null")))) == [("deleted", "true"), ("x", "null"), ("y", "2")]


def test_redirects(spark):
    edges = [("a", "b"), ("b", "a"), ("self", "self"), ("x", ""), *((f"c{i}", f"c{i + 1}") for i in range(25))]
    got = dict(rows(changes.redirect_targets(spark.createDataFrame(edges, "id string, next string"))))
    assert (got["a"], got["c0"], got["c10"]) == ("a", "c20", "c25") and "self" not in got and "x" not in got


def test_rebase(spark):
    box = spark.createDataFrame([(1, "a", '{"updated_at":3}'), (2, "a", '{"updated_at":4}'), (3, "a", "{}"), (4, "b", '{"updated_at":1}')], "id bigint, record_id string, payload string")
    stays, lost = changes.rebase_outbox(box, spark.createDataFrame([("a", 3)], "id string, updated_at bigint"), "id")
    assert [r.id for r in stays.orderBy("id").collect()] == [2, 3, 4] and rows(lost) == [("a", 3)]


def test_import_needs_strictly_newer(spark):
    t = lambda *x: spark.createDataFrame(list(x), "id string, updated_at bigint")
    got = changes.import_accepted(t(("a", 5), ("b", 5), ("c", 5), ("d", 6)), t(("a", 5), ("d", 5)), t(("b", 6), ("d", 5)), "id")
    assert [r.id for r in got.orderBy("id").collect()] == ["c", "d"]


def test_survivor_and_tags(spark):
    n = notes(spark, *({"id": i, "content_tag": "t", "tags": g, "created_at": c} for i, g, c in (("b", ["x"], 1), ("a", ["x", "y"], 9), ("c", ["x", "y"], 3), ("d", ["x", "y"], 3))))
    assert {r.survivor for r in reconcile.duplicate_clusters(n).collect()} == {"c"}
    got = spark.range(1).select(reconcile.union_tags(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "cbc"))).alias("t")).first()["t"]
    assert got == ["a", "a", "b", "c"]


def test_edges(spark):
    e = spark.createDataFrame([("1", "x", "y", "r", False), ("2", "z", "y", "r", False), ("3", "x", "z", "r", False), ("4", "x", "y", "r", False)], "id string, from_note_id string, to_note_id string, relation_type string, deleted boolean")
    got = reconcile.repointed_links(e, spark.createDataFrame([("z", "x")], "id string, survivor string"))
    assert {r.id: r.retired for r in got.collect()} == {"1": False, "2": True, "3": True, "4": False}


def test_cascade_and_book_merge(spark):
    e = spark.createDataFrame([("1", "p", "c", "handwritten_annotation", False, 1)], "id string, from_note_id string, to_note_id string, relation_type string, deleted boolean, updated_at bigint")
    s = spark.createDataFrame([("p", True, False, 1), ("c", False, False, 9)], "note_id string, has_annotation boolean, deleted boolean, updated_at bigint")
    out = reconcile.deletion_cascade(notes(spark, {"id": "p"}, {"id": "c"}), e, s, spark.createDataFrame([("c",)], "id string"), 5)
    assert [r.id for r in out["notes"].collect()] == ["c"] and [r.updated_at for r in out["note_signals"].collect()] == [10]
    assert [r.id for r in out["note_links"].collect()] == ["1"] and [(r.note_id, r.has_annotation) for r in out["unmarked"].collect()] == [("p", False)]
    b = spark.createDataFrame([("k", 5, 1, False, None), ("l", 2, 1, False, None)], "id string, created_at bigint, updated_at bigint, deleted boolean, merged_into string")
    got = reconcile.merge_books(b, notes(spark, {"id": "n", "book_id": "l", "content_tag": "t"}), spark.createDataFrame([("l", "k")], "id string, survivor string"), 7)
    assert [(r.id, r.merged_into, r.deleted) for r in got["losers"].collect()] == [("l", "k", True)]
    assert [(r.id, r.created_at) for r in got["survivors"].collect()] == [("k", 2)] and [(r.book_id, r.content_tag) for r in got["notes"].collect()] == [("k", None)]


def test_search_order_and_ties(spark):
    n = notes(spark, {"id": "old", "text": "The Stoicism"}, {"id": "new", "text": "stoicism", "created_at": 2}, {"id": "none", "text": "other"})
    ideas = spark.createDataFrame([("i", "Stoic", "", 9, False)], "id string, name string, description string, created_at bigint, deleted boolean")
    got = search.search(search.search_docs(n, ideas), "stoic", 5).collect()
    assert [r.ref_id for r in got] == ["i", "new", "old"] and got[0].score == 2.0 and got[0].snippet == "Stoic"
    assert search.search(search.search_docs(n, ideas), "  ", 5).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "note_id string, embedding array<float>")
    assert [r.note_id for r in vectors.top_k(v, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert [r.note_id for r in vectors.similar(v, "a", 5).collect()] == ["b", "c"] and vectors.similar(v, "zz", 5).count() == 0
    with pytest.raises(ValueError):
        vectors.top_k(v, [0.0, 0.0], 1)


def test_pending_and_embedding(spark):
    n = notes(spark, {"id": "a"}, {"id": "b"}, {"id": "c", "updated_at": 2}, {"id": "d", "text": " "})
    stored = spark.createDataFrame([("a", "m", "u:1"), ("b", None, "u:1"), ("c", "m", "u:1")], "note_id string, model_version string, content_token string")
    queue = vectors.pending(n, stored, "m")
    assert [r.id for r in queue.collect()] == ["d", "c", "b"]
    got = vectors.embed(queue, lambda t: [3.0, 4.0], 2).collect()
    assert {r.id: r.status for r in got} == {"b": "embedded", "c": "embedded", "d": "skipped"}
    batch, forget = vectors.next_batch(queue, spark.createDataFrame([("c", "u:2")], "id string, token string"), 5)
    assert {r.id for r in batch.collect()} == {"b", "d"} and not forget


def test_snapshot(spark):
    raw = spark.createDataFrame([('{"id":"a","createdAt":null}',), ('{"id":1}',), ("x",)], "raw string")
    assert [r[0] for r in raw.select(snapshot.valid_row(F.col("raw"), {"id": "text", "createdAt": "stamp"})).collect()] == [True, False, False]
    lines = snapshot.export_lines({"notes": notes(spark, {"id": "a", "book_id": None}, {"id": "b", "deleted": True})}, {"notes": ["id", "book_id"]})
    assert rows(lines) == [("notes", '{"id":"a","bookId":null,"deleted":0}')]
    tags = snapshot.migrated_tags(F.array(F.lit("a"), F.lit("b")), 12, {"a": "z"}, {"b": "a"})
    assert spark.range(1).select(tags.alias("t")).first()["t"] == ["a"]


def test_conform(spark):
    got = conform(spark.createDataFrame([("a", "x", "1", 9)], "id string, name string, created_at string, user_id int"), TABLES["collections"])
    assert tuple(got.first()) == ("a", "x", 1, None, None)


def test_held_back(spark):
    from quillspark.schema import TABLES as T

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    n = spark.createDataFrame([("n1", "b1"), ("n2", "b2")], "id string, book_id string")
    m = spark.createDataFrame([("m1", "n1", "c"), ("m2", "n2", "c")], "id string, note_id string, collection_id string")
    bad = changes.held_back({"books": ids("b1"), "notes": n, "collection_memberships": m}, {"books": ids("b1")}, list(T.values()))
    assert rows(bad["collection_memberships"]) == [("m1",)]
