from pyspark.sql import functions as F

from quillspark.schema import TABLES
from quillspark.sources.store import Store, change_stream
from quillspark.streaming.merge import merge_batch, pull
from quillspark.streaming.signals import HOUR_MS, recorded, recorder, throttled

FEED = "id string, name string, updated_at bigint, deleted boolean, change_seq bigint, user_id string"


def test_stream_equals_batch_and_commits_once(spark, tmp_path):
    pages = [[("a", "A", 2, False, 1, "u"), ("b", "B", 2, True, 2, "u")], [("a", "A0", 1, False, 3, "u"), ("a", "A2", 3, True, 4, "u"), ("c", "C", 1, False, 5, "u")]]
    feed = tmp_path / "feed"
    streamed, batched = Store(spark, str(tmp_path / "s1")), Store(spark, str(tmp_path / "s2"))
    for i, page in enumerate(pages):
        df = spark.createDataFrame(page, FEED)
        df.coalesce(1).write.mode("append").parquet(str(feed))
        assert merge_batch(batched, "collections", df, i)
        assert not merge_batch(batched, "collections", df, i)
    pull(streamed, "collections", change_stream(spark, str(feed), spark.createDataFrame([], FEED).schema), str(tmp_path / "cp")).awaitTermination(120)
    rows = lambda s: sorted((r.id, r.name, r.updated_at, r.deleted) for r in s.table("collections").collect())
    assert rows(streamed) == rows(batched) == [("a", "A2", 3, True), ("c", "C", 1, False)]
    assert batched.state()["meta"] == {"cursor:collections": 5} and batched.table("books").columns == list(TABLES["books"].columns)


def test_throttle(spark):
    e = spark.createDataFrame([("n", t) for t in (1, HOUR_MS, HOUR_MS + 1, HOUR_MS + 2)] + [("m", 5), ("m", None)], "k string, at bigint")
    assert sorted(tuple(r) for r in throttled(e, "k").collect()) == [("m", 5), ("n", 1), ("n", HOUR_MS + 1)]


def test_recorder(spark, tmp_path):
    rows = [("n", "exposure", 10), ("n", "exposure", 20), ("n", "return_visit", 30), ("m", "engagement", 7)]
    spark.createDataFrame(rows, "note_id string, kind string, at bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("note_id string, kind string, at bigint").parquet(str(tmp_path / "in"))
    q = recorder(stream).writeStream.format("memory").queryName("signals").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("signals").orderBy(F.col("note_id")).collect()
    assert [tuple(r) for r in got] == [("m", 0, 0, 7), ("n", 1, 30, 0)]


def test_recorder_refuses_absent_and_deleted_notes(spark, tmp_path):
    rows = [("live", "engagement", 5), ("dead", "engagement", 5), ("absent", "return_visit", 5)]
    spark.createDataFrame(rows, "note_id string, kind string, at bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    notes = spark.createDataFrame([("live", False), ("dead", True)], "id string, deleted boolean")
    stream = spark.readStream.schema("note_id string, kind string, at bigint").parquet(str(tmp_path / "in"))
    q = recorder(stream, notes=notes).writeStream.format("memory").queryName("refused").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("refused").collect()] == [("live", 0, 0, 5)]


def test_recorded_signals(spark):
    t = TABLES["note_signals"]
    row = {"source_prior": 0.6, "return_visits": 0, "has_annotation": False, "stitch_spawns": 0, "exposure_recency_at": 100, "engagement_recency_at": 0, "importance": 0.6, "created_at": 1, "updated_at": 1, "deleted": False}
    stored = [{"note_id": "seen"}, {"note_id": "lying", "importance": 0.1}, {"note_id": "null", "importance": None}, {"note_id": "back", "deleted": True}, {"note_id": "gone"}]
    signals = spark.createDataFrame([tuple((row | r)[c] for c in t.columns) for r in stored], t.struct)
    notes = spark.createDataFrame([(i, s, i == "gone") for i, s in (("seen", "manual"), ("lying", "manual"), ("null", "manual"), ("back", "share"), ("new", "handwritten"), ("gone", "manual"), ("quiet", "manual"))], "id string, source string, deleted boolean")
    at = 100 + HOUR_MS
    events = [("seen", "exposure", 101), ("lying", "exposure", 101), ("null", "exposure", 101), ("back", "exposure", at - 1), ("new", "return_visit", 5), ("new", "exposure", 6), ("new", "engagement", 9), ("gone", "engagement", 9), ("absent", "engagement", 9)]
    out = recorded(signals, notes, spark.createDataFrame(events, "note_id string, kind string, at bigint"), 777)
    got = {r.note_id: (r.source_prior, r.return_visits, r.exposure_recency_at, r.engagement_recency_at, round(r.importance, 6), r.deleted) for r in out.collect()}
    assert got == {
        "lying": (0.6, 0, 100, 0, 0.6, False),
        "null": (0.6, 0, 100, 0, 0.6, False),
        "back": (0.6, 0, 100, 0, 0.6, False),
        "new": (0.9, 1, 5, 9, round(0.9 * 2 ** (-0.1 / 1.5) + 0.1, 6), False),
    }
    assert out.select("updated_at").distinct().first()[0] == 777
    later = recorded(signals, notes, spark.createDataFrame([("seen", "exposure", at)], "note_id string, kind string, at bigint"), 778).first()
    assert (later.note_id, later.exposure_recency_at) == ("seen", at)
