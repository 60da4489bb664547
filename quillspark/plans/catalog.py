"""The archive's queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import scores, sealing, text
from quillspark.operators import changes, reads, reconcile, search, snapshot, vectors
from quillspark.plans import roles
from quillspark.plans.roles import BOOKS, FEED, LINKS, LOCAL, MEMBERSHIPS, NOTES, NOW_MS, TEXTS, load
from quillspark.sources.server import page_after
from quillspark.streaming import signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def ranked(rows: DataFrame, *order) -> DataFrame:
    """A `rank` column for a page: its rows are few, and the comparison ignores their order."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


# Reads


@query(f"WITH {NOTES} SELECT id, book_id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rank FROM (SELECT * FROM notes WHERE NOT deleted ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 20)")
def live_page(spark, sf_dir):
    page = reads.list_live(roles.notes(spark, sf_dir), limit=50, offset=20).select("id", "book_id", "created_at")
    return ranked(page, F.desc("created_at"), F.desc("id"))


@query(f"WITH {NOTES} SELECT id, created_at FROM notes WHERE NOT deleted AND book_id = 7")
def live_of_parent(spark, sf_dir):
    return reads.list_live(roles.notes(spark, sf_dir), where={"book_id": 7}).select("id", "created_at")


@query(f"WITH {NOTES} SELECT id, deleted FROM notes WHERE id = 1")
def row_by_key(spark, sf_dir):
    return reads.get_row(roles.notes(spark, sf_dir), "id", 1).select("id", "deleted")


@query(f"WITH {NOTES} SELECT count(*) AS n FROM notes WHERE NOT deleted")
def live_count(spark, sf_dir):
    return reads.count_live(roles.notes(spark, sf_dir))


@query(f"WITH {NOTES} SELECT id, created_at FROM notes WHERE id IN (SELECT item_id FROM benchmark)")
def rows_by_ids(spark, sf_dir):
    return reads.by_ids(roles.notes(spark, sf_dir), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))).select("id", "created_at")


@query(f"WITH {FEED} SELECT id, change_seq, updated_at FROM feed WHERE change_seq > 500 ORDER BY change_seq LIMIT 1000")
def change_page(spark, sf_dir):
    return page_after(roles.feed(spark, sf_dir), 500, 1000).select("id", "change_seq", "updated_at")


@query(f"WITH {NOTES} SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rank FROM (SELECT * FROM notes WHERE NOT deleted AND list_contains(tags, 'URGENT') ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 5)")
def contains_tag(spark, sf_dir):
    page = reads.notes_by_idea(roles.notes(spark, sf_dir), "URGENT", 100, 5)
    return ranked(page, F.desc("created_at"), F.desc("id")).select("id", "rank")


@query(f"WITH {NOTES} SELECT id FROM notes WHERE NOT deleted AND coalesce(len(tags), 0) = 0")
def untagged(spark, sf_dir):
    return reads.untagged_notes(roles.notes(spark, sf_dir)).select("id")


@query(f"WITH {NOTES} SELECT count(*) AS n FROM notes WHERE NOT deleted AND coalesce(len(tags), 0) = 0")
def untagged_count(spark, sf_dir):
    return reads.untagged(roles.notes(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"WITH {LINKS} SELECT id, from_note_id, to_note_id FROM links WHERE NOT deleted AND (from_note_id = 4 OR to_note_id = 4)")
def links_either_end(spark, sf_dir):
    return reads.links_of(roles.links(spark, sf_dir), 4).select("id", "from_note_id", "to_note_id")


EVENTS = "ev AS (SELECT event_id AS id, event_type AS text, epoch_us(ts) // 1000 AS created_at, event_type = 'error' AS deleted FROM events)"


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), roles.millis("ts").alias("created_at"), (F.col("event_type") == "error").alias("deleted"))


@query(f"WITH {EVENTS} SELECT id, created_at FROM ev WHERE NOT deleted AND created_at >= {NOW_MS} - 604800000 AND trim(text) <> ''")
def rolling_week(spark, sf_dir):
    return reads.fresh_notes(_events(spark, sf_dir), NOW_MS).select("id", "created_at")


@query(f"WITH {EVENTS} SELECT count(*) AS n FROM ev WHERE NOT deleted AND created_at >= {NOW_MS} - 604800000 AND trim(text) <> ''")
def notes_this_week(spark, sf_dir):
    return reads.fresh_notes(_events(spark, sf_dir), NOW_MS).agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS}, w AS (SELECT id, created_at FROM ev WHERE NOT deleted AND created_at >= {NOW_MS} - 604800000) SELECT id, created_at FROM w ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET (SELECT 123456789 % count(*) FROM w)")
def ordinal_pick(spark, sf_dir):
    return reads.ordinal(reads.fresh_notes(_events(spark, sf_dir), NOW_MS).select("id", "created_at"), 123456789)


@query(f"WITH {NOTES} SELECT t AS idea, count(*) AS n FROM (SELECT unnest(tags) AS t FROM notes WHERE NOT deleted) WHERE t IS NOT NULL GROUP BY t")
def tag_tally(spark, sf_dir):
    return reads.tag_tally(roles.notes(spark, sf_dir))


@query(f"WITH {BOOKS}, {NOTES} SELECT (SELECT count(*) FROM books WHERE NOT deleted) AS books, (SELECT count(*) FROM notes WHERE NOT deleted) AS notes, (SELECT count(*) FROM part WHERE p_size > 10) AS custom_ideas, (SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM notes WHERE NOT deleted)) AS active_ideas")
def archive_counts(spark, sf_dir):
    return reads.counts(roles.books(spark, sf_dir), roles.notes(spark, sf_dir), load(spark, sf_dir, "part").select((F.col("p_size") <= 10).alias("deleted")))


@query(f"WITH {BOOKS}, {NOTES}, p AS (SELECT * FROM books WHERE NOT deleted ORDER BY created_at DESC, id DESC LIMIT 200) SELECT id, title, (SELECT count(*) FROM notes WHERE book_id = p.id AND NOT deleted) AS note_count FROM p")
def parents_with_child_count(spark, sf_dir):
    return reads.books_with_counts(roles.books(spark, sf_dir), roles.notes(spark, sf_dir), 200).select("id", "title", "note_count")


@query(f"WITH {MEMBERSHIPS}, {NOTES} SELECT collection_id, count(DISTINCT note_id) AS n FROM memberships WHERE NOT deleted AND note_id IN (SELECT id FROM notes WHERE NOT deleted) GROUP BY collection_id")
def pair_counts_live(spark, sf_dir):
    return reads.collection_note_counts(roles.memberships(spark, sf_dir), roles.notes(spark, sf_dir))


@query(f"WITH {MEMBERSHIPS} SELECT DISTINCT note_id FROM memberships WHERE NOT deleted AND collection_id = 42")
def notes_of_collection(spark, sf_dir):
    rows = roles.memberships(spark, sf_dir)
    return reads.notes_of_collection(rows, 42)


@query(f"WITH {MEMBERSHIPS} SELECT DISTINCT collection_id FROM memberships WHERE NOT deleted AND note_id = 42")
def collections_of_note(spark, sf_dir):
    return reads.collections_of_note(roles.memberships(spark, sf_dir), 42)


# Changes


@query(
    f"""WITH RECURSIVE {FEED}, {LOCAL}, s AS (SELECT f.*, l.updated_at AS was, min(CASE WHEN NOT deleted THEN change_seq END) OVER (PARTITION BY f.id) AS live FROM feed f LEFT JOIN local l ON f.id = l.id),
k AS (SELECT *, greatest(max(updated_at) OVER (PARTITION BY id ORDER BY change_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), was) AS bar FROM s WHERE was IS NOT NULL OR change_seq >= live),
a AS (SELECT * FROM k WHERE bar IS NULL OR updated_at > bar)
SELECT id, arg_max(change_seq, updated_at) AS change_seq, max(updated_at) AS updated_at, arg_max(deleted, updated_at) AS deleted, count(*) AS merged FROM a GROUP BY id"""
)
def lww_latest(spark, sf_dir):
    won = changes.lww_winners(roles.feed(spark, sf_dir), roles.local(spark, sf_dir), "id")
    return won.select("id", "change_seq", "updated_at", "deleted", "merged")


@query(f"WITH {FEED} SELECT max(change_seq) AS cursor FROM feed")
def pull_cursor(spark, sf_dir):
    return changes.page_watermark(roles.feed(spark, sf_dir))


def _edits(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    fields = F.map_concat(
        F.create_map(F.col("event_type"), F.get_json_object("props", "$.k")),
        F.create_map(F.lit("deleted"), F.when(F.col("event_type") == "error", "true").otherwise("false")),
        F.create_map(F.lit("note"), F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("event_id").cast("string"))),
    )
    return e.select(F.col("user_id").alias("record"), roles.millis("ts").alias("created_at"), F.col("event_id").alias("id"), fields.alias("fields"))


@query(
    """WITH f AS (SELECT user_id AS record, epoch_us(ts) // 1000 AS c, event_id AS i, event_type AS field, json_extract_string(props, '$.k') AS value FROM events
UNION ALL SELECT user_id, epoch_us(ts) // 1000, event_id, 'deleted', CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END FROM events
UNION ALL SELECT user_id, epoch_us(ts) // 1000, event_id, 'note', CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id::VARCHAR END FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY record, field ORDER BY c DESC, i DESC) AS rn, max(value = 'true') OVER (PARTITION BY record, field) AS ever FROM f)
SELECT record, field, CASE WHEN field = 'deleted' AND ever THEN 'true' ELSE value END AS value FROM r WHERE rn = 1"""
)
def collapse_fields(spark, sf_dir):
    return changes.collapse(_edits(spark, sf_dir))


def _outbox(spark, sf_dir):
    e = load(spark, sf_dir, "events").where("event_type <> 'error'")
    stamp = F.when(F.col("event_id") % 4 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"updated_at":'), (F.col("event_id") % 19700 + 1).cast("string"), F.lit("}")))
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") * 1000 + F.col("event_id") % 37).cast("string").alias("record_id"), stamp.alias("payload"))


WON = f"""{FEED}, {LOCAL}, s AS (SELECT f.*, l.updated_at AS was, min(CASE WHEN NOT deleted THEN change_seq END) OVER (PARTITION BY f.id) AS live FROM feed f LEFT JOIN local l ON f.id = l.id),
k AS (SELECT *, greatest(max(updated_at) OVER (PARTITION BY id ORDER BY change_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), was) AS bar FROM s WHERE was IS NOT NULL OR change_seq >= live),
won AS (SELECT id, max(updated_at) AS at FROM k WHERE bar IS NULL OR updated_at > bar GROUP BY id),
ob AS (SELECT event_id AS id, user_id * 1000 + event_id % 37 AS record, CASE WHEN event_id % 4 <> 0 THEN event_id % 19700 + 1 END AS at FROM events WHERE event_type <> 'error')"""


@query(f"WITH {WON} SELECT ob.id, record::VARCHAR AS record_id FROM ob LEFT JOIN won ON ob.record = won.id WHERE NOT coalesce(ob.at <= won.at, false)")
def outbox_rebase(spark, sf_dir):
    won = changes.lww_winners(roles.feed(spark, sf_dir), roles.local(spark, sf_dir), "id")
    return changes.rebase_outbox(_outbox(spark, sf_dir), won, "id")[0].select("id", "record_id")


@query(f"WITH {WON} SELECT record::VARCHAR AS record_id, max(ob.at) AS discarded_at FROM ob JOIN won ON ob.record = won.id WHERE ob.at <= won.at GROUP BY record")
def superseded_edits(spark, sf_dir):
    won = changes.lww_winners(roles.feed(spark, sf_dir), roles.local(spark, sf_dir), "id")
    return changes.rebase_outbox(_outbox(spark, sf_dir), won, "id")[1]


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_partkey % 50 = 49 THEN p_partkey - 3 ELSE p_partkey + 1 END AS next FROM part),
c(id, target, h) AS (SELECT id, id, 0 FROM e WHERE next IS NOT NULL UNION ALL SELECT c.id, e.next, h + 1 FROM c JOIN e ON c.target = e.id WHERE e.next IS NOT NULL AND h < 20)
SELECT id, arg_max(target, h) AS target FROM c GROUP BY id"""
)
def redirect_chase(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    following = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_partkey") % 50 == 49, F.col("p_partkey") - 3).otherwise(F.col("p_partkey") + 1)
    return changes.redirect_targets(p.select(F.col("p_partkey").alias("id"), following.alias("next")))


@query(
    """WITH RECURSIVE v AS (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'view'),
a AS (SELECT user_id, min(t) AS t FROM v GROUP BY user_id UNION ALL SELECT a.user_id, (SELECT min(v.t) FROM v WHERE v.user_id = a.user_id AND v.t >= a.t + 3600000) AS t FROM a WHERE a.t IS NOT NULL)
SELECT user_id, count(t) AS recorded, max(t) AS exposure_recency_at FROM a GROUP BY user_id"""
)
def throttled_exposure(spark, sf_dir):
    views = load(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", roles.millis("ts").alias("at"))
    return signals.throttled(views, "user_id").groupBy("user_id").agg(F.count("*").alias("recorded"), F.max("at").alias("exposure_recency_at"))


@query(f"WITH {NOTES}, c AS (SELECT id, updated_at + (id % 5 - 2) * 86400000 AS at FROM notes WHERE id % 2 = 0) SELECT c.id, c.at AS updated_at FROM c LEFT JOIN (SELECT * FROM notes WHERE id % 3 <> 0) l ON c.id = l.id LEFT JOIN (SELECT id, updated_at + 86400000 AS updated_at FROM notes WHERE id % 7 = 0) s ON c.id = s.id WHERE (l.id IS NULL OR c.at > l.updated_at) AND (s.id IS NULL OR c.at > s.updated_at)")
def import_accept(spark, sf_dir):
    n = roles.notes(spark, sf_dir)
    c = n.where("id % 2 = 0").select("id", (F.col("updated_at") + (F.col("id") % 5 - 2) * 86400000).alias("updated_at"))
    server = n.where("id % 7 = 0").select("id", (F.col("updated_at") + 86400000).alias("updated_at"))
    return changes.import_accepted(c, n.where("id % 3 <> 0"), server, "id")


@query(f"WITH {NOTES} SELECT greatest({NOW_MS}, max(updated_at) + 1) AS stamp FROM notes")
def import_stamp(spark, sf_dir):
    return changes.batch_stamp(roles.notes(spark, sf_dir), NOW_MS)


@query("WITH bad AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0), n AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM bad)) SELECT count(*) AS n, (SELECT count(*) FROM n) AS notes FROM lineitem WHERE l_orderkey IN (SELECT id FROM n)")
def held_back(spark, sf_dir):
    from quillspark.schema import TABLES

    failed = {"books": roles.books(spark, sf_dir).where("deleted").select("id")}
    members = roles.memberships(spark, sf_dir).withColumn("id", F.monotonically_increasing_id())
    bad = changes.held_back({"books": roles.books(spark, sf_dir), "notes": roles.notes(spark, sf_dir), "collection_memberships": members}, failed, list(TABLES.values()))
    return bad["collection_memberships"].agg(F.count("*").alias("n")).crossJoin(bad["notes"].agg(F.count("*").alias("notes")))


# Reconciliation


@query(f"WITH {NOTES}, {BOOKS} SELECT DISTINCT book_id AS id FROM notes WHERE NOT deleted AND book_id NOT IN (SELECT id FROM books WHERE id % 10 <> 0)")
def missing_parents(spark, sf_dir):
    return reconcile.missing_books(roles.notes(spark, sf_dir).withColumn("book_id", F.col("book_id")), roles.books(spark, sf_dir).where("id % 10 <> 0"))


@query(
    f"""WITH RECURSIVE {NOTES}, {BOOKS}, c(id, target, h) AS (SELECT id, merged_into, 1 FROM books WHERE merged_into IS NOT NULL AND merged_into <> id::VARCHAR
  UNION ALL SELECT c.id, b.merged_into, h + 1 FROM c JOIN books b ON c.target = b.id::VARCHAR WHERE b.merged_into IS NOT NULL AND b.merged_into <> b.id::VARCHAR AND h < 20),
e AS (SELECT id, arg_max(target, h) AS target FROM c GROUP BY id),
r AS (SELECT n.id, n.book_id, coalesce(b.merged_into, '') AS into_, e.target, t.deleted AS td FROM notes n JOIN books b ON n.book_id = b.id AND b.deleted LEFT JOIN e ON e.id = b.id LEFT JOIN books t ON t.id::VARCHAR = e.target WHERE NOT n.deleted)
SELECT id, book_id::VARCHAR AS book_id, CASE WHEN into_ = '' THEN 'detach' WHEN td IS NULL THEN 'defer' WHEN NOT td THEN 'rehome' ELSE 'detach' END AS action,
  CASE WHEN into_ <> '' AND NOT td THEN target END AS target FROM r"""
)
def stranded_notes(spark, sf_dir):
    b = roles.books(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return reconcile.stranded_notes(roles.notes(spark, sf_dir).withColumn("book_id", F.col("book_id").cast("string")), b)


@query("WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS tag FROM part WHERE p_size > 5) SELECT tag FROM t WHERE lower(tag) NOT IN (SELECT lower(string_split(p_name, ' ')[1]) FROM part WHERE p_partkey < 3) AND lower(tag) NOT IN (SELECT lower(string_split(p_name, ' ')[2]) FROM part WHERE p_partkey < 2)")
def dropped_tags(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    notes = p.select(words.alias("tags"), (F.col("p_size") <= 5).alias("deleted"))
    canon = p.where("p_partkey < 3").select(F.get(words, F.lit(0)).alias("name"))
    ideas = p.where("p_partkey < 2").select(F.get(words, F.lit(1)).alias("name"), F.lit(False).alias("deleted"))
    return reconcile.dropped_tags(notes, canon, ideas)


@query(f"WITH {TEXTS}, l AS (SELECT * FROM texts WHERE NOT deleted) SELECT id, content_tag, first_value(id) OVER (PARTITION BY content_tag ORDER BY len(tags) DESC, created_at, id) AS survivor, count(*) OVER (PARTITION BY content_tag) AS n FROM l QUALIFY n > 1")
def dedup_survivor(spark, sf_dir):
    return reconcile.duplicate_clusters(roles.texts(spark, sf_dir))


@query(
    f"""WITH {LINKS}, m AS (SELECT p_partkey AS id, p_partkey // 4 * 4 AS survivor FROM part WHERE p_partkey % 4 <> 0),
r AS (SELECT l.id, coalesce(a.survivor, from_note_id) AS from_note_id, coalesce(b.survivor, to_note_id) AS to_note_id, relation_type, a.id IS NOT NULL OR b.id IS NOT NULL AS touched
  FROM links l LEFT JOIN m a ON a.id = from_note_id LEFT JOIN m b ON b.id = to_note_id WHERE NOT deleted)
SELECT id, from_note_id, to_note_id, relation_type, touched AND (row_number() OVER (PARTITION BY from_note_id, to_note_id, relation_type ORDER BY touched, id) > 1 OR from_note_id = to_note_id) AS retired FROM r"""
)
def edge_repoint(spark, sf_dir):
    moved = load(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 4 * 4").alias("survivor"))
    return reconcile.repointed_links(roles.links(spark, sf_dir), moved)


@query(f"WITH {NOTES} SELECT l_orderkey AS note_id, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey IN (SELECT id FROM notes WHERE deleted)")
def orphan_signals(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), "l_linenumber", (F.col("l_returnflag") == "R").alias("deleted"))
    return reconcile.orphan_signals(s, roles.notes(spark, sf_dir)).select("note_id", "l_linenumber")


@query(f"WITH {NOTES} SELECT l_orderkey AS note_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM notes WHERE NOT deleted)")
def orphan_vectors(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), "l_linenumber")
    return reconcile.orphan_vectors(s, roles.notes(spark, sf_dir))


@query(f"WITH {LINKS} SELECT DISTINCT n AS note_id FROM (SELECT unnest([from_note_id, to_note_id]) AS n FROM links WHERE NOT deleted AND relation_type <> 'A')")
def still_linked(spark, sf_dir):
    rows = roles.links(spark, sf_dir)
    return reconcile.still_linked(rows, rows.where("relation_type = 'A'"))


@query("SELECT l.o_orderkey AS id, array_to_string(list(c.l_linestatus || c.l_linenumber ORDER BY c.l_shipdate, c.l_linenumber, c.l_partkey, c.l_linestatus), '|') AS annotations FROM orders l JOIN lineitem c ON c.l_orderkey = l.o_orderkey WHERE l.o_orderstatus <> 'F' GROUP BY l.o_orderkey")
def annotations(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    c = load(spark, sf_dir, "lineitem").withColumn("said", F.concat("l_linestatus", F.col("l_linenumber").cast("string"))).withColumnRenamed("l_orderkey", "id")
    rows = snapshot.ordered_texts(o.join(c, "id"), "id", "said", "l_shipdate", "l_linenumber", "l_partkey", "l_linestatus")
    return rows.select("id", F.array_join("texts", "|").alias("annotations"))


# Search and vectors


@query(f"WITH {TEXTS} SELECT t.id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'stale' END AS reason FROM texts t LEFT JOIN labels l ON t.id = l.doc_id WHERE NOT t.deleted AND (l.doc_id IS NULL OR l.quality IS DISTINCT FROM 1 OR l.toxic IS DISTINCT FROM 0)")
def pending_queue(spark, sf_dir):
    stored = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id"), F.col("quality").cast("string").alias("model_version"), F.when(F.col("toxic") == 0, F.concat(F.lit("u:"), (F.col("doc_id") * 1000).cast("string"))).otherwise("old").alias("content_token"))
    notes = roles.texts(spark, sf_dir).withColumn("content_tag", F.lit(None).cast("string"))
    queue = vectors.pending(notes, stored, "1")
    return queue.join(stored.select(F.col("note_id").alias("id"), F.lit("stale").alias("r")), "id", "left").select("id", F.coalesce("r", F.lit("new")).alias("reason"))


_STEM = """CASE WHEN length(w) <= 3 THEN w ELSE (CASE WHEN p LIKE '%ing' AND length(p) > 5 THEN regexp_replace(p[:-4], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv)$', '') || coalesce(nullif(regexp_extract(p[:-4], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv)$')[1:1], ''), '')
 WHEN p LIKE '%ed' AND length(p) > 4 THEN regexp_replace(p[:-3], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv)$', '') || coalesce(nullif(regexp_extract(p[:-3], '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv)$')[1:1], ''), '') ELSE p END) END"""
_PLURAL = "CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN w LIKE '%sses' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"


@query(rf"WITH t AS (SELECT lower(unnest(regexp_split_to_array(text, '[\n\r\p{{Z}}\p{{P}}]+'))) AS w FROM documents), p AS (SELECT w, {_PLURAL} AS p FROM t WHERE w <> '') SELECT {_STEM} AS stem, count(*) AS n FROM p GROUP BY 1")
def stem_tokens(spark, sf_dir):
    return search.stem_tally(load(spark, sf_dir, "documents"))


@query(rf"WITH d AS (SELECT text FROM documents UNION ALL SELECT p_name FROM part), t AS (SELECT lower(unnest(regexp_split_to_array(text, '[\n\r\p{{Z}}\p{{P}}]+'))) AS w FROM d), p AS (SELECT w, {_PLURAL} AS p FROM t WHERE w <> '') SELECT {_STEM} AS stem, count(*) AS n FROM p GROUP BY 1")
def stem_tokens_all(spark, sf_dir):
    """stem_tokens over the whole archive: documents and part titles."""
    d = load(spark, sf_dir, "documents").select("text").unionAll(load(spark, sf_dir, "part").select("p_name"))
    return search.stem_tally(d)


_TERMS = {"red": 2, "ring": 4, "wid": 3}


def _weight(q: str) -> str:
    bound = min(6, int(len(q) * 0.2 + 0.5))
    fuzzy = f"WHEN levenshtein(t, '{q}') BETWEEN 1 AND {bound} THEN 0.45::DOUBLE * length(t) / (length(t) + levenshtein(t, '{q}'))" if bound else ""
    return f"max(CASE WHEN t = '{q}' THEN 1.0::DOUBLE WHEN starts_with(t, '{q}') THEN 0.375::DOUBLE * length(t) / (length(t) + 0.3::DOUBLE * (length(t) - {len(q)})) {fuzzy} ELSE 0.0 END)"


@query(
    f"""WITH k AS (SELECT p_partkey AS id, p_name, unnest(string_split(p_name, ' ')) AS t FROM part),
w AS (SELECT id, {_weight('red')} AS a, {_weight('ring')} AS b, {_weight('widgt')} AS c FROM k GROUP BY id)
SELECT id, round((2 * a + 2 * b + 2 * c) * ((a > 0)::INT + (b > 0)::INT + (c > 0)::INT), 6) AS score FROM w WHERE a + b + c > 0"""
)
def fuzzy_scores(spark, sf_dir):
    docs = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("content"))
    return search.scored(docs, "red ring widgt", ("id",)).select("id", F.round("score", 6).alias("score"))


def _search_oracle(terms: list[str]) -> str:
    columns = ", ".join(f"{_weight(q)[:-1]} * f) AS w{i}" for i, q in enumerate(terms))
    total, matched = " + ".join(f"w{i}" for i in range(len(terms))), " + ".join(f"(w{i} > 0)::INT" for i in range(len(terms)))
    return (
        rf"""WITH {TEXTS}, d AS (SELECT 'note' AS kind, id AS ref_id, '' AS title, trim(text) AS content, created_at FROM texts WHERE NOT deleted AND trim(text) <> ''
UNION ALL SELECT 'custom_idea', p_partkey, p_name, '', p_partkey FROM part),
k AS (SELECT kind, ref_id, created_at, 2.0::DOUBLE AS f, lower(unnest(regexp_split_to_array(title, '[\n\r\p{{Z}}\p{{P}}]+'))) AS w FROM d UNION ALL SELECT kind, ref_id, created_at, 1.0::DOUBLE, lower(unnest(regexp_split_to_array(content, '[\n\r\p{{Z}}\p{{P}}]+'))) FROM d),
p AS (SELECT *, {_PLURAL} AS p FROM k WHERE w <> ''), s AS (SELECT kind, ref_id, created_at, f, {_STEM} AS t FROM p),
w AS (SELECT kind, ref_id, created_at, {columns} FROM s GROUP BY ALL),
r AS (SELECT *, ({total}) * ({matched}) AS score FROM w WHERE {total} > 0)
SELECT kind, ref_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, kind = 'note' DESC, created_at DESC, ref_id DESC) AS rank FROM r QUALIFY rank <= 50"""
    )


@query(_search_oracle(["ring", "inst"]))
def lexical_search(spark, sf_dir):
    ideas = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("description"), F.col("p_partkey").alias("created_at"), F.lit(False).alias("deleted"))
    found = search.search(search.search_docs(roles.texts(spark, sf_dir), ideas), "rings inst", 50)
    return ranked(found.select("kind", "ref_id", F.round("score", 6).alias("score"), "created_at"), F.desc("score"), F.desc(F.col("kind") == "note"), F.desc("created_at"), F.desc("ref_id")).drop("created_at")


_DOT = "list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query(f"WITH p AS (SELECT embedding FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, {_DOT} AS score FROM embeddings e, p WHERE vec_id <> 7 ORDER BY score DESC, vec_id LIMIT 20)")
def similar_vectors(spark, sf_dir):
    found = vectors.similar(load(spark, sf_dir, "embeddings"), 7, 20, "vec_id")
    return ranked(found, F.desc("score"), F.asc("vec_id")).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("WITH p AS (SELECT [CASE WHEN i % 2 = 0 THEN 0.125 ELSE -0.125 END FOR i IN range(64)] AS embedding) SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, " + _DOT + " AS score FROM embeddings e, p ORDER BY score DESC, vec_id LIMIT 25)")
def vector_topk(spark, sf_dir):
    probe = [0.125 if i % 2 == 0 else -0.125 for i in range(64)]
    found = vectors.top_k(load(spark, sf_dir, "embeddings"), probe, 25, "vec_id")
    return ranked(found, F.desc("score"), F.asc("vec_id")).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: (x * 3)::DOUBLE * (x * 3)::DOUBLE))) AS len, embedding FROM embeddings) SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs((x * 3)::DOUBLE / len)::DOUBLE)), 4) AS taxicab FROM n")
def normalized_vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("v", scores.normalize(F.transform("embedding", lambda x: (x * 3).cast("float"))))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 4).alias("taxicab"))


# Scalars


@query("WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'purchase') AS s, bool_or(event_type = 'signup') AS a FROM events GROUP BY user_id), e AS (SELECT user_id, 0.1::DOUBLE * v + 0.3::DOUBLE * a::INT + 0.5::DOUBLE * s AS e FROM u) SELECT user_id, round(CASE WHEN user_id % 2 = 0 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END * exp(-0.6931471805599453::DOUBLE * greatest(e, 0) / 1.5::DOUBLE) + e, 6) AS importance FROM e")
def importance(spark, sf_dir):
    u = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("v"), F.count_if(F.col("event_type") == "purchase").alias("s"), F.bool_or(F.col("event_type") == "signup").alias("a"))
    prior = scores.source_prior(F.when(F.col("user_id") % 2 == 0, "manual").otherwise("other"))
    return u.select("user_id", F.round(scores.importance(prior, F.col("v"), F.col("a"), F.col("s")), 6).alias("importance"))


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS tags FROM (SELECT p_partkey, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda x: list_position(t, x[1]) = x[2]), lambda x: x[1]) AS list_distinct_ordered FROM (SELECT p_partkey, list_transform(string_split(p_name || ' ' || p_type, ' '), lambda x: CASE x WHEN 'red' THEN 'crimson' WHEN 'ring' THEN 'crimson' WHEN 'small' THEN 'little' ELSE x END) AS t FROM part))")
def tag_remap(spark, sf_dir):
    tags = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(text.remap_tags(tags, {"red": "crimson", "ring": "crimson", "small": "little"}), "|").alias("tags"))


@query("SELECT p_partkey, 'custom_' || regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slug_id(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_brand", F.lit(" / "), "p_name", F.lit("!")), "custom_").alias("slug"))


@query("WITH k AS (SELECT p_partkey, upper('isbn 97-' || p_partkey * 7919 || CASE WHEN p_size % 2 = 0 THEN '-1234' ELSE '12x' END) AS raw FROM part), n AS (SELECT p_partkey, regexp_replace(raw, '[^0-9X]', '', 'g') AS d FROM k) SELECT p_partkey, CASE WHEN regexp_matches(d, '^([0-9]{9}[0-9X]|[0-9]{13})$') THEN d END AS isbn FROM n")
def isbn_normalize(spark, sf_dir):
    raw = F.concat(F.lit("isbn 97-"), (F.col("p_partkey") * 7919).cast("string"), F.when(F.col("p_size") % 2 == 0, "-1234").otherwise("12x"))
    return load(spark, sf_dir, "part").select("p_partkey", text.normalize_isbn(raw).alias("isbn"))


#: A key for tests only.
TEST_KEY = bytes(range(64))


@query(
    "WITH m AS (SELECT p_partkey, lower(p_name) || chr(0) || p_brand AS x FROM part) SELECT p_partkey, sha256(unhex('"
    + bytes(b ^ 0x5C for b in TEST_KEY).hex()
    + "') || unhex(sha256(unhex('"
    + bytes(b ^ 0x36 for b in TEST_KEY).hex()
    + "') || encode(x)))) AS tag FROM m"
)
def content_fingerprint(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", sealing.content_tag(TEST_KEY, text.normalized(F.concat("p_name", F.lit(" !")), unicode=False), F.col("p_brand")).alias("tag"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM orders")
def iso_stamps(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.iso_millis(roles.millis("o_orderdate")).alias("at"))


@query("SELECT doc_id AS id, text FROM documents")
def sealed_round_trip(spark, sf_dir):
    """Each text sealed under its id and opened again."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    iv = F.substring(F.sha2(F.col("id").cast("string"), 256).cast("binary"), 1, 12)  # for the test; real ivs are random and stored
    sealed = d.select("id", sealing.seal_text(F.col("text"), TEST_KEY[:32], iv, F.col("id").cast("string")).alias("sealed"))
    return sealed.select("id", sealing.open_text(F.col("sealed"), TEST_KEY[:32], F.col("id").cast("string")).alias("text"))


# Snapshots


@query("SELECT c_custkey AS id, c_name AS title, c_mktsegment AS \"coverSource\", 0 AS deleted FROM customer WHERE c_acctbal >= 0")
def snapshot_rename(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("cover_source"), (F.col("c_acctbal") < 0).alias("deleted"))
    return snapshot.exported(c, ["id", "title", "cover_source"])


@query(f"WITH {NOTES} SELECT id FROM notes WHERE id % 6 = 0 OR created_at IS NULL")
def invalid_import_rows(spark, sf_dir):
    rows = roles.notes(spark, sf_dir).select("id", F.when(F.col("id") % 6 == 0, F.lit('{"id":7}')).otherwise(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "text", F.col("created_at").alias("createdAt")))).alias("raw"))
    return rows.where(~snapshot.valid_row(F.col("raw"), {"id": "text", "text": "text?", "createdAt": "stamp"})).select("id")
