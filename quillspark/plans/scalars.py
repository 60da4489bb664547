"""Queries over scalar functions and small reads, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import scores, sealing, text
from quillspark.operators import changes, reads, search, staging, vectors
from quillspark.plans import roles
from quillspark.plans.catalog import TEST_KEY, query, ranked
from quillspark.plans.roles import FEED, NOTES, TEXTS, load


@query("SELECT n_regionkey AS region, coalesce(min(CASE WHEN n_name = 'NATION_' || n_regionkey THEN lower(n_comment) <> 'false' END), true) AS on_ FROM (SELECT n_regionkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'False' ELSE 'maybe' END AS n_comment FROM nation) GROUP BY n_regionkey")
def settings(spark, sf_dir):
    """A setting for each region: false only if it is there and says so."""
    n = load(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 2 == 0, "False").otherwise("maybe").alias("value"))
    out = None
    for r in range(5):
        part = reads.setting(n.where(F.col("n_regionkey") == r), f"NATION_{r}").select(F.lit(r).alias("region"), F.col("on").alias("on_"))
        out = part if out is None else out.union(part)
    return out.join(n.select(F.col("n_regionkey").alias("region")).distinct(), "region", "left_semi")


_OUTBOX = "o AS (SELECT event_id AS id, user_id AS record_id, epoch_us(ts) // 3600000000 AS created_at FROM events)"


@query(f"WITH {_OUTBOX} SELECT id, record_id, row_number() OVER (ORDER BY created_at, id) AS rank FROM (SELECT * FROM o ORDER BY created_at, id LIMIT 500)")
def outbox_scan(spark, sf_dir):
    """The oldest queued edits."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("record_id"), F.expr("unix_millis(cast(ts AS timestamp)) div 3600000").alias("created_at"))
    return ranked(changes.oldest_first(e).limit(500), F.asc("created_at"), F.asc("id")).select("id", "record_id", "rank")


@query(f"WITH {TEXTS} SELECT l.doc_id AS note_id, l.quality::VARCHAR AS model FROM labels l JOIN texts t ON t.id = l.doc_id WHERE NOT t.deleted AND l.quality = 1 AND l.toxic IS NOT NULL")
def current_vectors(spark, sf_dir):
    stored = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id"), F.col("quality").cast("string").alias("model_version"), F.col("toxic").alias("embedding"))
    return vectors.current(roles.texts(spark, sf_dir), stored, "1").select("note_id", F.col("model_version").alias("model"))


@query("SELECT doc_id AS note_id FROM labels WHERE quality IS NOT DISTINCT FROM 1")
def vectors_of_corpus(spark, sf_dir):
    stored = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("note_id"), F.col("quality").cast("string").alias("model_version"))
    return vectors.without_stale(stored, "1").select("note_id")


@query(f"WITH {TEXTS} SELECT l.doc_id AS note_id FROM labels l JOIN texts t ON t.id = l.doc_id WHERE NOT t.deleted AND CASE WHEN l.toxic = 0 THEN t.content_tag ELSE 'old' END IS NOT DISTINCT FROM coalesce(t.content_tag, 'u:' || t.updated_at)")
def accepted_vectors(spark, sf_dir):
    """New vectors whose note is live and still has the content they were made from."""
    notes = roles.texts(spark, sf_dir)
    made = load(spark, sf_dir, "labels").join(notes.select(F.col("id").alias("doc_id"), "content_tag"), "doc_id").select(F.col("doc_id").alias("note_id"), F.when(F.col("toxic") == 0, F.col("content_tag")).otherwise("old").alias("content_token"))
    return vectors.accepted(made, notes).select("note_id")


_PRIOR = "CASE WHEN source IN ('handwritten', 'readwise_annotation') THEN 0.9 WHEN source = 'share' THEN 0.75 WHEN source = 'manual' THEN 0.7 WHEN source = 'image' THEN 0.6 ELSE 0.5 END"


@query(
    f"""WITH n AS (SELECT o_orderkey AS note_id, ['handwritten', 'readwise_annotation', 'share', 'manual', 'image', 'readwise', NULL, 'other'][o_orderkey % 8 + 1] AS source FROM orders WHERE o_orderkey % 9 <> 0),
s AS (SELECT l_orderkey AS note_id, count(*) AS v, bool_or(l_returnflag = 'R') AS a, sum(l_linenumber)::BIGINT AS w FROM lineitem GROUP BY l_orderkey), p AS (SELECT s.*, {_PRIOR}::DOUBLE AS prior FROM s LEFT JOIN n USING (note_id))
SELECT note_id, prior AS source_prior, round(prior * exp(-0.6931471805599453::DOUBLE * (0.1::DOUBLE * v + 0.3::DOUBLE * a::INT + 0.5::DOUBLE * w) / 1.5::DOUBLE) + (0.1::DOUBLE * v + 0.3::DOUBLE * a::INT + 0.5::DOUBLE * w), 6) AS importance FROM p"""
)
def prior_lookup(spark, sf_dir):
    """Signals with the prior of their note's origin, every origin among them."""
    origins = F.array(*map(F.lit, ("handwritten", "readwise_annotation", "share", "manual", "image", "readwise", None, "other")))
    n = load(spark, sf_dir, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("id"), F.get(origins, (F.col("o_orderkey") % 8).cast("int")).alias("source"))
    s = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("note_id")).agg(F.count("*").alias("return_visits"), F.bool_or(F.col("l_returnflag") == "R").alias("has_annotation"), F.sum("l_linenumber").alias("stitch_spawns"))
    out = staging.prior_of_import(s.withColumns({"source_prior": F.lit(0.0), "importance": F.lit(0.0)}), n)
    return out.select("note_id", "source_prior", F.round("importance", 6).alias("importance"))


@query("WITH d AS (SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS content, p_name AS title FROM part), h AS (SELECT * FROM d WHERE list_contains(string_split(title, ' '), 'ring') OR list_contains(string_split(lower(content), ' '), 'ring')) SELECT ref_id, CASE WHEN content = '' THEN title ELSE content END AS snippet FROM h")
def snippets(spark, sf_dir):
    """What a hit shows: its content, or its title if that is empty."""
    p = load(spark, sf_dir, "part")
    d = p.select(F.lit("custom_idea").alias("kind"), F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("content"), F.col("p_partkey").alias("created_at"))
    found = search.search(d, "ring", 1_000_000)
    return found.where("score >= 1").where(F.array_contains(F.split("title", " "), "ring") | F.array_contains(F.split(F.lower("content"), " "), "ring")).select("ref_id", "snippet")


@query(
    r"""WITH n AS (SELECT doc_id, nfc_normalize(coalesce(text, '')) || CASE doc_id % 3 WHEN 0 THEN '  !?' WHEN 1 THEN chr(9) || chr(7) || '...' ELSE chr(160) || chr(8239) || 'x' END AS t FROM documents),
w AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(t), '[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'), '\p{Cc}', '', 'g')) AS t FROM n)
SELECT doc_id, md5(trim(regexp_replace(t, '\p{P}+$', ''))) AS normal FROM w"""
)
def normal_forms(spark, sf_dir):
    """Every text in its normal form, compatibility characters folded."""
    d = load(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 3 == 0, "  !?").when(F.col("doc_id") % 3 == 1, "\t\x07...").otherwise("  x")
    return d.select("doc_id", F.md5(text.normalized(F.concat(F.coalesce("text", F.lit("")), tail)).cast("binary")).alias("normal"))


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END ELSE text END AS text, doc_id % 4 = 2 AND doc_id % 5 = 0 AS failed FROM documents WHERE text IS NOT NULL")
def readable_texts(spark, sf_dir):
    """Absent, empty, sealed and open texts as they read; every fifth was sealed for another note."""
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    iv = F.substring(F.sha2(F.col("id").cast("string"), 256).cast("binary"), 1, 12)  # for the test; real ivs are random and stored
    owner = F.when(F.col("id") % 5 == 0, "another").otherwise(F.col("id").cast("string"))
    sealed = sealing.seal_text(F.col("text"), TEST_KEY[:32], iv, owner)
    k = F.col("id") % 4
    kept = d.select("id", F.when(k == 0, None).when(k == 1, "").when(k == 2, sealed).otherwise(F.col("text")).alias("text"))
    said, failed = sealing.readable(F.col("text"), TEST_KEY[:32], F.col("id").cast("string"))
    return kept.select("id", said.alias("text"), failed.alias("failed"))


@query("SELECT vec_id, len(embedding) * 4 + 29 AS sealed_bytes, vec_id % 5 <> 0 AS opened, CASE WHEN vec_id % 5 <> 0 THEN round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) END AS taxicab FROM embeddings")
def sealed_vectors(spark, sf_dir):
    """Vectors as bytes, sealed, opened and read again; every fifth under another vector's name."""
    e = load(spark, sf_dir, "embeddings")
    dims = len(e.select("embedding").first()[0])
    iv = F.substring(F.sha2(F.col("vec_id").cast("string"), 256).cast("binary"), 1, 12)
    sealed = e.select("vec_id", sealing.seal_bytes(vectors.to_bytes(F.col("embedding").cast("array<float>")), TEST_KEY[:32], iv, F.concat(F.lit("emb:"), F.col("vec_id"))).alias("sealed"))
    name = F.concat(F.lit("emb:"), F.when(F.col("vec_id") % 5 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id")))
    back = sealed.select("vec_id", F.length("sealed").cast("bigint").alias("sealed_bytes"), vectors.from_bytes(sealing.open_bytes(F.col("sealed"), TEST_KEY[:32], name), dims).alias("v"))
    return back.select("vec_id", "sealed_bytes", F.col("v").isNotNull().alias("opened"), F.when(F.col("v").isNotNull(), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 6)).alias("taxicab"))


@query("SELECT DISTINCT l_partkey || ':' || l_orderkey AS id, l_partkey AS collection_id FROM lineitem")
def membership_ids(spark, sf_dir):
    m = roles.memberships(spark, sf_dir).select(F.col("collection_id").cast("string").alias("c"), F.col("note_id").cast("string").alias("note_id"), "collection_id").distinct()
    return m.select(text.membership_id(F.col("c"), F.col("note_id")).alias("id"), "collection_id")


@query("SELECT p_partkey, 'https://covers.test/b/isbn/' || CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_partkey * 7 END || '-L.jpg' AS by_isbn, 'https://covers.test/b/id/' || p_size || '-L.jpg' AS by_id FROM part")
def cover_urls(spark, sf_dir):
    p, base = load(spark, sf_dir, "part"), "https://covers.test/b"
    return p.select("p_partkey", text.cover_by_isbn(F.when(F.col("p_size") % 2 == 0, None).otherwise((F.col("p_partkey") * 7).cast("string")), base).alias("by_isbn"), text.cover_by_id(F.col("p_size"), base).alias("by_id"))


@query("SELECT p_partkey, p_brand || '|' || p_size || '|' || p_mfgr || '|' || p_container AS key FROM (SELECT p_partkey, p_brand, p_size, p_name AS p_mfgr, p_type AS p_container FROM part)")
def corpus_keys(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", scores.corpus_key(F.col("p_brand"), F.col("p_size"), F.col("p_name"), F.col("p_type")).alias("key"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'u' || user_id END AS sub FROM events")
def token_subjects(spark, sf_dir):
    """The subject of signed tokens; every seventh can't be read."""
    e = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("u"))
    body = F.to_json(F.struct(F.col("u").alias("sub"), F.lit("?>~").alias("x")))
    part = F.rtrim(F.translate(F.base64(body.cast("binary")), "+/=", "-_ "))
    return e.select("event_id", text.token_subject(F.when(F.col("event_id") % 7 == 0, "no token").otherwise(F.concat(F.lit("h."), part, F.lit(".s")))).alias("sub"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || '|' || p_brand END AS items FROM part")
def string_arrays(spark, sf_dir):
    """The strings of JSON arrays with numbers, nulls and arrays among them; anything but an array has none."""
    p = load(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('{"a":"'), "p_name", F.lit('"}'))).otherwise(F.concat(F.lit('["'), "p_name", F.lit('",1,null,["x"],"'), "p_brand", F.lit('",true]')))
    return p.select("p_partkey", F.array_join(text.string_items(raw), "|").alias("items"))


@query(f"WITH {FEED}, p AS (SELECT *, change_seq // 100 AS page, CASE WHEN change_seq % 50 = 0 THEN change_seq - 5 ELSE change_seq END AS s, CASE WHEN change_seq % 41 = 0 THEN NULL ELSE updated_at END AS u FROM feed), l AS (SELECT *, lag(s) OVER (PARTITION BY page ORDER BY change_seq) AS prev FROM p) SELECT change_seq FROM l WHERE s <= prev OR u IS NULL OR s < 0")
def preflight_rows(spark, sf_dir):
    """Feed rows that stop an import: their number does not rise, or their stamp is missing."""
    f = roles.feed(spark, sf_dir)
    rows = f.select("id", F.expr("change_seq div 100").alias("page"), F.col("change_seq").alias("place"), F.when(F.col("change_seq") % 50 == 0, F.col("change_seq") - 5).otherwise(F.col("change_seq")).alias("change_seq"), F.when(F.col("change_seq") % 41 == 0, None).otherwise(F.col("updated_at")).alias("updated_at"), "deleted")
    return changes.invalid_feed_rows(rows, "id").select(F.col("place").alias("change_seq"))


@query(f"WITH {FEED} SELECT page, count(*) >= 1000 AND max(change_seq) <= page * 1000 + 999 - page % 2 * 1000 AS stalled FROM (SELECT change_seq, change_seq // 1000 AS page FROM feed) WHERE page < 6 GROUP BY page")
def stalled_pages(spark, sf_dir):
    """Pages of a thousand, every second one against a cursor that is already past it."""
    f, out = roles.feed(spark, sf_dir), None
    for page in range(6):
        rows = f.where(f"change_seq div 1000 = {page}")
        part = changes.stalled(rows, page * 1000 + 999 - page % 2 * 1000, 1000).select(F.lit(page).cast("bigint").alias("page"), "stalled")
        out = part if out is None else out.union(part)
    return out.join(f.select(F.expr("change_seq div 1000").alias("page")).distinct(), "page", "left_semi")


@query(f"WITH {NOTES} SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN 'tag' || id END, 'u:' || coalesce(CASE WHEN id % 4 <> 0 THEN updated_at END, 0)) AS token FROM notes")
def content_tokens(spark, sf_dir):
    n = roles.notes(spark, sf_dir)
    return n.select("id", scores.content_token(F.when(F.col("id") % 3 == 0, F.concat(F.lit("tag"), "id")), F.when(F.col("id") % 4 != 0, F.col("updated_at"))).alias("token"))
