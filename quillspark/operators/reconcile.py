"""Repairs after a merge: missing and stranded parents, dropped tags, duplicate contents, repointed links, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import cover_by_id, cover_by_isbn, normalize_isbn, slug
from quillspark.operators.changes import redirect_targets
from quillspark.operators.reads import live
from quillspark.schema import TABLES, conform


def missing_books(notes: DataFrame, books: DataFrame) -> DataFrame:
    """Book ids of live notes without any row, deleted ones included, in books."""
    wanted = live(notes).where("book_id IS NOT NULL AND cast(book_id AS string) <> ''").select(F.col("book_id").alias("id")).distinct()
    return wanted.join(books.select("id"), "id", "left_anti")


def stranded_notes(notes: DataFrame, books: DataFrame) -> DataFrame:
    """id, book_id, action, target: live notes on deleted books move to the live end of the redirects, wait if it is unknown, or lose the book."""
    ends = redirect_targets(books.select("id", F.col("merged_into").alias("next")))
    gone = books.where("deleted = true").select(F.col("id").alias("book_id"), F.coalesce("merged_into", F.lit("")).alias("__into"))
    state = books.select(F.col("id").alias("target"), (F.col("deleted") == F.lit(False)).alias("__alive"))
    rows = live(notes).join(gone, "book_id").join(ends.withColumnRenamed("id", "book_id"), "book_id", "left").join(state, "target", "left")
    action = F.when(F.col("__into") == "", "detach").when(F.col("__alive").isNull(), "defer").when(F.col("__alive"), "rehome").otherwise("detach")
    return rows.select("id", "book_id", action.alias("action"), F.when(action == "rehome", F.col("target")).alias("target"))


def dropped_tags(notes: DataFrame, canon: DataFrame, ideas: DataFrame) -> DataFrame:
    """Tags of live notes that are neither canon names nor live custom ideas, in any case."""
    used = live(notes).select(F.explode("tags").alias("tag")).where("tag IS NOT NULL").distinct().withColumn("lowered", F.lower("tag"))
    return used.join(canon.select(F.lower("name").alias("lowered")), "lowered", "left_anti").join(live(ideas).select(F.lower("name").alias("lowered")), "lowered", "left_anti").select("tag")


def duplicate_clusters(notes: DataFrame) -> DataFrame:
    """id, content_tag, survivor, n for live notes that share a content tag: most tags, then earliest, then least id survives."""
    rows = live(notes).where("content_tag <> ''").select("id", "content_tag", "created_at", F.coalesce(F.size("tags"), F.lit(0)).alias("k"))
    best = rows.groupBy("content_tag").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "created_at", "id")).alias("best")).where("n > 1")
    best = best.hint("rebalance")  # an exchange of its own, so that a hot tag's join can be split
    return rows.join(best, "content_tag").select("id", "content_tag", F.col("best.id").alias("survivor"), "n")


def union_tags(survivor: Column, others: Column) -> Column:
    """The survivor's tags as they are, then the others' new ones in first-seen order."""
    return F.concat(survivor, F.array_except(F.array_distinct(others), survivor))


def repointed_links(links: DataFrame, moved: DataFrame) -> DataFrame:
    """id, from_note_id, to_note_id, relation_type, retired: live links with merged notes replaced (moved: id, survivor).

    Of the links that now say the same the first stays, untouched ones before touched ones, then by id; touched ones
    that repeat or link a note with itself retire.
    """
    a, b = (moved.select(F.col("id").alias(c), F.col("survivor").alias(f"__{c}")) for c in ("from_note_id", "to_note_id"))
    rows = live(links).join(a, "from_note_id", "left").join(b, "to_note_id", "left")
    rows = rows.withColumn("touched", F.col("__from_note_id").isNotNull() | F.col("__to_note_id").isNotNull())
    rows = rows.select("id", F.coalesce("__from_note_id", "from_note_id").alias("from_note_id"), F.coalesce("__to_note_id", "to_note_id").alias("to_note_id"), "relation_type", "touched")
    rn = F.row_number().over(Window.partitionBy("from_note_id", "to_note_id", "relation_type").orderBy("touched", "id"))
    retired = F.col("touched") & ((rn > 1) | (F.col("from_note_id") == F.col("to_note_id")))
    return rows.withColumn("retired", retired).drop("touched")


def orphan_signals(signals: DataFrame, notes: DataFrame) -> DataFrame:
    """Live signals whose note is there and deleted; of an absent note they stay."""
    return live(signals).join(notes.where("deleted = true").select(F.col("id").alias("note_id")), "note_id", "left_semi")


def orphan_vectors(vectors: DataFrame, notes: DataFrame) -> DataFrame:
    return vectors.join(live(notes).select(F.col("id").alias("note_id")), "note_id", "left_anti")


def still_linked(links: DataFrame, retiring: DataFrame) -> DataFrame:
    """note_id of every note that a live link outside `retiring` touches, in either direction."""
    rest = live(links).join(retiring.select("id"), "id", "left_anti")
    return rest.select(F.col("from_note_id").alias("note_id")).union(rest.select("to_note_id")).distinct()


def later(now_ms: int, column: str = "updated_at") -> Column:
    """Now, and in any case after the row's own stamp."""
    return F.greatest(F.lit(now_ms).cast("bigint"), F.coalesce(column, F.lit(0)) + 1)


def deletion_cascade(notes: DataFrame, links: DataFrame, signals: DataFrame, deleted: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """What deleting notes (deleted: id) takes along, as whole rows: their signals, the margin links that lead to them, and
    under `unmarked` the signals of live parents whose margins changed.

    A note without signals gets deleted ones with its origin's prior, as another copy may have live ones. A parent is
    marked as long as another live margin is left; without signals and margins it stays without.
    """
    from quillspark.operators.margins import born_or_stored, is_margin, scored

    notes, links, signals = (conform(x, TABLES[t]) for x, t in ((notes, "notes"), (links, "note_links"), (signals, "note_signals")))
    gone = deleted.select("id").distinct()
    dead = notes.join(gone, "id", "left_semi")
    tomb = lambda rows: rows.withColumn("deleted", F.lit(True)).withColumn("updated_at", later(now_ms))
    retired = scored(born_or_stored(signals, dead.select("id", "source"), now_ms).where("was_live OR NOT there"))
    margins = live(links).where(is_margin(F.col("relation_type")))
    ends = margins.join(gone.withColumnRenamed("id", "to_note_id"), "to_note_id", "left_semi").select(*links.columns)
    left = margins.join(ends.select("id"), "id", "left_anti").select(F.col("from_note_id").alias("note_id")).distinct().withColumn("__left", F.lit(True))
    parents = live(notes).join(ends.select(F.col("from_note_id").alias("id")).distinct(), "id", "left_semi").join(gone, "id", "left_anti").select("id", "source")
    now = born_or_stored(signals, parents, now_ms).join(left, "note_id", "left").withColumn("has", F.coalesce("__left", F.lit(False))).where("there OR has")
    now = scored(now.withColumnsRenamed({"importance": "__old", "has_annotation": "__had"}).withColumnRenamed("has", "has_annotation"))
    moved = ~F.col("was_live") | (F.col("__had") != F.col("has_annotation")) | F.coalesce(F.abs(F.col("__old") - F.col("importance")) > 1e-9, F.lit(True))
    marks = now.where(moved).withColumn("deleted", F.lit(False)).withColumn("updated_at", later(now_ms))
    return {
        "notes": tomb(live(dead)),
        "note_signals": conform(tomb(retired), TABLES["note_signals"]),
        "note_links": tomb(ends.withColumn("relation_type", F.coalesce("relation_type", F.lit("handwritten_annotation")))),
        "unmarked": conform(marks, TABLES["note_signals"]),
    }


def merge_books(books: DataFrame, notes: DataFrame, losers: DataFrame, now_ms: int, redirects: DataFrame | None = None) -> dict[str, DataFrame]:
    """losers: id, survivor. Losers become redirects, their live notes move, and each survivor takes the earliest created_at.

    Pairs whose survivor isn't live, is itself a loser, or already leads to the loser are left out (`cycles` has the
    last). `redirects` (id, next) are the ones known before; the result's are these and the new ones. What an undo needs
    is in `undo_books` (id, survivor, prior_created_at) and `undo_notes` (id, prior_book_id); a loser with an earlier
    redirect is a merge resumed, of which notes may have moved before, and so is in neither.
    """
    known = redirects if redirects is not None else books.where("coalesce(merged_into, '') <> ''").select("id", F.col("merged_into").alias("next"))
    pairs = losers.where("id <> survivor AND coalesce(id, '') <> ''").select("id", "survivor").dropDuplicates(["id"])
    ends = redirect_targets(known).select(F.col("id").alias("survivor"), "target")
    pairs = pairs.join(ends, "survivor", "left").withColumn("__cycle", F.coalesce(F.col("target") == F.col("id"), F.lit(False)))
    alive = live(books).select(F.col("id").alias("survivor"), F.col("created_at").alias("prior_created_at"))
    valid = pairs.where("NOT __cycle").join(alive, "survivor").join(pairs.select(F.col("id").alias("survivor")), "survivor", "left_anti").select("id", "survivor", "prior_created_at")
    own = valid.select("id", "survivor")
    gone = live(books).join(own, "id")
    earliest = gone.groupBy("survivor").agg(F.min("created_at").alias("__first")).withColumnRenamed("survivor", "id")
    kept = books.join(earliest, "id").withColumn("created_at", F.least("created_at", "__first")).withColumn("updated_at", later(now_ms)).drop("__first")
    moving = live(notes).join(gone.select(F.col("id").alias("__book"), "survivor"), F.col("book_id") == F.col("__book"))
    moved = moving.withColumn("book_id", F.col("survivor")).withColumn("content_tag", F.lit(None).cast("string")).withColumn("updated_at", later(now_ms)).select(*notes.columns)
    fresh = gone.select("id").join(known.select("id"), "id", "left_anti")
    return {
        "losers": gone.withColumn("merged_into", F.col("survivor")).withColumn("deleted", F.lit(True)).withColumn("updated_at", later(now_ms)).select(*books.columns),
        "survivors": kept,
        "notes": moved,
        "redirects": known.join(own.select("id"), "id", "left_anti").select("id", "next").union(own),
        "cycles": pairs.where("__cycle").select("id", "survivor"),
        "undo_books": valid.join(fresh, "id", "left_semi"),
        "undo_notes": moving.join(fresh.withColumnRenamed("id", "__book"), "__book", "left_semi").select("id", F.col("__book").alias("prior_book_id")),
    }


def unmerge(books: DataFrame, notes: DataFrame, redirects: DataFrame, undo_books: DataFrame, undo_notes: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """Takes a merge back: losers return and lose their redirect, their notes return without a content tag, and survivors
    get the earliest created_at of their own earlier one and those still merged into them."""
    back = undo_books.select("id", F.col("survivor").alias("__to"))
    returned = books.join(undo_books.select("id"), "id", "left_semi").withColumn("deleted", F.lit(False)).withColumn("merged_into", F.lit(None).cast("string")).withColumn("updated_at", later(now_ms))
    homes = notes.join(undo_notes.select("id", "prior_book_id"), "id").withColumn("book_id", F.col("prior_book_id")).withColumn("content_tag", F.lit(None).cast("string")).withColumn("updated_at", later(now_ms))
    left = redirects.join(back, (redirects["id"] == back["id"]) & (F.col("next") == F.col("__to")), "left_anti")
    still = left.join(books.select("id", F.col("created_at").alias("__at")), "id").groupBy(F.col("next").alias("id")).agg(F.min("__at").alias("__first"))
    prior = undo_books.groupBy(F.col("survivor").alias("id")).agg(F.max("prior_created_at").alias("__prior"))
    kept = books.join(prior, "id").join(still, "id", "left").withColumn("created_at", F.least("__prior", "__first")).withColumn("updated_at", later(now_ms))
    return {"losers": returned, "notes": homes.select(*notes.columns), "survivors": kept.select(*books.columns), "redirects": left}


def tag_heal(notes: DataFrame, key: bytes) -> DataFrame:
    """Live notes with a text and no content tag, with the tag; their stamps stay."""
    from quillspark.functions import sealing, text

    rows = live(notes).where("coalesce(content_tag, '') = '' AND text IS NOT NULL").where(~sealing.is_sealed(F.col("text")))
    return rows.withColumn("content_tag", sealing.content_tag(key, text.normalized(F.col("text")), F.col("book_id")))


def merge_notes(notes: DataFrame, clusters: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """clusters: id, survivor (duplicate_clusters gives them). Survivors take the union of the tags and, if they have none, the first loser's image; losers are deleted.

    A cluster's losers are folded in order of (created_at, id).
    """
    losers = notes.join(clusters.where("id <> survivor").select("id", "survivor"), "id")
    stamp = F.greatest(F.lit(now_ms).cast("bigint"), F.col("updated_at") + 1)
    folded = losers.groupBy(F.col("survivor").alias("id")).agg(F.sort_array(F.collect_list(F.struct("created_at", "id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "image_path"))).alias("__l"))
    kept = notes.join(folded, "id")
    tags = F.flatten(F.transform("__l", lambda x: F.filter(x["tags"], lambda t: t.isNotNull())))
    image = F.get(F.filter(F.transform("__l", lambda x: x["image_path"]), lambda p: F.coalesce(p, F.lit("")) != ""), F.lit(0))
    kept = kept.withColumn("tags", union_tags(F.coalesce("tags", F.array().cast("array<string>")), tags))
    kept = kept.withColumn("image_path", F.when(F.coalesce("image_path", F.lit("")) == "", image).otherwise(F.col("image_path")))
    return {"survivors": kept.withColumn("updated_at", stamp).drop("__l"), "losers": losers.withColumn("deleted", F.lit(True)).withColumn("updated_at", stamp).drop("survivor")}


def moved_memberships(memberships: DataFrame, moved: DataFrame, now_ms: int) -> dict[str, DataFrame]:
    """moved: id, survivor. The losers' live memberships are deleted; each collection has one live membership of the survivor, an old one's created_at kept."""
    gone = live(memberships).join(moved.select(F.col("id").alias("note_id"), "survivor"), "note_id")
    stamp = F.greatest(F.lit(now_ms).cast("bigint"), F.col("updated_at") + 1)
    wanted = gone.groupBy("collection_id", F.col("survivor").alias("note_id")).agg(F.min("created_at").alias("__first"))
    there = memberships.select("collection_id", "note_id", F.col("created_at").alias("__old"), F.col("updated_at").alias("__at"), F.col("deleted").alias("__gone"))
    joined = wanted.join(there, ["collection_id", "note_id"], "left").where("__gone IS NULL OR __gone")
    made = joined.select(
        F.concat_ws(":", "collection_id", "note_id").alias("id"), "note_id", "collection_id", F.coalesce("__old", "__first").alias("created_at"), F.greatest(F.lit(now_ms).cast("bigint"), F.col("__at") + 1).alias("updated_at"), F.lit(False).alias("deleted")
    )
    return {"deleted": gone.withColumn("deleted", F.lit(True)).withColumn("updated_at", stamp).drop("survivor"), "ensured": made}


def unmerge_books(books: DataFrame, token: DataFrame, now_ms: int) -> DataFrame:
    """token: id, survivor, as a merge left it. Losers that still point at that survivor come back."""
    rows = books.join(token.select("id", "survivor"), "id").where("deleted AND merged_into = survivor")
    return rows.withColumn("deleted", F.lit(False)).withColumn("merged_into", F.lit(None).cast("string")).withColumn("updated_at", F.greatest(F.lit(now_ms).cast("bigint"), F.col("updated_at") + 1)).drop("survivor")


def retired_links(links: DataFrame, moved: DataFrame, now_ms: int) -> DataFrame:
    """Whole rows of the live links that merged notes change: repointed, or deleted where they repeat one or became loops."""
    new = repointed_links(links, moved).withColumnsRenamed({"from_note_id": "__from", "to_note_id": "__to", "relation_type": "__rel"})
    rows = live(links).join(new, "id").where("retired OR __from <> from_note_id OR __to <> to_note_id")
    same = F.col("retired")
    rows = rows.withColumn("from_note_id", F.when(same, F.col("from_note_id")).otherwise(F.col("__from"))).withColumn("to_note_id", F.when(same, F.col("to_note_id")).otherwise(F.col("__to")))
    return rows.withColumn("deleted", same).withColumn("updated_at", later(now_ms)).select(*links.columns)


def merge_content_duplicates(notes: DataFrame, links: DataFrame, memberships: DataFrame, survivor: str, losers: list[str], now_ms: int, allow_cross_cluster: bool = False) -> dict[str, DataFrame]:
    """Whole rows by table that fold some live notes into a live one; no tables if there are no losers.

    All have to be live and, unless `allow_cross_cluster`, share one content tag that isn't empty; else ValueError.
    """
    losers = [x for x in dict.fromkeys(losers) if x and x != survivor]
    if not survivor:
        raise ValueError("a survivor is needed")
    if not losers:
        return {}
    spark = notes.sparkSession
    pairs = spark.createDataFrame([(i, survivor) for i in [survivor, *losers]], "id string, survivor string")  # what a person picked
    found = live(notes).join(pairs, "id")
    seen = found.agg(F.count("*").alias("n"), F.count_if(F.col("id") == survivor).alias("own"), F.count_distinct(F.coalesce("content_tag", F.lit(""))).alias("tags"), F.min(F.coalesce("content_tag", F.lit(""))).alias("tag")).first()
    if not seen["own"] or seen["n"] < len(losers) + 1:
        raise ValueError("a note to merge is absent or deleted")
    if not allow_cross_cluster and (seen["tags"] != 1 or not seen["tag"]):
        raise ValueError("the notes do not share a content tag")
    folded = merge_notes(found.drop("survivor"), pairs, now_ms)
    moved = pairs.where("id <> survivor")
    lists = moved_memberships(memberships, moved, now_ms)
    return {
        "notes": folded["survivors"].select(*notes.columns).unionByName(folded["losers"].select(*notes.columns)),
        "note_links": retired_links(links, moved, now_ms),
        "collection_memberships": lists["deleted"].select(*memberships.columns).unionByName(lists["ensured"].select(*memberships.columns)),
    }


def dropped_ideas(notes: DataFrame, canon: DataFrame, ideas: DataFrame, prefix: str, now_ms: int) -> DataFrame:
    """New custom ideas for dropped tags, one for each name in any case, unless its id is there (deleted ones included)."""
    tags = dropped_tags(notes, canon, ideas).groupBy(F.lower("tag")).agg(F.min("tag").alias("name"))
    now = F.lit(now_ms).cast("bigint")
    rows = tags.select(slug(F.col("name"), prefix).alias("id"), "name", F.lit("").alias("description"), now.alias("created_at"), now.alias("updated_at"), F.lit(False).alias("deleted"))
    return rows.groupBy("id").agg(*(F.min_by(c, "name").alias(c) for c in rows.columns[1:])).join(ideas.select("id"), "id", "left_anti")


def resolved_covers(books: DataFrame, search, base: str, source: str, now_ms: int, budget: int = 10, enabled: bool = True) -> DataFrame:
    """Partial rows (id, cover_url, cover_source, cover_resolved_at, updated_at) of the books settled: those with a cover found, and misses with a null one.

    An ISBN gives its cover without a search. A book without a title is a miss. At most `budget` others are searched for
    (`search` is a Covers); an outage settles nothing, and neither does a pass that is not enabled.
    """
    open_ = live(books).where("coalesce(cover_source, '') <> 'manual' AND cover_url IS NULL AND (cover_resolved_at IS NULL OR coalesce(updated_at, 0) > cover_resolved_at)")
    if not enabled:
        open_ = open_.limit(0)
    open_ = open_.select("id", "title", "author", "created_at", normalize_isbn(F.col("isbn")).alias("__isbn"))
    direct = open_.where("__isbn IS NOT NULL").select("id", cover_by_isbn(F.col("__isbn"), base).alias("cover_url"))
    rest = open_.where("__isbn IS NULL")
    untitled = rest.where("trim(coalesce(title, '')) = ''").select("id", F.lit(None).cast("string").alias("cover_url"))
    asked = rest.where("trim(coalesce(title, '')) <> ''").orderBy(F.desc("created_at"), F.desc("id")).limit(budget)
    found = search.search(asked.select("id", "title", "author")).where("outcome <> 'outage'")
    found = found.select("id", F.when(F.col("outcome") == "hit", F.coalesce(cover_by_id(F.col("cover_id"), base), cover_by_isbn(normalize_isbn(F.col("isbn")), base))).alias("cover_url"))
    now = F.lit(now_ms).cast("bigint")
    return direct.union(untitled).union(found).select("id", "cover_url", F.when(F.col("cover_url").isNotNull(), source).alias("cover_source"), now.alias("cover_resolved_at"), now.alias("updated_at"))
