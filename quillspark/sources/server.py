"""What the archive asks of the outside: a server that keeps the shared copy, and a search for book covers.

Both are protocols over DataFrames. StoreServer keeps the shared copy in a store of its own.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.changes import sparse
from quillspark.operators.staging import patched
from quillspark.schema import TABLES
from quillspark.sources.store import Store


class Server(Protocol):
    """Edits come as (key, fields: map<string,string>); what is returned of them are the keys (`id`) that the server refused."""

    def fetch_page(self, table: str, after: int, limit: int) -> DataFrame:
        """Up to `limit` rows with a change_seq above `after`, ascending, tombstones included."""

    def fetch_by_ids(self, table: str, ids: DataFrame) -> DataFrame:
        """The rows of some keys, tombstones included."""

    def setting(self, key: str) -> str | None:
        """A setting of the application, or None."""

    def upsert(self, table: str, edits: DataFrame, user: str) -> DataFrame:
        """Inserts rows or changes the named columns of those that are there, under the user's name."""

    def patch(self, table: str, edits: DataFrame) -> DataFrame:
        """Changes the named columns of rows that are there; an absent one is refused."""


class Covers(Protocol):
    """A search for a book's cover."""

    def search(self, books: DataFrame) -> DataFrame:
        """id, outcome (hit, miss or outage), cover_id, isbn for each row of `books` (id, title, author)."""


class FrameCovers:
    """Covers from a table: title, author, cover_id, isbn. A title that is not there is a miss, one with `down` an outage."""

    def __init__(self, known: DataFrame):
        self.known = known

    def search(self, books: DataFrame) -> DataFrame:
        known = self.known.select(F.col("title").alias("__title"), "cover_id", "isbn", "down").dropDuplicates(["__title"])
        found = books.select("id", F.trim("title").alias("__title")).join(known, "__title", "left")
        outcome = F.when(F.coalesce("down", F.lit(False)), "outage").when(F.col("cover_id").isNotNull() | F.col("isbn").isNotNull(), "hit").otherwise("miss")
        return found.select("id", outcome.alias("outcome"), "cover_id", "isbn")


def page_after(rows: DataFrame, after: int, limit: int) -> DataFrame:
    """A keyset page: the next `limit` rows above a change_seq, ascending; each page reads on from the last one's greatest."""
    return rows.where(F.col("change_seq") > after).orderBy("change_seq").limit(limit)


class StoreServer:
    """The shared copy in a store: each table's columns, user_id, and change_seq, which every change sets anew.

    An insert without a required column, or with a parent that is not there, is refused; one that says nothing of deletion
    is live. An edit older than the row it
    meets is taken and changes nothing.
    """

    def __init__(self, store: Store, settings: dict[str, str] | None = None):
        self.store, self.settings = store, settings or {}

    def rows(self, table: str) -> DataFrame:
        if f"server_{table}" in self.store.state()["tables"]:
            return self.store.table(f"server_{table}")
        empty = self.store.spark.createDataFrame([], TABLES[table].struct)
        return empty.withColumn("user_id", F.lit(None).cast("string")).withColumn("change_seq", F.lit(None).cast("bigint"))

    def fetch_page(self, table: str, after: int, limit: int) -> DataFrame:
        return page_after(self.rows(table), after, limit)

    def fetch_by_ids(self, table: str, ids: DataFrame) -> DataFrame:
        key = TABLES[table].key
        return self.rows(table).join(ids.select(key), key, "left_semi")

    def setting(self, key: str) -> str | None:
        return self.settings.get(key)

    def upsert(self, table: str, edits: DataFrame, user: str) -> DataFrame:
        t = TABLES[table]
        there = self.rows(table).select(t.key, F.lit(True).alias("__there"))
        asked = edits.join(there, t.key, "left")
        refused = F.col("__there").isNull() & sparse(F.col("fields"), [*t.required])
        for i, (column, parent) in enumerate(t.parents):
            known = self.rows(parent).select(F.col(TABLES[parent].key).alias(f"__p{i}"))
            asked = asked.join(known, F.col("fields")[column] == F.col(f"__p{i}"), "left")
            refused = refused | (F.col("fields")[column].isNotNull() & F.col(f"__p{i}").isNull())
        return self._write(table, asked.withColumn("__refused", refused), user)

    def patch(self, table: str, edits: DataFrame) -> DataFrame:
        t = TABLES[table]
        there = self.rows(table).select(t.key, F.lit(True).alias("__there"))
        return self._write(table, edits.join(there, t.key, "left").withColumn("__refused", F.col("__there").isNull()), None)

    def _write(self, table: str, judged: DataFrame, user: str | None) -> DataFrame:
        t, spark = TABLES[table], self.store.spark
        refused = spark.createDataFrame(judged.where("__refused").select(t.key).collect(), "id string")  # as many as one flush was refused
        good = judged.where("NOT __refused").select(t.key, "fields")
        have = self.rows(table)
        old = have.select(t.key, "user_id", F.col("updated_at").alias("__was"))
        new = patched(have.select(*t.columns), good, t).withColumn("deleted", F.coalesce("deleted", F.lit(False))).join(old, t.key, "left")
        new = new.where("__was IS NULL OR coalesce(updated_at, 0) >= __was").withColumn("user_id", F.coalesce("user_id", F.lit(user).cast("string"))).drop("__was")
        last = have.agg(F.coalesce(F.max("change_seq"), F.lit(0)).alias("__last"))
        new = new.crossJoin(F.broadcast(last)).withColumn("change_seq", F.col("__last") + 1 + F.monotonically_increasing_id()).drop("__last")  # one row
        after = have.join(new.select(t.key), t.key, "left_anti").unionByName(new.select(*have.columns))
        state = self.store.state()
        if not self.store.commit(state["batch"] + 1, {f"server_{table}": after}):
            raise RuntimeError("another writer committed meanwhile")
        return refused
