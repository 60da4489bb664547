"""A versioned store of tables in Parquet: every commit writes new directories and then moves one pointer.

Tables of the archive lie in PARTS directories by key hash; a commit of changes rewrites only the parts that they touch.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.changes import oldest_first
from quillspark.schema import OUTBOX, TABLES, conform

#: Parts of a table by key hash.
PARTS = 64


class Store:
    """Tables under a path of any Hadoop file system. A commit covers several tables and becomes visible at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    @contextmanager
    def scratch(self, rows: DataFrame, tag: str):
        """The rows, written once to the store's own file system, which all machines see, and deleted at the end."""
        at = f"scratch/{tag}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{at}")
        try:
            yield self.spark.read.schema(rows.schema).parquet(f"{self.path}/{at}")
        finally:
            self._fs.delete(self._at(at), True)

    def _pointers(self) -> list[str]:
        if not self._fs.exists(self._at("pointers")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at("pointers"))]
        return sorted((n for n in names if n.endswith(".json") and not n.startswith((".", "_"))), reverse=True)

    def _state(self, pointer: str) -> dict:
        stream = self._fs.open(self._at(f"pointers/{pointer}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self) -> dict:
        """{"batch": last committed batch, "tables": {name: directory or {part: directory}}, "meta": {...}} of the newest pointer."""
        done = self._pointers()
        return self._state(done[0]) if done else {"batch": -1, "tables": {}, "meta": {}}

    def table(self, name: str) -> DataFrame:
        """The table as the newest pointer has it: a synced one, the outbox or any other that was committed."""
        return self._read(name, self.state()["tables"].get(name))

    def _read(self, name: str, at) -> DataFrame:
        struct = TABLES[name].struct if name in TABLES else OUTBOX if name == "outbox" else T.StructType.fromDDL("key string, value string")
        paths = [at] if isinstance(at, str) else list((at or {}).values())
        if not paths:
            return self.spark.createDataFrame([], struct)
        read = self.spark.read.schema(struct) if name in TABLES or name == "outbox" else self.spark.read
        return read.parquet(*(f"{self.path}/{x}" for x in paths))

    def exists(self, name: str) -> bool:
        return name in self.state()["tables"]

    def columns(self, name: str) -> dict[str, str]:
        """The columns of a table's files as they are, and their types; older ones may lack columns that table() adds as nulls."""
        at = self.state()["tables"].get(name)
        paths = [at] if isinstance(at, str) else list((at or {}).values())
        return dict(self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{x}" for x in paths)).dtypes) if paths else {}

    def outbox(self) -> DataFrame:
        """The queued edits, oldest first."""
        return oldest_first(self.table("outbox"))

    def get(self, key: str, default=None):
        """A value of the store's own settings: cursors, redirects and the like."""
        return self.state()["meta"].get(key, default)

    def set(self, **values) -> None:
        """Sets settings; None deletes one."""
        self.commit(self.state()["batch"] + 1, {}, values)

    def commit(self, batch: int, tables: dict[str, DataFrame], meta: dict | None = None) -> bool:
        """Writes whole tables and moves the pointer; False if the batch, or a later one, is there already."""
        state = self.state()
        if batch <= state["batch"]:
            return False
        unique = f"v={batch}-{uuid.uuid4().hex[:8]}"  # so that two writers of one batch never share a directory
        written = {}
        for name, rows in tables.items():
            if name in TABLES:
                part = part_of(TABLES[name].key)
                conform(rows, TABLES[name]).withColumn("__part", part).repartition(PARTS, "__part").write.partitionBy("__part").parquet(f"{self.path}/{name}/{unique}")
                written[name] = self._parts(f"{name}/{unique}")
            else:
                rows.write.parquet(f"{self.path}/{name}/{unique}")
                written[name] = f"{name}/{unique}"
        return self._point(batch, state, written, meta)

    def apply(self, batch: int, changes: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None, meta: dict | None = None) -> bool:
        """Like commit, from changed rows: each takes the place of the row of its key, and parts without one are not rewritten.

        `replaced` are whole tables besides, such as the outbox.
        """
        state = self.state()
        if batch <= state["batch"]:
            return False
        unique = f"v={batch}-{uuid.uuid4().hex[:8]}"
        written = {}
        for name, rows in changes.items():
            table = TABLES[name]
            rows = conform(rows, table).withColumn("__part", part_of(table.key))
            rows.write.parquet(f"{self.path}/{name}/{unique}-changes")  # read twice below, and their lineage ends here
            rows = self.spark.read.parquet(f"{self.path}/{name}/{unique}-changes")
            touched = [r["__part"] for r in rows.select("__part").distinct().collect()]  # at most PARTS
            have = state["tables"].get(name) or {}
            old = self._read(name, {p: d for p, d in have.items() if int(p) in touched}).withColumn("__part", part_of(table.key))
            new = old.join(rows.select(table.key), table.key, "left_anti").unionByName(rows)
            new.repartition(PARTS, "__part").write.partitionBy("__part").parquet(f"{self.path}/{name}/{unique}")
            written[name] = {**have, **self._parts(f"{name}/{unique}")}
        for name, rows in (replaced or {}).items():
            rows.write.parquet(f"{self.path}/{name}/{unique}")
            written[name] = f"{name}/{unique}"
        done = self._point(batch, state, written, meta)
        for name in changes:
            self._fs.delete(self._at(f"{name}/{unique}-changes"), True)
        return done

    def vacuum(self, keep: int = 2) -> None:
        """Deletes directories and pointers that none of the newest `keep` pointers names; for a time without readers of older ones."""
        names = self._pointers()
        used = {x for n in names[:keep] for at in self._state(n)["tables"].values() for x in ([at] if isinstance(at, str) else at.values())}
        used = {"/".join(x.split("/")[:2]) for x in used}
        for status in self._fs.listStatus(self._at("")):
            name = status.getPath().getName()
            if status.isDirectory() and name not in ("pointers", "scratch"):
                for version in self._fs.listStatus(status.getPath()):
                    if f"{name}/{version.getPath().getName()}" not in used:
                        self._fs.delete(version.getPath(), True)
        for n in names[keep:]:
            self._fs.delete(self._at(f"pointers/{n}"), False)

    def _parts(self, at: str) -> dict[str, str]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(at))]
        return {n.split("=")[1]: f"{at}/{n}" for n in names if n.startswith("__part=")}

    def _point(self, batch: int, state: dict, written: dict, meta: dict | None) -> bool:
        kept = {k: v for k, v in (state["meta"] | (meta or {})).items() if v is not None}
        state = {"batch": batch, "tables": state["tables"] | written, "meta": kept}
        temporary, final = self._at(f"pointers/.{batch:012d}.{uuid.uuid4().hex[:8]}"), self._at(f"pointers/{batch:012d}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                return False  # another writer was first
            raise OSError(f"the pointer of batch {batch} could not be moved")
        return True


def part_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def change_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Change files (Parquet) as a stream; the checkpoint keeps the place, as a cursor would."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
