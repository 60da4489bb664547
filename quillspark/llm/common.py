"""Tables, shared scratch storage and Arrow plumbing used by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch, at most. Texts may be long, so a batch of the default 10,000 rows could be large.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keeps this session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes (or one row), so that whole texts fit a Python worker.

    The limits have to hold when the result is read, so they stay in the session; smaller ones of the caller's are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared folder; the folder goes when the driver's JVM ends.

    The folder is the one that spark.checkpoint.dir names. Where that is unset a local session (a test) makes one; on a
    cluster there is none that all machines see, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex[:12]}-{tag}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df: DataFrame, tag: str, paths: list[str] | None = None) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends here, and a lost executor costs nothing.

    The table's path is added to `paths`, for discard().
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes scratch tables that nothing will read again, and has the driver notice that their plans are gone.

    Executors keep the broadcasts and shuffles of finished plans until the driver's JVM collects its references to them,
    which by itself it does every half hour at the latest; an operator of many small plans would fill them meanwhile.
    """
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def decoded(raw: bytes) -> str:
    """Every operator reads text this way: what isn't UTF-8 becomes U+FFFD."""
    return raw.decode("utf-8", "replace")


def binary_rows(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def filter_rows(df: DataFrame, text: str, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """Rows of `df`, all columns as they are, whose text `keep` accepts; nothing is shuffled.

    The text goes in front by position, so that names of other columns do not matter.
    """
    at, schema = df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, schema)
