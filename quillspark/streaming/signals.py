"""Throttled usage signals: an exposure counts if the last counted one is at least an hour old."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.reads import live
from quillspark.schema import TABLES, conform

HOUR_MS = 3_600_000


def throttled(events: DataFrame, key: str, gap_ms: int = HOUR_MS) -> DataFrame:
    """The counted rows of (key, at). Rows stream through in order, so a hot key takes bounded memory."""
    ordered = events.select(key, "at").repartition(key).sortWithinPartitions(key, "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = (), 0
        for batch in batches:
            keep = []
            for k, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now != (k,):
                    now, last = (k,), 0
                counted = at is not None and (last <= 0 or at - last >= gap_ms)
                last = at if counted else last
                keep.append(counted)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)


def recorder(events: DataFrame, gap_ms: int = HOUR_MS, notes: DataFrame | None = None) -> DataFrame:
    """A stream of (note_id, kind, at) to the stream of each note's signals: note_id, return_visits, exposure_recency_at, engagement_recency_at.

    Exposure is throttled by the stored stamp; a return visit also counts as an exposure; only changes come out. With
    `notes` (a table, read anew in each batch) only notes that are there and live earn signals.
    """
    if notes is not None:
        events = events.join(live(notes).select(F.col("id").alias("note_id")), "note_id", "left_semi")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        visits, exposed, engaged = state.get if state.exists else (0, 0, 0)
        before = (visits, exposed, engaged)
        for batch in batches:
            for kind, at in sorted(zip(batch["kind"], batch["at"], strict=True), key=lambda x: x[1]):
                if kind == "exposure" and (exposed <= 0 or at - exposed >= gap_ms):
                    exposed = at
                elif kind == "engagement":
                    engaged = at
                elif kind == "return_visit":
                    visits, exposed = visits + 1, at
        if (visits, exposed, engaged) != before or not state.exists:
            state.update((int(visits), int(exposed), int(engaged)))
            yield pd.DataFrame({"note_id": [key[0]], "return_visits": [visits], "exposure_recency_at": [exposed], "engagement_recency_at": [engaged]})

    shape = "return_visits bigint, exposure_recency_at bigint, engagement_recency_at bigint"
    return events.groupBy("note_id").applyInPandasWithState(run, f"note_id string, {shape}", shape, "update", GroupStateTimeout.NoTimeout)


def recorded(signals: DataFrame, notes: DataFrame, events: DataFrame, now_ms: int, gap_ms: int = HOUR_MS) -> DataFrame:
    """Whole signal rows that a batch of (note_id, kind, at) changes.

    A note's events count in order, from its stored row on: an exposure if the last one is gap_ms old, a return visit
    always, also as an exposure, and an engagement always. Only live notes earn signals. A row that is absent or deleted
    is born or returns, with its note's prior if it has none; a live one comes only if something changed, be it that its
    stored importance is not what follows from it.
    """
    from quillspark.operators.margins import born_or_stored, scored

    earning = live(notes).join(events.select(F.col("note_id").alias("id")).distinct(), "id", "left_semi").select("id", "source")
    before = born_or_stored(signals, earning, now_ms)
    rows = events.join(before.select("note_id", "return_visits", "exposure_recency_at", "engagement_recency_at"), "note_id")
    ordered = rows.select("note_id", "kind", "at", "return_visits", "exposure_recency_at", "engagement_recency_at").repartition("note_id").sortWithinPartitions("note_id", "at", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, (0, 0, 0), []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate([pa.string(), *[pa.int64()] * 3])], ["note_id", "visits", "exposed", "engaged"])
            done.clear()
            return out

        for batch in batches:
            for note, kind, at, *stored in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if note != now:
                    if now is not None:
                        done.append((now, *state))
                    now, state = note, tuple(stored)
                visits, exposed, engaged = state
                if kind == "exposure" and (exposed <= 0 or at - exposed >= gap_ms):
                    exposed = at
                elif kind == "engagement":
                    engaged = at
                elif kind == "return_visit":
                    visits, exposed = visits + 1, at
                state = visits, exposed, engaged
            yield flush()
        if now is not None:
            done.append((now, *state))
            yield flush()

    after = ordered.mapInArrow(run, "note_id string, visits bigint, exposed bigint, engaged bigint")
    both = before.withColumnRenamed("importance", "__old").join(after, "note_id")
    same = (F.col("return_visits") == F.col("visits")) & (F.col("exposure_recency_at") == F.col("exposed")) & (F.col("engagement_recency_at") == F.col("engaged"))
    new = scored(both.withColumn("__same", same).withColumns({"return_visits": F.col("visits"), "exposure_recency_at": F.col("exposed"), "engagement_recency_at": F.col("engaged")}))
    agree = F.col("__same") & F.coalesce(F.abs(F.col("__old") - F.col("importance")) <= 1e-9, F.lit(False))
    moved = new.where(~F.col("was_live") | ~agree)
    return conform(moved.withColumn("updated_at", F.lit(now_ms).cast("bigint")).withColumn("deleted", F.lit(False)), TABLES["note_signals"])
