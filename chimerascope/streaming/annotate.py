"""Annotation of a stream of events: each micro-batch is one set-based run against the static models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chimerascope import schemas
from chimerascope.operators.sides import TRANSCRIPT_ID
from chimerascope.plans.annotate import annotate
from chimerascope.plans.staging import drop_since, mark


def annotate_stream(events: DataFrame, models: DataFrame, out: str, checkpoint: str, *, id_pattern: str = TRANSCRIPT_ID, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that writes the results of each micro-batch to out/batch=N; a batch that is run again overwrites its own folder, so results come once. What a batch stages is deleted behind it."""

    def one_batch(batch: DataFrame, number: int) -> None:
        start = mark()
        annotate(batch.select(*schemas.EVENT), models, id_pattern=id_pattern).write.mode("overwrite").parquet(f"{out}/batch={number}")
        drop_since(start)

    return events.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
