"""Files that arrive over time (an extension): each micro-batch of new files is ingested as pending documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import ReviewStore
from ..schema import MAX_UPLOAD_BYTES
from ..sources.files import accepted, pending_documents


def watch(spark: SparkSession, store: ReviewStore, folder: str, checkpoint: str, now: str, limit: int = MAX_UPLOAD_BYTES):
    """Start a stream over ``folder``; the caller waits for it or stops it. Files are accepted as uploads are."""
    schema = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = pending_documents(accepted(batch, limit), now)
        store.append_states(rows.withColumns({"seq": F.lit(0).cast("long"), "deleted": F.lit(False)}))

    return files.drop("content").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
