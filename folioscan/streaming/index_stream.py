"""Incremental indexing: arriving chunks become segments of a searchable index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators import segments
from folioscan.operators.index import check_chunks


def index_stream(
    chunks: DataFrame, root: str, checkpoint: str, once: bool = True, name: str = "chunks", deleted: str | None = None, fanout: int = segments.FANOUT
) -> StreamingQuery:
    """Commits each micro-batch under root.  A batch that runs again after a failure
    is known by its number and the stream's name.  Rows whose column `deleted` is
    true delete their chunk_id.  Segments of alike size are merged as they add up."""
    check_chunks(chunks)

    def write(batch: DataFrame, number: int) -> None:
        spark, gone = batch.sparkSession, None
        if deleted:
            gone = batch.filter(batch[deleted]).select("chunk_id")
            batch = batch.filter(~batch[deleted] | batch[deleted].isNull()).drop(deleted)
        segments.commit(spark, root, batch, gone, name, number)
        segments.merge(spark, root, fanout=fanout)

    writer = chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
