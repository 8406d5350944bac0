"""Change streams into collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quiverline.sources.collection import Collection


def upserts(stream: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Append a stream of ``id``, ``vector`` and ``payload`` to the log; a batch that comes again is known by its number."""

    def batch(rows: DataFrame, number: int) -> None:
        collection.insert_batch(rows, name=f"stream-{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
