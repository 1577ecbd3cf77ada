"""Incremental ingestion as a stream of landed files: each batch is upserted exactly once.

The version that a batch publishes names it, so that a batch that runs again after a failure is known and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.schemas import AWARDS_LANDING, ENTITIES, SNAPSHOTS
from ..plans.store import Store

LANDED = {"awards": AWARDS_LANDING, "entities": ENTITIES, "entity_snapshots": SNAPSHOTS}


def ingest(spark: SparkSession, table: str, landing: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Load the files of ``landing`` that haven't been loaded yet into a table of the store, then stop."""
    stream = spark.readStream.schema(LANDED[table]).parquet(landing)

    def load(batch: DataFrame, batch_id: int) -> None:
        store.load(table, batch, source=checkpoint, batch=batch_id)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
