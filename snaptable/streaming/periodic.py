"""Snapshots whenever a table's directory has got new files, and garbage collection after each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.repository import Repository
from ..sources.database import Database


def periodic(repository: Repository, db: Database, collection: str, checkpoint: str, keep_last: int | None = None, now: datetime | None = None, name: str = "auto") -> StreamingQuery:
    """Snapshot the database for each batch of new files of one of its tables, as long as there are any. Only files
    that are new since the last snapshot are read; the rest of the refs are that one's.

    The batch number is the snapshot's id, so a batch that runs again after a crash takes no second one.
    """
    spark = repository.spark

    def take(_, batch: int) -> None:
        snapshot_id = f"{name}-{batch:08d}"
        if repository.store.snapshots().filter(F.col("snapshot_id") == snapshot_id).isEmpty():
            repository.create(db, f"batch {batch}", snapshot_id=snapshot_id, now=now)
        if keep_last is not None:
            repository.gc(keep_last)

    stream = spark.readStream.schema(db.read(collection).schema).parquet(db.location(collection))
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(take).start()
