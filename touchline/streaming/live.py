"""Live jobs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import live
from touchline.session import written
from touchline.sources.provider_json import LIVE_SCHEMA

# The late-data policy of every job here: declared, not inherited.
LATENESS = "30 days"


def live_stream(spark: SparkSession, path: str, files_per_batch: int = 2) -> DataFrame:
    """Live entries arriving as JSON files."""
    return spark.readStream.schema(LIVE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def ingest_snapshots(entries: DataFrame, aliases: DataFrame, season: str, table_path: str, checkpoint: str):
    """Parse each micro-batch with the batch operators and store it under its own
    batch folder, so a repeated batch replaces itself. The club table is worked out once, not in every batch."""
    aliases = written(aliases, "live-aliases")

    def store(batch: DataFrame, batch_id: int) -> None:
        parsed = live.parse_snapshots(batch, aliases, season)
        parsed.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return entries.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated_events(events: DataFrame, at: str, key: list[str], lateness: str = LATENESS) -> DataFrame:
    """Each event once, though every snapshot repeats the earlier ones."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)


def in_play_stream(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(live.in_play(F.col("status")))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_IN_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which stateful processors need and Spark does not set by itself.
    A provider of the caller's own stays. A started stream holds its own copy of the settings, so the session gets its own back."""
    before = spark.conf.get(_PROVIDER, _IN_MEMORY)
    if before != _IN_MEMORY:
        yield
        return
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there, into a parquet table."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        def store(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        query = stream.writeStream.foreachBatch(store).outputMode(mode)
    with rocksdb_state(stream.sparkSession):
        running = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
