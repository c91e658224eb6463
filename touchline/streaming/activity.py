"""Windowed activity counts over an event stream, and the events that come too late for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATENESS = "1 hour"


def _counted(events: DataFrame, window: Column, at: str, keys: list[str], value: str, lateness: str) -> DataFrame:
    got = events.withWatermark(at, lateness).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), *keys, "n", "total")


def windowed(events: DataFrame, at: str, keys: list[str], value: str, width: str, slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Counts and sums in windows side by side, or overlapping ones with a ``slide``."""
    return _counted(events, F.window(at, width, slide) if slide else F.window(at, width), at, keys, value, lateness)


def sessions(events: DataFrame, at: str, keys: list[str], value: str, gap: str, lateness: str = LATENESS) -> DataFrame:
    """Counts and sums in runs of events of a key that are less than ``gap`` apart."""
    return _counted(events, F.session_window(at, gap), at, keys, value, lateness)


def split_late(events: DataFrame, at: str, path: str, checkpoint: str, lateness: str = LATENESS) -> None:
    """Write the events as on_time and late tables under ``path``: late ones are behind the greatest time of all earlier
    batches by more than ``lateness``, which is what the windows drop. A repeated batch replaces itself."""
    spark = events.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        seen = f"{path}/seen"
        schema = "batch int, top timestamp"
        if batch_id:
            before = spark.read.schema(schema).parquet(seen).where(F.col("batch") < batch_id).agg(F.max("top")).first()[0]
        else:
            before = None
        behind = F.lit(False) if before is None else F.coalesce(F.col(at) < F.lit(before) - F.expr(f"INTERVAL {lateness}"), F.lit(False))
        marked = batch.withColumn("_late", behind)
        marked.where("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{path}/on_time/batch={batch_id}")
        marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.agg(F.max(at).cast("timestamp").alias("top")).write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")

    events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
