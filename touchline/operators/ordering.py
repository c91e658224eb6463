"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.session import written


def with_position(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """1-based position in a total order. Rows are range-partitioned and sorted
    in parallel; each partition then only needs the sizes of those before it."""
    local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(
        {"_part": F.spark_partition_id(), "_local": local})
    stored = written(sorted_, "ordered")
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_size"))
    # one row per partition
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return stored.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_before") + F.col("_local") + 1).drop("_part", "_local", "_before")
