"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("touchline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, whose
    executors live on this machine, may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = os.path.join(tempfile.gettempdir(), f"touchline-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROW_BOUND = 200_000
BROADCAST_BYTE_BOUND = 64_000_000


def broadcast_bounded(df: DataFrame, bound: int = BROADCAST_ROW_BOUND, byte_bound: int = BROADCAST_BYTE_BOUND) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes (as JSON): beyond either bound the
    side is returned as it is and the join shuffles (AQE splits skewed partitions)."""
    seen = df.limit(bound + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    if seen["n"] <= bound and seen["b"] <= byte_bound:
        return F.broadcast(df)
    return df


def refuse_if_any(problems: DataFrame, label: str, what: str) -> None:
    """Fail if there is any row. The whole report is written to the shared folder; the error names its path, its size and a first row."""
    first = problems.first()
    if first is not None:
        path = fresh_path(problems.sparkSession, label)
        problems.write.parquet(path)
        raise ValueError(f"{what}: {problems.sparkSession.read.parquet(path).count()} rows in {path}, such as {first.asDict()}")


def spread(df: DataFrame) -> DataFrame:
    """For CPU-heavy work on few bytes: use all cores if the scan has fewer
    partitions than the cluster has. A large scan stays as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the configured number of shuffle partitions.
    A stated number keeps AQE from merging small but expensive partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread_by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Hash-partition a written table by ``keys`` into about ``rows`` rows a partition, and at least one for each core.
    The stated number grows with the table, and AQE does not merge partitions whose rows get wide later."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)
