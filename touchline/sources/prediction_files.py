"""Prediction and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTION_SCHEMA = (
    "match_id long, league int, season int, match_date date, home long, away long, fold int, y int, ftr string, "
    "config_id string, p_home double, p_draw double, p_away double"
)


def write_predictions(predictions: DataFrame, path: str) -> None:
    columns = [f.split()[0] for f in PREDICTION_SCHEMA.split(", ")]
    predictions.select(*columns).write.option("header", True).csv(path)


def read_config(spark: SparkSession, path: str, config_id: str, expected_rows: int, key: list[str]) -> DataFrame:
    """One configuration of a prediction file. The wrong row count, a missing
    configuration or a repeated key is an error, never silently repaired."""
    rows = spark.read.schema(PREDICTION_SCHEMA).option("header", True).csv(path).where(F.col("config_id") == config_id)
    per_key = rows.groupBy(*key).count()
    seen = per_key.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count_if(F.col("count") > 1).alias("repeated")).first()
    if seen["n"] == 0:
        raise ValueError(f"configuration {config_id!r} not present in {path}")
    if seen["n"] != expected_rows or seen["repeated"]:
        raise ValueError(f"{config_id!r}: {seen['n']} rows (expected {expected_rows}), {seen['repeated']} repeated keys")
    return rows


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Small metric tables as JSON lines."""
    metrics.write.json(path)
