"""Raw season files: scan, header survey, sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import schema as S


LABEL = r"/([^/]+)\.csv(/[^/]*)?$"


def season_label() -> Column:
    """``<season>`` of ``<season>.csv``, which may be a file or a folder of parts."""
    return F.regexp_extract(F.col("_metadata.file_path"), LABEL, 1)


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(season, column) from the first line of every season file. Files are listed without their content, and of each
    season's first file one line is read, whatever its size. A byte order mark is skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).where("length > 0")
    listed = files.select(F.regexp_extract("path", LABEL, 1).alias("season"), "path").groupBy("season").agg(F.min("path").alias("path"))
    first = spark.createDataFrame(
        [(row["season"], spark.read.text(row["path"]).first()["value"]) for row in listed.orderBy("season").collect()],  # one row per season
        "season string, header string")
    return first.select("season", F.posexplode(F.split("header", ",")).alias("place", "column")).withColumn(
        "column", F.trim(F.regexp_replace("column", '^\ufeff?"?|"$', "")))


def scan_seasons(spark: SparkSession, folder: str, seasons: list[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Read all season files and keep the approved columns.

    Files may differ in their extra columns, so files with the same header are
    read together and the reads are united by name. Returns the rows with a
    ``Season`` column and the number of dropped columns per season.
    """
    first = headers(spark, folder).groupBy("season").agg(
        F.sort_array(F.collect_list(F.struct("place", "column"))).alias("columns"))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for row in first.collect():  # one row per season file
        by_header.setdefault(tuple(c["column"] for c in row["columns"]), []).append(row["season"])
    present = {s for group in by_header.values() for s in group}
    absent = sorted(set(seasons or []) - present)
    if absent:
        raise FileNotFoundError(f"missing raw files for seasons {absent} in {folder}")
    parts, dropped = [], {}
    for columns, group in sorted(by_header.items()):
        group = sorted(s for s in group if seasons is None or s in seasons)
        if not group:
            continue
        missing = [c for c in S.RAW_COLUMNS if c not in columns]
        if missing:
            raise ValueError(f"seasons {group} lack required columns: {missing}")
        schema = ", ".join(f"`{c}` string" for c in columns)
        raw = spark.read.schema(schema).option("header", True).csv([f"{folder}/{s}.csv" for s in group])
        parts.append(raw.select(season_label().alias("Season"), *S.RAW_COLUMNS))
        dropped |= {s: len(columns) - len(S.RAW_COLUMNS) for s in group}
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, dropped


def write_matches(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by league and season; AQE sizes and splits the partitions."""
    df.hint("rebalance", "league", "season").write.partitionBy("league", "season").mode(mode).parquet(path)
