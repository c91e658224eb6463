"""The ``contests`` table derived from the order tables.

Every order served by two or more suppliers becomes one contest between the
lowest and the highest supplier key; quantities give the counts. A supplier
sits out one year in seven, so spells, gaps and returns all occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import written

_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")

    # Pre-aggregate the large side before it meets the order header.
    per_side = lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    headers = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("match_id"),
        (F.col("c_nationkey") % 5).alias("league"),
        F.to_date("o_orderdate").alias("match_date"),
        F.year("o_orderdate").alias("season"),
    )
    sides = (
        per_side.join(headers, F.col("l_orderkey") == F.col("match_id"))
        .where((F.col("l_suppkey") + F.col("season")) % 7 != 0)
        .select("match_id", "league", "season", "match_date",
                F.col("l_suppkey").alias("team"), F.col("q").cast("int").alias("q"))
    )
    pairs = (
        sides.groupBy("match_id", "league", "season", "match_date")
        .agg(
            F.min(F.struct("team", "q")).alias("lo"),
            F.max(F.struct("team", "q")).alias("hi"),
            F.count("*").alias("n_sides"),
        )
        .where("n_sides >= 2")
    )
    even = F.col("match_id") % 2 == 0
    home, away = F.when(even, F.col("lo")).otherwise(F.col("hi")), F.when(even, F.col("hi")).otherwise(F.col("lo"))
    qh, qa = F.col("h.q"), F.col("a.q")
    return (
        pairs.withColumns({"h": home, "a": away})
        .select(
            "match_id", "league", "season", "match_date",
            F.col("h.team").alias("home"), F.col("a.team").alias("away"),
            F.least(qh % 5, qh % 7).alias("fthg"), F.least(qa % 5, qa % 7).alias("ftag"),
            (qh % 13 + 8).alias("hs"), (qa % 13 + 8).alias("as_"),
            (qh % 7).alias("hst"), (qa % 7).alias("ast"),
        )
        .withColumn("ftr", F.when(F.col("fthg") > F.col("ftag"), "H").when(F.col("fthg") < F.col("ftag"), "A").otherwise("D"))
    )


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contests table, written once per application to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        _WRITTEN[key] = written(derive_contests(spark, sf_dir), "contests")
    return _WRITTEN[key]
