"""Rolling-origin folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import schema as S

Fold = tuple[int, object, object]  # number, last training season, validation season


def assign_folds(rows: DataFrame, folds: list[Fold] = S.APPROVED_FOLDS) -> DataFrame:
    """Each row once per fold it belongs to, as ``fold`` and ``part``.

    The season range test is a per-row expression over the few fold constants,
    so no join is needed.
    """
    season = F.col("season")
    member = F.array_compact(F.array(*[
        F.when(season <= F.lit(cutoff), F.struct(F.lit(n).alias("fold"), F.lit("train").alias("part")))
        .when(season == F.lit(validation), F.struct(F.lit(n).alias("fold"), F.lit("validation").alias("part")))
        for n, cutoff, validation in folds
    ]))
    return rows.withColumn("_m", F.explode(member)).select(*rows.columns, "_m.fold", "_m.part")


def fold_violations(rows: DataFrame, folds: list[Fold], sealed_from=None, row_cap=None) -> DataFrame:
    """Why a table must not be used for these folds; empty means admissible.

    Checks: both parts present, training strictly earlier by date, no sealed
    rows, no rows past the cap. One aggregation over the assigned rows.
    """
    spark = rows.sparkSession
    span = assign_folds(rows, folds).groupBy("fold").agg(
        F.max(F.when(F.col("part") == "train", F.col("match_date"))).alias("train_end"),
        F.min(F.when(F.col("part") == "validation", F.col("match_date"))).alias("validation_start"),
    )
    wanted = spark.createDataFrame([(n,) for n, _, _ in folds], "fold int")
    per_fold = wanted.join(span, "fold", "left").select("fold", F.explode(F.array_compact(F.array(
        F.when(F.col("train_end").isNull(), F.lit("no training rows")),
        F.when(F.col("validation_start").isNull(), F.lit("no validation rows")),
        F.when(F.col("train_end") >= F.col("validation_start"), F.lit("training not strictly earlier")),
    ))).alias("problem"))
    limits = []
    if sealed_from is not None:
        limits.append(F.when(F.col("season") >= F.lit(sealed_from), F.lit("sealed season present")))
    if row_cap is not None:
        limits.append(F.when(F.col("season") > F.lit(row_cap), F.lit("season past the row cap")))
    if limits:
        over = rows.select(F.explode(F.array_compact(F.array(*limits))).alias("problem")).distinct()
        per_fold = per_fold.unionByName(over.select(F.lit(None).cast("int").alias("fold"), "problem"))
    return per_fold


def pairing_violations(schedule: DataFrame, folds: list[Fold]) -> DataFrame:
    """Validation seasons whose parameters do not come from exactly the seasons
    up to the fold's cutoff, or come from no estimate at all."""
    cutoff_of = F.create_map(*[x for _, cutoff, validation in folds for x in (F.lit(validation), F.lit(cutoff))])
    last = F.array_max("estimated_from")
    wanted = cutoff_of[F.col("season")]
    return schedule.where(wanted.isNotNull()).select(
        "league", "season",
        F.when(last.isNull(), "parameters are not estimated")
        .when(last >= F.col("season"), "parameters not strictly earlier")
        .when(last != wanted, "cutoff is not the approved one").alias("problem"),
    ).where("problem is not null")
