"""Provenance of written feature tables, and goal-model parameter files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import schema as S

SIDE_SUFFIX = ".provenance"


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free content hash, as one row."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def provenance_record(features: DataFrame, schedule: DataFrame, source: DataFrame, *, valid_for_evaluation: bool,
                      row_cap=None, purpose: str = "", sealed=S.SEALED_SEASON) -> DataFrame:
    """One row: what the table was built from, with which parameters, and whether
    it may be used for evaluation."""
    settings = {
        "ewma_halflife": S.EWMA_HALFLIFE, "min_periods": S.MIN_PERIODS, "efficiency_window": S.EFFICIENCY_WINDOW,
        "rest_days_cap": S.REST_DAYS_CAP, "history_depth_cap": S.HISTORY_DEPTH_CAP, "k_factor": S.K_FACTOR,
        "initial_rating": S.INITIAL_RATING, "min_prior_seasons": S.MIN_PRIOR_SEASONS,
    }
    # one row per (league, season): the schedule is carried as JSON
    entries = schedule.agg(F.to_json(F.sort_array(F.collect_list(F.struct(
        "league", "season_idx", F.col("season").cast("string").alias("season"), "status", "home_advantage", "season_shrink",
        "promoted_delta", "k_factor", "initial_rating", F.col("estimated_from").cast("array<string>").alias("estimated_from"))))).alias("schedule"))
    return (
        fingerprint(features).join(F.broadcast(entries))
        .join(F.broadcast(fingerprint(source).select(F.col("fingerprint").alias("source_fingerprint"))))
        .select(
            "n_rows", "fingerprint", "source_fingerprint", "schedule", F.lit(",".join(S.FEATURE_COLUMNS)).alias("feature_columns"),
            F.lit(len(S.FEATURE_COLUMNS)).alias("n_features"), F.lit(json.dumps(settings)).alias("settings"),
            F.lit(str(sealed)).alias("sealed_season"), F.lit(None if row_cap is None else str(row_cap)).cast("string").alias("row_cap"),
            F.lit(bool(valid_for_evaluation)).alias("valid_for_evaluation"), F.lit(purpose).alias("purpose")))


def read_provenance(spark: SparkSession, path: str) -> dict | None:
    try:
        row = spark.read.parquet(path + SIDE_SUFFIX).first()
    except Exception as e:  # noqa: BLE001 - the error class differs between file systems
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row.asDict()


def write_features(features: DataFrame, provenance: DataFrame, path: str, force: bool = False) -> None:
    """Write table and provenance. An existing table whose provenance differs is
    not overwritten unless forced."""
    spark = features.sparkSession
    old, new = read_provenance(spark, path), provenance.first().asDict()
    if old is not None and old != new and not force:
        changed = sorted(k for k in new if old.get(k) != new[k])
        raise ValueError(f"refusing to overwrite {path}: provenance differs in {changed}")
    spark.createDataFrame([new], provenance.schema).coalesce(1).write.mode("overwrite").parquet(path + SIDE_SUFFIX)
    features.hint("rebalance", "league", "season").write.partitionBy("league", "season").mode("overwrite").parquet(path)


def provenance_violations(spark: SparkSession, path: str, seasons: list) -> list[str]:
    """Why a stored table must not be used to evaluate these seasons."""
    old = read_provenance(spark, path)
    if old is None:
        return ["no provenance"]
    out = [] if old["valid_for_evaluation"] else ["not valid for evaluation"]
    if old["feature_columns"].split(",") != S.FEATURE_COLUMNS:
        out.append("built with another feature list")
    stored = spark.read.parquet(path)
    per_season = stored.groupBy("season").count().collect()  # one row per season
    if sum(r["count"] for r in per_season) != old["n_rows"]:
        out.append("row count differs from provenance")
    present = {str(r["season"]) for r in per_season}
    out += [f"season {s} absent" for s in seasons if str(s) not in present]
    if old["row_cap"] is not None:
        out += [f"season {s} past the row cap" for s in sorted(present) if s > old["row_cap"]]
    # Every league of the table must have its own parameters for each season.
    kind = "array<struct<league:string,season:string,status:string,estimated_from:array<string>>>"
    schedule = spark.read.parquet(path + SIDE_SUFFIX).select(F.explode(F.from_json("schedule", kind)).alias("e")).select("e.*")
    used = stored.where(F.col("season").cast("string").isin([str(s) for s in seasons])).select(
        F.col("league").cast("string").alias("league"), F.col("season").cast("string").alias("season")).distinct()
    problem = (F.when(F.coalesce(F.col("status") != "estimated", F.lit(True)), "has no estimated parameters")
               .when(F.coalesce(F.array_max("estimated_from") >= F.col("season"), F.lit(True)), "parameters are not strictly earlier"))
    bad = used.join(schedule, ["league", "season"], "left").select("season", "league", problem.alias("problem")).where("problem IS NOT NULL")
    rows = bad.distinct().orderBy("season", "league").collect()  # at most one row for each league and season asked about
    return out + [f"season {r['season']} of league {r['league']} {r['problem']}" for r in rows]


PARAMETER_SCHEMA = (
    "params struct<config_id:string,intercept:double,home_advantage:double,rho:double,attack:map<string,double>,"
    "defence:map<string,double>,promoted_attack_offset:double,promoted_defence_offset:double>, "
    "metadata struct<training_cutoff_season:string,training_seasons:array<string>,training_matches:bigint,sealed_final_test_scored:boolean>"
)


def write_goal_parameters(fits: DataFrame, offsets: DataFrame, path: str, training: DataFrame) -> None:
    """One JSON document per (league, fold, config). A document holds one number
    per club, so a group is bounded by the league's clubs. ``training``: the rows that were fitted, for cutoff, seasons and number."""
    seen = training.agg(F.sort_array(F.collect_set(F.col("season").cast("string"))).alias("seasons"), F.count("*").alias("n")).first()
    training_seasons = seen["seasons"]
    if not training_seasons:
        raise ValueError("no training rows")
    rows = fits.where("status = 'fitted'").join(offsets, ["league", "fold"])
    params = rows.groupBy("league", "fold", "config_id").agg(F.struct(
        F.first("config_id").alias("config_id"), F.first("intercept").alias("intercept"), F.first("home_advantage").alias("home_advantage"),
        F.first("rho").alias("rho"),
        F.map_from_entries(F.collect_list(F.struct(F.col("team").cast("string"), "attack"))).alias("attack"),
        F.map_from_entries(F.collect_list(F.struct(F.col("team").cast("string"), "defence"))).alias("defence"),
        F.first("promoted_attack").alias("promoted_attack_offset"), F.first("promoted_defence").alias("promoted_defence_offset")).alias("params"))
    meta = F.struct(F.lit(training_seasons[-1]).alias("training_cutoff_season"), F.array(*[F.lit(s) for s in training_seasons]).alias("training_seasons"),
                    F.lit(seen["n"]).alias("training_matches"),
                    F.lit(False).alias("sealed_final_test_scored"))
    params.select("league", "fold", "params", meta.alias("metadata")).write.json(path)


def read_goal_parameters(spark: SparkSession, path: str, sealed: str = S.SEALED_SEASON, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parameters as (fits, offsets) tables ready for scoring. Documents that
    list the sealed season or claim a scored final test are refused."""
    docs = spark.read.schema("league int, fold int, " + PARAMETER_SCHEMA).option("multiLine", multiline).json(path)
    docs = docs.withColumns({"league": F.coalesce("league", F.lit(0)), "fold": F.coalesce("fold", F.lit(0))})
    bad = docs.where(F.coalesce(
        F.array_contains("metadata.training_seasons", sealed) | F.col("metadata.sealed_final_test_scored") | F.col("metadata.training_cutoff_season").isNull()
        | (F.size("metadata.training_seasons") < 1) | F.col("params").isNull(), F.lit(True)))
    if bad.limit(1).count():
        raise ValueError(f"{path} holds unsound goal-model parameters")
    p = F.col("params")
    fits = docs.select("league", "fold", p["config_id"].alias("config_id"), p["intercept"].alias("intercept"), p["home_advantage"].alias("home_advantage"),
                       p["rho"].alias("rho"), p["defence"].alias("_d"), F.explode(p["attack"]).alias("team", "attack")).select(
        "league", "fold", "config_id", "team", "attack", F.try_element_at("_d", F.col("team")).alias("defence"), "intercept", "home_advantage", "rho",
        F.lit("fitted").alias("status"))
    offsets = docs.select("league", "fold", p["promoted_attack_offset"].alias("promoted_attack"), p["promoted_defence_offset"].alias("promoted_defence"))
    return fits, offsets


def checked_training(spark: SparkSession, path: str, cutoff: str, matches: int) -> DataFrame:
    """(league, fold, training_cutoff_season, training_matches) of written parameters; refused unless all were fitted on that many
    matches up to that season."""
    docs = spark.read.schema("league int, fold int, " + PARAMETER_SCHEMA).json(path).select("league", "fold", "metadata.*")
    sound = ((F.col("training_cutoff_season") == cutoff) & (F.col("training_matches") == matches) & (F.array_max("training_seasons") == cutoff))
    if docs.where(F.coalesce(~sound, F.lit(True))).limit(1).count():
        raise ValueError(f"{path} was not fitted on {matches} matches up to {cutoff}")
    return docs.select("league", "fold", "training_cutoff_season", "training_matches")
