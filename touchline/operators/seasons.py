"""Season order, team rows, rosters and newcomer definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def season_index(matches: DataFrame) -> DataFrame:
    """One row per (league, season), numbered from 0 by first match date."""
    spans = matches.groupBy("league", "season").agg(
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("last_date"),
        F.count("*").alias("n_matches"),
    )
    order = W.partitionBy("league").orderBy("first_date", "season")
    return spans.withColumn("season_idx", F.row_number().over(order) - 1)


def with_season_index(matches: DataFrame, index: DataFrame | None = None) -> DataFrame:
    index = season_index(matches) if index is None else index
    return matches.join(index.select("league", "season", "season_idx"), ["league", "season"])


def _points(result, win: str):
    return F.when(result == win, 3.0).when(result == "D", 1.0).otherwise(0.0)


def _score(result, win: str):
    return F.when(result == win, 1.0).when(result == "D", 0.5).otherwise(0.0)


def target(result):
    """H, D, A as 0, 1, 2; anything else is null."""
    return F.when(result == "H", 0).when(result == "D", 1).when(result == "A", 2)


def team_rows(matches: DataFrame, *extra: str) -> DataFrame:
    """Two rows per match, one per side, from a single scan."""
    ftr = F.col("ftr")

    def side(is_home: bool):
        us, them = ("h", "a") if is_home else ("a", "h")
        goals = {"h": "fthg", "a": "ftag"}
        sot = {"h": "hst", "a": "ast"}
        shots = {"h": "hs", "a": "as_"}
        win = "H" if is_home else "A"
        return F.struct(
            F.lit(is_home).alias("is_home"),
            F.col("home" if is_home else "away").alias("team"),
            F.col("away" if is_home else "home").alias("opponent"),
            F.col(goals[us]).alias("gf"), F.col(goals[them]).alias("ga"),
            F.col(sot[us]).alias("sot_for"), F.col(sot[them]).alias("sot_against"),
            F.col(shots[us]).alias("shots_for"), F.col(shots[them]).alias("shots_against"),
            _points(ftr, win).alias("pts"), _score(ftr, win).alias("score"),
        )

    keep = ["match_id", "league", "season", "match_date", "home", "away", *extra]
    return matches.select(*keep, F.explode(F.array(side(True), side(False))).alias("s")).select(*keep, "s.*")


def team_seasons(matches_idx: DataFrame) -> DataFrame:
    """Mean score and points per (league, season, team), pre-aggregated map-side."""
    return (
        team_rows(matches_idx, "season_idx")
        .groupBy("league", "season", "season_idx", "team")
        .agg(F.avg("score").alias("mean_score"), F.avg("pts").alias("ppg"), F.count("*").alias("n"))
    )


def classify_team_seasons(team_season: DataFrame) -> DataFrame:
    """Each team-season as new, stale (absent a full season) or continuing,
    with both newcomer readings and the spell number.

    * ``is_newcomer`` - not in the immediately preceding season (rating prior).
    * ``is_debut``    - never seen in any earlier season (goal-model prior).
    """
    w = W.partitionBy("league", "team").orderBy("season_idx")
    prev = F.lag("season_idx").over(w)
    kind = (
        F.when(F.col("prev_idx").isNull(), "new")
        .when(F.col("season_idx") - F.col("prev_idx") >= 2, "stale")
        .otherwise("continuing")
    )
    return (
        team_season.withColumn("prev_idx", prev)
        .withColumn("kind", kind)
        .withColumns({
            "spell": F.sum(F.when(F.col("kind") != "continuing", 1).otherwise(0)).over(w),
            "is_newcomer": F.col("kind") != "continuing",
            "is_debut": (F.col("kind") == "new") & (F.col("season_idx") > 0),
            "is_returning": F.col("kind") == "stale",
        })
    )


def rosters(matches: DataFrame) -> DataFrame:
    """Distinct clubs per (league, season)."""
    return (
        matches.select("league", "season", F.explode(F.array("home", "away")).alias("team"))
        .distinct()
    )
