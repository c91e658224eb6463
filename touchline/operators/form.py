"""Team form before each match day.

All visibility is by date, so a team's state is the same for every match of a
day. The work is therefore done on one row per (team, day): matches are folded
into days first, and the running windows per team then hold at most one row per
calendar day, however many matches a team has played.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.operators.seasons import team_rows
from touchline.session import spread_by_rows, written

METRICS = ["gf", "ga", "sot_for", "sot_against", "shots_for", "shots_against", "pts"]
EWMA_NAMES = ["gf", "ga", "sot_for", "sot_against", "shots_for", "shots_against", "ppg"]
DAY_KEY = ["league", "team", "season_idx", "match_date"]

# Team-days of one task of the windows.
STATE_ROWS = 100_000

# Powers of two stay inside a double while a block spans this many half-lives.
BLOCK_HALFLIVES = 500


def team_days(matches_idx: DataFrame, halflife: float = S.EWMA_HALFLIFE,
              window: int = S.EFFICIENCY_WINDOW) -> DataFrame:
    """One row per (league, team, season, day): counts, sums, the day's decayed
    sums (latest match weight 1) and its last ``window`` efficiency triples."""
    latest_first = W.partitionBy(*DAY_KEY).orderBy(F.desc("home"), F.desc("away"), F.desc("match_id"))
    weight = F.pow(F.lit(0.5), F.col("back") / F.lit(float(halflife)))
    rows = team_rows(matches_idx, "season_idx").withColumn("back", F.row_number().over(latest_first) - 1)
    recent = F.when(
        F.col("back") < window,
        F.struct((-F.col("back")).alias("pos"), F.col("shots_for").alias("shots"),
                 F.col("sot_for").alias("sot"), F.col("gf").alias("goals")),
    )
    return rows.groupBy(*DAY_KEY).agg(
        F.count("*").alias("n"),
        F.sum("pts").alias("day_pts"),
        F.sum(F.col("gf") - F.col("ga")).alias("day_gd"),
        F.sum(weight).alias("w_day"),
        *[F.sum(F.col(m) * weight).alias(f"x_{m}") for m in METRICS],
        F.sort_array(F.collect_list(recent)).alias("recent"),
    )


def with_spells(days: DataFrame) -> DataFrame:
    """Spell number per team: history restarts after a missed season."""
    w = W.partitionBy("league", "team").orderBy("match_date")
    prev = F.lag("season_idx").over(w)
    spell = W.partitionBy("league", "team", "spell")
    return (
        days.withColumn("starts", F.when(prev.isNull() | (F.col("season_idx") - prev >= 2), 1).otherwise(0))
        .withColumn("spell", F.sum("starts").over(w))
        .withColumn("spell_season", F.min("season_idx").over(spell))
        .withColumn("is_returning", (F.col("spell") > 1) & (F.col("season_idx") == F.col("spell_season")))
        .drop("starts", "spell_season")
    )


def _ewma_state(days: DataFrame, halflife: float) -> DataFrame:
    """Decayed numerators and denominator after each day.

    Within a block of matches the recurrence has the closed form
    sum(x * 2^(m / h)); the block before contributes its last value scaled
    down, and anything older is below 2^-500 of the total.
    """
    block_size = BLOCK_HALFLIVES * halflife
    spell = W.partitionBy("league", "team", "spell").orderBy("block", "match_date")
    block = W.partitionBy("league", "team", "spell", "block").orderBy("match_date")
    sums = {"w_day": "w", **{f"x_{m}": m for m in METRICS}}
    up = F.pow(F.lit(2.0), (F.col("m_after") - F.col("block") * block_size) / halflife)
    down = F.pow(F.lit(2.0), (F.col("block_before") - F.col("block")) * F.lit(float(BLOCK_HALFLIVES)))
    return (
        days.withColumn("m_after", F.sum("n").over(W.partitionBy("league", "team", "spell").orderBy("match_date")))
        .withColumn("block", F.floor((F.col("m_after") - 1) / block_size))
        .withColumns({f"c_{v}": F.sum(F.col(k) * up).over(block) for k, v in sums.items()})
        .withColumns({f"p_{v}": F.lag(f"c_{v}").over(spell) for v in sums.values()}
                     | {"p_block": F.lag("block").over(spell)})
        .withColumns({f"b_{v}": F.first(f"p_{v}").over(block) for v in sums.values()}
                     | {"block_before": F.first("p_block").over(block)})
        .withColumns({f"s_{v}": F.col(f"c_{v}") + F.coalesce(F.col(f"b_{v}") * down, F.lit(0.0)) for v in sums.values()})
    )


def team_state(days: DataFrame, *, halflife: float = S.EWMA_HALFLIFE, min_periods: int = S.MIN_PERIODS,
               window: int = S.EFFICIENCY_WINDOW, rest_cap: int = S.REST_DAYS_CAP,
               depth_cap: int = S.HISTORY_DEPTH_CAP) -> DataFrame:
    """Everything known about a team before each of its match days.

    One exchange on (league, team) serves every window below. The rows grow wide in it and each window sorts its own, so the
    number of its partitions follows the days.
    """
    days = spread_by_rows(written(days, "team-days"), STATE_ROWS, "league", "team")
    team = W.partitionBy("league", "team").orderBy("match_date")
    spell = W.partitionBy("league", "team", "spell").orderBy("block", "match_date")
    season = W.partitionBy("league", "team", "season_idx").orderBy("match_date")
    before = (W.unboundedPreceding, -1)

    state = _ewma_state(with_spells(days), halflife)
    state = state.withColumns({
        "prior_all": F.coalesce(F.sum("n").over(team.rowsBetween(*before)), F.lit(0)),
        "last_date": F.lag("match_date").over(team),
        "prior_spell": F.col("m_after") - F.col("n"),
        "lag_w": F.lag("s_w").over(spell),
        **{f"lag_{m}": F.lag(f"s_{m}").over(spell) for m in METRICS},
        "last_days": F.flatten(F.collect_list("recent").over(spell.rowsBetween(-window, -1))),
        "season_n": F.coalesce(F.sum("n").over(season.rowsBetween(*before)), F.lit(0)),
        "season_pts": F.sum("day_pts").over(season.rowsBetween(*before)),
        "season_gd": F.sum("day_gd").over(season.rowsBetween(*before)),
    })
    warm = F.col("prior_spell") >= min_periods
    take = F.least(F.lit(window), F.size("last_days"))
    last = F.when(take > 0, F.slice("last_days", -take, take))

    def total(field: str):
        return F.aggregate(F.transform(last, lambda r: r[field].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)

    state = state.withColumns({
        "sum_shots": total("shots"), "sum_sot": total("sot"), "sum_goals": total("goals"),
    })
    ratio = lambda a, b: F.when(warm & (F.col(b) > 0), F.col(a) / F.col(b))
    return state.select(
        *DAY_KEY, "spell", "is_returning",
        F.col("season_n").alias("matches_played_season"),
        F.col("prior_all").alias("prior_matches_all_time"),
        F.least(F.lit(rest_cap), F.date_diff("match_date", "last_date")).cast("double").alias("rest_days_raw"),
        F.col("last_date"),
        *[F.when(warm, F.col(f"lag_{m}") / F.col("lag_w")).alias(f"ewma_{name}") for m, name in zip(METRICS, EWMA_NAMES)],
        F.when(F.col("season_n") > 0, F.col("season_pts") / F.col("season_n")).alias("std_ppg"),
        F.when(F.col("season_n") > 0, F.col("season_gd") / F.col("season_n")).alias("std_gd"),
        ratio("sum_sot", "sum_shots").alias("sot_ratio"),
        ratio("sum_goals", "sum_sot").alias("conversion"),
        F.least(F.col("prior_spell"), F.lit(depth_cap)).cast("double").alias("history_depth"),
        F.when(warm, 0.0).otherwise(1.0).alias("is_cold_start"),
    ).withColumn("rest_days", F.when(F.col("last_date").isNotNull(), F.col("rest_days_raw"))).drop("rest_days_raw", "last_date")


def matchups(f: DataFrame) -> DataFrame:
    """Pure column differences between the two sides; null propagates."""
    c = F.col
    return f.withColumns({
        "elo_diff": c("home_elo") - c("away_elo"),
        "diff_ewma_ppg": c("home_ewma_ppg") - c("away_ewma_ppg"),
        "diff_ewma_sot_diff": (c("home_ewma_sot_for") - c("home_ewma_sot_against"))
        - (c("away_ewma_sot_for") - c("away_ewma_sot_against")),
        "diff_ewma_gd": (c("home_ewma_gf") - c("home_ewma_ga")) - (c("away_ewma_gf") - c("away_ewma_ga")),
        "home_attack_vs_away_defence_goals": c("home_ewma_gf") - c("away_ewma_ga"),
        "away_attack_vs_home_defence_goals": c("away_ewma_gf") - c("home_ewma_ga"),
        "home_attack_vs_away_defence_sot": c("home_ewma_sot_for") - c("away_ewma_sot_against"),
        "diff_std_ppg": c("home_std_ppg") - c("away_std_ppg"),
        "diff_std_gd": c("home_std_gd") - c("away_std_gd"),
    })
