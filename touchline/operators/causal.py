"""Causal rating parameters: every season uses only seasons before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions.ratings import gap_from_score
from touchline.operators.seasons import classify_team_seasons, season_index, team_seasons, with_season_index


def season_moments(matches: DataFrame) -> DataFrame:
    """Per (league, season): the sums that every estimate is built from.

    Team-seasons are the only intermediate, so after the first map-side
    aggregation nothing grows with the number of matches.
    """
    index = season_index(matches)
    m = with_season_index(matches, index)
    home = m.groupBy("league", "season_idx").agg(
        F.sum(F.when(F.col("ftr") == "H", 1.0).when(F.col("ftr") == "D", 0.5).otherwise(0.0)).alias("home_score"),
        F.count("*").alias("n_home"),
    )
    per_team = W.partitionBy("league", "team").orderBy("season_idx")
    ts = classify_team_seasons(team_seasons(m)).withColumn("prev_ppg", F.lag("ppg").over(per_team))
    # The opening season is burn-in: everyone looks new, and it starts no pair.
    new = F.col("is_newcomer") & (F.col("season_idx") > 0)
    pair = (F.col("prev_idx") == F.col("season_idx") - 1) & (F.col("prev_idx") >= 1)
    x, y = F.col("prev_ppg"), F.col("ppg")
    team = ts.groupBy("league", "season_idx").agg(
        F.sum(F.when(new, F.col("mean_score")).otherwise(0.0)).alias("new_score"),
        F.count_if(new).alias("n_new"),
        F.count_if(pair).alias("n_pair"),
        F.sum(F.when(pair, x).otherwise(0.0)).alias("sx"),
        F.sum(F.when(pair, y).otherwise(0.0)).alias("sy"),
        F.sum(F.when(pair, x * x).otherwise(0.0)).alias("sxx"),
        F.sum(F.when(pair, x * y).otherwise(0.0)).alias("sxy"),
    )
    return index.join(home, ["league", "season_idx"]).join(team, ["league", "season_idx"])


def _through(matches: DataFrame) -> DataFrame:
    """Season moments summed over all seasons up to and including each one."""
    upto = W.partitionBy("league").orderBy("season_idx").rowsBetween(W.unboundedPreceding, 0)
    sums = ["home_score", "n_home", "new_score", "n_new", "n_pair", "sx", "sy", "sxx", "sxy"]
    return season_moments(matches).withColumns({c: F.sum(c).over(upto) for c in sums})


def home_advantage_through(matches: DataFrame) -> DataFrame:
    """Home advantage estimated through each season."""
    return _through(matches).select(
        "league", "season", gap_from_score(F.col("home_score") / F.col("n_home")).alias("home_advantage"))


def promoted_prior_through(matches: DataFrame) -> DataFrame:
    """Newcomer rating offset through each season; no row before the first newcomer."""
    return _through(matches).where("n_new > 0").select(
        "league", "season", F.col("n_new").alias("n_newcomers"),
        gap_from_score(F.col("new_score") / F.col("n_new")).alias("promoted_delta"))


def season_shrink_through(matches: DataFrame) -> DataFrame:
    """Slope of next on previous points per game through each season."""
    n = F.col("n_pair")
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    return _through(matches).where("n_pair > 0").select(
        "league", "season", n.alias("n_pairs"), F.when(var_x > 1e-12, cov / var_x).alias("season_shrink"))


def parameter_schedule(
    matches: DataFrame,
    *,
    min_prior_seasons: int = S.MIN_PRIOR_SEASONS,
    sealed_from=None,
    strict: bool = False,
    k_factor: float = S.K_FACTOR,
    initial_rating: float = S.INITIAL_RATING,
    apriori: tuple[float, float, float] = (
        S.APRIORI_HOME_ADVANTAGE, S.APRIORI_SEASON_SHRINK, S.APRIORI_PROMOTED_DELTA,
    ),
) -> DataFrame:
    """One parameter row per (league, season) in a single cumulative query.

    ``status`` names why an estimate could not be made; ``strict`` turns it
    into a failure of the job.
    """
    before = W.partitionBy("league").orderBy("season_idx").rowsBetween(W.unboundedPreceding, -1)
    summed = ["home_score", "n_home", "new_score", "n_new", "n_pair", "sx", "sy", "sxx", "sxy"]
    cum = season_moments(matches).withColumns(
        {f"c_{c}": F.sum(c).over(before) for c in summed}
        | {"prior": F.collect_list("season").over(before)}
    )
    estimated = F.size("prior") >= max(min_prior_seasons, 3)
    home_mean = F.try_divide(F.col("c_home_score"), F.col("c_n_home"))
    new_mean = F.try_divide(F.col("c_new_score"), F.col("c_n_new"))
    n = F.col("c_n_pair")
    var_x = F.col("c_sxx") - F.try_divide(F.col("c_sx") * F.col("c_sx"), n)
    cov = F.col("c_sxy") - F.try_divide(F.col("c_sx") * F.col("c_sy"), n)
    inside = lambda m: (m > 0) & (m < 1)
    status = (
        F.when(~estimated, "apriori")
        .when(~inside(home_mean), "home score outside (0, 1)")
        .when(F.col("c_n_new") == 0, "no newcomer team-seasons")
        .when(~inside(new_mean), "newcomer score outside (0, 1)")
        .when(n == 0, "no season transitions")
        .when(n < 2, "fewer than two transitions")
        .when(~(var_x > 1e-12), "no variance in previous points")
    )
    if sealed_from is not None:
        status = status.when(F.exists("prior", lambda s: s >= F.lit(sealed_from)), "uses a sealed season")
    status = status.otherwise("estimated")
    ok = F.col("status") == "estimated"

    def pick(prior_value: float, value: Column) -> Column:
        return F.when(F.col("status") == "apriori", F.lit(float(prior_value))).when(ok, value)

    out = (
        cum.withColumn("status", status)
        .withColumns({
            "home_advantage": pick(apriori[0], gap_from_score(home_mean)),
            "season_shrink": pick(apriori[1], F.try_divide(cov, var_x)),
            "promoted_delta": pick(apriori[2], gap_from_score(new_mean)),
            "k_factor": F.lit(float(k_factor)),
            "initial_rating": F.lit(float(initial_rating)),
            "estimated_from": F.when(ok, F.col("prior")).otherwise(F.slice("prior", 1, 0)),
        })
        .select("league", "season", "season_idx", "status", "home_advantage", "season_shrink",
                "promoted_delta", "k_factor", "initial_rating", "estimated_from")
    )
    if strict:
        failed = ~F.col("status").isin("estimated", "apriori")
        out = out.withColumn(
            "status",
            F.when(failed, F.raise_error(F.concat(F.lit("rating parameters: "), F.col("status")))).otherwise(F.col("status")),
        )
    return out


def constant_schedule(matches: DataFrame, home_advantage: float, season_shrink: float, promoted_delta: float,
                      k_factor: float = S.K_FACTOR, initial_rating: float = S.INITIAL_RATING) -> DataFrame:
    """Diagnostic mode: one parameter row for every season. Not causal."""
    return season_index(matches).select(
        "league", "season", "season_idx", F.lit("fixed").alias("status"),
        F.lit(float(home_advantage)).alias("home_advantage"),
        F.lit(float(season_shrink)).alias("season_shrink"),
        F.lit(float(promoted_delta)).alias("promoted_delta"),
        F.lit(float(k_factor)).alias("k_factor"),
        F.lit(float(initial_rating)).alias("initial_rating"),
        F.array().cast("array<int>").alias("estimated_from"),
    )


def schedule_violations(schedule: DataFrame, sealed_from=None) -> DataFrame:
    """Rows that break causality, plus non-constant K or initial rating.

    A source season at or after the sealed one is reported as such, and is not
    reported a second time as non-causal.
    """
    src = schedule.select("league", "season", F.explode("estimated_from").alias("source"))
    late = src["source"] >= src["season"]
    if sealed_from is not None:
        sealed = src["source"] >= F.lit(sealed_from)
        rule = F.when(sealed, "sealed_source").when(late, "not_causal")
    else:
        rule = F.when(late, "not_causal")
    causal = src.withColumn("rule", rule).where("rule is not null").select(
        "league", F.col("season").cast("string").alias("season"), "rule",
        F.col("source").cast("string").alias("detail"),
    )
    constant = (
        schedule.groupBy("league")
        .agg(F.count_distinct("k_factor").alias("nk"), F.count_distinct("initial_rating").alias("ni"))
        .select("league", F.lit(None).cast("string").alias("season"), F.explode(F.array_compact(F.array(
            F.when(F.col("nk") > 1, F.struct(F.lit("k_not_constant").alias("rule"), F.col("nk").cast("string").alias("detail"))),
            F.when(F.col("ni") > 1, F.struct(F.lit("initial_not_constant").alias("rule"), F.col("ni").cast("string").alias("detail"))),
        ))).alias("v"))
        .select("league", "season", "v.rule", "v.detail")
    )
    return causal.unionByName(constant)
