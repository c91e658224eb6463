"""The pre-match feature table and its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import schema as S
from touchline.operators.causal import parameter_schedule
from touchline.operators.elo import ratings
from touchline.operators.form import EWMA_NAMES, matchups, team_days, team_state
from touchline.operators.seasons import season_index, target, with_season_index
from touchline.session import written

SIDE_COLUMNS = (
    ["matches_played_season", "prior_matches_all_time", "rest_days", "is_returning", "elo"]
    + [f"ewma_{m}" for m in EWMA_NAMES]
    + ["std_ppg", "std_gd", "sot_ratio", "conversion", "history_depth", "is_cold_start"]
)


def require_columns(matches: DataFrame) -> None:
    missing = [c for c in S.REQUIRED_CONTEST_COLUMNS if c not in matches.columns]
    if missing:
        raise ValueError(f"contest table is missing required columns: {missing}")


def attach_sides(matches_idx: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """Both teams' state as ``home_*`` and ``away_*`` columns: two equi-joins."""
    out = matches_idx
    for side in ("home", "away"):
        s = state.select(
            "league", "season_idx", "match_date", F.col("team").alias(side),
            *[F.col(c).alias(f"{side}_{c}") for c in columns],
        )
        out = out.join(s, ["league", "season_idx", "match_date", side])
    return out


def build_features(
    matches: DataFrame,
    schedule: DataFrame | None = None,
    *,
    halflife: float = S.EWMA_HALFLIFE,
    min_periods: int = S.MIN_PERIODS,
    window: int = S.EFFICIENCY_WINDOW,
    rest_cap: int = S.REST_DAYS_CAP,
) -> DataFrame:
    """Every match as one row of 12 metadata and 35 feature columns plus target.

    Pass :func:`causal.constant_schedule` for the diagnostic fixed-parameter
    mode. No row is dropped and no value is imputed.
    """
    require_columns(matches)
    schedule = parameter_schedule(matches, strict=True) if schedule is None else schedule
    m = with_season_index(matches, season_index(matches))
    state = team_state(team_days(m, halflife, window), halflife=halflife, min_periods=min_periods,
                       window=window, rest_cap=rest_cap)
    # Both sides need the ratings, and a lost executor must not repeat a league's pass.
    elo = written(ratings(matches, schedule), "ratings")
    state = state.join(elo, ["league", "season_idx", "match_date", "team"])
    rows = m.select("match_id", "league", "season", "season_idx", "match_date", "home", "away", "ftr")
    wide = matchups(attach_sides(rows, state, SIDE_COLUMNS))
    return output_types(wide.withColumn("target", target(F.col("ftr"))))


def output_types(wide: DataFrame) -> DataFrame:
    """Declared order and types: features double, counters long, flags boolean."""
    counters = [c for c in S.METADATA_COLUMNS if "matches" in c]
    typed = (
        ["match_id", "league"]
        + [F.col(c).cast("long").alias(c) if c in counters else F.col(c) for c in S.METADATA_COLUMNS]
        + [F.col(c).cast("double").alias(c) for c in S.FEATURE_COLUMNS]
        + ["ftr", F.col("target").cast("long").alias("target")]
    )
    return wide.select(*typed)


#: What a row's own match came to: no feature may carry any of it.
OUTCOMES = ["fthg", "ftag", "hs", "as_", "hst", "ast", "target"]


def leaked_columns(features: DataFrame, matches: DataFrame) -> DataFrame:
    """(check, n): features that equal one and the same outcome of their own match in every row, nulls included, and vary."""
    outcomes = matches.select("match_id", *[F.col(c).cast("double").alias(f"_o_{c}") for c in OUTCOMES if c in matches.columns])
    own = features.select("match_id", F.col("target").cast("double").alias("_o_target"), *S.FEATURE_COLUMNS).join(outcomes, "match_id")
    known = [c for c in own.columns if c.startswith("_o_")]
    same = lambda f: sum((F.when(F.col(f).eqNullSafe(F.col(o)), 1 << k).otherwise(0) for k, o in enumerate(known)), F.lit(0))
    one = own.agg(F.count("*").alias("n"), *[F.struct(F.bit_and(same(f)).alias("as"), (F.min(f) < F.max(f)).alias("varies")).alias(f) for f in S.FEATURE_COLUMNS])
    each = F.array(*[F.struct(F.concat(F.lit("leaked_column:"), F.lit(f)).alias("check"), F.when((F.col(f)["as"] > 0) & F.col(f)["varies"], F.col("n")).alias("n")) for f in S.FEATURE_COLUMNS])
    return one.select(F.explode(each).alias("x")).select("x.check", "x.n").where("n > 0")


def contract_violations(features: DataFrame, *, matches: DataFrame | None = None, expected_rows: int | None = None,
                        min_periods: int = S.MIN_PERIODS, initial_rating: float = S.INITIAL_RATING) -> DataFrame:
    """Breaches of the feature contract as (check, n) rows; empty means sound.

    Schema checks run on the driver against ``features.schema``; all data checks
    are one aggregation. With the ``matches`` behind the rows, features that are an outcome of their own match are told too.
    """
    spark = features.sparkSession
    expected = S.METADATA_COLUMNS + S.FEATURE_COLUMNS + ["ftr", "target"]
    allowed = set(expected) | {"match_id", "league"}
    static = [("missing_column:" + c, 1) for c in expected if c not in features.columns]
    static += [("unexpected_column:" + c, 1) for c in features.columns if c not in allowed]
    static += [
        ("not_double:" + c, 1) for c in S.FEATURE_COLUMNS
        if c in features.columns and not isinstance(features.schema[c].dataType, T.DoubleType)
    ]
    static_df = spark.createDataFrame(static, "check string, n long")
    if any(c.startswith("missing_column") for c, _ in static):
        return static_df

    c, feats = F.col, S.FEATURE_COLUMNS
    inf = float("inf")
    n_inf = sum((F.when(c(f).isin(inf, -inf), 1).otherwise(0) for f in feats), F.lit(0))
    all_null = F.lit(True)
    for f in feats:
        all_null = all_null & (c(f).isNull() | F.isnan(f))
    void = lambda f: c(f).isNull() | F.isnan(f)
    per_key = features.groupBy(*S.MATCH_KEY).count()
    checks = {
        "infinite_value": F.sum(n_inf),
        "all_features_null": F.count_if(all_null),
        "target_disagrees": F.count_if(~c("target").eqNullSafe(target(c("ftr")))),
        "target_unknown": F.count_if(~c("target").isin(0, 1, 2)),
        "empty": F.when(F.count("*") == 0, 1).otherwise(0),
        "elo_drift": F.when(F.abs((F.avg("home_elo") + F.avg("away_elo")) / 2 - initial_rating) > S.ELO_DRIFT, 1).otherwise(0),
        **{f"null:{f}": F.count_if(void(f)) for f in S.ALWAYS_PRESENT_COLUMNS},
    }
    for side in ("home", "away"):
        depth, cold = c(f"{side}_history_depth"), c(f"{side}_is_cold_start")
        elo = c(f"{side}_elo")
        checks |= {
            f"cold_flag:{side}": F.count_if(cold != F.when(depth < min_periods, 1.0).otherwise(0.0)),
            f"depth_range:{side}": F.count_if((depth < 0) | (depth > S.HISTORY_DEPTH_CAP)),
            f"form_when_cold:{side}": F.count_if((cold > 0) & c(f"{side}_ewma_ppg").isNotNull()),
            f"elo_band:{side}": F.count_if((elo < S.ELO_BAND[0]) | (elo > S.ELO_BAND[1])),
        }
    if expected_rows is not None:
        checks["row_count"] = F.when(F.count("*") != expected_rows, F.count("*")).otherwise(0)
    one = features.agg(*[v.cast("long").alias(k) for k, v in checks.items()])
    long = one.unpivot([], list(checks), "check", "n")
    dup = per_key.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n")).select(
        F.lit("duplicate_key").alias("check"), "n")
    found = static_df.unionByName(long.unionByName(dup).where("n > 0"))
    return found if matches is None else found.unionByName(leaked_columns(features, matches))


def cold_start_rows(features: DataFrame) -> DataFrame:
    """Matches where at least one side lacks usable history."""
    cold = (F.col("home_is_cold_start") > 0) | (F.col("away_is_cold_start") > 0)
    return features.groupBy("league", "season").agg(F.count_if(cold).alias("cold_rows"), F.count("*").alias("n_rows"))


def opening_elo_mean(rated: DataFrame, index: DataFrame) -> DataFrame:
    """Mean rating of every club at its first fixture of the season, from the ratings alone. ``index``: :func:`seasons.season_index`."""
    first = rated.groupBy("league", "season_idx", "team").agg(F.min_by("elo", "match_date").alias("elo"))
    mean = first.groupBy("league", "season_idx").agg(F.avg("elo").alias("mean_opening_elo"), F.count("*").alias("n_teams"))
    return mean.join(index.select("league", "season_idx", "season"), ["league", "season_idx"]).drop("season_idx")


def target_correlations(features: DataFrame, sealed_from=None) -> DataFrame:
    """Correlation of each feature with the target; a large one hints at leakage."""
    rows = features if sealed_from is None else features.where(F.col("season") < F.lit(sealed_from))
    one = rows.agg(*[F.corr(f, "target").alias(f) for f in S.FEATURE_COLUMNS])
    return one.unpivot([], S.FEATURE_COLUMNS, "feature", "corr")
