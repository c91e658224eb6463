"""Column lists, types and constants of the contest data model."""

from __future__ import annotations

# --- Fixed values -----------------------------------------------------------
# Raw season files: approved columns, in output order.
RAW_COLUMNS = [
    "Date", "HomeTeam", "AwayTeam",
    "FTHG", "FTAG", "FTR",
    "HTHG", "HTAG", "HTR",
    "HS", "AS", "HST", "AST",
    "HF", "AF",
    "HC", "AC",
    "HY", "AY",
    "HR", "AR",
    "Referee",
]
RAW_COUNT_COLUMNS = [
    "FTHG", "FTAG", "HTHG", "HTAG",
    "HS", "AS", "HST", "AST",
    "HF", "AF", "HC", "AC",
    "HY", "AY", "HR", "AR",
]
SEASON_ROWS = 380
SEASON_TEAMS = 20

# Column-name prefixes that mark bookmaker columns in raw files.
BOOKMAKER_PREFIXES = [
    "B365", "BW", "BF", "BV", "BMGM", "IW", "LB", "PS", "WH", "VC",
    "CL", "1XB", "Max", "Avg", "Bb", "AHh",
]

# Feature-build constants.
EWMA_HALFLIFE = 10.0
MIN_PERIODS = 3
EFFICIENCY_WINDOW = 10
REST_DAYS_CAP = 21
HISTORY_DEPTH_CAP = 38
K_FACTOR = 20.0
INITIAL_RATING = 1500.0
MIN_PRIOR_SEASONS = 3
APRIORI_HOME_ADVANTAGE = 45.0
APRIORI_SEASON_SHRINK = 0.80
APRIORI_PROMOTED_DELTA = -100.0
ELO_BAND = (800.0, 2200.0)
ELO_DRIFT = 100.0

# The season held back from every estimate, and the approved folds
# (fold, last training season, validation season).
SEALED_SEASON = "2025_26"
APPROVED_FOLDS = [
    (1, "2021_22", "2022_23"),
    (2, "2022_23", "2023_24"),
    (3, "2023_24", "2024_25"),
]

METADATA_COLUMNS = [
    "season", "match_date", "home", "away",
    "home_matches_played_season", "away_matches_played_season",
    "home_prior_matches_all_time", "away_prior_matches_all_time",
    "home_rest_days", "away_rest_days",
    "home_is_returning", "away_is_returning",
]
FEATURE_COLUMNS = [
    "home_elo", "away_elo", "elo_diff",
    "home_ewma_gf", "home_ewma_ga", "home_ewma_sot_for", "home_ewma_sot_against",
    "home_ewma_shots_for", "home_ewma_shots_against", "home_ewma_ppg",
    "away_ewma_gf", "away_ewma_ga", "away_ewma_sot_for", "away_ewma_sot_against",
    "away_ewma_shots_for", "away_ewma_shots_against", "away_ewma_ppg",
    "diff_ewma_ppg", "diff_ewma_sot_diff", "diff_ewma_gd",
    "home_attack_vs_away_defence_goals", "away_attack_vs_home_defence_goals",
    "home_attack_vs_away_defence_sot",
    "home_std_ppg", "away_std_ppg", "diff_std_ppg", "diff_std_gd",
    "home_sot_ratio", "away_sot_ratio", "home_conversion", "away_conversion",
    "home_history_depth", "away_history_depth", "home_is_cold_start", "away_is_cold_start",
]
DERIVED_COLUMNS = [
    "elo_diff", "diff_ewma_ppg", "diff_ewma_sot_diff", "diff_ewma_gd",
    "home_attack_vs_away_defence_goals", "away_attack_vs_home_defence_goals",
    "home_attack_vs_away_defence_sot", "diff_std_ppg",
    "home_is_cold_start", "away_is_cold_start",
]
TRIO_COLUMNS = ["elo_diff", "diff_ewma_ppg", "diff_ewma_sot_diff"]
# --- End of fixed values ----------------------------------------------------

LINEAR_COLUMNS = [c for c in FEATURE_COLUMNS if c not in DERIVED_COLUMNS]
ALWAYS_PRESENT_COLUMNS = [
    c for c in FEATURE_COLUMNS if "elo" in c or "history_depth" in c or "cold_start" in c
]

CONTEST_SCHEMA = (
    "match_id long, league int, season int, match_date date, home long, away long, "
    "fthg int, ftag int, hs int, as_ int, hst int, ast int, ftr string"
)
REQUIRED_CONTEST_COLUMNS = [
    "season", "match_date", "home", "away", "fthg", "ftag", "ftr", "hs", "as_", "hst", "ast",
]
MATCH_KEY = ["league", "match_date", "home", "away"]
