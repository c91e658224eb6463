"""Cleaning and rule checks on raw season tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions.labels import parse_raw_date, season_years
from touchline.session import refuse_if_any

# --- Fixed values: verified fixes of single source typos -------------------
# (season, date, home team, away team, column, expected value, new value, reason)
KNOWN_CORRECTIONS = [
    ("2021_22", "2021-08-15", "Newcastle", "West Ham", "AS", 8, 18,
     "Source typo: raw AS=8 violates AST<=AS (AST=9). Independent match records confirm West Ham recorded AS=18, AST=9."),
]
# --- End of fixed values ----------------------------------------------------

CORRECTION_SCHEMA = "Season string, Date string, HomeTeam string, AwayTeam string, column string, expected int, new_value int, reason string"
CORRECTION_KEY = ["Season", "Date", "HomeTeam", "AwayTeam"]
VIOLATION_KEY = ["Season", "HomeTeam", "AwayTeam", "Date"]


def whitelist(df: DataFrame) -> tuple[DataFrame, int]:
    """The approved columns, or an error naming the missing ones; and how many were dropped."""
    missing = [c for c in S.RAW_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    extra = [c for c in df.columns if c not in S.RAW_COLUMNS and c != "Season"]
    keep = [c for c in df.columns if c == "Season"] + S.RAW_COLUMNS
    return df.select(*keep), len(extra)


def clean(df: DataFrame) -> DataFrame:
    """Parse dates, cast counts, trim the referee's name."""
    return df.withColumns(
        {"Date": parse_raw_date(F.col("Date")), "Referee": F.trim("Referee")}
        | {c: F.col(c).try_cast("int") for c in S.RAW_COUNT_COLUMNS}
    )


def corrections_table(spark: SparkSession, rows=None) -> DataFrame:
    table = spark.createDataFrame(KNOWN_CORRECTIONS if rows is None else rows, CORRECTION_SCHEMA)
    return table.withColumn("Date", F.to_date("Date"))


def _count_value(column: Column) -> Column:
    """The value of the count column named by ``column``."""
    pairs = [x for c in S.RAW_COUNT_COLUMNS for x in (F.lit(c), F.col(c))]
    return F.create_map(*pairs)[column]


def audit_corrections(matches: DataFrame, corrections: DataFrame) -> DataFrame:
    """Per correction: rows matched, current value, and whether it may be applied."""
    hit = matches.join(corrections, CORRECTION_KEY).withColumn("current", _count_value(F.col("column")))
    found = hit.groupBy(*CORRECTION_KEY, "column").agg(
        F.count("*").alias("n_matched"), F.min("current").alias("old_value"))
    return (
        corrections.join(found, [*CORRECTION_KEY, "column"], "left")
        .withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
        .withColumn("applicable", (F.col("n_matched") == 1) & F.col("old_value").eqNullSafe(F.col("expected")))
    )


def apply_corrections(matches: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Corrected matches and the log. A correction that does not hit exactly one
    row holding the expected value fails the job."""
    seasons = matches.select("Season").distinct()
    wanted = corrections.join(seasons, "Season", "left_semi")
    log = audit_corrections(matches, wanted)
    refuse_if_any(log.where("NOT applicable").drop("reason"), "refused-corrections", "refusing corrections")
    fixes = wanted.groupBy(*CORRECTION_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "new_value"))).alias("fixes"))
    fixed = matches.join(fixes, CORRECTION_KEY, "left").withColumns(
        {c: F.coalesce(F.col("fixes")[c], F.col(c)) for c in S.RAW_COUNT_COLUMNS}
    )
    return fixed.select(*matches.columns), log.drop("applicable", "n_matched", "expected")


def expected_result(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").otherwise("D")


def _detail(*shown: str) -> Column:
    text = F.concat(F.col("Date").cast("string"), F.lit(" "), F.col("HomeTeam"), F.lit(" v "), F.col("AwayTeam"))
    for c in shown:
        text = F.concat(text, F.lit(f" {c}="), F.coalesce(F.col(c).cast("string"), F.lit("nan")))
    return text


def row_rules() -> dict[str, tuple[Column, Column]]:
    """Rule name -> (breach condition, detail text)."""
    c = F.col
    negative = F.lit(False)
    for name in S.RAW_COUNT_COLUMNS:
        negative = negative | F.coalesce(c(name) < 0, F.lit(False))

    def differs(result: str, home: str, away: str) -> Column:
        return ~c(result).eqNullSafe(expected_result(c(home), c(away)))

    return {
        "home_equals_away": (c("HomeTeam") == c("AwayTeam"), F.concat(c("Date").cast("string"), F.lit(" "), c("HomeTeam"))),
        "negative_statistic": (negative, _detail()),
        "ftr_inconsistent": (differs("FTR", "FTHG", "FTAG"), _detail("FTHG", "FTAG", "FTR")),
        "htr_inconsistent": (differs("HTR", "HTHG", "HTAG"), _detail("HTHG", "HTAG", "HTR")),
        "hst_exceeds_hs": (c("HST") > c("HS"), _detail("HS", "HST")),
        "ast_exceeds_as": (c("AST") > c("AS"), _detail("AS", "AST")),
        "hthg_exceeds_fthg": (c("HTHG") > c("FTHG"), _detail("FTHG", "HTHG")),
        "htag_exceeds_ftag": (c("HTAG") > c("FTAG"), _detail("FTAG", "HTAG")),
    }


def row_violations(matches: DataFrame) -> DataFrame:
    """All breaches of all rules in one pass, one row per breach."""
    breaches = [
        F.when(broken, F.struct(F.lit(name).alias("rule"), detail.alias("detail")))
        for name, (broken, detail) in row_rules().items()
    ]
    return matches.select("Season", F.explode(F.array_compact(F.array(*breaches))).alias("v")).select("Season", "v.*")


def duplicate_violations(matches: DataFrame) -> DataFrame:
    """Every member of a repeated (date, home, away) group. Counting is
    pre-aggregated; only the repeated keys meet the rows again."""
    key = ["Date", "HomeTeam", "AwayTeam"]
    repeated = matches.groupBy(*key).count().where("count > 1").drop("count")
    return matches.join(repeated, key).select(
        "Season", F.lit("duplicate_match").alias("rule"), _detail().alias("detail"))


def require_clean(violations: DataFrame) -> None:
    """Stop the batch before anything is written if a single rule is broken."""
    refuse_if_any(violations, "rule-violations", "refusing to write, rule violations")


def calendar_check(matches: DataFrame) -> DataFrame:
    """Per season: match years outside the label's two years; a season without
    a single valid date is rejected as well."""
    years = F.year("Date")
    unexpected = F.when(~F.array_contains(season_years(F.col("Season")), years), years)
    return matches.groupBy("Season").agg(
        F.array_join(F.sort_array(F.collect_set(unexpected)), ",").alias("unexpected_years"),
        F.count("Date").alias("n_dated"),
    ).withColumn("accepted", (F.col("unexpected_years") == "") & (F.col("n_dated") > 0))


def season_profile(matches: DataFrame) -> DataFrame:
    """Rows, teams, date span, first-seen teams and soft warnings per season."""
    teams = matches.select("Season", F.explode(F.array("HomeTeam", "AwayTeam")).alias("team")).distinct()
    debut = teams.groupBy("team").agg(F.min("Season").alias("Season"))
    new = debut.groupBy("Season").agg(F.count("*").alias("n_new_teams"))
    sizes = teams.groupBy("Season").agg(F.count("*").alias("n_teams"))
    spans = matches.groupBy("Season").agg(
        F.count("*").alias("n_rows"), F.min("Date").alias("date_min"), F.max("Date").alias("date_max"))
    warnings = F.array_join(F.array_compact(F.array(
        F.when(F.col("n_rows") != S.SEASON_ROWS,
               F.format_string(f"%d rows found, expected {S.SEASON_ROWS}", "n_rows")),
        F.when(F.col("n_teams") != S.SEASON_TEAMS,
               F.format_string(f"%d unique teams found, expected {S.SEASON_TEAMS}", "n_teams")),
    )), "; ")
    return (
        spans.join(sizes, "Season").join(new, "Season", "left")
        .withColumn("n_new_teams", F.coalesce("n_new_teams", F.lit(0)))
        .withColumn("warnings", warnings)
    )


def new_teams(matches: DataFrame) -> DataFrame:
    """Teams first seen in each season: the set difference with all earlier ones."""
    teams = matches.select("Season", F.explode(F.array("HomeTeam", "AwayTeam")).alias("team")).distinct()
    return teams.groupBy("team").agg(F.min("Season").alias("Season"))


def missingness(matches: DataFrame) -> DataFrame:
    """Null count per column and season, only where there are any."""
    columns = [c for c in matches.columns if c != "Season"]
    counts = matches.groupBy("Season").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["Season"], columns, "column", "n_missing").where("n_missing > 0")


def schema_drift(file_columns: DataFrame) -> DataFrame:
    """Columns common to all files or varying, with the files that lack them."""
    pairs = file_columns.select("season", "column").distinct()
    files = pairs.select("season").distinct()
    present = pairs.groupBy("column").agg(F.collect_set("season").alias("present_in"))
    # one row: the list of season files
    every = files.agg(F.sort_array(F.collect_set("season")).alias("every"))
    return present.join(F.broadcast(every)).select(
        "column", F.size("present_in").alias("n_present"), F.size("every").alias("n_files"),
        (F.size("present_in") == F.size("every")).alias("is_common"),
        F.array_join(F.sort_array(F.array_except("every", "present_in")), ",").alias("missing_from"),
    )


def is_bookmaker(column: Column) -> Column:
    """Column names starting with a bookmaker prefix. Descriptive only."""
    return column.rlike("^(" + "|".join(S.BOOKMAKER_PREFIXES) + ")")
