"""Queries over the raw season view: scans, cleaning and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import schema as S
from touchline.functions import labels
from touchline.operators import quality
from touchline.plans import sqltext as Q
from touchline.plans.registry import register
from touchline.session import fresh_path
from touchline.sources import season_files
from touchline.sources.contests import contests
from touchline.sources.raw_view import RAW_SQL, raw_seasons

RAW = f"WITH {Q.CONTESTS}, {RAW_SQL} "
SUMS = ", ".join(f'sum("{c}")::BIGINT "{c}"' for c in S.RAW_COUNT_COLUMNS)


def raw(spark, sf):
    return raw_seasons(contests(spark, sf))


def cleaned(spark, sf):
    return quality.clean(quality.whitelist(raw(spark, sf))[0])


def season_folder(spark, sf):
    """One ``<season>.csv`` per season; odd years lack one bookmaker column."""
    folder = fresh_path(spark, "season-csv")
    rows = raw(spark, sf)
    for (label,) in rows.select("Season").distinct().collect():  # one row per season
        part = rows.where(F.col("Season") == label).drop("Season", *(["MaxA"] if int(label[:4]) % 2 else []))
        part.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(f"{folder}/{label}.csv")
    return folder


@register("s1_season_csv_scan", RAW + f'SELECT "Season", count(*) n, {SUMS}, min("Date")::VARCHAR date_min, max("Date")::VARCHAR date_max, '
          'count("Referee") n_referee, 3 - yr % 2 dropped FROM raw GROUP BY "Season", yr')
def season_csv_scan(spark, sf):
    df, dropped = season_files.scan_seasons(spark, season_folder(spark, sf))
    sums = [F.sum(c).alias(c) for c in S.RAW_COUNT_COLUMNS]
    width = F.create_map(*[x for k, v in dropped.items() for x in (F.lit(k), F.lit(v))])
    return quality.clean(df).groupBy("Season").agg(
        F.count("*").alias("n"), *sums, F.min("Date").alias("date_min"), F.max("Date").alias("date_max"),
        F.count("Referee").alias("n_referee")).withColumn("dropped", width[F.col("Season")])


FILES_SQL = RAW + """, f AS (SELECT DISTINCT "Season" season, yr FROM raw),
fc AS (SELECT season, unnest([""" + ", ".join(f"'{c}'" for c in [*S.RAW_COLUMNS, "Div", "B365H"]) + """]) col FROM f
       UNION ALL SELECT season, 'MaxA' FROM f WHERE yr % 2 = 0) """


@register("p9_schema_drift", FILES_SQL + """SELECT col AS "column", count(*) n_present, (SELECT count(*) FROM f) n_files,
  count(*) = (SELECT count(*) FROM f) is_common,
  coalesce((SELECT string_agg(season, ',' ORDER BY season) FROM f WHERE season NOT IN (SELECT season FROM fc x WHERE x.col = fc.col)), '') missing_from
FROM fc GROUP BY col""")
def schema_drift(spark, sf):
    return quality.schema_drift(season_files.headers(spark, season_folder(spark, sf)))


@register("p11_bookmaker_columns", FILES_SQL + """SELECT season, count(*) n_columns, count(*) FILTER (WHERE col IN ('B365H', 'MaxA')) n_bookmaker FROM fc GROUP BY season""")
def bookmaker_columns(spark, sf):
    h = season_files.headers(spark, season_folder(spark, sf))
    return h.groupBy("season").agg(F.count("*").alias("n_columns"), F.count_if(quality.is_bookmaker(F.col("column"))).alias("n_bookmaker"))


@register("u4_common_columns", FILES_SQL + """SELECT col AS "column" FROM fc GROUP BY col HAVING count(*) = (SELECT count(*) FROM f)""")
def common_columns(spark, sf):
    return quality.schema_drift(season_files.headers(spark, season_folder(spark, sf))).where("is_common").select("column")


@register("u1_season_union", RAW + """SELECT "Season", count(*) n FROM raw GROUP BY "Season" """)
def season_union(spark, sf):
    """Two disjoint season scans united as a bag."""
    folder = season_folder(spark, sf)
    labels_ = sorted(r[0] for r in season_files.headers(spark, folder).select("season").distinct().collect())
    first, _ = season_files.scan_seasons(spark, folder, labels_[::2])
    second, _ = season_files.scan_seasons(spark, folder, labels_[1::2])
    return first.unionByName(second).groupBy("Season").agg(F.count("*").alias("n"))


@register("s4_parquet_sink", f"WITH {Q.CONTESTS} SELECT league, season, count(*) n, sum(fthg)::BIGINT goals FROM contests GROUP BY league, season")
def parquet_sink(spark, sf):
    path = fresh_path(spark, "matches")
    season_files.write_matches(contests(spark, sf), path)
    return spark.read.parquet(path).groupBy("league", "season").agg(F.count("*").alias("n"), F.sum("fthg").alias("goals"))


@register("s2_whitelist_projection", RAW + "SELECT count(*) n, 3 dropped, count(DISTINCT \"HomeTeam\") n_home FROM raw")
def whitelist_projection(spark, sf):
    kept, dropped = quality.whitelist(raw(spark, sf))
    return kept.agg(F.count("*").alias("n"), F.lit(dropped).alias("dropped"), F.count_distinct("HomeTeam").alias("n_home"))


@register("s3_pruned_parquet_scan", f"WITH {Q.CONTESTS} SELECT season, home, away, fthg::BIGINT fthg, ftag::BIGINT ftag, ftr, "
          "match_date::VARCHAR match_date FROM contests")
def pruned_scan(spark, sf):
    return contests(spark, sf).select("season", "match_date", "home", "away", "fthg", "ftag", "ftr")


@register("p1_mixed_dates", RAW + 'SELECT "Season", "Date"::VARCHAR "Date", "HomeTeam", "AwayTeam" FROM raw')
def mixed_dates(spark, sf):
    return raw(spark, sf).select("Season", labels.parse_raw_date(F.col("Date")).alias("Date"), "HomeTeam", "AwayTeam")


@register("p2_trimmed_referees", RAW + 'SELECT "Referee", count(*) n FROM raw GROUP BY "Referee"')
def trimmed_referees(spark, sf):
    return cleaned(spark, sf).groupBy("Referee").agg(F.count("*").alias("n"))


CORRECTED = """, once AS (
  SELECT "Season", "Date", "HomeTeam", "AwayTeam", min("AS") old, min(league) league FROM raw GROUP BY ALL HAVING count(*) = 1),
fix AS (SELECT * EXCLUDE (league) FROM once WHERE "Date" = (SELECT max("Date") FROM once o WHERE o."Season" = once."Season"))"""


def correction_rows(spark, sf):
    """Corrections taken from the data: each season's unique fixtures of its last day get AS + 10."""
    m = cleaned(spark, sf)
    once = m.groupBy(*quality.CORRECTION_KEY).agg(F.count("*").alias("n"), F.min("AS").alias("expected")).where("n = 1").drop("n")
    last = once.groupBy("Season").agg(F.max("Date").alias("Date"))
    return once.join(last, ["Season", "Date"]).select(
        *quality.CORRECTION_KEY, F.lit("AS").alias("column"), "expected", (F.col("expected") + 10).alias("new_value"),
        F.lit("test correction").alias("reason"))


@register("p3_point_corrections", RAW + CORRECTED + """ SELECT raw."Season", raw."Date"::VARCHAR "Date", raw."HomeTeam", raw."AwayTeam",
  coalesce(fix.old + 10, raw."AS")::BIGINT "AS", fix.old IS NOT NULL corrected
  FROM raw LEFT JOIN fix USING ("Season", "Date", "HomeTeam", "AwayTeam")""")
def point_corrections(spark, sf):
    m = cleaned(spark, sf)
    fixed, log = quality.apply_corrections(m, correction_rows(spark, sf))
    flag = log.select(*quality.CORRECTION_KEY, F.lit(True).alias("corrected"))
    return fixed.join(flag, quality.CORRECTION_KEY, "left").select(
        *quality.CORRECTION_KEY, "AS", F.coalesce("corrected", F.lit(False)).alias("corrected"))


RULE_SQL = RAW + """, d AS (SELECT *, "Date"::VARCHAR || ' ' || "HomeTeam" || ' v ' || "AwayTeam" who FROM raw)
SELECT "Season", 'home_equals_away' AS "rule", "Date"::VARCHAR || ' ' || "HomeTeam" detail FROM d WHERE "HomeTeam" = "AwayTeam"
UNION ALL SELECT "Season", 'negative_statistic', who FROM d WHERE least(""" + ", ".join(f'"{c}"' for c in S.RAW_COUNT_COLUMNS) + """) < 0
UNION ALL SELECT "Season", 'ftr_inconsistent', who || ' FTHG=' || "FTHG" || ' FTAG=' || "FTAG" || ' FTR=' || "FTR" FROM d
  WHERE "FTR" <> CASE WHEN "FTHG" > "FTAG" THEN 'H' WHEN "FTHG" < "FTAG" THEN 'A' ELSE 'D' END
UNION ALL SELECT "Season", 'htr_inconsistent', who || ' HTHG=' || "HTHG" || ' HTAG=' || "HTAG" || ' HTR=' || "HTR" FROM d
  WHERE "HTR" <> CASE WHEN "HTHG" > "HTAG" THEN 'H' WHEN "HTHG" < "HTAG" THEN 'A' ELSE 'D' END
UNION ALL SELECT "Season", 'hst_exceeds_hs', who || ' HS=' || "HS" || ' HST=' || "HST" FROM d WHERE "HST" > "HS"
UNION ALL SELECT "Season", 'ast_exceeds_as', who || ' AS=' || "AS" || ' AST=' || "AST" FROM d WHERE "AST" > "AS"
UNION ALL SELECT "Season", 'hthg_exceeds_fthg', who || ' FTHG=' || "FTHG" || ' HTHG=' || "HTHG" FROM d WHERE "HTHG" > "FTHG"
UNION ALL SELECT "Season", 'htag_exceeds_ftag', who || ' FTAG=' || "FTAG" || ' HTAG=' || "HTAG" FROM d WHERE "HTAG" > "FTAG\""""


@register("p4_row_rules", RULE_SQL)
def row_rules(spark, sf):
    return quality.row_violations(cleaned(spark, sf))


@register("p5_duplicate_matches", RAW + """SELECT "Season", 'duplicate_match' AS "rule", "Date"::VARCHAR || ' ' || "HomeTeam" || ' v ' || "AwayTeam" detail
FROM (SELECT *, count(*) OVER (PARTITION BY "Date", "HomeTeam", "AwayTeam") n FROM raw) WHERE n > 1""")
def duplicate_matches(spark, sf):
    return quality.duplicate_violations(cleaned(spark, sf))


@register("p6_batch_gate", RAW + """SELECT count(*) n_clean FROM raw WHERE "HST" <= "HS" AND "AST" <= "AS" AND "HTHG" <= "FTHG" AND "HTAG" <= "FTAG"
  AND "HomeTeam" <> "AwayTeam" AND least(""" + ", ".join(f'"{c}"' for c in S.RAW_COUNT_COLUMNS) + """) >= 0
  AND "FTR" = CASE WHEN "FTHG" > "FTAG" THEN 'H' WHEN "FTHG" < "FTAG" THEN 'A' ELSE 'D' END
  AND "HTR" = CASE WHEN "HTHG" > "HTAG" THEN 'H' WHEN "HTHG" < "HTAG" THEN 'A' ELSE 'D' END""")
def batch_gate(spark, sf):
    """The gate refuses the whole batch and accepts the rows no rule names."""
    m = cleaned(spark, sf)
    broken = F.lit(False)
    for condition, _ in quality.row_rules().values():
        broken = broken | F.coalesce(condition, F.lit(False))
    sound = m.where(~broken)
    quality.require_clean(quality.row_violations(sound))
    try:
        quality.require_clean(quality.row_violations(m))
    except ValueError:
        return sound.agg(F.count("*").alias("n_clean"))
    raise AssertionError("the gate let a broken batch pass")


@register("p7_season_calendar", RAW + """SELECT "Season", '' unexpected_years, count("Date") n_dated, true accepted FROM raw GROUP BY "Season" """)
def season_calendar(spark, sf):
    return quality.calendar_check(cleaned(spark, sf))


@register("p8_season_profile", RAW + """, t AS (SELECT DISTINCT "Season", unnest(["HomeTeam", "AwayTeam"]) team FROM raw),
debut AS (SELECT team, min("Season") "Season" FROM t GROUP BY team),
a AS (SELECT "Season", count(*) n_rows, min("Date")::VARCHAR date_min, max("Date")::VARCHAR date_max FROM raw GROUP BY "Season"),
b AS (SELECT "Season", count(*) n_teams FROM t GROUP BY "Season"), c AS (SELECT "Season", count(*) n FROM debut GROUP BY "Season")
SELECT "Season", n_rows, date_min, date_max, n_teams, coalesce(c.n, 0) n_new_teams,
  concat_ws('; ', CASE WHEN n_rows <> 380 THEN n_rows || ' rows found, expected 380' END,
                  CASE WHEN n_teams <> 20 THEN n_teams || ' unique teams found, expected 20' END) warnings
FROM a JOIN b USING ("Season") LEFT JOIN c USING ("Season")""")
def season_profile(spark, sf):
    return quality.season_profile(cleaned(spark, sf))


@register("p10_missingness", RAW + """SELECT "Season", 'Referee' AS "column", count(*) n_missing FROM raw WHERE "Referee" IS NULL GROUP BY "Season" """)
def missingness(spark, sf):
    return quality.missingness(cleaned(spark, sf))


@register("p12_result_mapping", f"WITH {Q.CONTESTS} SELECT match_id, CASE ftr WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END target, "
          "CASE ftr WHEN 'H' THEN 3.0 WHEN 'D' THEN 1.0 ELSE 0.0 END::DOUBLE home_points, CASE ftr WHEN 'A' THEN 3.0 WHEN 'D' THEN 1.0 ELSE 0.0 END::DOUBLE away_points, "
          "hscore home_score FROM contests")
def result_mapping(spark, sf):
    from touchline.operators import seasons

    ftr = F.col("ftr")
    return contests(spark, sf).select(
        "match_id", seasons.target(ftr).alias("target"), seasons._points(ftr, "H").alias("home_points"),
        seasons._points(ftr, "A").alias("away_points"), seasons._score(ftr, "H").alias("home_score"))


@register("u2_team_universe", f"WITH {Q.CONTESTS} SELECT home team FROM contests UNION SELECT away FROM contests")
def team_universe(spark, sf):
    return contests(spark, sf).select(F.explode(F.array("home", "away")).alias("team")).distinct()


@register("u3_new_teams", RAW + """SELECT team, min("Season") "Season" FROM (SELECT "Season", "HomeTeam" team FROM raw UNION ALL SELECT "Season", "AwayTeam" FROM raw) GROUP BY team""")
def new_teams(spark, sf):
    return quality.new_teams(cleaned(spark, sf))


@register("t1_total_order", f"WITH {Q.CONTESTS} SELECT row_number() OVER (ORDER BY match_date, home, away, match_id) pos, match_id FROM contests")
def total_order(spark, sf):
    from touchline.operators.ordering import with_position

    return with_position(contests(spark, sf).select("match_id", "match_date", "home", "away"),
                         ["match_date", "home", "away", "match_id"]).select("pos", "match_id")


@register("p23_output_types", f"WITH {Q.CONTESTS} SELECT match_id, fthg::DOUBLE fthg, ftag::BIGINT ftag, ftr = 'D' is_draw FROM contests")
def output_types(spark, sf):
    from touchline.operators.features import require_columns

    c = contests(spark, sf)
    require_columns(c)
    shaped = c.select("match_id", F.col("fthg").cast("double").alias("fthg"), F.col("ftag").cast("long").alias("ftag"),
                      (F.col("ftr") == "D").alias("is_draw"))
    from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

    return shaped.to(StructType([StructField("match_id", LongType()), StructField("fthg", DoubleType()),
                                 StructField("ftag", LongType()), StructField("is_draw", BooleanType())]))


@register("f1_season_labels", RAW + """SELECT DISTINCT "Season", yr "year", yr start_year, (yr // 100) * 100 + (yr + 1) % 100 end_year FROM raw""")
def season_labels(spark, sf):
    label = F.col("Season")
    return raw(spark, sf).select("Season").distinct().select(
        "Season", labels.season_key(label)["year"].alias("year"),
        labels.season_years(label)[0].alias("start_year"), labels.season_years(label)[1].alias("end_year"))
