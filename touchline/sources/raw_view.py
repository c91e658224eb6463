"""Contests rewritten as a raw season table: text columns, mixed date formats,
padded names, extra bookmaker columns and, here and there, broken rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import schema as S

EXTRA_COLUMNS = ["Div", "B365H", "MaxA"]


def raw_seasons(contests: DataFrame) -> DataFrame:
    c = F.col
    id_, season = c("match_id"), c("season")
    ht_home, ht_away = c("hst") % 3, c("ast") % 3
    text = {
        "Season": F.concat(season.cast("string"), F.lit("_"), F.lpad(((season + 1) % 100).cast("string"), 2, "0")),
        "Div": F.concat(F.lit("L"), c("league").cast("string")),
        "Date": F.when(season % 2 == 0, F.date_format("match_date", "dd/MM/yyyy")).otherwise(F.date_format("match_date", "dd/MM/yy")),
        "HomeTeam": F.concat(F.lit("Club "), c("home").cast("string")),
        "AwayTeam": F.concat(F.lit("Club "), c("away").cast("string")),
        "FTHG": c("fthg"), "FTAG": c("ftag"),
        "FTR": F.when(id_ % 211 == 0, "H").otherwise(c("ftr")),
        "HTHG": ht_home, "HTAG": ht_away,
        "HTR": F.when(id_ % 223 == 0, "D").when(ht_home > ht_away, "H").when(ht_home < ht_away, "A").otherwise("D"),
        "HS": F.when(id_ % 50 == 0, c("hs") - 8).otherwise(c("hs")), "AS": F.when(id_ % 70 == 0, c("as_") - 8).otherwise(c("as_")),
        "HST": c("hst"), "AST": c("ast"), "HF": c("hs") % 7, "AF": c("as_") % 7, "HC": c("hst"), "AC": c("ast"),
        "HY": c("hs") % 4, "AY": c("as_") % 4, "HR": F.lit(0), "AR": F.when(id_ % 307 == 0, -1).otherwise(0),
        "Referee": F.when(id_ % 101 != 0, F.concat(F.lit("  Ref "), (id_ % 17).cast("string"), F.lit(" "))),
        "B365H": c("hs") / 10, "MaxA": c("as_") / 10,
    }
    order = ["Season", *S.RAW_COLUMNS, *EXTRA_COLUMNS]
    return contests.select(*[text[k].cast("string").alias(k) for k in order])


RAW_SQL = """raw AS MATERIALIZED (
  SELECT match_id, season yr, match_date "Date", season || '_' || lpad(((season + 1) % 100)::VARCHAR, 2, '0') "Season",
    'Club ' || home "HomeTeam", 'Club ' || away "AwayTeam", fthg "FTHG", ftag "FTAG",
    CASE WHEN match_id % 211 = 0 THEN 'H' ELSE ftr END "FTR", hst % 3 "HTHG", ast % 3 "HTAG",
    CASE WHEN match_id % 223 = 0 THEN 'D' WHEN hst % 3 > ast % 3 THEN 'H' WHEN hst % 3 < ast % 3 THEN 'A' ELSE 'D' END "HTR",
    CASE WHEN match_id % 50 = 0 THEN hs - 8 ELSE hs END "HS", CASE WHEN match_id % 70 = 0 THEN as_ - 8 ELSE as_ END "AS",
    hst "HST", ast "AST", hs % 7 "HF", as_ % 7 "AF", hst "HC", ast "AC", hs % 4 "HY", as_ % 4 "AY", 0 "HR",
    CASE WHEN match_id % 307 = 0 THEN -1 ELSE 0 END "AR",
    CASE WHEN match_id % 101 <> 0 THEN 'Ref ' || (match_id % 17) END "Referee", league
  FROM contests)"""
