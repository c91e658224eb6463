"""The club table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLUB_SCHEMA = ("canonical_id string, canonical_name string, historical_names array<string>, aliases array<string>, "
               "provider_ids map<string,string>, has_history boolean")

# --- Fixed values -----------------------------------------------------------
# canonical id; canonical name; historical spellings; aliases; id at football_data_org
CLUBS = [
    ("arsenal", "Arsenal", ["Arsenal"], ["Arsenal FC"], "57"),
    ("aston_villa", "Aston Villa", ["Aston Villa"], ["Aston Villa FC", "Villa"], "58"),
    ("bournemouth", "Bournemouth", ["Bournemouth"], ["AFC Bournemouth", "Bournemouth AFC"], "1044"),
    ("brentford", "Brentford", ["Brentford"], ["Brentford FC"], "402"),
    ("brighton", "Brighton & Hove Albion", ["Brighton"],
     ["Brighton & Hove Albion FC", "Brighton and Hove Albion", "Brighton Hove Albion"], "397"),
    ("burnley", "Burnley", ["Burnley"], ["Burnley FC"], None),
    ("cardiff", "Cardiff City", ["Cardiff"], ["Cardiff City FC"], None),
    ("chelsea", "Chelsea", ["Chelsea"], ["Chelsea FC"], "61"),
    ("coventry_city", "Coventry City", [], ["Coventry City FC", "Coventry"], "1076"),
    ("crystal_palace", "Crystal Palace", ["Crystal Palace"], ["Crystal Palace FC"], "354"),
    ("everton", "Everton", ["Everton"], ["Everton FC"], "62"),
    ("fulham", "Fulham", ["Fulham"], ["Fulham FC"], "63"),
    ("huddersfield", "Huddersfield Town", ["Huddersfield"], ["Huddersfield Town AFC", "Huddersfield Town FC"], None),
    ("hull", "Hull City", ["Hull"], ["Hull City AFC", "Hull City FC"], "322"),
    ("ipswich", "Ipswich Town", ["Ipswich"], ["Ipswich Town FC"], "349"),
    ("leeds", "Leeds United", ["Leeds"], ["Leeds United FC", "Leeds Utd"], "341"),
    ("leicester", "Leicester City", ["Leicester"], ["Leicester City FC"], None),
    ("liverpool", "Liverpool", ["Liverpool"], ["Liverpool FC"], "64"),
    ("luton", "Luton Town", ["Luton"], ["Luton Town FC"], None),
    ("man_city", "Manchester City", ["Man City"], ["Manchester City FC", "Man. City"], "65"),
    ("man_united", "Manchester United", ["Man United"],
     ["Manchester United FC", "Man Utd", "Man. United", "Manchester Utd"], "66"),
    ("middlesbrough", "Middlesbrough", ["Middlesbrough"], ["Middlesbrough FC"], None),
    ("newcastle", "Newcastle United", ["Newcastle"], ["Newcastle United FC", "Newcastle Utd"], "67"),
    ("norwich", "Norwich City", ["Norwich"], ["Norwich City FC"], None),
    ("nottingham_forest", "Nottingham Forest", ["Nott'm Forest"],
     ["Nottingham Forest FC", "Nottm Forest", "Notts Forest"], "351"),
    ("sheffield_united", "Sheffield United", ["Sheffield United"], ["Sheffield United FC", "Sheffield Utd"], None),
    ("southampton", "Southampton", ["Southampton"], ["Southampton FC"], None),
    ("stoke", "Stoke City", ["Stoke"], ["Stoke City FC"], None),
    ("sunderland", "Sunderland", ["Sunderland"], ["Sunderland AFC", "Sunderland FC"], "71"),
    ("swansea", "Swansea City", ["Swansea"], ["Swansea City AFC", "Swansea City FC"], None),
    ("tottenham", "Tottenham Hotspur", ["Tottenham"], ["Tottenham Hotspur FC", "Spurs"], "73"),
    ("watford", "Watford", ["Watford"], ["Watford FC"], None),
    ("west_brom", "West Bromwich Albion", ["West Brom"],
     ["West Bromwich Albion FC", "West Bromwich Albion", "West Bromwich"], None),
    ("west_ham", "West Ham United", ["West Ham"], ["West Ham United FC", "West Ham Utd"], None),
    ("wolves", "Wolverhampton Wanderers", ["Wolves"], ["Wolverhampton Wanderers FC", "Wolverhampton"], None),
]
WITHOUT_HISTORY = ["coventry_city"]
PROVIDER = "football_data_org"
# --- End of fixed values ----------------------------------------------------


def club_table(spark: SparkSession) -> DataFrame:
    rows = [(i, n, h, a, {PROVIDER: p} if p else {}, i not in WITHOUT_HISTORY) for i, n, h, a, p in CLUBS]
    return spark.createDataFrame(rows, CLUB_SCHEMA)
