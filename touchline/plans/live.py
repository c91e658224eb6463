"""Queries over fixtures, provider JSON, snapshots and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import provider as P
from touchline.operators import live, teams
from touchline.plans import sqltext as Q
from touchline.plans.registry import register
from touchline.plans.text import club_rows
from touchline.session import fresh_path
from touchline.sources import provider_json
from touchline.sources.contests import contests, table

CODES = ["NS", "1H", "HT", "FT", "PST", "ET", "XX", "live"]
STATUS = ["SCHEDULED", "LIVE", "HALF_TIME", "FINISHED", "POSTPONED", "EXTRA_TIME", "UNKNOWN", "LIVE"]
DETAILS = [("Goal", "Normal Goal"), ("Goal", "Own Goal"), ("Goal", "Missed Penalty"), ("Goal", "Penalty"), ("Card", "Yellow Card"),
           ("Card", "Second Yellow card"), ("Card", "Red Card"), ("Card", "x"), ("subst", "Substitution 1"), ("Var", "Goal cancelled"), ("odd", "")]
TYPES = ["GOAL", "OWN_GOAL", "PENALTY_MISSED", "PENALTY_GOAL", "YELLOW_CARD", "SECOND_YELLOW_CARD", "RED_CARD", "UNKNOWN", "SUBSTITUTION", "VAR", "UNKNOWN"]


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def live_json_path(spark, sf):
    """Every contest as one live entry, written as JSON files."""
    id_ = F.col("match_id")
    name = lambda c: F.concat(F.lit("Club "), F.col(c).cast("string"), F.lit(" FC"))
    away_block = F.when(id_ % 5 == 0, F.concat(F.lit("Klub "), F.col("away").cast("string"))).otherwise(name("away"))
    item = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("string").alias("value"))
    stats = lambda s, t: F.array(
        item("Total Shots", F.col(s)), item(" shots on goal", F.col(t)), item("Ball Possession", F.concat((F.col(s) % 10 + 50).cast("string"), F.lit("%"))),
        item("Corner Kicks", F.lit(None)), item("Fouls", F.lit("abc")), item("Offsides", F.lit(-1)), item("Passes %", F.lit("130%")), item("Unknown label", F.lit(5)))
    block = lambda n, s: F.struct(F.struct(n.alias("name")).alias("team"), s.alias("statistics"))
    event = lambda k, team: F.struct(
        F.struct((id_ % 90).cast("int").alias("elapsed")).alias("time"), F.struct(team.alias("name")).alias("team"),
        F.struct(F.concat(F.lit("P"), F.col("home").cast("string")).alias("name")).alias("player"),
        pick([d[0] for d in DETAILS], k).alias("type"), pick([d[1] for d in DETAILS], k).alias("detail"))
    player = lambda n: F.struct(F.struct(n.alias("name"), F.lit(7).alias("number"), F.lit("M").alias("pos")).alias("player"))
    entry = contests(spark, sf).select(
        F.struct(id_.alias("id"), F.when(id_ % 2 == 0, F.date_format("match_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("date"),
                 F.unix_timestamp(F.col("match_date").cast("timestamp")).alias("timestamp"),
                 F.struct(pick(CODES, id_ % 8).alias("short"), F.when(id_ % 8 != 0, (id_ % 90).cast("int")).alias("elapsed")).alias("status")).alias("fixture"),
        F.struct(F.struct(name("home").alias("name")).alias("home"), F.struct(name("away").alias("name")).alias("away")).alias("teams"),
        F.struct(F.col("fthg").alias("home"), F.col("ftag").alias("away")).alias("goals"),
        F.array(event(id_ % 11, name("home")), event((id_ + 3) % 11, away_block)).alias("events"),
        F.array(F.struct(F.struct(name("home").alias("name")).alias("team"), F.lit("4-4-2").alias("formation"),
                         F.array(player(F.lit("A")), player(F.lit("")), player(F.lit("B"))).alias("startXI"),
                         F.struct(F.lit("C").alias("name")).alias("coach"))).alias("lineups"),
        F.when(id_ % 7 != 0, F.array(block(name("home"), stats("hs", "hst")), block(away_block, stats("as_", "ast")))).alias("statistics"),
        F.lit("2024-01-01T00:00:00.000Z").alias("fetched_at"))
    path = fresh_path(spark, "live-json")
    entry.write.json(path)
    return path


def live_json(spark, sf):
    return provider_json.read_live(spark, live_json_path(spark, sf))


def aliases(spark, sf):
    return teams.alias_table(club_rows(spark, sf))


SQL_STATUS = "['" + "', '".join(STATUS) + "'][match_id % 8 + 1]"
SQL_TYPES = "['" + "', '".join(TYPES) + "']"


@register("s9_r1_live_fixtures", f"WITH {Q.CONTESTS} SELECT match_id::VARCHAR fixture_id, 'club_' || home home_id, 'club_' || away away_id, "
          f"strftime(match_date, '%Y-%m-%d %H:%M:%S.%f') kickoff, {SQL_STATUS} status, coalesce(CASE WHEN match_id % 8 <> 0 THEN match_id % 90 END, -1) AS \"minute\", "
          "fthg::BIGINT home_score, ftag::BIGINT away_score FROM contests")
def live_fixtures(spark, sf):
    f = live.parse_live_fixtures(live_json(spark, sf), aliases(spark, sf), "2024_25")
    return f.where("problem is null").select("fixture_id", "home_id", "away_id", "kickoff", "status", F.coalesce("minute", F.lit(-1)).alias("minute"), "home_score", "away_score")


@register("f15_f20_events", f"""WITH {Q.CONTESTS} SELECT match_id::VARCHAR fixture_id, 0 place, {SQL_TYPES}[match_id % 11 + 1] "type", match_id % 90 "minute", 'club_' || home team_id, 'P' || home player FROM contests
UNION ALL SELECT match_id::VARCHAR, 1, {SQL_TYPES}[(match_id + 3) % 11 + 1], match_id % 90, CASE WHEN match_id % 5 <> 0 THEN 'club_' || away END, 'P' || home FROM contests""")
def live_events(spark, sf):
    return live.parse_events(live_json(spark, sf), aliases(spark, sf)).select("fixture_id", "place", "type", "minute", "team_id", "player")


@register("f20_lineups", f"WITH {Q.CONTESTS} SELECT match_id::VARCHAR fixture_id, 'club_' || home team_id, '4-4-2' formation, 'C' coach, 'A,B' players, 0 n_substitutes FROM contests")
def live_lineups(spark, sf):
    return live.parse_lineups(live_json(spark, sf), aliases(spark, sf)).select(
        "fixture_id", "team_id", "formation", "coach", F.array_join(F.transform("starting_xi", lambda p: p["name"]), ",").alias("players"),
        F.size("substitutes").alias("n_substitutes"))


_STAT = "CASE WHEN match_id % 7 <> 0{e} THEN {v} END"


@register("f13_f14_j11_statistics", f"""WITH {Q.CONTESTS} SELECT match_id::VARCHAR fixture_id, match_id % 7 <> 0 has_home, match_id % 7 <> 0 AND match_id % 5 <> 0 has_away,
  coalesce({_STAT.format(e='', v='hs')}, -1)::BIGINT home_shots, coalesce({_STAT.format(e='', v='hst')}, -1)::BIGINT home_on_target, coalesce({_STAT.format(e='', v='50.0 + hs % 10')}, -1)::DOUBLE home_possession,
  coalesce({_STAT.format(e=' AND match_id % 5 <> 0', v='as_')}, -1)::BIGINT away_shots, -1 home_corners, -1 home_fouls, -1 home_offsides, coalesce({_STAT.format(e='', v='100.0')}, -1)::DOUBLE home_pass_accuracy FROM contests""")
def live_statistics(spark, sf):
    s = live.parse_snapshots(live_json(spark, sf), aliases(spark, sf), "2024_25")
    n = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return s.select(
        "fixture_id", F.col("home_stats").isNotNull().alias("has_home"), F.col("away_stats").isNotNull().alias("has_away"),
        n("home_stats.shots").alias("home_shots"), n("home_stats.shots_on_target").alias("home_on_target"), n("home_stats.possession_percent").alias("home_possession"),
        n("away_stats.shots").alias("away_shots"), n("home_stats.corners").alias("home_corners"), n("home_stats.fouls").alias("home_fouls"),
        n("home_stats.offsides").alias("home_offsides"), n("home_stats.pass_accuracy_percent").alias("home_pass_accuracy"))


ORG = ["TIMED", "IN_PLAY", "PAUSED", "FINISHED", "POSTPONED", "AWARDED", "odd"]
ORG_STATUS = ["SCHEDULED", "LIVE", "HALF_TIME", "FINISHED", "POSTPONED", "FINISHED", "UNKNOWN"]


@register("s9_f12_f16_schedule", f"""WITH {Q.CONTESTS} SELECT match_id::VARCHAR fixture_id, 'club_' || home home_id, CASE WHEN match_id % 13 <> 0 THEN 'club_' || away END away_id,
  ['{"', '".join(ORG_STATUS)}'][match_id % 7 + 1] status, strftime(match_date, '%Y-%m-%d %H:%M:%S.%f') kickoff, CASE WHEN match_id % 13 = 0 THEN 'no usable team names' END problem FROM contests""")
def schedule_feed(spark, sf):
    """The schedule feed: one document per league and season, names falling back to the short one."""
    id_ = F.col("match_id")
    name = lambda c: F.concat(F.lit("Club "), F.col(c).cast("string"))
    match = F.struct(
        id_.alias("id"), F.date_format("match_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utcDate"), pick(ORG, id_ % 7).alias("status"),
        F.struct(name("home").alias("name")).alias("homeTeam"),
        F.struct(F.when(id_ % 13 == 0, "").alias("name"), F.when(id_ % 13 != 0, name("away")).alias("shortName")).alias("awayTeam"),
        F.struct(F.struct(F.col("fthg").alias("home"), F.col("ftag").alias("away")).alias("fullTime")).alias("score"))
    path = fresh_path(spark, "schedule-json")
    contests(spark, sf).select(F.array(match).alias("matches")).write.json(path)
    f = live.parse_schedule(provider_json.read_fixtures(spark, path), aliases(spark, sf), "2024_25")
    return f.select("fixture_id", "home_id", "away_id", "status", "kickoff", "problem")


TABLE_SQL = f"""WITH {Q.TEAM_ROWS}, t AS (SELECT league, season, team, count(*) played, count(*) FILTER (WHERE pts = 3) won, count(*) FILTER (WHERE pts = 1) drawn,
  count(*) FILTER (WHERE pts = 0) lost, sum(gf)::BIGINT goals_for, sum(ga)::BIGINT goals_against, sum(pts)::BIGINT points, sum(gf - ga)::BIGINT goal_difference FROM tr GROUP BY ALL),
lt AS (SELECT *, rank() OVER (PARTITION BY league, season ORDER BY points DESC, goal_difference DESC, goals_for DESC) position FROM t) """


@register("a22_league_table", TABLE_SQL + "SELECT * FROM lt")
def league_table(spark, sf):
    return live.league_table(contests(spark, sf))


@register("s9_standings_feed", TABLE_SQL + "SELECT 'Club ' || team team, position, points, goal_difference, played FROM lt")
def standings_feed(spark, sf):
    t = live.league_table(contests(spark, sf))
    row = F.struct("position", F.struct(F.concat(F.lit("Club "), F.col("team").cast("string")).alias("name")).alias("team"), F.col("played").alias("playedGames"),
                   "won", F.col("drawn").alias("draw"), "lost", F.col("goals_for").alias("goalsFor"), F.col("goals_against").alias("goalsAgainst"),
                   F.col("goal_difference").alias("goalDifference"), "points")
    groups = F.array(*[F.struct(F.lit(k).alias("type"), F.array(row).alias("table")) for k in ("HOME", "TOTAL")])
    path = fresh_path(spark, "standings-json")
    t.select(groups.alias("standings")).write.json(path)
    s = provider_json.read_standings(spark, path)
    return s.select(F.col("team.name").alias("team"), "position", "points", F.col("goalDifference").alias("goal_difference"), F.col("playedGames").alias("played"))


def fixtures(spark, sf):
    return contests(spark, sf).select(
        F.col("match_id").alias("fixture_id"), F.col("home").alias("home_id"), F.col("away").alias("away_id"), F.col("match_date").cast("timestamp").alias("kickoff"),
        pick(STATUS, F.col("match_id") % 8).alias("status"))


FIX = f"WITH {Q.CONTESTS}, fx AS (SELECT match_id fixture_id, home home_id, away away_id, match_date::TIMESTAMP kickoff, {SQL_STATUS} status FROM contests) "
COLS = "fixture_id, home_id, away_id, strftime(kickoff, '%Y-%m-%d %H:%M:%S.%f') kickoff, status"


@register("p16_fixture_filters", FIX + f"SELECT {COLS} FROM fx WHERE (home_id = 3 OR away_id = 3) AND status = 'LIVE' AND kickoff >= '1996-01-01' AND kickoff <= '2000-06-30'")
def fixture_filters(spark, sf):
    return live.filter_fixtures(fixtures(spark, sf), team=3, status="LIVE", date_from="1996-01-01", date_to="2000-06-30")


@register("p17_upcoming", FIX + f"SELECT {COLS} FROM fx WHERE kickoff >= '2001-06-01'")
def upcoming(spark, sf):
    return live.upcoming(fixtures(spark, sf), "2001-06-01")


@register("p17_t3_recent_results", FIX + f"SELECT {COLS} FROM fx WHERE status = 'FINISHED' ORDER BY kickoff DESC, fixture_id LIMIT 25")
def recent(spark, sf):
    return live.recent(fixtures(spark, sf), limit=25)


@register("p17_team_recent", FIX + f"SELECT {COLS} FROM fx WHERE status = 'FINISHED' AND (home_id = 4 OR away_id = 4) ORDER BY kickoff DESC, fixture_id LIMIT 5")
def team_recent(spark, sf):
    return live.recent(fixtures(spark, sf), team=4, limit=5)


@register("p18_status_sets", FIX + "SELECT status, count(*) FILTER (WHERE status IN ('LIVE', 'HALF_TIME', 'EXTRA_TIME', 'PENALTIES')) n_in_play, "
          "count(*) FILTER (WHERE status IN ('POSTPONED', 'SUSPENDED', 'ABANDONED', 'CANCELLED')) n_not_played FROM fx GROUP BY status")
def status_sets(spark, sf):
    s = F.col("status")
    return fixtures(spark, sf).groupBy("status").agg(F.count_if(live.in_play(s)).alias("n_in_play"), F.count_if(live.not_played(s)).alias("n_not_played"))


def snapshots(spark, sf):
    """Snapshots from the event log: one fixture per user."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("fixture_id"), F.col("ts").alias("fetched_at"), "event_id",
        F.when(F.col("event_type") == "click", "LIVE").when(F.col("event_type") == "view", "HALF_TIME").when(F.col("event_type") == "purchase", "FINISHED").otherwise("SCHEDULED").alias("status"),
        F.from_json("props", "k int")["k"].alias("minute"), F.floor("value").cast("int").alias("home_score"))


SNAP = """WITH snap AS (SELECT user_id fixture_id, ts fetched_at, event_id, CASE event_type WHEN 'click' THEN 'LIVE' WHEN 'view' THEN 'HALF_TIME' WHEN 'purchase' THEN 'FINISHED' ELSE 'SCHEDULED' END status,
  (props::JSON->>'k')::INT AS "minute", floor(value)::INT home_score FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY fetched_at DESC, event_id DESC) rn FROM snap) WHERE rn = 1) """
AT = "strftime(fetched_at, '%Y-%m-%d %H:%M:%S.%f')"


@register("r2_latest_snapshot", SNAP + f"SELECT fixture_id, {AT} fetched_at, event_id, status, \"minute\"::BIGINT AS \"minute\", home_score::BIGINT home_score FROM latest")
def latest(spark, sf):
    return live.latest_snapshots(snapshots(spark, sf), ["fixture_id"], "fetched_at", "event_id")


@register("r3_r8_f17_provenance", SNAP + f"""SELECT fixture_id, {AT} fetched_at, 'api_football' provider, 'REPLAY' source_kind, 300 ttl_seconds, {AT} last_successful_refresh,
  round(greatest(0, epoch_us(TIMESTAMP '2024-01-30 23:55:00') - epoch_us(fetched_at)) / 1e6, 6) cache_age_seconds, greatest(0, epoch_us(TIMESTAMP '2024-01-30 23:55:00') - epoch_us(fetched_at)) >= 300000000 is_stale FROM latest""")
def provenance(spark, sf):
    rows = live.latest_snapshots(snapshots(spark, sf), ["fixture_id"], "fetched_at", "event_id").select("fixture_id", "fetched_at")
    return live.with_freshness(rows, F.lit("2024-01-30 23:55:00").cast("timestamp_ntz"), "fetched_at", P.LIVE_TTL_SECONDS, "api_football", replay=True)


@register("r5_in_play", SNAP + "SELECT fixture_id, status, \"minute\"::BIGINT AS \"minute\" FROM latest WHERE status IN ('LIVE', 'HALF_TIME')")
def in_play(spark, sf):
    rows = live.latest_snapshots(snapshots(spark, sf), ["fixture_id"], "fetched_at", "event_id")
    return rows.where(live.in_play(F.col("status"))).select("fixture_id", "status", "minute")


@register("j13_as_of_lookup", """WITH reads AS (SELECT event_id read_id, user_id, ts FROM events WHERE event_type = 'error'), snap AS (SELECT user_id, ts, max(event_id) event_id, max_by(value, event_id) AS "value" FROM events WHERE event_type <> 'error' GROUP BY ALL),
j AS (SELECT r.read_id, r.user_id, r.ts rt, s.ts st, s.event_id, s."value" FROM reads r ASOF LEFT JOIN snap s ON s.user_id = r.user_id AND r.ts >= s.ts)
SELECT read_id, user_id, coalesce(event_id, -1) snapshot_id, coalesce(round("value", 6), -1) AS "value", coalesce(strftime(st, '%Y-%m-%d %H:%M:%S.%f'), 'none') snapshot_at, coalesce(round((epoch_us(rt) - epoch_us(st)) / 1e6, 6), -1) age_seconds,
  coalesce((epoch_us(rt) - epoch_us(st) >= 1800000000)::INT, -1) is_stale, CASE WHEN st IS NULL THEN 'no snapshot' END problem FROM j""")
def as_of_lookup(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    reads = e.where("event_type = 'error'").withColumnRenamed("event_id", "read_id")
    out = live.as_of(reads, e.where("event_type <> 'error'"), "user_id", "ts", ["value", "event_id"], P.SLOW_TTL_SECONDS, tie="event_id")
    return out.select("read_id", "user_id", F.coalesce("event_id", F.lit(-1)).alias("snapshot_id"), F.coalesce("value", F.lit(-1.0)).alias("value"), F.coalesce(F.date_format("snapshot_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("none")).alias("snapshot_at"),
                      F.coalesce("age_seconds", F.lit(-1.0)).alias("age_seconds"), F.coalesce("is_stale", F.lit(-1)).alias("is_stale"), "problem")


@register("p22_live_constraints", """WITH b AS (SELECT event_id, user_id % 7 h, event_id % 7 a, (props::JSON->>'k')::INT - 2 mi, floor(value)::INT - 3 hs, value possession, event_id % 40 pos, ts FROM events)
SELECT event_id, 'same_club' AS "rule" FROM b WHERE h = a UNION ALL SELECT event_id, 'negative_minute' FROM b WHERE mi < 0 UNION ALL SELECT event_id, 'negative_score' FROM b WHERE hs < 0
UNION ALL SELECT event_id, 'negative_statistic' FROM b WHERE event_id % 9 = 0
UNION ALL SELECT event_id, 'percent_range' FROM b WHERE possession > 100 OR possession < 0 OR event_id % 103 > 100 UNION ALL SELECT event_id, 'position_below_one' FROM b WHERE pos < 1
UNION ALL SELECT event_id, 'fetched_after_read' FROM b WHERE ts > TIMESTAMP '2024-01-30'""")
def live_constraints(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select("event_id", (F.col("user_id") % 7).alias("home_id"), (F.col("event_id") % 7).alias("away_id"),
                    (F.from_json("props", "k int")["k"] - 2).alias("minute"), (F.floor("value") - 3).alias("home_score"), F.lit(0).alias("away_score"),
                    *[F.lit(None).cast("int").alias(n) for n in live.STATISTIC_COUNTS[2:]], (F.col("event_id") % 9 - 1).alias("shots"),
                    F.lit(None).cast("int").alias("shots_on_target"), (F.col("event_id") % 103).alias("pass_accuracy"),
                    F.col("value").alias("possession"), (F.col("event_id") % 40).alias("position"), F.col("ts").alias("fetched_at"),
                    F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").alias("read_at"))
    return live.constraint_violations(live.live_rules(), rows, ["event_id"])
