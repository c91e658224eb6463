"""Queries over seasons, causal parameters, form, ratings and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import schema as S
from touchline.operators import causal, elo, features, form, seasons
from touchline.plans import sqltext as Q
from touchline.plans.models import feature_table
from touchline.plans.registry import r, register
from touchline.sources.contests import contests


def indexed(spark, sf):
    return seasons.with_season_index(contests(spark, sf))


@register("a3_season_order", f"WITH {Q.INDEXED} SELECT league, season::BIGINT season, first_date::VARCHAR first_date, "
          "last_date::VARCHAR last_date, n_matches, season_idx FROM sidx")
def season_order(spark, sf):
    return seasons.season_index(contests(spark, sf))


@register("a1_team_rows", f"WITH {Q.TEAM_ROWS} SELECT match_id, league, season, match_date::VARCHAR match_date, home, away, "
          "is_home, team, opponent, gf::BIGINT gf, ga::BIGINT ga, sot_for::BIGINT sot_for, sot_against::BIGINT sot_against, "
          "shots_for::BIGINT shots_for, shots_against::BIGINT shots_against, pts, score FROM tr")
def team_rows(spark, sf):
    return seasons.team_rows(contests(spark, sf))


@register("a2_team_seasons", f"WITH {Q.TEAM_ROWS} SELECT league, season, season_idx, team, {r('avg(score)')} mean_score, "
          f"{r('avg(pts)')} ppg, count(*) n FROM tr GROUP BY league, season, season_idx, team")
def team_season_means(spark, sf):
    return seasons.team_seasons(indexed(spark, sf))


@register("a8_rosters", f"WITH {Q.CONTESTS} SELECT league, season, team FROM (SELECT league, season, home team FROM contests "
          "UNION SELECT league, season, away FROM contests)")
def roster(spark, sf):
    return seasons.rosters(contests(spark, sf))


@register("w1_spells", f"WITH {Q.TEAM_SEASONS} SELECT league, season, season_idx, team, kind, spell::BIGINT spell, "
          "kind <> 'continuing' is_newcomer, kind = 'new' AND season_idx > 0 is_debut, kind = 'stale' is_returning FROM ts")
def spells(spark, sf):
    ts = seasons.classify_team_seasons(seasons.team_seasons(indexed(spark, sf)))
    return ts.select("league", "season", "season_idx", "team", "kind", "spell", "is_newcomer", "is_debut", "is_returning")


@register("j3_newcomers_previous_season", f"WITH {Q.TEAM_SEASONS} SELECT a.league, a.season, a.team FROM ts a WHERE a.season_idx > 0 "
          "AND NOT EXISTS (SELECT 1 FROM ts b WHERE b.league = a.league AND b.team = a.team AND b.season_idx = a.season_idx - 1)")
def newcomers_previous(spark, sf):
    ts = seasons.team_seasons(indexed(spark, sf)).select("league", "season", "season_idx", "team")
    follow = ts.select("league", "team", (F.col("season_idx") + 1).alias("season_idx"))
    return ts.where("season_idx > 0").join(follow, ["league", "team", "season_idx"], "left_anti").select("league", "season", "team")


@register("j4_newcomers_all_history", f"WITH {Q.TEAM_SEASONS} SELECT league, season, team FROM ts a WHERE season_idx > 0 "
          "AND NOT EXISTS (SELECT 1 FROM ts b WHERE b.league = a.league AND b.team = a.team AND b.season_idx < a.season_idx)")
def newcomers_debut(spark, sf):
    ts = seasons.classify_team_seasons(seasons.team_seasons(indexed(spark, sf)))
    return ts.where("is_debut").select("league", "season", "team")


@register("j2_team_season_flags", f"WITH {Q.TEAM_SEASONS} SELECT a.league, a.season, a.team, {r('a.ppg')} ppg, "
          "b.team IS NULL is_newcomer FROM ts a LEFT JOIN ts b ON b.league = a.league AND b.team = a.team AND b.season_idx = a.season_idx - 1")
def team_season_flags(spark, sf):
    ts = seasons.team_seasons(indexed(spark, sf))
    flag = ts.select("league", "team", (F.col("season_idx") + 1).alias("season_idx"), F.lit(True).alias("was_there"))
    return ts.join(flag, ["league", "team", "season_idx"], "left").select(
        "league", "season", "team", "ppg", F.col("was_there").isNull().alias("is_newcomer"))


@register("j5_consecutive_seasons", f"WITH {Q.TEAM_SEASONS} SELECT b.league, b.team, b.season, {r('a.ppg')} ppg_prev, {r('b.ppg')} ppg_next "
          "FROM ts a JOIN ts b ON b.league = a.league AND b.team = a.team AND b.season_idx = a.season_idx + 1")
def consecutive_seasons(spark, sf):
    ts = seasons.team_seasons(indexed(spark, sf))
    prev = ts.select("league", "team", (F.col("season_idx") + 1).alias("season_idx"), F.col("ppg").alias("ppg_prev"))
    return ts.join(prev, ["league", "team", "season_idx"]).select(
        "league", "team", "season", "ppg_prev", F.col("ppg").alias("ppg_next"))


@register("a7_parameter_schedule", f"WITH {Q.SCHEDULE} SELECT league, season, season_idx, status, {r('home_advantage')} home_advantage, "
          f"{r('season_shrink')} season_shrink, {r('promoted_delta')} promoted_delta, k_factor, initial_rating, "
          "CASE WHEN season_idx < 3 THEN 0 ELSE season_idx END n_source_seasons FROM schedule")
def parameter_schedule(spark, sf):
    s = causal.parameter_schedule(contests(spark, sf), strict=True)
    return s.withColumn("n_source_seasons", F.size("estimated_from")).drop("estimated_from")


@register("a4_home_advantage", f"WITH {Q.INDEXED} SELECT a.league, a.season, {r('-400 * log10(1 / avg(b.hscore) - 1)')} home_advantage "
          "FROM sidx a JOIN m b ON b.league = a.league AND b.season_idx <= a.season_idx GROUP BY a.league, a.season")
def home_advantage(spark, sf):
    return causal.home_advantage_through(contests(spark, sf))


@register("a5_promoted_prior", f"WITH {Q.TEAM_SEASONS} SELECT a.league, a.season, count(*) n_newcomers, "
          f"{r('-400 * log10(1 / avg(b.mean_score) - 1)')} promoted_delta FROM sidx a JOIN ts b ON b.league = a.league "
          "AND b.season_idx <= a.season_idx AND b.season_idx > 0 AND b.kind <> 'continuing' GROUP BY a.league, a.season")
def promoted_prior(spark, sf):
    return causal.promoted_prior_through(contests(spark, sf))


@register("a6_season_shrink", f"WITH {Q.TEAM_SEASONS} SELECT a.league, a.season, count(*) n_pairs, {r('regr_slope(b.ppg, b.prev_ppg)')} season_shrink "
          "FROM sidx a JOIN ts b ON b.league = a.league AND b.season_idx <= a.season_idx AND b.prev_idx = b.season_idx - 1 "
          "AND b.prev_idx >= 1 GROUP BY a.league, a.season")
def season_shrink(spark, sf):
    return causal.season_shrink_through(contests(spark, sf))


@register("p21_schedule_violations", f"WITH {Q.SCHEDULE}, src AS (SELECT a.league, a.season, b.season source FROM schedule a "
          "JOIN schedule b ON b.league = a.league AND a.season_idx >= 3 AND b.season_idx < a.season_idx) "
          "SELECT league, season::VARCHAR season, CASE WHEN source >= 2000 THEN 'sealed_source' ELSE 'not_causal' END AS rule, "
          "source::VARCHAR detail FROM src WHERE source >= 2000 OR source >= season")
def schedule_violations(spark, sf):
    s = causal.parameter_schedule(contests(spark, sf))
    return causal.schedule_violations(s, sealed_from=2000)


@register("j6_parameter_lookup", f"WITH {Q.SCHEDULE} SELECT match_id, {r('home_advantage')} home_advantage, {r('season_shrink')} season_shrink, "
          f"{r('promoted_delta')} promoted_delta FROM m JOIN schedule USING (league, season_idx)")
def parameter_lookup(spark, sf):
    c = contests(spark, sf)
    s = causal.parameter_schedule(c).select("league", "season", "home_advantage", "season_shrink", "promoted_delta")
    return c.select("match_id", "league", "season").join(s, ["league", "season"]).drop("league", "season")


FORM_SQL = ", ".join(r(c) + f" {c}" for c in [f"ewma_{m}" for m in form.EWMA_NAMES] + ["std_ppg", "std_gd", "sot_ratio", "conversion"])


@register("w3_w7_team_form", f"WITH {Q.FORM}, f AS (SELECT league, season_idx, match_date, team, {Q.FORM_COLUMNS} FROM form) "
          f"SELECT DISTINCT league, season_idx, match_date::VARCHAR match_date, team, matches_played_season, prior_matches_all_time, "
          f"rest_days, is_returning, {FORM_SQL}, history_depth, is_cold_start FROM f")
def team_form(spark, sf):
    state = form.team_state(form.team_days(indexed(spark, sf)))
    return state.drop("spell")


@register("w4_season_to_date", f"WITH {Q.TEAM_ROWS} SELECT match_id, team, {r('avg(pts) OVER se')} std_ppg, {r('avg(gf - ga) OVER se')} std_gd "
          "FROM tr WINDOW se AS (PARTITION BY league, team, season_idx ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def season_to_date(spark, sf):
    m = indexed(spark, sf)
    state = form.team_state(form.team_days(m)).select(*form.DAY_KEY, "std_ppg", "std_gd")
    rows = seasons.team_rows(m, "season_idx").select("match_id", *form.DAY_KEY)
    return rows.join(state, form.DAY_KEY).select("match_id", "team", "std_ppg", "std_gd")


@register("w9_first_seen_teams", f"WITH {Q.TEAM_ROWS} SELECT league, min(season) season, team FROM tr GROUP BY league, team")
def first_seen(spark, sf):
    ts = seasons.classify_team_seasons(seasons.team_seasons(indexed(spark, sf)))
    return ts.where("kind = 'new'").select("league", "season", "team")


@register("e1_elo_ratings", f"WITH {Q.elo()} SELECT league, season_idx, match_date::VARCHAR match_date, team, {r('elo')} elo FROM rating")
def elo_ratings(spark, sf):
    c = contests(spark, sf)
    return elo.ratings(c, causal.parameter_schedule(c, strict=True))


@register("e3_elo_fixed_parameters", f"WITH {Q.elo(Q.FIXED_SCHEDULE)} SELECT league, season_idx, match_date::VARCHAR match_date, team, {r('elo')} elo FROM rating")
def elo_fixed(spark, sf):
    c = contests(spark, sf)
    return elo.ratings(c, causal.constant_schedule(c, 60.0, 0.75, -80.0))


@register("e4_elo_by_levels", f"WITH {Q.elo()} SELECT league, season_idx, match_date::VARCHAR match_date, team, {r('elo')} elo FROM rating")
def elo_by_levels(spark, sf):
    c = contests(spark, sf)
    return elo.ratings_by_levels(c, causal.parameter_schedule(c, strict=True))


# The day of a team is reached by the longest chain of contests: a step of the recursion is a level.
@register("e4_contest_levels", f"""WITH RECURSIVE {Q.INDEXED}, g AS MATERIALIZED (SELECT DISTINCT league, season_idx, match_date d, home, away FROM m),
td AS (SELECT *, lag(d) OVER (PARTITION BY league, season_idx, team ORDER BY d) before FROM (SELECT DISTINCT league, season_idx, unnest([home, away]) team, d FROM g)),
need AS MATERIALIZED (SELECT DISTINCT g.league, g.season_idx, g.d, g.home, g.away, p.d pd, p.home ph, p.away pa FROM g JOIN td t ON t.league = g.league AND t.season_idx = g.season_idx AND t.d = g.d AND t.team IN (g.home, g.away)
  JOIN g p ON p.league = t.league AND p.season_idx = t.season_idx AND p.d = t.before AND t.team IN (p.home, p.away)),
reach(league, season_idx, d, home, away, level) AS (
  SELECT league, season_idx, d, home, away, 1 FROM g
  UNION SELECT n.league, n.season_idx, n.d, n.home, n.away, r.level + 1 FROM reach r JOIN need n ON n.league = r.league AND n.season_idx = r.season_idx AND n.pd = r.d AND n.ph = r.home AND n.pa = r.away),
deep AS (SELECT league, season_idx, d, home, away, max(level) level FROM reach GROUP BY ALL)
SELECT league, season_idx, level, count(*) n_pairs, min(d)::VARCHAR first_day, max(d)::VARCHAR last_day FROM deep GROUP BY ALL""")
def contest_levels(spark, sf):
    levels = elo.contest_levels(elo.pair_days(indexed(spark, sf)))
    return levels.groupBy("league", "season_idx", "level").agg(F.count("*").alias("n_pairs"), F.min("match_date").alias("first_day"), F.max("match_date").alias("last_day"))


def feature_select(columns):
    out = []
    for c in columns:
        if c in S.FEATURE_COLUMNS or c.endswith("rest_days"):
            out.append(f"{r(c)} {c}")
        elif c == "match_date":
            out.append("match_date::VARCHAR match_date")
        else:
            out.append(c)
    return ", ".join(out)


ALL_FEATURES = ["match_id", "league", *S.METADATA_COLUMNS, *S.FEATURE_COLUMNS, "ftr", "target"]


@register("features_full", f"WITH {Q.FEATURES} SELECT {feature_select(ALL_FEATURES)} FROM features")
def features_full(spark, sf):
    return features.build_features(contests(spark, sf))


@register("j7_team_state_both_sides", f"WITH {Q.FORM}, s AS (SELECT DISTINCT league, match_date, team, {Q.FORM_COLUMNS} FROM form) "
          f"SELECT m.match_id, {r('h.ewma_gf')} home_ewma_gf, {r('a.ewma_gf')} away_ewma_gf, h.history_depth home_history_depth, "
          "a.history_depth away_history_depth FROM m JOIN s h ON h.league = m.league AND h.match_date = m.match_date AND h.team = m.home "
          "JOIN s a ON a.league = m.league AND a.match_date = m.match_date AND a.team = m.away")
def team_state_both_sides(spark, sf):
    m = indexed(spark, sf)
    state = form.team_state(form.team_days(m))
    return features.attach_sides(m.select("match_id", "league", "season_idx", "match_date", "home", "away"), state,
                                 ["ewma_gf", "history_depth"]).select(
        "match_id", "home_ewma_gf", "away_ewma_gf", "home_history_depth", "away_history_depth")


@register("w8_matchup_differences", f"""WITH {Q.FORM}, s AS (SELECT DISTINCT league, match_date, team, {Q.FORM_COLUMNS} FROM form)
SELECT m.match_id, {r('h.ewma_ppg - a.ewma_ppg')} diff_ewma_ppg,
  {r('(h.ewma_sot_for - h.ewma_sot_against) - (a.ewma_sot_for - a.ewma_sot_against)')} diff_ewma_sot_diff,
  {r('(h.ewma_gf - h.ewma_ga) - (a.ewma_gf - a.ewma_ga)')} diff_ewma_gd,
  {r('h.ewma_gf - a.ewma_ga')} home_attack_vs_away_defence_goals, {r('a.ewma_gf - h.ewma_ga')} away_attack_vs_home_defence_goals,
  {r('h.ewma_sot_for - a.ewma_sot_against')} home_attack_vs_away_defence_sot,
  {r('h.std_ppg - a.std_ppg')} diff_std_ppg, {r('h.std_gd - a.std_gd')} diff_std_gd
FROM m JOIN s h ON h.league = m.league AND h.match_date = m.match_date AND h.team = m.home
       JOIN s a ON a.league = m.league AND a.match_date = m.match_date AND a.team = m.away""")
def matchup_differences(spark, sf):
    m = indexed(spark, sf)
    state = form.team_state(form.team_days(m)).withColumn("elo", F.lit(0.0))
    wide = features.attach_sides(m.select("match_id", "league", "season_idx", "match_date", "home", "away"), state,
                                 ["elo", "std_ppg", "std_gd", *[f"ewma_{n}" for n in form.EWMA_NAMES]])
    return form.matchups(wide).select(
        "match_id", "diff_ewma_ppg", "diff_ewma_sot_diff", "diff_ewma_gd", "home_attack_vs_away_defence_goals",
        "away_attack_vs_home_defence_goals", "home_attack_vs_away_defence_sot", "diff_std_ppg", "diff_std_gd")


@register("p13_feature_contract", f"WITH {Q.CONTESTS} SELECT 'duplicate_key' AS \"check\", (count(*) - count(DISTINCT (league, match_date, home, away)))::BIGINT n "
          "FROM contests HAVING count(*) <> count(DISTINCT (league, match_date, home, away))")
def feature_contract(spark, sf):
    return features.contract_violations(feature_table(spark, sf), matches=contests(spark, sf))


@register("p14_cold_start_rows", f"WITH {Q.FORM}, s AS (SELECT DISTINCT league, match_date, team, n_sp FROM form) "
          "SELECT m.league, m.season, count(*) FILTER (WHERE h.n_sp < 3 OR a.n_sp < 3) cold_rows, count(*) n_rows FROM m "
          "JOIN s h ON h.league = m.league AND h.match_date = m.match_date AND h.team = m.home "
          "JOIN s a ON a.league = m.league AND a.match_date = m.match_date AND a.team = m.away GROUP BY m.league, m.season")
def cold_start(spark, sf):
    m = indexed(spark, sf)
    state = form.team_state(form.team_days(m))
    wide = features.attach_sides(m.select("league", "season", "season_idx", "match_date", "home", "away"), state, ["is_cold_start"])
    return features.cold_start_rows(wide)


@register("a9_opening_elo_mean", f"""WITH {Q.elo()}, opener AS (
  SELECT league, season_idx, team, arg_min(elo, match_date) elo FROM rating GROUP BY league, season_idx, team)
SELECT league, s.season, {r('avg(elo)')} mean_opening_elo, count(*) n_teams FROM opener JOIN sidx s USING (league, season_idx) GROUP BY league, s.season""")
def opening_elo(spark, sf):
    c = contests(spark, sf)
    return features.opening_elo_mean(elo.ratings(c, causal.parameter_schedule(c, strict=True)), seasons.season_index(c))


@register("a24_target_correlation", f"WITH {Q.FEATURES}, c AS (SELECT "
          + ", ".join(f"{r(f'corr({c}, target)')} {c}" for c in S.FEATURE_COLUMNS)
          + " FROM features WHERE season < 2001) SELECT feature, corr FROM (UNPIVOT c ON "
          + ", ".join(S.FEATURE_COLUMNS) + " INTO NAME feature VALUE corr)")
def target_correlation(spark, sf):
    return features.target_correlations(feature_table(spark, sf), sealed_from=2001)


@register("f2_elo_expectancy", f"WITH {Q.CONTESTS} SELECT match_id, {r('1 / (1 + pow(10, -((1400 + 10 * hs) + 45 - (1400 + 10 * as_)) / 400.0::DOUBLE))')} expected, "
          f"{r('-400 * log10(1 / ((hst + 1) / (hst + ast + 2.0::DOUBLE)) - 1)')} gap FROM contests")
def elo_expectancy(spark, sf):
    from touchline.functions.ratings import expectancy, gap_from_score

    rating = lambda c: 1400.0 + 10 * F.col(c)
    share = (F.col("hst") + 1) / (F.col("hst") + F.col("ast") + 2)
    return contests(spark, sf).select("match_id", expectancy(rating("hs"), rating("as_"), F.lit(45.0)).alias("expected"), gap_from_score(share).alias("gap"))
