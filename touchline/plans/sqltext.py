"""SQL building blocks shared by the SQL twins."""

CONTESTS = """side AS (
  SELECT o.o_orderkey id, c.c_nationkey % 5 league, CAST(o.o_orderdate AS DATE) d, year(o.o_orderdate) yr,
         l.l_suppkey team, CAST(sum(l.l_quantity) AS INT) q
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE (l.l_suppkey + year(o.o_orderdate)) % 7 <> 0
  GROUP BY ALL),
pr AS (
  SELECT id, league, d, yr, min(team) lo, max(team) hi, min_by(q, team) qlo, max_by(q, team) qhi
  FROM side GROUP BY id, league, d, yr HAVING count(*) >= 2),
oriented AS (
  SELECT id, league, d, yr, CASE WHEN id % 2 = 0 THEN lo ELSE hi END home, CASE WHEN id % 2 = 0 THEN hi ELSE lo END away,
         CASE WHEN id % 2 = 0 THEN qlo ELSE qhi END qh, CASE WHEN id % 2 = 0 THEN qhi ELSE qlo END qa
  FROM pr),
contests0 AS (
  SELECT id match_id, league, yr season, d match_date, home, away,
         least(qh % 5, qh % 7) fthg, least(qa % 5, qa % 7) ftag, 8 + qh % 13 hs, 8 + qa % 13 as_, qh % 7 hst, qa % 7 ast
  FROM oriented),
contests AS MATERIALIZED (
  SELECT *, CASE WHEN fthg > ftag THEN 'H' WHEN fthg < ftag THEN 'A' ELSE 'D' END ftr,
         CASE WHEN fthg > ftag THEN 1.0 WHEN fthg < ftag THEN 0.0 ELSE 0.5 END::DOUBLE hscore
  FROM contests0)"""

INDEXED = CONTESTS + """,
sidx AS (
  SELECT league, season, min(match_date) first_date, max(match_date) last_date, count(*) n_matches,
         row_number() OVER (PARTITION BY league ORDER BY min(match_date)) - 1 season_idx
  FROM contests GROUP BY league, season),
m AS MATERIALIZED (SELECT c.*, s.season_idx FROM contests c JOIN sidx s USING (league, season))"""

TEAM_ROWS = INDEXED + """,
tr AS MATERIALIZED (
  SELECT match_id, league, season, season_idx, match_date, home, away, home team, away opponent, true is_home,
         fthg gf, ftag ga, hst sot_for, ast sot_against, hs shots_for, as_ shots_against,
         3.0::DOUBLE * (ftr = 'H')::INT + (ftr = 'D')::INT pts, hscore score FROM m
  UNION ALL
  SELECT match_id, league, season, season_idx, match_date, home, away, away, home, false,
         ftag, fthg, ast, hst, as_, hs, 3.0::DOUBLE * (ftr = 'A')::INT + (ftr = 'D')::INT, 1 - hscore FROM m)"""

TEAM_SEASONS = TEAM_ROWS + """,
ts0 AS (
  SELECT league, season, season_idx, team, avg(score) mean_score, avg(pts) ppg, count(*) n
  FROM tr GROUP BY ALL),
ts1 AS (
  SELECT *, lag(season_idx) OVER w prev_idx, lag(ppg) OVER w prev_ppg
  FROM ts0 WINDOW w AS (PARTITION BY league, team ORDER BY season_idx)),
ts2 AS (
  SELECT *, CASE WHEN prev_idx IS NULL THEN 'new' WHEN season_idx - prev_idx >= 2 THEN 'stale' ELSE 'continuing' END kind
  FROM ts1),
ts AS MATERIALIZED (
  SELECT *, sum((kind <> 'continuing')::INT) OVER (PARTITION BY league, team ORDER BY season_idx) spell FROM ts2)"""

# Estimates by a self-join on cutoffs, one group per (league, season).
SCHEDULE = TEAM_SEASONS + """,
est_home AS (
  SELECT a.league, a.season_idx, avg(b.hscore) hm
  FROM sidx a JOIN m b ON b.league = a.league AND b.season_idx < a.season_idx GROUP BY ALL),
est_team AS (
  SELECT a.league, a.season_idx,
         avg(b.mean_score) FILTER (WHERE b.season_idx > 0 AND b.kind <> 'continuing') nm,
         regr_slope(b.ppg, b.prev_ppg) FILTER (WHERE b.prev_idx = b.season_idx - 1 AND b.prev_idx >= 1) slope
  FROM sidx a JOIN ts b ON b.league = a.league AND b.season_idx < a.season_idx GROUP BY ALL),
schedule AS MATERIALIZED (
  SELECT s.league, s.season, s.season_idx, CASE WHEN s.season_idx < 3 THEN 'apriori' ELSE 'estimated' END status,
         CASE WHEN s.season_idx < 3 THEN 45.0 ELSE -400 * log10(1 / h.hm - 1) END home_advantage,
         CASE WHEN s.season_idx < 3 THEN 0.8 ELSE t.slope END season_shrink,
         CASE WHEN s.season_idx < 3 THEN -100.0 ELSE -400 * log10(1 / t.nm - 1) END promoted_delta,
         20.0::DOUBLE k_factor, 1500.0::DOUBLE initial_rating
  FROM sidx s LEFT JOIN est_home h USING (league, season_idx) LEFT JOIN est_team t USING (league, season_idx))"""

# Match-level RANGE frames (strictly earlier dates); the Spark side works on days.
FORM = TEAM_SEASONS + """,
fr AS (
  SELECT tr.*, ts.spell, ts.kind,
         row_number() OVER (PARTITION BY tr.league, tr.team, ts.spell ORDER BY match_date, home, away, match_id) i
  FROM tr JOIN ts USING (league, season, season_idx, team)),
form0 AS (
  SELECT *,
    count(*) OVER sp n_sp, count(*) OVER al n_all, count(*) OVER se n_se, max(match_date) OVER al last_date,
    avg(pts) OVER se std_ppg, avg(gf - ga) OVER se std_gd, sum(pow(2, i / 10.0)) OVER sp w,
    sum(gf * pow(2, i / 10.0)) OVER sp e_gf, sum(ga * pow(2, i / 10.0)) OVER sp e_ga,
    sum(sot_for * pow(2, i / 10.0)) OVER sp e_sot_for, sum(sot_against * pow(2, i / 10.0)) OVER sp e_sot_against,
    sum(shots_for * pow(2, i / 10.0)) OVER sp e_shots_for, sum(shots_against * pow(2, i / 10.0)) OVER sp e_shots_against,
    sum(pts * pow(2, i / 10.0)) OVER sp e_ppg
  FROM fr
  WINDOW sp AS (PARTITION BY league, team, spell ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING),
         al AS (PARTITION BY league, team ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING),
         se AS (PARTITION BY league, team, season_idx ORDER BY match_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
cum AS (
  SELECT league, team, spell, i, sum(shots_for) OVER c cs, sum(sot_for) OVER c ct, sum(gf) OVER c cg
  FROM fr WINDOW c AS (PARTITION BY league, team, spell ORDER BY i)),
form AS MATERIALIZED (
  SELECT f.*, x.cs - coalesce(y.cs, 0) s_shots, x.ct - coalesce(y.ct, 0) s_sot, x.cg - coalesce(y.cg, 0) s_goals
  FROM form0 f
  LEFT JOIN cum x ON x.league = f.league AND x.team = f.team AND x.spell = f.spell AND x.i = f.n_sp
  LEFT JOIN cum y ON y.league = f.league AND y.team = f.team AND y.spell = f.spell AND y.i = f.n_sp - 10)"""

FORM_COLUMNS = """n_se matches_played_season, n_all prior_matches_all_time,
  CASE WHEN last_date IS NOT NULL THEN least(21, match_date - last_date)::DOUBLE END rest_days, kind = 'stale' is_returning,
  CASE WHEN n_sp >= 3 THEN e_gf / w END ewma_gf, CASE WHEN n_sp >= 3 THEN e_ga / w END ewma_ga,
  CASE WHEN n_sp >= 3 THEN e_sot_for / w END ewma_sot_for, CASE WHEN n_sp >= 3 THEN e_sot_against / w END ewma_sot_against,
  CASE WHEN n_sp >= 3 THEN e_shots_for / w END ewma_shots_for, CASE WHEN n_sp >= 3 THEN e_shots_against / w END ewma_shots_against,
  CASE WHEN n_sp >= 3 THEN e_ppg / w END ewma_ppg, CASE WHEN n_se > 0 THEN std_ppg END std_ppg, CASE WHEN n_se > 0 THEN std_gd END std_gd,
  CASE WHEN n_sp >= 3 AND s_shots > 0 THEN s_sot / s_shots END sot_ratio,
  CASE WHEN n_sp >= 3 AND s_sot > 0 THEN s_goals / s_sot END conversion,
  least(n_sp, 38)::DOUBLE history_depth, CASE WHEN n_sp >= 3 THEN 0.0 ELSE 1.0 END is_cold_start"""



def elo(schedule: str = SCHEDULE) -> str:
    """Ratings as a recursion over match days: every step holds each team's
    rating before and after the day; a season's first day rolls its roster."""
    return "RECURSIVE " + schedule + """,
days AS MATERIALIZED (
  SELECT league, season_idx, match_date, row_number() OVER (PARTITION BY league ORDER BY match_date) step,
         min(match_date) OVER (PARTITION BY league, season_idx) = match_date opens
  FROM (SELECT DISTINCT league, season_idx, match_date FROM m)),
lastday AS MATERIALIZED (SELECT league, max(step) mx FROM days GROUP BY league),
game AS MATERIALIZED (
  SELECT d.step, m.league, m.home, m.away, m.hscore, s.home_advantage, s.k_factor
  FROM m JOIN days d USING (league, season_idx, match_date) JOIN schedule s USING (league, season_idx)),
roll AS MATERIALIZED (
  SELECT ts.league, ts.team, CASE WHEN ts.season_idx = 0 THEN 0 WHEN ts.kind <> 'continuing' THEN 1 ELSE 2 END k,
         s.season_shrink sh, s.promoted_delta pd, s.initial_rating ir, d.step
  FROM ts JOIN schedule s USING (league, season_idx) JOIN days d USING (league, season_idx) WHERE d.opens),
elo(step, league, team, pre, post) AS (
  SELECT 0::BIGINT, league, team, NULL::DOUBLE, 1500.0::DOUBLE FROM (SELECT DISTINCT league, team FROM ts)
  UNION ALL
  (WITH cur AS (
     SELECT e.step + 1 step, e.league, e.team, e.post old, r.k, r.sh, r.pd, r.ir
     FROM elo e JOIN lastday z ON z.league = e.league AND e.step < z.mx
     LEFT JOIN roll r ON r.league = e.league AND r.team = e.team AND r.step = e.step + 1),
   rolled AS (
     SELECT *, CASE WHEN k IS NULL THEN old WHEN k = 0 THEN ir WHEN k = 1 THEN ir + pd ELSE ir + sh * (old - ir) END v FROM cur),
   pre AS (
     SELECT step, league, team,
            CASE WHEN k IS NULL THEN v ELSE v + ir - avg(v) OVER (PARTITION BY league, k IS NULL) END pre FROM rolled),
   moved AS (
     SELECT g.league, g.home, g.away, g.k_factor * (g.hscore - 1 / (1 + pow(10, -(h.pre + g.home_advantage - a.pre) / 400))) ch
     FROM pre h JOIN game g ON g.league = h.league AND g.step = h.step AND g.home = h.team
     JOIN pre a ON a.league = g.league AND a.team = g.away),
   summed AS (
     SELECT league, team, sum(ch) ch
     FROM (SELECT league, home team, ch FROM moved UNION ALL SELECT league, away, -ch FROM moved) GROUP BY ALL)
   SELECT p.step, p.league, p.team, p.pre, p.pre + coalesce(s.ch, 0) FROM pre p LEFT JOIN summed s USING (league, team))),
rating AS MATERIALIZED (
  SELECT d.league, d.season_idx, d.match_date, e.team, e.pre elo
  FROM elo e JOIN days d USING (league, step)
  WHERE EXISTS (SELECT 1 FROM tr WHERE tr.league = d.league AND tr.team = e.team AND tr.match_date = d.match_date))"""


FIXED_SCHEDULE = TEAM_SEASONS + """,
schedule AS MATERIALIZED (
  SELECT league, season, season_idx, 60.0::DOUBLE home_advantage, 0.75::DOUBLE season_shrink, -80.0::DOUBLE promoted_delta,
         20.0::DOUBLE k_factor, 1500.0::DOUBLE initial_rating FROM sidx)"""

# The full feature table: team form and ratings joined to both sides.
FEATURES = elo(SCHEDULE + "," + FORM[len(TEAM_SEASONS) + 1:]) + f""",
side_state AS MATERIALIZED (
  SELECT DISTINCT league, match_date, team, elo, {FORM_COLUMNS}
  FROM form JOIN rating USING (league, match_date, team)),
features AS MATERIALIZED (
  SELECT m.match_id, m.league, m.season, m.season_idx, m.match_date, m.home, m.away, m.ftr, m.fthg, m.ftag,
    CASE m.ftr WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END target,
    """ + ", ".join(
    f"{s[0]}.{c} {s}_{c}" for s in ("home", "away") for c in (
        "matches_played_season", "prior_matches_all_time", "rest_days", "is_returning", "elo",
        "ewma_gf", "ewma_ga", "ewma_sot_for", "ewma_sot_against", "ewma_shots_for", "ewma_shots_against", "ewma_ppg",
        "std_ppg", "std_gd", "sot_ratio", "conversion", "history_depth", "is_cold_start")
) + """,
    h.elo - a.elo elo_diff, h.ewma_ppg - a.ewma_ppg diff_ewma_ppg,
    (h.ewma_sot_for - h.ewma_sot_against) - (a.ewma_sot_for - a.ewma_sot_against) diff_ewma_sot_diff,
    (h.ewma_gf - h.ewma_ga) - (a.ewma_gf - a.ewma_ga) diff_ewma_gd,
    h.ewma_gf - a.ewma_ga home_attack_vs_away_defence_goals, a.ewma_gf - h.ewma_ga away_attack_vs_home_defence_goals,
    h.ewma_sot_for - a.ewma_sot_against home_attack_vs_away_defence_sot,
    h.std_ppg - a.std_ppg diff_std_ppg, h.std_gd - a.std_gd diff_std_gd
  FROM m JOIN side_state h ON h.league = m.league AND h.match_date = m.match_date AND h.team = m.home
         JOIN side_state a ON a.league = m.league AND a.match_date = m.match_date AND a.team = m.away)"""
