"""Queries over the goal model."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import scorelines
from touchline.operators import folds as folding
from touchline.operators import goals, seasons
from touchline.plans import sqltext as Q
from touchline.plans.registry import r, register
from touchline.session import spread_by, written
from touchline.sources.contests import contests

FOLDS = [(1, 1998, 1999), (2, 1999, 2000), (3, 2000, 2001)]
FOLD_SQL = "fd(fold, cutoff, validation) AS (VALUES (1, 1998, 1999), (2, 1999, 2000), (3, 2000, 2001))"

PAIRS = f"""WITH {Q.INDEXED}, {FOLD_SQL},
tr_end AS (SELECT league, fold, max(match_date) t FROM contests JOIN fd ON season <= cutoff GROUP BY ALL),
wt AS MATERIALIZED (SELECT c.*, fold, exp(-ln(2) / 365 * (t - match_date)) weight FROM contests c JOIN fd ON season <= cutoff JOIN tr_end USING (league, fold))"""


@register("k1_j12_fold_assignment", f"WITH {Q.CONTESTS}, {FOLD_SQL} SELECT match_id, fold, CASE WHEN season <= cutoff THEN 'train' ELSE 'validation' END part "
          "FROM contests JOIN fd ON season <= cutoff OR season = validation")
def fold_assignment(spark, sf):
    return folding.assign_folds(contests(spark, sf).select("match_id", "season"), FOLDS).select("match_id", "fold", "part")


@register("p15_fold_admissibility", f"""WITH {Q.CONTESTS}, {FOLD_SQL}, bad(fold, cutoff, validation) AS (VALUES (4, 2001, 2001), (5, 2002, 2003)),
allf AS (SELECT * FROM fd UNION ALL SELECT * FROM bad),
s AS (SELECT f.fold, max(match_date) FILTER (WHERE season <= cutoff) te, min(match_date) FILTER (WHERE season = validation AND season > cutoff) vs
      FROM allf f JOIN contests ON season <= cutoff OR season = validation GROUP BY f.fold)
SELECT fold::BIGINT fold, 'no training rows' problem FROM s WHERE te IS NULL
UNION ALL SELECT fold, 'no validation rows' FROM s WHERE vs IS NULL
UNION ALL SELECT fold, 'training not strictly earlier' FROM s WHERE te >= vs
UNION ALL SELECT 0, 'sealed season present' FROM contests WHERE season >= 2001 HAVING count(*) > 0
UNION ALL SELECT 0, 'season past the row cap' FROM contests WHERE season > 2000 HAVING count(*) > 0""")
def fold_admissibility(spark, sf):
    bad = [(4, 2001, 2001), (5, 2002, 2003)]
    found = folding.fold_violations(contests(spark, sf).select("season", "match_date"), FOLDS + bad, sealed_from=2001, row_cap=2000)
    return found.withColumn("fold", F.coalesce("fold", F.lit(0)))  # 0: the whole table


@register("p15_cutoff_pairing", f"""WITH {Q.SCHEDULE}, want(season, cutoff) AS (VALUES (1997, 1996), (1999, 1998), (2000, 1998))
SELECT s.league, s.season, CASE WHEN season_idx < 3 THEN 'parameters are not estimated' ELSE 'cutoff is not the approved one' END problem
FROM schedule s JOIN want USING (season) WHERE season_idx < 3 OR season - 1 <> cutoff""")
def cutoff_pairing(spark, sf):
    from touchline.operators.causal import parameter_schedule

    return folding.pairing_violations(parameter_schedule(contests(spark, sf)), [(1, 1996, 1997), (2, 1998, 1999), (3, 1998, 2000)])


@register("w10_time_decay", PAIRS + f" SELECT match_id, fold, {r('weight')} weight FROM wt")
def time_decay(spark, sf):
    train = folding.assign_folds(contests(spark, sf).select("match_id", "league", "season", "match_date"), FOLDS).where("part = 'train'")
    return goals.decay_weights(train, ["league", "fold"], 365.0).select("match_id", "fold", "weight")


PAIR_SUMS = ", ".join(
    f"{r(f'sum({w} * ({cond}))')} {p}{name}" for p, w in (("", "1.0"), ("d_", "weight")) for name, cond in (
        ("w", "1"), ("whg", "fthg"), ("wag", "ftag"), ("w00", "(fthg = 0 AND ftag = 0)::INT"), ("w01", "(fthg = 0 AND ftag = 1)::INT"),
        ("w10", "(fthg = 1 AND ftag = 0)::INT"), ("w11", "(fthg = 1 AND ftag = 1)::INT")))


def pair_statistics(spark, sf):
    return goals.fold_pair_statistics(goals.season_pair_statistics(contests(spark, sf)), FOLDS)


@register("a21_pair_statistics", PAIRS + f" SELECT league, fold, home, away, {PAIR_SUMS.replace('sum(1.0 *', 'sum(1.0::DOUBLE *')} FROM wt GROUP BY league, fold, home, away")
def a21(spark, sf):
    return pair_statistics(spark, sf)


OFFSETS = f"""{FOLD_SQL}, tg AS (SELECT league, season, season_idx, team, avg(gf) gf, avg(ga) ga FROM tr GROUP BY ALL),
lg AS (SELECT league, season, avg(gf) lg FROM tr GROUP BY ALL),
debut AS (SELECT t.*, lg.lg FROM tg t JOIN lg USING (league, season) WHERE season_idx > 0 AND NOT EXISTS
  (SELECT 1 FROM tg o WHERE o.league = t.league AND o.team = t.team AND o.season_idx < t.season_idx)),
offsets AS MATERIALIZED (SELECT l.league, f.fold, coalesce(avg(ln(d.gf / d.lg)) FILTER (WHERE d.gf > 0), 0) promoted_attack,
  coalesce(avg(ln(d.ga / d.lg)) FILTER (WHERE d.ga > 0), 0) promoted_defence
  FROM (SELECT DISTINCT league FROM m) l CROSS JOIN fd f LEFT JOIN debut d ON d.league = l.league AND d.season <= f.cutoff GROUP BY ALL)"""


@register("a10_promoted_offsets", f"WITH {Q.TEAM_ROWS}, {OFFSETS} SELECT league, fold, {r('promoted_attack')} promoted_attack, {r('promoted_defence')} promoted_defence FROM offsets")
def promoted_offsets(spark, sf):
    return goals.promoted_offsets(contests(spark, sf), FOLDS)


def moment_fits(spark, sf):
    """Strengths by log ratios of mean goals, in the layout of a fit."""
    c = contests(spark, sf)
    rows = seasons.team_rows(c)
    league = rows.groupBy("league").agg(F.avg("gf").alias("lg"))
    return rows.groupBy("league", "team").agg(F.avg("gf").alias("gf"), F.avg("ga").alias("ga")).join(league, "league").select(
        "league", F.lit(3).alias("fold"), F.lit("dixon_coles").alias("config_id"), "team",
        F.log(F.col("gf") / F.col("lg")).alias("attack"), F.log(F.col("ga") / F.col("lg")).alias("defence"),
        F.log("lg").alias("intercept"), F.lit(0.2).alias("home_advantage"), F.lit(-0.1).alias("rho"), F.lit("fitted").alias("status"))


def rated_pairs(spark, sf):
    c = contests(spark, sf)
    pairs = c.select("league", "home", "away").distinct().withColumn("fold", F.lit(3))
    fits = moment_fits(spark, sf).where("team % 10 <> 3")
    rated = goals.attach_strengths(pairs, fits, goals.promoted_offsets(c, FOLDS), ["league", "fold"])
    return spread_by(rated, "league", "home", "away")


RATED = f"""WITH {Q.TEAM_ROWS}, {OFFSETS}, lgoals AS (SELECT league, avg(gf) lg FROM tr GROUP BY league),
st AS (SELECT league, team, ln(avg(gf) / any_value(lg)) attack, ln(avg(ga) / any_value(lg)) defence FROM tr JOIN lgoals USING (league)
       WHERE team % 10 <> 3 GROUP BY league, team),
rated AS MATERIALIZED (SELECT p.league, p.home, p.away, -0.1::DOUBLE rho,
  exp(ln(lg) + 0.2 + coalesce(h.attack, o.promoted_attack) + coalesce(a.defence, o.promoted_defence)) lh,
  exp(ln(lg) + coalesce(a.attack, o.promoted_attack) + coalesce(h.defence, o.promoted_defence)) la
  FROM (SELECT DISTINCT league, home, away FROM m) p JOIN lgoals USING (league) JOIN offsets o ON o.league = p.league AND o.fold = 3
  LEFT JOIN st h ON h.league = p.league AND h.team = p.home LEFT JOIN st a ON a.league = p.league AND a.team = p.away),
pmf AS MATERIALIZED (SELECT league, home, away, k, exp(-lh + k * ln(lh) - lgamma(k + 1)) ph, exp(-la + k * ln(la) - lgamma(k + 1)) pa
  FROM rated, range(31) t(k)),
kept AS (SELECT league, home, away, cap, sum(ph) FILTER (WHERE k <= cap) * sum(pa) FILTER (WHERE k <= cap) mass
  FROM pmf, (VALUES (15), (20), (25), (30)) c(cap) GROUP BY ALL),
caps AS (SELECT league, home, away, min(cap) FILTER (WHERE 1 - mass < 1e-5) cap FROM kept GROUP BY ALL),
cell0 AS (SELECT r.league, r.home, r.away, c.cap, x.k hg, y.k ag, x.ph * y.pa *
   CASE WHEN x.k = 0 AND y.k = 0 THEN 1 - lh * la * rho WHEN x.k = 0 AND y.k = 1 THEN 1 + lh * rho
        WHEN x.k = 1 AND y.k = 0 THEN 1 + la * rho WHEN x.k = 1 AND y.k = 1 THEN 1 - rho ELSE 1 END p
  FROM rated r JOIN caps c USING (league, home, away) JOIN pmf x USING (league, home, away) JOIN pmf y USING (league, home, away)
  WHERE x.k <= c.cap AND y.k <= c.cap),
cell AS MATERIALIZED (SELECT * EXCLUDE (p), p / sum(p) OVER (PARTITION BY league, home, away) p FROM cell0)"""


@register("j8_strength_lookup", RATED + f" SELECT league, home, away, {r('lh')} rate_home, {r('la')} rate_away FROM rated")
def strength_lookup(spark, sf):
    return rated_pairs(spark, sf).select("league", "home", "away", "rate_home", "rate_away")


@register("j8_strict_unfitted", f"WITH {Q.CONTESTS} SELECT DISTINCT league, team FROM (SELECT league, home team FROM contests UNION SELECT league, away FROM contests) WHERE team % 10 = 3")
def strict_unfitted(spark, sf):
    c = contests(spark, sf)
    return goals.unfitted_teams(c, moment_fits(spark, sf).where("team % 10 <> 3"), ["league"])


@register("f3_f4_taus", RATED + f" SELECT league, home, away, {r('1 - lh * la * rho')} tau00, {r('1 + lh * rho')} tau01, {r('1 + la * rho')} tau10, {r('1 - rho')} tau11, "
          f"{r('-lh + 21 * ln(lh) - lgamma(22)')} ln_p21 FROM rated")
def tau_values(spark, sf):
    rated = rated_pairs(spark, sf)
    t = scorelines.taus(F.col("rate_home"), F.col("rate_away"), F.col("rho"))
    # 21 goals: beyond the range of the built-in factorial
    return rated.select("league", "home", "away", *[v.alias(k) for k, v in t.items()],
                        F.log(scorelines.poisson_pmf(F.col("rate_home"))[21]).alias("ln_p21"))


@register("m5_j14_w12_score_grid", RATED + f" SELECT league, hg home_goals, ag away_goals, count(*) n, {r('avg(p)')} mean_p, {r('max(p)')} max_p FROM cell GROUP BY league, hg, ag")
def score_grid(spark, sf):
    """Every cell of every pairing's grid, averaged per scoreline."""
    grid = goals.score_grid(rated_pairs(spark, sf), ["league", "home", "away"])
    return grid.groupBy("league", "home_goals", "away_goals").agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))


SUMMARY = RATED + f""", summary AS MATERIALIZED (SELECT league, home, away, any_value(cap) cap, sum(p) FILTER (WHERE hg > ag) p_home,
  sum(p) FILTER (WHERE hg = ag) p_draw, sum(p) FILTER (WHERE hg < ag) p_away, sum(p * hg) eh, sum(p * ag) ea FROM cell GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY league, home, away ORDER BY p DESC, hg, ag) rk FROM cell)"""


@register("m5_match_prediction", SUMMARY + f""" SELECT m.match_id, {r('p_home')} p_home, {r('p_draw')} p_draw, {r('p_away')} p_away,
  {r('eh')} expected_home_goals, {r('ea')} expected_away_goals, summary.cap, hg || '-' || ag most_likely_scoreline
  FROM m JOIN summary USING (league, home, away) JOIN ranked USING (league, home, away) WHERE rk = 1""")
def match_prediction(spark, sf):
    scored = goals.score_fixtures(rated_pairs(spark, sf), strict=True)
    return contests(spark, sf).select("match_id", "league", "home", "away").join(scored, ["league", "home", "away"]).select(
        "match_id", "p_home", "p_draw", "p_away", "expected_home_goals", "expected_away_goals", "cap", "most_likely_scoreline")


@register("t2_top_scorelines", SUMMARY + f" SELECT league, home, away, rk::BIGINT rk, hg || '-' || ag score, {r('p')} p FROM ranked WHERE rk <= 3")
def top_scorelines(spark, sf):
    # The outer form keeps Spark from pushing "array not empty" below the grid sums.
    return goals.score_fixtures(rated_pairs(spark, sf)).select(
        "league", "home", "away", F.posexplode_outer("top_scorelines").alias("rk", "s")).select(
        "league", "home", "away", (F.col("rk") + 1).alias("rk"), "s.score", "s.p")


@register("m13_score_explanation", SUMMARY + f""" SELECT league, home, away, {r('eh')} expected_home_goals, {r('ea')} expected_away_goals,
  0.2 home_advantage, {r('ln(lg)')} intercept, {r('coalesce(h.attack, o.promoted_attack)')} home_attack, {r('coalesce(a.attack, o.promoted_attack)')} away_attack,
  {r('coalesce(h.defence, o.promoted_defence)')} home_defence, {r('coalesce(a.defence, o.promoted_defence)')} away_defence, -0.1 rho,
  {r('p_home')} p_home, {r('p_draw')} p_draw, {r('p_away')} p_away,
  top_scorelines
  FROM summary s JOIN (SELECT league, home, away, string_agg(hg || '-' || ag, ',' ORDER BY rk) top_scorelines FROM ranked WHERE rk <= 3 GROUP BY ALL) k USING (league, home, away)
  JOIN lgoals USING (league) JOIN offsets o ON o.league = s.league AND o.fold = 3
  LEFT JOIN st h ON h.league = s.league AND h.team = s.home LEFT JOIN st a ON a.league = s.league AND a.team = s.away""")
def score_explanation(spark, sf):
    return goals.score_fixtures(rated_pairs(spark, sf)).select(
        "league", "home", "away", "expected_home_goals", "expected_away_goals", "home_advantage", "intercept",
        "home_attack", "away_attack", "home_defence", "away_defence", "rho", "p_home", "p_draw", "p_away",
        F.array_join(F.transform("top_scorelines", lambda s: s["score"]), ",").alias("top_scorelines"))


def all_fits(spark, sf):
    """Five configurations x three folds for every league."""
    return written(goals.fit_goal_models(pair_statistics(spark, sf)), "goal-fits")


@register("m4_goal_model_fit")
def goal_model_fit(spark, sf):
    return all_fits(spark, sf)


def goals_scored_sql(folds: str, configs: str) -> str:
    """Goals of each team in the training rows of each fold, by the weights of each configuration."""
    return f"""WITH {Q.TEAM_ROWS}, fd(fold, cutoff) AS (VALUES {folds}), rows0 AS (SELECT fold, tr.*, max(match_date) OVER (PARTITION BY league, fold) ends FROM tr JOIN fd ON season <= cutoff),
cf(config_id, halflife) AS (VALUES {configs}), wt AS (SELECT *, CASE WHEN halflife IS NULL THEN 1.0 ELSE exp(-ln(2.0) / halflife * (ends - match_date)) END::DOUBLE wt FROM rows0, cf)
SELECT league, fold, config_id, team, {r('sum(wt * gf)', 3)} scored, {r('sum(wt * ga)', 3)} conceded FROM wt GROUP BY league, fold, config_id, team"""


def rounded_scores(df):
    return df.withColumns({k: F.round(k, 3) for k in ("scored", "conceded")})


_CONFIGS = ", ".join(f"('{k}', {v[2] or 'NULL::DOUBLE'})" for k, v in goals.CONFIGS.items())


@register("m4_goal_model_identities", goals_scored_sql(", ".join(f"({n}, {c})" for n, c, _ in FOLDS), _CONFIGS))
def goal_model_identities(spark, sf):
    """At the optimum of every fit, each team's expected goals with corrections and penalty are the goals it has scored and conceded."""
    pairs = pair_statistics(spark, sf)
    return rounded_scores(goals.score_identities(pairs, all_fits(spark, sf)))


@register("j15_config_fold_matrix", f"WITH {Q.CONTESTS}, {FOLD_SQL} SELECT DISTINCT league, fold, config_id FROM contests JOIN fd ON season <= cutoff, "
          "(VALUES ('poisson'), ('poisson_l2'), ('dixon_coles'), ('dixon_coles_l2'), ('dixon_coles_l2_decay')) c(config_id)")
def config_fold_matrix(spark, sf):
    """From the folds and configurations alone; nothing is fitted for it."""
    rows = folding.assign_folds(contests(spark, sf).select("league", "season"), FOLDS).where("part = 'train'").select("league", "fold").distinct()
    return rows.withColumn("config_id", F.explode(F.array(*[F.lit(c) for c in goals.CONFIGS])))


@register("u5_goal_model_out_of_fold")
def goal_model_out_of_fold(spark, sf):
    c = contests(spark, sf)
    return goals.out_of_fold(c, all_fits(spark, sf), goals.promoted_offsets(c, FOLDS), FOLDS)


@register("k3_goal_model_selection")
def goal_model_selection(spark, sf):
    from touchline.operators.evaluate import select_best

    c = contests(spark, sf)
    oof = written(goals.out_of_fold(c, all_fits(spark, sf), goals.promoted_offsets(c, FOLDS), FOLDS), "goal-oof")
    return select_best(oof, ["match_id", "fold"], {k: v[3] for k, v in goals.CONFIGS.items()})
