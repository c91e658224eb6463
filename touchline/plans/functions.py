"""Queries written in SQL only, with the registered functions."""

from __future__ import annotations

from touchline.functions.sql import register_functions
from touchline.plans import sqltext as Q
from touchline.plans.registry import r, register
from touchline.sources.contests import contests


def run(spark, sf, text):
    register_functions(spark)
    contests(spark, sf).createOrReplaceTempView("contests")
    return spark.sql(text)


_P = "(hs + 1) / (hs + as_ + ast + 3.0), (ast + 1) / (hs + as_ + ast + 3.0), (as_ + 1) / (hs + as_ + ast + 3.0)"
_BUT = "CASE WHEN rho IS NULL OR hg > 1 OR ag > 1 THEN 1 WHEN hg = 0 AND ag = 0 THEN 1 - lh * la * rho WHEN hg = 0 THEN 1 + lh * rho WHEN ag = 0 THEN 1 + la * rho ELSE 1 - rho END"


@register("sql_scalar_functions", f"""WITH {Q.CONTESTS}, b AS (SELECT *, 1400 + 10.0 * hs rh, 1400 + 10.0 * as_ ra, [(hs + 1) / (hs + as_ + ast + 3.0), (ast + 1) / (hs + as_ + ast + 3.0), (as_ + 1) / (hs + as_ + ast + 3.0)] p FROM contests),
e AS (SELECT *, list_transform(p, lambda x: pow(x, 1 / 1.3::DOUBLE)) q FROM b)
SELECT match_id, {r('1 / (1 + pow(10, -(rh + 45 - ra) / 400.0::DOUBLE))')} expected, {r('20 * (hscore - 1 / (1 + pow(10, -(rh + 45 - ra) / 400.0::DOUBLE)))')} moved,
  {r('-400 * log10(1 / ((hst + 1) / (hst + ast + 2.0::DOUBLE)) - 1)')} gap, {r('exp(-1.5::DOUBLE + hs * ln(1.5::DOUBLE) - lgamma(hs + 1))')} p_shots,
  {r('q[1] / list_sum(q)')} scaled_home, {r('0.4 * q[2] / list_sum(q) + 0.6 * p[2]')} pooled_draw FROM e""")
def scalar_functions(spark, sf):
    return run(spark, sf, f"""SELECT match_id, elo_expectancy(1400 + 10 * hs, 1400 + 10 * as_, 45) expected,
      elo_change(1400 + 10 * hs, 1400 + 10 * as_, 45, CASE ftr WHEN 'H' THEN 1 WHEN 'A' THEN 0 ELSE 0.5 END, 20) moved, elo_gap((hst + 1) / (hst + ast + 2)) gap, poisson_p(hs, 1.5) p_shots,
      temperature_scaled({_P}, 1.3).home scaled_home,
      pooled(temperature_scaled({_P}, 1.3), named_struct('home', (hs + 1) / (hs + as_ + ast + 3D), 'draw', (ast + 1) / (hs + as_ + ast + 3D), 'away', (as_ + 1) / (hs + as_ + ast + 3D)), 0.4).draw pooled_draw
    FROM contests""")


@register("sql_score_grid", f"""WITH {Q.CONTESTS}, rt AS (SELECT league, season, avg(fthg) * (1 + season % 4) lh, avg(ftag) * (1 + season % 3) la, CASE WHEN season % 2 = 0 THEN -0.05 END rho FROM contests GROUP BY league, season),
pm AS (SELECT rt.*, k, exp(-lh + k * ln(lh) - lgamma(k + 1)) ph, exp(-la + k * ln(la) - lgamma(k + 1)) pa FROM rt, (SELECT unnest(range(0, 31)) k)),
cu AS (SELECT league, season, k, sum(ph) OVER w * sum(pa) OVER w z FROM pm WINDOW w AS (PARTITION BY league, season ORDER BY k)),
cp AS (SELECT league, season, min(k) cap, arg_min(z, k) z FROM cu WHERE k IN (15, 20, 25, 30) AND 1 - z < 1e-5 GROUP BY league, season),
cell AS (SELECT h.league, h.season, cap, hg, ag, ph * pa * {_BUT} / z p FROM (SELECT *, k hg FROM pm) h JOIN (SELECT league, season, k ag, pa pb FROM pm) a USING (league, season) JOIN cp USING (league, season) WHERE hg <= cap AND ag <= cap)
SELECT league, season, count(*) n_cells, {r('sum(p) FILTER (WHERE hg > ag)')} p_home, {r('sum(p) FILTER (WHERE hg = ag)')} p_draw, {r('sum(p * hg)')} goals, {r('max(p)')} best FROM cell GROUP BY league, season""".replace("ph * pa *", "ph * pb *"))
def score_grid(spark, sf):
    return run(spark, sf, """WITH rt AS (SELECT league, season, avg(fthg) * (1 + season % 4) lh, avg(ftag) * (1 + season % 3) la, CASE WHEN season % 2 = 0 THEN -0.05D END rho FROM contests GROUP BY league, season)
    SELECT league, season, count(*) n_cells, sum(p) FILTER (WHERE home_goals > away_goals) p_home, sum(p) FILTER (WHERE home_goals = away_goals) p_draw, sum(p * home_goals) goals, max(p) best
    FROM rt, LATERAL score_grid(lh, la, rho) GROUP BY league, season""")
