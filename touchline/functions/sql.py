"""The formulas as SQL functions: registered once in a session, they can be used in any SQL text.

Scalar functions are inlined by the optimizer, so a query that uses them has the plan of the written-out formula. ``score_grid``
is a table function: the normalised scoreline distribution of one fixture as rows, for LATERAL joins."""

from __future__ import annotations

from pyspark.sql import SparkSession

from touchline.functions.scorelines import GRID_CAPS, LOST_MASS

_PROBABILITIES = "STRUCT<home: DOUBLE, draw: DOUBLE, away: DOUBLE>"
_LOG_FLOOR = 1e-15

#: name -> (parameters, result, body)
SCALARS = {
    "elo_expectancy": ("home DOUBLE, away DOUBLE, home_advantage DOUBLE", "DOUBLE", "1 / (1 + power(10D, -(home + home_advantage - away) / 400))"),
    "elo_gap": ("mean_score DOUBLE", "DOUBLE", "CASE WHEN mean_score > 0 AND mean_score < 1 THEN -400 * log10(1 / mean_score - 1) END"),
    "elo_change": ("home DOUBLE, away DOUBLE, home_advantage DOUBLE, score DOUBLE, k DOUBLE", "DOUBLE",
                   "k * (score - 1 / (1 + power(10D, -(home + home_advantage - away) / 400)))"),
    "low_score_tau": ("home_goals INT, away_goals INT, rate_home DOUBLE, rate_away DOUBLE, rho DOUBLE", "DOUBLE",
                      "CASE WHEN rho IS NULL OR home_goals > 1 OR away_goals > 1 THEN 1D WHEN home_goals = 0 AND away_goals = 0 THEN 1 - rate_home * rate_away * rho "
                      "WHEN home_goals = 0 THEN 1 + rate_home * rho WHEN away_goals = 0 THEN 1 + rate_away * rho ELSE 1 - rho END"),
    # a product from 1 to k: the built-in factorial ends at 20
    "poisson_p": ("k INT, rate DOUBLE", "DOUBLE",
                  "exp(-rate + k * ln(rate) - aggregate(CASE WHEN k > 0 THEN sequence(1, k) ELSE array() END, 0D, (a, x) -> a + ln(x)))"),
    "temperature_scaled": ("p_home DOUBLE, p_draw DOUBLE, p_away DOUBLE, temperature DOUBLE", _PROBABILITIES,
                           f"(SELECT named_struct('home', e[0] / s, 'draw', e[1] / s, 'away', e[2] / s) FROM (SELECT e, e[0] + e[1] + e[2] AS s FROM (SELECT transform(z, v -> exp(v - array_max(z))) AS e "
                           f"FROM (SELECT transform(array(p_home, p_draw, p_away), p -> ln(greatest(p, {_LOG_FLOOR:.15f}D)) / temperature) AS z))))"),
    "pooled": (f"a {_PROBABILITIES}, b {_PROBABILITIES}, weight DOUBLE", _PROBABILITIES,
               "named_struct('home', weight * a.home + (1 - weight) * b.home, 'draw', weight * a.draw + (1 - weight) * b.draw, 'away', weight * a.away + (1 - weight) * b.away)"),
}

_MARGINAL = "transform(sequence(0, {top}), k -> exp(-{rate} + k * ln({rate}) - aggregate(CASE WHEN k > 0 THEN sequence(1, k) ELSE array() END, 0D, (a, x) -> a + ln(x))))"
_KEPT = "aggregate(slice(ph, 1, {cap} + 1), 0D, (a, x) -> a + x) * aggregate(slice(pa, 1, {cap} + 1), 0D, (a, x) -> a + x)"


def _score_grid() -> str:
    caps = " ".join(f"WHEN 1 - {_KEPT.format(cap=c)} < {LOST_MASS:.10f}D THEN {c}" for c in GRID_CAPS)
    return f"""SELECT h, a, ph[h] * pa[a] * CASE WHEN rho IS NULL OR h > 1 OR a > 1 THEN 1D WHEN h = 0 AND a = 0 THEN 1 - rate_home * rate_away * rho
      WHEN h = 0 THEN 1 + rate_home * rho WHEN a = 0 THEN 1 + rate_away * rho ELSE 1 - rho END / z
    FROM (SELECT ph, pa, h, z, rho, rate_home, rate_away, explode(sequence(0, cap)) AS a FROM (SELECT *, explode(sequence(0, cap)) AS h FROM (SELECT *, {_KEPT.format(cap="cap")} AS z FROM (SELECT *, CASE {caps} END AS cap
      FROM (SELECT {_MARGINAL.format(top=GRID_CAPS[-1], rate="rate_home")} AS ph, {_MARGINAL.format(top=GRID_CAPS[-1], rate="rate_away")} AS pa, rho, rate_home, rate_away)))))"""


def register_functions(spark: SparkSession) -> list[str]:
    """Define all functions for this session; their names."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION score_grid(rate_home DOUBLE, rate_away DOUBLE, rho DOUBLE) RETURNS TABLE (home_goals INT, away_goals INT, p DOUBLE) RETURN {_score_grid()}")
    return [*SCALARS, "score_grid"]
