"""SQL functions against the column expressions and plain formulas."""

import math

import pytest

from touchline.functions.sql import register_functions


@pytest.fixture(scope="module")
def sql(spark):
    register_functions(spark)
    return lambda text: spark.sql(text).first()


def test_formulas(sql):
    r = sql("SELECT elo_expectancy(1500, 1400, 45) a, elo_gap(0.5) b, elo_gap(1) c, elo_change(1500, 1500, 0, 1, 20) d, poisson_p(25, 3) e, poisson_p(0, 3) f, elo_expectancy(NULL, 1, 1) g")
    assert r["a"] == pytest.approx(1 / (1 + 10 ** (-145 / 400))) and r["b"] == 0 and r["c"] is None and r["d"] == 10 and r["g"] is None
    assert r["e"] == pytest.approx(math.exp(-3 + 25 * math.log(3) - math.lgamma(26)), rel=1e-9) and r["f"] == pytest.approx(math.exp(-3))


def test_low_scores(sql):
    r = sql("SELECT low_score_tau(0, 0, 1.5, 1.0, -0.1) a, low_score_tau(0, 1, 1.5, 1.0, -0.1) b, low_score_tau(1, 0, 1.5, 1.0, -0.1) c, low_score_tau(1, 1, 1.5, 1.0, -0.1) d, "
            "low_score_tau(2, 0, 1.5, 1.0, -0.1) e, low_score_tau(0, 0, 1.5, 1.0, NULL) f")
    assert [round(x, 12) for x in r] == [1.15, 0.85, 0.9, 1.1, 1.0, 1.0]


@pytest.mark.parametrize("rates, cells", [("1.5, 1.2", 16 * 16), ("6, 5.5", 21 * 21), ("50, 50", 0)])
def test_grid(sql, rates, cells):
    """The cap grows with the rates; rates beyond every cap give no rows."""
    r = sql(f"SELECT count(*) n, sum(g.p) p, sum(g.p * g.home_goals) goals FROM (SELECT 1) t, LATERAL score_grid({rates}, NULL) g")
    assert r["n"] == cells
    if cells:
        assert r["p"] == pytest.approx(1) and r["goals"] == pytest.approx(float(rates.split(",")[0]), abs=1e-3)


def test_pooling(sql):
    r = sql("SELECT temperature_scaled(0.5, 0.3, 0.2, 1) a, temperature_scaled(1, 0, 0, 2) b, pooled(named_struct('home', 1D, 'draw', 0D, 'away', 0D), named_struct('home', 0D, 'draw', 0.5D, 'away', 0.5D), 0.25) c")
    assert tuple(r["a"]) == pytest.approx((0.5, 0.3, 0.2)) and sum(r["b"]) == pytest.approx(1) and tuple(r["c"]) == pytest.approx((0.25, 0.375, 0.375))
