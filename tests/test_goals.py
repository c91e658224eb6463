import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import scorelines as P
from touchline.operators import goals


def rated(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id int, rate_home double, rate_away double, rho double")


def test_taus_by_hand(spark):
    t = P.taus(F.col("rate_home"), F.col("rate_away"), F.col("rho"))
    row = rated(spark, (1.5, 1.0, -0.1)).select(*[v.alias(k) for k, v in t.items()]).first()
    assert tuple(row) == pytest.approx((1.15, 0.85, 0.90, 1.10))


def test_grid_caps_and_rejections(spark):
    rows = goals.score_fixtures(rated(spark, (1.5, 1.2, 0.0), (6, 5.5, 0.0), (50, 50, 0.0), (5, 5, 0.2), (5, 5, -0.2))).orderBy("id").collect()
    assert rows[0]["cap"] == 15 and rows[1]["cap"] > 15
    assert rows[2]["problem"].startswith("grid too small") and rows[2]["p_home"] is None
    assert rows[3]["problem"].startswith("infeasible") and rows[4]["problem"].startswith("infeasible")
    with pytest.raises(Exception, match="infeasible"):
        goals.score_fixtures(rated(spark, (5, 5, 0.2)), strict=True).collect()


def test_summary_equals_the_full_matrix(spark):
    cases = [(1.4, 1.1, -0.08), (0.3, 2.7, 0.05), (3.4, 3.4, -0.02), (0.05, 0.06, -0.1), (7.5, 0.4, 0.0)]
    for row, (lh, la, rho) in zip(goals.score_fixtures(rated(spark, *cases)).orderBy("id").collect(), cases):
        k = np.arange(row["cap"] + 1)
        pmf = lambda m: np.array([math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in k])
        p = np.outer(pmf(lh), pmf(la))
        p[0, 0] *= 1 - lh * la * rho
        p[0, 1] *= 1 + lh * rho
        p[1, 0] *= 1 + la * rho
        p[1, 1] *= 1 - rho
        p /= p.sum()
        assert row["p_home"] == pytest.approx(np.tril(p, -1).sum()) and row["p_draw"] == pytest.approx(np.trace(p))
        assert row["expected_home_goals"] == pytest.approx((p.sum(1) * k).sum())
        best = sorted(((-p[i, j], i, j) for i in k for j in k))[:3]
        assert [s["score"] for s in row["top_scorelines"]] == [f"{i}-{j}" for _, i, j in best]
        assert [s["p"] for s in row["top_scorelines"]] == pytest.approx([-x for x, _, _ in best])


def synthetic_pairs(n=6, seed=0):
    rng = np.random.default_rng(seed)
    home, away = [np.array(v) for v in zip(*[(i, j) for i in range(n) for j in range(n) if i != j])]
    w = rng.integers(1, 4, len(home)).astype(float)
    s = {"w": w, "whg": rng.poisson(1.6 * w).astype(float), "wag": rng.poisson(1.2 * w).astype(float)}
    low = rng.random((4, len(home))) * w / 6
    return home, away, n, {**s, **dict(zip(("w00", "w01", "w10", "w11"), low))}


@pytest.mark.parametrize("use_rho,sigma", [(False, None), (False, 0.25), (True, None), (True, 0.25)])
def test_fit_is_a_stationary_point(use_rho, sigma):
    home, away, n, s = synthetic_pairs()
    fit = goals.fit_pairs(home, away, n, s, use_rho, sigma)
    assert fit["status"] == "fitted"
    assert abs(fit["atk"].sum()) < 1e-6 and abs(fit["dfn"].sum()) < 1e-6
    assert max(np.abs(fit["atk"]).max(), np.abs(fit["dfn"]).max()) <= 1.5 + 1e-9

    def loss(c, g, atk, dfn, rho):
        lh, la = np.exp(c + g + atk[home] + dfn[away]), np.exp(c + atk[away] + dfn[home])
        v = -(s["whg"] * np.log(lh) - s["w"] * lh + s["wag"] * np.log(la) - s["w"] * la).sum()
        if use_rho:
            v -= (s["w00"] * np.log(1 - lh * la * rho) + s["w01"] * np.log(1 + lh * rho) + s["w10"] * np.log(1 + la * rho) + s["w11"] * np.log(1 - rho)).sum()
        return v + (0 if sigma is None else ((atk**2).sum() + (dfn**2).sum()) / (2 * sigma**2))

    at = (fit["c"], fit["g"], fit["atk"], fit["dfn"], fit["rho"])
    base = loss(*at)
    for _ in range(50):
        rng = np.random.default_rng(_)
        step = rng.normal(0, 1e-3, n)
        moved = (at[0] + rng.normal(0, 1e-3), at[1] + rng.normal(0, 1e-3), at[2] + step - step.mean(), at[3], at[4] + (rng.normal(0, 1e-4) if use_rho else 0))
        assert loss(*moved) >= base - 1e-9


def test_a_fit_holds_little_beside_its_sums():
    """Four blocks of pairs and one give the same fit; rates and slopes of all pairs at once are never held."""
    rng = np.random.default_rng(3)
    n, m = 300, 4 * goals.PAIR_BLOCK - 7
    home, away = rng.integers(0, n, m, dtype=np.int32), rng.integers(0, n, m, dtype=np.int32)
    hg, ag = rng.poisson(1.6, m).astype(float), rng.poisson(1.2, m).astype(float)
    s = {"w": np.ones(m), "whg": hg, "wag": ag, **{f"w{x}{y}": ((hg == x) & (ag == y)).astype(float) for x in (0, 1) for y in (0, 1)}}
    tracemalloc.start()
    fit = goals.fit_pairs(home, away, n, s, True, 0.25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fit["status"] == "fitted" and peak < 80 * m
    whole = pytest.MonkeyPatch()
    whole.setattr(goals, "PAIR_BLOCK", m)
    try:
        again = goals.fit_pairs(home, away, n, s, True, 0.25)
    finally:
        whole.undo()
    assert np.abs(fit["atk"] - again["atk"]).max() < 1e-7 and abs(fit["rho"] - again["rho"]) < 1e-7


def test_decay_halves_in_a_year(spark):
    rows = spark.sql("SELECT 1 g, date'2020-01-01' match_date UNION ALL SELECT 1, date'2019-01-01'")
    got = {str(r["match_date"]): r["weight"] for r in goals.decay_weights(rows, ["g"], 365.0).collect()}
    assert got["2020-01-01"] == 1.0 and got["2019-01-01"] == pytest.approx(0.5)


def test_fit_through_spark_recovers_order(make_matches):
    rows = []
    for s in range(3):
        for k in range(30):
            h, a = [("A", "B"), ("B", "C"), ("C", "A"), ("B", "A"), ("C", "B"), ("A", "C")][k % 6]
            rows.append((2010 + s, f"{2010 + s}-02-{k % 28 + 1:02d}", h, a, 3 if h == "A" else k % 2, 2 if a == "A" else (k // 2) % 2))
    m = make_matches(rows)
    folds = [(1, 2011, 2012)]
    fits = goals.fit_goal_models(goals.fold_pair_statistics(goals.season_pair_statistics(m), folds))
    by = {(r["config_id"], r["team"]): r for r in fits.collect()}
    code = make_matches.code
    for config in goals.CONFIGS:
        assert by[config, code("A")]["status"] == "fitted"
        assert by[config, code("A")]["attack"] > by[config, code("B")]["attack"]
        assert (by[config, code("A")]["rho"] is None) == (not goals.CONFIGS[config][0])
    oof = goals.out_of_fold(m, fits, goals.promoted_offsets(m, folds), folds)
    assert oof.count() == 30 * 5
    assert oof.agg(F.max(F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1))).first()[0] < 1e-9


def test_a_failed_fit_is_not_left_out(spark):
    fits = spark.createDataFrame([(0, 1, "c", "A", None, None, None, None, None, "not converged")],
                                 "league int, fold int, config_id string, team string, attack double, defence double, intercept double, home_advantage double, rho double, status string")
    offsets = spark.createDataFrame([(0, 1, 0.0, 0.0)], "league int, fold int, promoted_attack double, promoted_defence double")
    fixtures = spark.createDataFrame([(0, 1, "A", "B")], "league int, fold int, home string, away string")
    with pytest.raises(Exception, match="goal model not fitted: not converged"):
        goals.attach_strengths(fixtures, fits, offsets, ["league", "fold"]).collect()


def test_parameters_without_metadata_are_refused(spark, tmp_path):
    from touchline.sources import provenance

    (tmp_path / "p.json").write_text('{"league": 0, "fold": 1, "params": {"config_id": "c", "intercept": 0.1, "home_advantage": 0.2, "attack": {"A": 0.1}, "defence": {"A": 0.1}}}')
    with pytest.raises(ValueError, match="unsound"):
        provenance.read_goal_parameters(spark, str(tmp_path / "p.json"))
