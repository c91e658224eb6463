import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import calibrate, classify, evaluate, explain
from touchline.operators.medians import exact_medians


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, 1, "x", y, *map(float, p)) for i, (y, p) in enumerate(rows)],
        "match_id int, fold int, config_id string, y int, p_home double, p_draw double, p_away double")


def test_brier_extremes(spark):
    perfect = frame(spark, [(0, (1, 0, 0)), (2, (0, 0, 1))])
    wrong = frame(spark, [(0, (0, 0, 1)), (2, (1, 0, 0))])
    assert perfect.agg(F.avg(evaluate.brier())).first()[0] == 0.0
    assert wrong.agg(F.avg(evaluate.brier())).first()[0] == 2.0


def test_paired_comparison(spark):
    a = frame(spark, [(0, (0.9, 0.05, 0.05))] * 60)
    rng = random.Random(1)
    b = frame(spark, [(0, (p := 0.34 + rng.random() / 50, 0.66 - p, 0.34)) for _ in range(60)])
    assert not evaluate.paired_comparison(a, b, ["match_id"]).first()["is_tie"]
    assert evaluate.paired_comparison(a, a, ["match_id"]).first()["is_tie"]


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([2, 1.5, 2], 400)
    y = rng.integers(0, 3, 400)
    m = evaluate.fold_metrics(frame(spark, [(int(t), q) for t, q in zip(y, p)]), ["fold"]).first()
    conf, top = p.max(1), p.argmax(1)
    edges = np.linspace(0, 1, 11)
    ece = sum(abs((conf[b] - (top == y)[b]).sum()) for lo, hi in zip(edges, edges[1:]) if (b := (conf > lo) & (conf <= hi)).any()) / 400
    assert m["ece"] == pytest.approx(ece)
    assert m["accuracy"] == pytest.approx((top == y).mean())
    f1 = [2 * ((top == k) & (y == k)).sum() / ((top == k).sum() + (y == k).sum()) for k in range(3)]
    assert m["macro_f1"] == pytest.approx(np.mean(f1))


def test_absent_class_scores_zero(spark):
    m = evaluate.fold_metrics(frame(spark, [(0, (0.6, 0.2, 0.2))] * 3), ["fold"]).first()
    assert (m["precision_D"], m["recall_D"], m["f1_D"]) == (0.0, 0.0, 0.0) and m["recall_H"] == 1.0


def test_alignment_rejects_bad_sums(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "p array<double>")
    with pytest.raises(Exception, match="renormalise"):
        df.select(*[v.alias(k) for k, v in evaluate.align(F.col("p"), [0, 2]).items()]).collect()


def meta(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    truth = rng.dirichlet([3, 2, 3], n)
    y = [int(rng.choice(3, p=t)) for t in truth]
    sharp = truth**2 / (truth**2).sum(1, keepdims=True)
    other = rng.dirichlet([2, 2, 2], n)
    rows = [(1, t, *map(float, a), *map(float, b)) for t, a, b in zip(y, sharp, other)]
    cols = "meta_fold int, y int, " + ", ".join(f"{c} double" for c in calibrate.TRIO + calibrate.DC)
    return spark.createDataFrame(rows, cols), np.array(y), sharp, other


def test_fits_find_the_minimum(spark):
    train, y, a, b = meta(spark)
    at = np.arange(len(y))

    def scaled(t):
        z = np.log(a) / t
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    loss = lambda q: -np.log(q[at, y]).mean()
    t = calibrate.fit_temperature(train)[1]
    grid = np.linspace(0.5, 4, 701)
    assert loss(scaled(t)) <= min(loss(scaled(g)) for g in grid) + 1e-9
    w = calibrate.fit_weight(train)[1]
    assert loss(w * a + (1 - w) * b) <= min(loss(g * a + (1 - g) * b) for g in np.linspace(0, 1, 501)) + 1e-9
    tj, wj = calibrate.fit_joint(train)[1]
    assert loss(wj * scaled(tj) + (1 - wj) * b) <= min(loss(a), loss(scaled(t)), loss(w * a + (1 - w) * b)) + 1e-9


def test_identities(spark):
    train, y, a, b = meta(spark, 50)
    q = calibrate.temperature_scale(calibrate.TRIO, F.lit(1.0))
    row = train.select(*[x.alias(f"q{i}") for i, x in enumerate(q)], *calibrate.TRIO).first()
    assert tuple(row)[:3] == pytest.approx(tuple(row)[3:])


@pytest.mark.parametrize("temperature,selected", [(0.7, "raw_trio"), (2.0, "temperature_trio")])
def test_incumbent_rule(spark, temperature, selected):
    """The incumbent is too sharp by construction, so only a larger T replaces it."""
    train, *_ = meta(spark, 300)
    rows = train.withColumns({"match_id": F.monotonically_increasing_id()})
    scored = calibrate.apply_candidates(rows, {"raw_trio": {1: (1.0, 1.0)}, "temperature_trio": {1: (temperature, 1.0)}})
    verdict = calibrate.incumbent_verdicts(scored, ["match_id", "fold"]).first()
    assert verdict["selected"] == selected and verdict["passes"] == (selected != "raw_trio")


def test_exact_medians(spark):
    rng = random.Random(7)
    xs = [rng.choice([rng.gauss(0, 1), 0.25]) for _ in range(4001)]
    ys = [rng.random() if i % 3 else None for i in range(4001)]
    df = spark.createDataFrame([(x, v) for x, v in zip(xs, ys)], "x double, y double").repartition(5)
    got = exact_medians(df, ["x", "y"])
    assert got["x"] == np.median(xs)
    assert got["y"] == np.median([v for v in ys if v is not None])


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 9, [1.0, 1.0, 1e18], [-3.0, 7.0, 7.0, 9.0], [float(i) for i in range(2000)] + [2000.0] * 3000, [None]])
def test_exact_medians_of_few_and_of_skewed_values(spark, values):
    got = exact_medians(spark.createDataFrame([(v,) for v in values], "x double"), ["x"])["x"]
    assert got == (None if values == [None] else np.median(values))


def linear_rows(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    logits = np.stack([0.9 * x[:, 0], -0.2 * np.ones(n), -0.9 * x[:, 0] - 0.3 * x[:, 1]], 1)
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    rows = [(float(a), None if i % 9 == 0 else float(b), t) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "a double, b double, target int"), rows


def test_linear_fit_matches_newton(spark):
    df, rows = linear_rows(spark)
    model = classify.fit_linear(df, ["a", "b"], c=0.5)
    med = np.median([r[1] for r in rows if r[1] is not None])
    z = np.array([[r[0], med if r[1] is None else r[1], float(r[1] is None)] for r in rows])
    z = (z - z.mean(0)) / z.std(0)
    n, k = z.shape
    hot = np.eye(3)[[r[2] for r in rows]]
    design = np.hstack([z, np.ones((n, 1))])
    theta = np.zeros((3, k + 1))
    penalty = np.append(np.full(k, 1 / (0.5 * n)), 0)
    for _ in range(60):
        p = np.exp(design @ theta.T)
        p /= p.sum(1, keepdims=True)
        grad = (p - hot).T @ design / n + theta * penalty
        hess = np.zeros((3 * (k + 1),) * 2)
        for i in range(3):
            for j in range(3):
                weight = p[:, i] * ((i == j) - p[:, j])
                hess[i * (k + 1):(i + 1) * (k + 1), j * (k + 1):(j + 1) * (k + 1)] = (design * weight[:, None]).T @ design / n
        hess += np.diag(np.tile(penalty, 3))
        theta -= (np.linalg.pinv(hess) @ grad.ravel()).reshape(theta.shape)
    want = np.exp(design @ theta.T)
    want /= want.sum(1, keepdims=True)
    got = np.array([tuple(r) for r in classify.predict_linear(df, model).select(*evaluate.PROBABILITIES).collect()])
    assert np.abs(got - want).max() < 1e-5


def test_explanation_adds_up(spark):
    df, _ = linear_rows(spark, 60)
    model = classify.fit_linear(df, ["a", "b"])
    e = explain.explain_linear(df, model)
    assert explain.reconstruction_check(e).first()["sound"]
    for r in e.collect():
        a, b = r["features"]
        assert b["was_imputed"] == (r["b"] is None) and not a["was_imputed"]
        assert a["missingness_logit"] is None and b["missingness_logit"] is not None
        zero = classify.predict_linear(spark.createDataFrame([(0.0, r["b"])], "a double, b double"), model).first() if r["a"] > 1.5 else None
        if zero is not None:
            assert a["sensitivity"]["home"] == pytest.approx(r["p_home"] - zero["p_home"], abs=1e-9)
    assert math.isclose(sum(model.means), sum(model.means))


def test_meta_validation_reads_the_merge_once(spark, monkeypatch):
    """The candidates, the verdicts and the last refit take the merged rows from where they were written."""
    from touchline.plans import calibration

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(p):
        seen.add(1)
        return p

    rows = spark.createDataFrame(
        [(season * 100 + i, 0, season, season - 1998, "2000-01-01", 0 if i % 5 < 3 else 1 + i % 2, 0.9, 0.06, 0.04, 0.3, 0.3, 0.4) for season in (1999, 2000, 2001) for i in range(90)],
        ["match_id", "league", "season", "fold", "match_date", "y", *calibrate.TRIO, *calibrate.DC])
    rows = rows.withColumn("y", F.col("y").cast("int")).withColumn("p_home_trio", counted("p_home_trio"))
    monkeypatch.setattr(calibration, "merged", lambda spark, sf: rows)
    got = calibration.meta_validation(spark, "").collect()
    assert len(got) == 3 and got[0]["selected"] != calibrate.INCUMBENT and got[0]["final_temperature"] > 1
    assert seen.value == 270
