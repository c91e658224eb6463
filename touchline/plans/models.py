"""Queries over fitted and frozen outcome models."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import schema as S
from touchline.operators import classify, evaluate, explain, features, form, grids, seasons
from touchline.operators.classify import LinearModel
from touchline.operators.folds import assign_folds
from touchline.operators.medians import exact_medians
from touchline.plans import sqltext as Q
from touchline.plans.goals import FOLDS
from touchline.plans.registry import r, register
from touchline.session import fresh_path, written
from touchline.sources.contests import contests

_FEATURES: dict = {}


def feature_table(spark, sf):
    """The feature table, written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FEATURES:
        _FEATURES[key] = written(features.build_features(contests(spark, sf)), "features")
    return _FEATURES[key]


# A frozen model on three form differences. Two columns had nulls in training.
FORM_COLUMNS = ["diff_std_gd", "diff_ewma_ppg", "diff_ewma_sot_diff"]
FROZEN = LinearModel(
    FORM_COLUMNS, [0.0, 0.01, -0.02], ["diff_std_gd", "diff_ewma_ppg"], [0.0, 0.0, 0.0, 0.1, 0.15], [1.2173, 0.5119, 1.1071, 0.3037, 0.3571],
    [[0.21, 0.35, 0.12, -0.05, 0.04], [-0.02, -0.03, 0.01, 0.02, -0.01], [-0.19, -0.32, -0.13, 0.03, -0.03]], [0.25, -0.1, -0.15])


def form_differences(spark, sf):
    m = seasons.with_season_index(contests(spark, sf))
    state = form.team_state(form.team_days(m)).withColumn("elo", F.lit(0.0))
    wide = features.attach_sides(m.select("match_id", "season", "league", "season_idx", "match_date", "home", "away", "ftr"), state,
                                 ["elo", "std_ppg", "std_gd", *[f"ewma_{n}" for n in form.EWMA_NAMES]])
    return form.matchups(wide).select("match_id", *FORM_COLUMNS)


def _frozen_sql():
    x = [f"(coalesce({c}, {m!r}) - {mu!r}) / {s!r}" for c, m, mu, s in zip(FORM_COLUMNS, FROZEN.medians, FROZEN.means, FROZEN.scales)]
    x += [f"(({c} IS NULL)::INT - {mu!r}) / {s!r}" for c, mu, s in zip(FROZEN.indicators, FROZEN.means[3:], FROZEN.scales[3:])]
    x = [f"({v})::DOUBLE x{i}" for i, v in enumerate(x)]
    logits = [" + ".join([repr(b)] + [f"{w!r} * x{i}" for i, w in enumerate(row)]) for row, b in zip(FROZEN.coefficients, FROZEN.intercepts)]
    return f"""WITH {Q.FORM}, s AS (SELECT DISTINCT league, match_date, team, {Q.FORM_COLUMNS} FROM form),
fd0 AS (SELECT m.match_id, h.std_gd - a.std_gd diff_std_gd, h.ewma_ppg - a.ewma_ppg diff_ewma_ppg,
  (h.ewma_sot_for - h.ewma_sot_against) - (a.ewma_sot_for - a.ewma_sot_against) diff_ewma_sot_diff
  FROM m JOIN s h ON h.league = m.league AND h.match_date = m.match_date AND h.team = m.home
         JOIN s a ON a.league = m.league AND a.match_date = m.match_date AND a.team = m.away),
xs AS (SELECT *, {", ".join(x)} FROM fd0),
lg AS (SELECT *, {", ".join(f"({z})::DOUBLE z{j}" for j, z in enumerate(logits))} FROM xs),
pr0 AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) e0, exp(z1 - greatest(z0, z1, z2)) e1, exp(z2 - greatest(z0, z1, z2)) e2 FROM lg),
p AS MATERIALIZED (SELECT *, e0 / (e0 + e1 + e2) p0, e1 / (e0 + e1 + e2) p1, e2 / (e0 + e1 + e2) p2,
  CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END top FROM pr0)"""


FROZEN_SQL = _frozen_sql()


@register("m9_frozen_scoring", FROZEN_SQL + f" SELECT match_id, {r('p0')} p_home, {r('p1')} p_draw, {r('p2')} p_away, ['H', 'D', 'A'][top + 1] predicted_class FROM p")
def frozen_scoring(spark, sf):
    return classify.predict_linear(form_differences(spark, sf), FROZEN).drop(*FORM_COLUMNS)


def _contribution_sql():
    """One row per match and feature."""
    parts = []
    for k, c in enumerate(FORM_COLUMNS):
        i = 3 + FROZEN.indicators.index(c) if c in FROZEN.indicators else None
        val = [f"{FROZEN.coefficients[j][k]!r} * x{k}" for j in range(3)]
        mis = [f"{FROZEN.coefficients[j][i]!r} * x{i}" if i else "0.0" for j in range(3)]
        ref = [f"({FROZEN.coefficients[j][k]!r} * (0.0 - {FROZEN.means[k]!r}) / {FROZEN.scales[k]!r}"
               + (f" + {FROZEN.coefficients[j][i]!r} * (0.0 - {FROZEN.means[i]!r}) / {FROZEN.scales[i]!r}" if i else "") + ")::DOUBLE" for j in range(3)]
        cols = [f"'{c}' AS \"name\"", f"{c} raw", f"coalesce({c}, {FROZEN.medians[k]!r}) eff", f"{f'{c} IS NULL' if i else 'false'} imp", f"{k} k"]
        cols += [f"{v} v{j}" for j, v in enumerate(val)] + [f"({v})::DOUBLE m{j}" for j, v in enumerate(mis)]
        cols += [f"z{j} - ({val[j]}) - ({mis[j]}) + {ref[j]} c{j}" for j in range(3)]
        parts.append(f"SELECT match_id, top, p0, p1, p2, {', '.join(cols)} FROM p")
    return FROZEN_SQL + ", con0 AS (" + " UNION ALL ".join(parts) + """),
con AS MATERIALIZED (SELECT *, v0 + m0 g0, v1 + m1 g1, v2 + m2 g2,
  CASE WHEN raw = 0 THEN 0 ELSE p0 - exp(c0) / (exp(c0) + exp(c1) + exp(c2)) END s0, CASE WHEN raw = 0 THEN 0 ELSE p1 - exp(c1) / (exp(c0) + exp(c1) + exp(c2)) END s1,
  CASE WHEN raw = 0 THEN 0 ELSE p2 - exp(c2) / (exp(c0) + exp(c1) + exp(c2)) END s2 FROM con0)"""


CONTRIBUTIONS = _contribution_sql()


@register("m10_linear_explanation", CONTRIBUTIONS + f""" SELECT match_id, "name", {r('raw')} raw_value, {r('eff')} effective_value, imp was_imputed,
  {r('v0')} value_home, {r('m0')} missingness_home, {r('g0')} grouped_home, {r('g1')} grouped_draw, {r('g2')} grouped_away FROM con""")
def linear_explanation(spark, sf):
    e = explain.explain_linear(form_differences(spark, sf), FROZEN)
    f = F.col("f")
    return e.select("match_id", F.explode_outer("features").alias("f")).select(
        "match_id", f["name"].alias("name"), f["raw_value"].alias("raw_value"), f["effective_value"].alias("effective_value"),
        f["was_imputed"].alias("was_imputed"), f["value_logit"]["home"].alias("value_home"),
        F.coalesce(f["missingness_logit"]["home"], F.lit(0.0)).alias("missingness_home"),
        *[f["grouped_logit"][n].alias(f"grouped_{n}") for n in explain.LONG_NAMES])


@register("m10_reconstruction", FROZEN_SQL + " SELECT count(*) n_rows, true sound FROM p")
def reconstruction(spark, sf):
    return explain.reconstruction_check(explain.explain_linear(form_differences(spark, sf), FROZEN)).select("n_rows", "sound")


@register("m11_counterfactual", CONTRIBUTIONS + f""" SELECT match_id, "name", {r('s0')} sensitivity_home, {r('s1')} sensitivity_draw, {r('s2')} sensitivity_away, imp changed_missingness FROM con""")
def counterfactual(spark, sf):
    e = explain.explain_linear(form_differences(spark, sf), FROZEN)
    f = F.col("f")
    return e.select("match_id", F.explode_outer("features").alias("f")).select(
        "match_id", f["name"].alias("name"), *[f["sensitivity"][n].alias(f"sensitivity_{n}") for n in explain.LONG_NAMES],
        f["counterfactual_changed_missingness"].alias("changed_missingness"))


_DIRECTION = "CASE WHEN {v} > 0 THEN 'supports_' WHEN {v} < 0 THEN 'opposes_' END || ['home', 'draw', 'away'][top + 1]"


@register("m12_w13_drivers", CONTRIBUTIONS + f""", g AS (SELECT *, [g0, g1, g2][top + 1] gv, [s0, s1, s2][top + 1] sv FROM con)
SELECT match_id, 'logit' kind, row_number() OVER (PARTITION BY match_id ORDER BY gv DESC, k) AS "rank", "name" feature, {r('gv')} AS "value", coalesce({_DIRECTION.format(v='gv')}, 'neutral') direction FROM g
UNION ALL SELECT match_id, 'sensitivity', row_number() OVER (PARTITION BY match_id ORDER BY sv DESC, k), "name", {r('sv')}, coalesce({_DIRECTION.format(v='sv')}, 'neutral') FROM g""")
def drivers(spark, sf):
    e = explain.explain_linear(form_differences(spark, sf), FROZEN)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("drivers")) for k, c in (("logit", "drivers_by_logit"), ("sensitivity", "drivers_by_sensitivity"))])
    each = e.select("match_id", F.explode(kinds).alias("x")).select("match_id", "x.kind", F.posexplode_outer("x.drivers").alias("pos", "d"))
    return each.select("match_id", "kind", (F.col("pos") + 1).alias("rank"), "d.feature", "d.value", "d.direction")


@register("m1_exact_medians", f"WITH {Q.FORM}, f AS (SELECT DISTINCT league, match_date, team, {Q.FORM_COLUMNS} FROM form) "
          f"SELECT {r('median(ewma_gf)')} ewma_gf, {r('median(ewma_ppg)')} ewma_ppg, {r('median(std_gd)')} std_gd, {r('median(rest_days)')} rest_days FROM f")
def medians(spark, sf):
    state = form.team_state(form.team_days(seasons.with_season_index(contests(spark, sf))))
    columns = ["ewma_gf", "ewma_ppg", "std_gd", "rest_days"]
    found = exact_medians(written(state.select(*columns), "state"), columns)
    return spark.createDataFrame([tuple(found[c] for c in columns)], ", ".join(f"{c} double" for c in columns))


def fold_predictions(spark, sf, config_id, predict):
    """Fit on each fold's training rows, predict its validation rows, unite."""
    rows = assign_folds(feature_table(spark, sf), FOLDS)
    out = None
    for fold, _, _ in FOLDS:
        train = rows.where((F.col("fold") == fold) & (F.col("part") == "train"))
        val = rows.where((F.col("fold") == fold) & (F.col("part") == "validation"))
        one = predict(train, val).select(
            "match_id", "season", "match_date", "home", "away", "fold", F.col("target").alias("y"), "ftr",
            F.lit(config_id).alias("config_id"), *evaluate.PROBABILITIES)
        out = one if out is None else out.unionByName(one)
    return out


def linear(columns, c=1.0, impute=True):
    return lambda train, val: classify.predict_linear(val, classify.fit_linear(train, columns, c, impute))


@register("m1_baselines_out_of_fold")
def baselines(spark, sf):
    elo_only = fold_predictions(spark, sf, "baseline_elo_only", linear(["elo_diff"], impute=False))
    trio = fold_predictions(spark, sf, "baseline_strength_trio", linear(S.TRIO_COLUMNS))
    return elo_only.unionByName(trio)


_GRIDS: dict = {}
_GRID_ROWS: dict = {}


def grid_predictions(spark, sf, family):
    """All points of a family on all folds, predicted for every validation row; fitted once per application and table."""
    key = (spark.sparkContext.applicationId, sf, family)
    if key not in _GRIDS:
        folds, columns = [n for n, _, _ in FOLDS], tuple(grids.FAMILIES[family])
        own = (*key[:2], columns)
        if own not in _GRID_ROWS:
            _GRID_ROWS[own] = grids.grid_rows(assign_folds(feature_table(spark, sf), FOLDS), folds, list(columns))
        _GRIDS[key] = written(grids.predictions_of(_GRID_ROWS[own], folds, [family]), "grid-predictions")
    return _GRIDS[key]


def _points_sql(*families):
    points = ", ".join(f"('{p}')" for p, (family, _) in grids.POINTS.items() if family in families)
    folds = ", ".join(f"({n}, {v})" for n, _, v in FOLDS)
    return f"""WITH {Q.CONTESTS}, pt AS (SELECT * FROM (VALUES {points}) t(config_id)), fd AS (SELECT * FROM (VALUES {folds}) t(fold, season))
SELECT config_id, fold, count(*) n_rows, count(*) FILTER (WHERE ftr = 'H') n_home, count(*) FILTER (WHERE ftr = 'D') n_draw, count(*) FILTER (WHERE ftr = 'A') n_away, 0 n_unsound
FROM contests JOIN fd USING (season) CROSS JOIN pt GROUP BY ALL"""


def point_counts(predictions):
    """Rows and classes of every point and fold, and rows that break the probability contract."""
    p = [F.col(c) for c in evaluate.PROBABILITIES]
    sound = (F.least(*p) >= 0) & (F.abs(p[0] + p[1] + p[2] - 1.0) <= 1e-6) & ~F.isnan(p[0] + p[1] + p[2])
    return predictions.groupBy("config_id", "fold").agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col("y") == k).alias(n) for k, n in enumerate(("n_home", "n_draw", "n_away"))],
        F.count_if(~F.coalesce(sound, F.lit(False))).alias("n_unsound"))


@register("m1_logistic_grid", _points_sql("logreg"))
def logistic_grid(spark, sf):
    return point_counts(grid_predictions(spark, sf, "logreg"))


@register("m2_forest_grid", _points_sql("forest"))
def forest_grid(spark, sf):
    return point_counts(grid_predictions(spark, sf, "forest"))


@register("m3_boosted_grid", _points_sql("xgboost", "catboost"))
def boosted_grid(spark, sf):
    return point_counts(grid_predictions(spark, sf, "xgboost").unionByName(grid_predictions(spark, sf, "catboost")))


@register("m2_random_forest_fold")
def random_forest(spark, sf):
    """The metric suite of all six points on all folds."""
    return evaluate.fold_metrics(grid_predictions(spark, sf, "forest"), ["config_id", "fold"])


@register("m3_boosted_trees_fold")
def boosted(spark, sf):
    """The metric suite of all twenty points on all folds."""
    return evaluate.fold_metrics(grid_predictions(spark, sf, "xgboost").unionByName(grid_predictions(spark, sf, "catboost")), ["config_id", "fold"])


@register("k3_grid_selection")
def grid_selection(spark, sf):
    """The tie-aware selection over every grid point of all families."""
    every = None
    for family in grids.FAMILIES:
        one = grid_predictions(spark, sf, family).withColumn("family", F.lit(family))
        every = one if every is None else every.unionByName(one)
    return evaluate.select_best(every, ["match_id", "fold", "y"], {"logreg": 0, "forest": 1, "xgboost": 2, "catboost": 3}, "family")


@register("m14_s10_final_model")
def final_model(spark, sf):
    """Fit the frozen configuration on every row before the sealed season, save,
    load, score the sealed season's rows."""
    rows = feature_table(spark, sf)
    train = rows.where("season < 2001")
    last = train.agg(F.max("season")).first()[0]
    if last != 2000:
        raise ValueError(f"training must end at 2000, got {last}")
    path = fresh_path(spark, "linear-model")
    classify.save_linear(spark, classify.fit_linear(train, S.TRIO_COLUMNS), path)
    model = classify.load_linear(spark, path)
    return classify.predict_linear(rows.where("season = 2001").select("match_id", *S.TRIO_COLUMNS), model)
