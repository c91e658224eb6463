"""Queries over the meta layer: merge, temperature, pool, incumbent rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import calibrate
from touchline.plans.evaluation import PREDICTIONS, predictions
from touchline.plans.registry import r, register
from touchline.session import fresh_path, refuse_if_any, written
from touchline.sources import prediction_files

APPROVED = [(1, 1999), (2, 2000), (3, 2001)]
META_FOLDS = [(1, [1999], 2000), (2, [1999, 2000], 2001)]
KEY = ["fold", "season", "match_date", "home", "away", "league", "match_id"]

MERGED = PREDICTIONS + """, merged AS MATERIALIZED (
  SELECT a.match_id, a.league, a.season, a.fold, a.match_date, a.y, a.p_home ah, a.p_draw ad, a.p_away aa, b.p_home bh, b.p_draw bd, b.p_away ba
  FROM preds a JOIN preds b ON a.match_id = b.match_id AND a.fold = b.fold AND a.config_id = 'shots_strong' AND b.config_id = 'shots_weak'),
mf(meta_fold, train, evaluation) AS (VALUES (1, [1999], 2000), (2, [1999, 2000], 2001)),
meta AS MATERIALIZED (SELECT m.*, meta_fold, CASE WHEN list_contains(train, season) THEN 'train' ELSE 'evaluate' END part,
  [greatest(ln(ah), -34.5), greatest(ln(ad), -34.5), greatest(ln(aa), -34.5)] z
  FROM merged m JOIN mf ON list_contains(train, season) OR season = evaluation)"""


def two_sets(spark, sf):
    p = predictions(spark, sf)
    return p.where("config_id = 'shots_strong'"), p.where("config_id = 'shots_weak'")


def merged(spark, sf):
    out, problems = calibrate.merge_predictions(*two_sets(spark, sf), KEY, APPROVED)
    refuse_if_any(problems, "merge-problems", "predictions do not merge one to one")
    return out


def training_rows(spark, sf):
    return written(calibrate.meta_rows(merged(spark, sf), META_FOLDS).where("part = 'train'"), "meta-train")


@register("j1_prediction_merge", MERGED + f" SELECT match_id, fold, y, {r('ah')} p_home_trio, {r('ad')} p_draw_trio, {r('aa')} p_away_trio, {r('bh')} p_home_dc, {r('bd')} p_draw_dc, {r('ba')} p_away_dc FROM merged")
def prediction_merge(spark, sf):
    return merged(spark, sf).select("match_id", "fold", "y", *calibrate.TRIO, *calibrate.DC)


@register("j1_merge_guards", PREDICTIONS + """, a AS (SELECT * FROM preds WHERE config_id = 'shots_strong' AND match_id % 11 <> 0),
b AS (SELECT * REPLACE (CASE WHEN match_id % 7 = 0 THEN (y + 1) % 3 ELSE y END AS y) FROM preds WHERE config_id = 'shots_weak')
SELECT 'unmatched' problem, count(*) n FROM b WHERE match_id % 11 = 0 UNION ALL
SELECT 'target_disagrees', count(*) FROM b WHERE match_id % 11 <> 0 AND match_id % 7 = 0 UNION ALL
SELECT 'sealed_season', count(*) FROM b WHERE season >= 2001 UNION ALL
SELECT 'fold_season_not_approved', count(*) FROM b WHERE fold = 3 UNION ALL SELECT 'approved_pair_absent', 1""")
def merge_guards(spark, sf):
    a, b = two_sets(spark, sf)
    y = F.when(F.col("match_id") % 7 == 0, (F.col("y") + 1) % 3).otherwise(F.col("y"))
    _, problems = calibrate.merge_predictions(
        a.where("match_id % 11 <> 0"), b.withColumn("y", y), KEY, [(1, 1999), (2, 2000), (4, 2002)], sealed_from=2001)
    return problems


@register("s5_s6_prediction_files", PREDICTIONS + f" SELECT match_id, fold, y, {r('p_home')} p_home, {r('p_draw')} p_draw, {r('p_away')} p_away FROM preds WHERE config_id = 'shots_weak'")
def prediction_csv(spark, sf):
    """Write the long table as CSV, read one configuration back under its guards."""
    path = fresh_path(spark, "predictions")
    p = predictions(spark, sf)
    prediction_files.write_predictions(p, path)
    expected = p.where("config_id = 'shots_weak'").count()
    back = prediction_files.read_config(spark, path, "shots_weak", expected, KEY)
    return back.select("match_id", "fold", "y", "p_home", "p_draw", "p_away")


SCALED = "exp(z[1] / {t}) / s"


@register("f6_temperature_scaling", MERGED + f", x AS (SELECT match_id, meta_fold, z, exp(z[1] / 1.7) + exp(z[2] / 1.7) + exp(z[3] / 1.7) s FROM meta WHERE part = 'evaluate') "
          f"SELECT match_id, meta_fold, {r('exp(z[1] / 1.7) / s')} p_home, {r('exp(z[2] / 1.7) / s')} p_draw, {r('exp(z[3] / 1.7) / s')} p_away FROM x")
def temperature_scaling(spark, sf):
    rows = calibrate.meta_rows(merged(spark, sf), META_FOLDS).where("part = 'evaluate'")
    q = calibrate.temperature_scale(calibrate.TRIO, F.lit(1.7))
    return rows.select("match_id", "meta_fold", q[0].alias("p_home"), q[1].alias("p_draw"), q[2].alias("p_away"))


@register("f7_convex_pool", MERGED + f" SELECT match_id, {r('0.3 * ah + 0.7 * bh')} p_home, {r('0.3 * ad + 0.7 * bd')} p_draw, {r('0.3 * aa + 0.7 * ba')} p_away FROM merged")
def convex_pool(spark, sf):
    q = calibrate.convex_pool([F.col(c) for c in calibrate.TRIO], [F.col(c) for c in calibrate.DC], F.lit(0.3))
    return merged(spark, sf).select("match_id", q[0].alias("p_home"), q[1].alias("p_draw"), q[2].alias("p_away"))


@register("k4_meta_folds", MERGED + " SELECT match_id, meta_fold, part FROM meta")
def meta_folds(spark, sf):
    rows = calibrate.meta_rows(merged(spark, sf), META_FOLDS)
    if calibrate.meta_order_violations(rows).limit(1).collect():
        raise ValueError("meta-training rows are not strictly earlier")
    return rows.select("match_id", "meta_fold", "part")


NEWTON_T = MERGED.replace("WITH ", "WITH RECURSIVE ", 1) + """, nt(i, meta_fold, b) AS (
  SELECT 0, meta_fold, 1.0::DOUBLE FROM mf UNION ALL
  (WITH q AS (SELECT i, n.meta_fold, b, z, y, list_transform(z, lambda v: exp(v * b - list_max(z) * b)) e FROM nt n JOIN meta m ON m.meta_fold = n.meta_fold AND part = 'train' WHERE i < 12),
   d AS (SELECT *, (e[1] * z[1] + e[2] * z[2] + e[3] * z[3]) / list_sum(e) mu, (e[1] * z[1] * z[1] + e[2] * z[2] * z[2] + e[3] * z[3] * z[3]) / list_sum(e) s2 FROM q)
   SELECT i + 1, meta_fold, least(5.0, greatest(0.2, any_value(b) - avg(mu - z[y + 1]) / avg(s2 - mu * mu))) FROM d GROUP BY i, meta_fold))"""


@register("m6_temperature_fit", NEWTON_T + f" SELECT meta_fold, {r('1 / b', 4)} temperature FROM nt WHERE i = 12")
def temperature_fit(spark, sf):
    fitted = calibrate.fit_temperature(training_rows(spark, sf))
    return spark.createDataFrame([(f, round(t, 4)) for f, t in sorted(fitted.items())], "meta_fold int, temperature double")


@register("m7_pool_weight_fit", MERGED + f""", g AS (SELECT unnest(range(0, 1001)) / 1000.0::DOUBLE w),
pair AS (SELECT meta_fold, [ah, ad, aa][y + 1] a, [bh, bd, ba][y + 1] b FROM meta WHERE part = 'train'),
l AS (SELECT meta_fold, w, avg(-ln(w * a + (1 - w) * b)) ll FROM pair, g GROUP BY ALL)
SELECT meta_fold, arg_min(w, ll) weight FROM l GROUP BY meta_fold""")
def pool_weight_fit(spark, sf):
    fitted = calibrate.fit_weight(training_rows(spark, sf))
    return spark.createDataFrame([(f, round(w, 3)) for f, w in sorted(fitted.items())], "meta_fold int, weight double")


def _meta_fits(rows: str) -> str:
    """Newton recursions over ``rows`` (meta_fold, z, y, a, d): nt has 1 / T of the scaled model, wn the weight of the raw pool, jn both
    of the joint one. A parameter at its bound that would leave it rests."""
    e = "list_transform(z, lambda v: exp(v * b - list_max(z) * b)) e"
    moments = "(e[1] * z[1] + e[2] * z[2] + e[3] * z[3]) / list_sum(e) mu, (e[1] * z[1] * z[1] + e[2] * z[2] * z[2] + e[3] * z[3] * z[3]) / list_sum(e) s2"
    return f"""folds0 AS (SELECT DISTINCT meta_fold FROM {rows}),
nt(i, meta_fold, b) AS (SELECT 0, meta_fold, 1.0::DOUBLE FROM folds0 UNION ALL
  (WITH q AS (SELECT i, n.meta_fold, b, z, y, {e} FROM nt n JOIN {rows} m ON m.meta_fold = n.meta_fold WHERE i < 15), d AS (SELECT *, {moments} FROM q)
   SELECT i + 1, meta_fold, least(5.0, greatest(0.2, any_value(b) - avg(mu - z[y + 1]) / avg(s2 - mu * mu))) FROM d GROUP BY i, meta_fold)),
wn(i, meta_fold, w) AS (SELECT 0, meta_fold, 0.5::DOUBLE FROM folds0 UNION ALL
  (WITH q AS (SELECT i, n.meta_fold, w, (a - d) / greatest(w * a + (1 - w) * d, 1e-15) g FROM wn n JOIN {rows} m ON m.meta_fold = n.meta_fold WHERE i < 40)
   SELECT i + 1, meta_fold, least(1.0, greatest(0.0, any_value(w) + avg(g) / avg(g * g))) FROM q GROUP BY i, meta_fold)),
jn(i, meta_fold, b, w) AS (SELECT 0, meta_fold, 1.0::DOUBLE, 0.5::DOUBLE FROM folds0 UNION ALL
  (WITH q0 AS (SELECT i, n.meta_fold, b, w, z, y, d, {e} FROM jn n JOIN {rows} m ON m.meta_fold = n.meta_fold WHERE i < 60),
   q1 AS (SELECT *, e[y + 1] / list_sum(e) qy, {moments} FROM q0), q2 AS (SELECT *, z[y + 1] - mu u, greatest(w * qy + (1 - w) * d, 1e-15) mm FROM q1),
   q3 AS (SELECT *, w * qy * u / mm rb, (qy - d) / mm rw FROM q2),
   g AS (SELECT i, meta_fold, any_value(b) b, any_value(w) w, avg(-rb) gb, avg(-rw) gw, abs(avg(rb * rb - w * qy * (u * u - (s2 - mu * mu)) / mm)) + 1e-9 hbb, avg(rw * rw) + 1e-9 hww,
     avg(rb * rw - qy * u / mm) hbw FROM q3 GROUP BY i, meta_fold),
   f AS (SELECT *, NOT ((w <= 0 AND gw > 0) OR (w >= 1 AND gw < 0)) free, CASE WHEN hbb * hww > hbw * hbw THEN hbw ELSE 0 END h FROM g)
   SELECT i + 1, meta_fold, least(5.0, greatest(0.2, CASE WHEN free THEN b - (hww * gb - h * gw) / (hbb * hww - h * h) ELSE b - gb / hbb END)),
     least(1.0, greatest(0.0, CASE WHEN free THEN w - (hbb * gw - h * gb) / (hbb * hww - h * h) ELSE w END)) FROM f))"""


_OF_Y = "[ah, ad, aa][y + 1] a, [bh, bd, ba][y + 1] d"
FITTED = MERGED.replace("WITH ", "WITH RECURSIVE ", 1) + f""", fitrow AS MATERIALIZED (SELECT meta_fold, z, y, {_OF_Y} FROM meta WHERE part = 'train' UNION ALL
  SELECT 0, [greatest(ln(ah), -34.5), greatest(ln(ad), -34.5), greatest(ln(aa), -34.5)], y, {_OF_Y} FROM merged), {_meta_fits("fitrow")}"""


@register("m8_joint_fit", FITTED + f" SELECT meta_fold, {r('1 / b', 4)} temperature, {r('w', 4)} weight FROM jn WHERE i = 60 AND meta_fold > 0")
def joint_fit(spark, sf):
    fitted = calibrate.fit_joint(training_rows(spark, sf))
    return spark.createDataFrame([(f, round(t, 4), round(w, 4)) for f, (t, w) in sorted(fitted.items())], "meta_fold int, temperature double, weight double")


FIXED_PARAMS = {"raw_trio": {1: (1.0, 1.0), 2: (1.0, 1.0)}, "temperature_trio": {1: (1.3, 1.0), 2: (1.6, 1.0)},
                "pool_raw_trio": {1: (1.0, 0.4), 2: (1.0, 0.2)}}
_LL = "-ln(greatest(py, 1e-15))"


@register("k5_incumbent_rule", MERGED + f""", ev AS (SELECT *, [ah, ad, aa][y + 1] a, [bh, bd, ba][y + 1] b, CASE meta_fold WHEN 1 THEN 1.3 ELSE 1.6 END t FROM meta WHERE part = 'evaluate'),
c AS (SELECT match_id, meta_fold, 'raw_trio' cand, a py FROM ev UNION ALL
  SELECT match_id, meta_fold, 'temperature_trio', exp(z[y + 1] / t) / (exp(z[1] / t) + exp(z[2] / t) + exp(z[3] / t)) FROM ev UNION ALL
  SELECT match_id, meta_fold, 'pool_raw_trio', CASE meta_fold WHEN 1 THEN 0.4 * a + 0.6 * b ELSE 0.2 * a + 0.8 * b END FROM ev),
f AS (SELECT cand, meta_fold, avg({_LL}) ll FROM c GROUP BY ALL), i AS (SELECT meta_fold, ll inc FROM f WHERE cand = 'raw_trio'),
v AS (SELECT cand, avg(ll) m, avg(inc) mi, avg(ll) < avg(inc) lower_mean, bool_and(ll < inc) every, max(ll) <= max(inc) worst FROM f JOIN i USING (meta_fold) WHERE cand <> 'raw_trio' GROUP BY cand),
p AS (SELECT x.cand, avg(-ln(x.py) + ln(o.py)) md, stddev_samp(-ln(x.py) + ln(o.py)) / sqrt(count(*)) se, count(*) n
  FROM c x JOIN c o ON o.cand = 'raw_trio' AND o.match_id = x.match_id AND o.meta_fold = x.meta_fold WHERE x.cand <> 'raw_trio' GROUP BY x.cand),
t AS (SELECT *, abs(md) >= 2 * se AND md < 0 improved FROM v JOIN p USING (cand)),
s AS (SELECT coalesce((SELECT cand FROM t WHERE lower_mean AND improved AND every AND worst ORDER BY m LIMIT 1), 'raw_trio') selected)
SELECT cand config_id, {r('m')} mean_log_loss, {r('mi')} incumbent_mean, lower_mean, every better_every_season, worst no_worse_worst_season, {r('md')} mean_diff,
  n, {r('se')} standard_error, improved paired_improvement, lower_mean AND improved AND every AND worst passes, 1 n_params, selected FROM t, s""")
def incumbent_rule(spark, sf):
    rows = calibrate.meta_rows(merged(spark, sf), META_FOLDS).where("part = 'evaluate'")
    return calibrate.incumbent_verdicts(calibrate.apply_candidates(rows, FIXED_PARAMS), ["match_id", "fold"])


@register("t4_best_challenger", MERGED + f""", ev AS (SELECT *, [ah, ad, aa][y + 1] a, [bh, bd, ba][y + 1] b FROM meta WHERE part = 'evaluate'),
c AS (SELECT meta_fold, 'raw_trio' cand, a py FROM ev UNION ALL SELECT meta_fold, 'pool_raw_trio', CASE meta_fold WHEN 1 THEN 0.4 * a + 0.6 * b ELSE 0.2 * a + 0.8 * b END FROM ev),
f AS (SELECT cand, meta_fold, avg({_LL}) ll FROM c GROUP BY ALL)
SELECT cand config_id, {r('avg(ll)')} mean_log_loss FROM f GROUP BY cand ORDER BY avg(ll) LIMIT 1""")
def best_challenger(spark, sf):
    from touchline.operators.evaluate import config_summary

    rows = calibrate.meta_rows(merged(spark, sf), META_FOLDS).where("part = 'evaluate'")
    some = {k: v for k, v in FIXED_PARAMS.items() if k != "temperature_trio"}
    return config_summary(calibrate.apply_candidates(rows, some), ["config_id"]).orderBy("mean_log_loss").limit(1).select("config_id", "mean_log_loss")


@register("k4_k6_meta_validation", FITTED + f""", nt1 AS MATERIALIZED (SELECT meta_fold, 1 / b t FROM nt WHERE i = 15), wn1 AS MATERIALIZED (SELECT meta_fold, w FROM wn WHERE i = 40), jn1 AS MATERIALIZED (SELECT meta_fold, 1 / b t, w FROM jn WHERE i = 60),
par AS (SELECT 'raw_trio' cand, meta_fold, 1.0::DOUBLE t, 1.0::DOUBLE w, 0 np FROM nt1 UNION ALL SELECT 'temperature_trio', meta_fold, t, 1.0, 1 FROM nt1
  UNION ALL SELECT 'pool_raw_trio', meta_fold, 1.0, w, 1 FROM wn1 UNION ALL SELECT 'pool_calibrated_trio', meta_fold, t, w, 2 FROM jn1),
c AS MATERIALIZED (SELECT match_id, m.meta_fold, cand, np, w * exp(z[y + 1] / t) / (exp(z[1] / t) + exp(z[2] / t) + exp(z[3] / t)) + (1 - w) * [bh, bd, ba][y + 1] py FROM meta m JOIN par USING (meta_fold) WHERE part = 'evaluate'),
f AS (SELECT cand, meta_fold, any_value(np) np, avg({_LL}) ll FROM c GROUP BY cand, meta_fold), i AS (SELECT meta_fold, ll inc FROM f WHERE cand = 'raw_trio'),
v AS (SELECT cand, any_value(np) np, avg(ll) m, avg(inc) mi, avg(ll) < avg(inc) lower_mean, bool_and(ll < inc) every, max(ll) <= max(inc) worst FROM f JOIN i USING (meta_fold) WHERE cand <> 'raw_trio' GROUP BY cand),
p AS (SELECT x.cand, avg(-ln(x.py) + ln(o.py)) md, stddev_samp(-ln(x.py) + ln(o.py)) / sqrt(count(*)) se, count(*) n
  FROM c x JOIN c o ON o.cand = 'raw_trio' AND o.match_id = x.match_id AND o.meta_fold = x.meta_fold WHERE x.cand <> 'raw_trio' GROUP BY x.cand),
t AS (SELECT *, abs(md) >= 2 * se AND md < 0 improved FROM v JOIN p USING (cand)),
s AS (SELECT coalesce((SELECT cand FROM t WHERE lower_mean AND improved AND every AND worst ORDER BY m, np, cand LIMIT 1), 'raw_trio') selected),
last AS (SELECT t, w FROM par, s WHERE meta_fold = 0 AND cand = selected)
SELECT cand config_id, {r('m')} mean_log_loss, {r('mi')} incumbent_mean, lower_mean, every better_every_season, worst no_worse_worst_season, {r('md')} mean_diff,
  n, {r('se')} standard_error, improved paired_improvement, lower_mean AND improved AND every AND worst passes, np n_params, selected, {r('last.t', 4)} final_temperature, {r('last.w', 4)} final_weight FROM t, s, last""")
def meta_validation(spark, sf):
    """All candidates fitted per meta-fold, judged, and the final parameters."""
    both = written(merged(spark, sf), "merged")  # the last refit reads it once a pass
    all_rows = written(calibrate.meta_rows(both, META_FOLDS), "meta")
    params = calibrate.fit_candidates(all_rows.where("part = 'train'"))
    scored = calibrate.apply_candidates(all_rows.where("part = 'evaluate'"), params)
    verdicts = written(calibrate.incumbent_verdicts(scored, ["match_id", "fold"]), "verdicts")  # a few rows, read twice
    selected = verdicts.select("selected").first()["selected"]
    t, w = calibrate.final_parameters(both, selected)
    return verdicts.withColumns({"final_temperature": F.lit(round(t, 4)), "final_weight": F.lit(round(w, 4))})


@register("k7_meta_probe", MERGED + " SELECT meta_fold, count(*) n_train, 0 n_changed, 1 n_control FROM meta WHERE part = 'train' GROUP BY meta_fold")
def meta_probe(spark, sf):
    """Turning every result from a meta-fold's evaluation season on must not change its fitted temperature; turning an earlier one must."""
    rows = written(merged(spark, sf), "meta-probe")
    out = []
    for fold, train, evaluation in META_FOLDS:
        def fitted(turned):
            changed = rows.withColumn("y", F.when(turned, (F.col("y") + 1) % 3).otherwise(F.col("y")))
            return calibrate.fit_temperature(calibrate.meta_rows(changed, [(fold, train, evaluation)]).where("part = 'train'"))[fold]

        before = fitted(F.lit(False))
        probe, control = fitted(F.col("season") >= evaluation), fitted((F.col("season") < evaluation) & (F.col("match_id") % 2 == 0))
        out.append((fold, rows.where(F.col("season").isin(train)).count(), int(probe != before), int(control != before)))
    return spark.createDataFrame(out, "meta_fold int, n_train long, n_changed int, n_control int")
