"""Queries over probabilistic predictions: contract, metrics, comparison, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import labels
from touchline.operators import evaluate
from touchline.operators.seasons import target
from touchline.plans import sqltext as Q
from touchline.plans.goals import FOLD_SQL, FOLDS
from touchline.operators.folds import assign_folds
from touchline.plans.registry import r, register
from touchline.sources.contests import contests

# Two formula predictors on contest columns and the training-share baseline.
FORMULAS = {"shots_strong": (0.1, 0.6), "shots_weak": (0.2, 0.1)}

PREDICTIONS = f"""WITH {Q.CONTESTS}, {FOLD_SQL},
val AS (SELECT c.*, fold, CASE ftr WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END y FROM contests c JOIN fd ON season = validation),
freq AS (SELECT fold, avg((ftr = 'H')::INT) ph, avg((ftr = 'D')::INT) pd, avg((ftr = 'A')::INT) pa FROM contests JOIN fd ON season <= cutoff GROUP BY fold),
preds AS MATERIALIZED (
  SELECT match_id, league, season, match_date, home, away, fold, y, ftr, config_id, 0.74 * e p_home, 0.26::DOUBLE p_draw, 0.74 * (1 - e) p_away FROM (
    SELECT *, 1 / (1 + exp(-(a + b * (hs - as_) / 10.0::DOUBLE))) e FROM val, (VALUES ('shots_strong', 0.1::DOUBLE, 0.6::DOUBLE), ('shots_weak', 0.2::DOUBLE, 0.1::DOUBLE)) f(config_id, a, b))
  UNION ALL SELECT match_id, league, season, match_date, home, away, fold, y, ftr, 'baseline_class_frequency', ph, pd, pa FROM val JOIN freq USING (fold)),
scored AS MATERIALIZED (
  SELECT *, CASE y WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END py, greatest(p_home, p_draw, p_away) conf,
    CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END top FROM preds)"""

KEEP = ["match_id", "league", "season", "match_date", "home", "away", "fold", "y", "ftr", "config_id"]


def predictions(spark, sf):
    """The long out-of-fold table: one row per configuration, fold and match."""
    rows = assign_folds(contests(spark, sf), FOLDS).withColumn("y", target(F.col("ftr")))
    val = rows.where("part = 'validation'")
    parts = []
    for name, (a, b) in FORMULAS.items():
        e = 1.0 / (1.0 + F.exp(-(a + b * (F.col("hs") - F.col("as_")) / 10.0)))
        parts.append(val.withColumn("config_id", F.lit(name)).select(
            *KEEP, (0.74 * e).alias("p_home"), F.lit(0.26).alias("p_draw"), (0.74 * (1 - e)).alias("p_away")))
    shares = evaluate.class_frequencies(rows.where("part = 'train'"), ["fold"])
    parts.append(val.withColumn("config_id", F.lit("baseline_class_frequency")).join(shares, "fold").select(*KEEP, *evaluate.PROBABILITIES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("u5_prediction_union", PREDICTIONS + f" SELECT match_id, season, match_date::VARCHAR match_date, home, away, fold, y, ftr, config_id, {r('p_home')} p_home, {r('p_draw')} p_draw, {r('p_away')} p_away FROM preds")
def prediction_union(spark, sf):
    return predictions(spark, sf).drop("league")


@register("a11_class_frequency", PREDICTIONS + f" SELECT fold, {r('ph')} p_home, {r('pd')} p_draw, {r('pa')} p_away FROM freq")
def class_frequency(spark, sf):
    rows = assign_folds(contests(spark, sf), FOLDS).withColumn("y", target(F.col("ftr"))).where("part = 'train'")
    return evaluate.class_frequencies(rows, ["fold"])


EDGE10 = ", ".join(repr(e) for e in evaluate.bin_edges(10))
GAP = ("(SELECT sum(abs(g)) / sum(n) FROM (SELECT count(*) n, sum(conf - (top = y)::INT) g FROM scored z JOIN (SELECT unnest(['"
       + "', '".join(repr(e) for e in evaluate.bin_edges(10)[:-1]) + "'])::DOUBLE lo, unnest(['"
       + "', '".join(repr(e) for e in evaluate.bin_edges(10)[1:]) + "'])::DOUBLE hi) b ON (conf > lo OR (lo = 0 AND conf >= 0)) AND conf <= hi "
       "WHERE z.config_id = s.config_id AND z.fold = s.fold GROUP BY lo))")
PREC = {}
for _k, _c in enumerate(evaluate.CLASSES):
    tp, pp, ap = f"count(*) FILTER (WHERE y = {_k} AND top = {_k})", f"count(*) FILTER (WHERE top = {_k})", f"count(*) FILTER (WHERE y = {_k})"
    PREC[f"precision_{_c}"] = f"CASE WHEN {pp} = 0 THEN 0.0 ELSE {tp} / ({pp})::DOUBLE END"
    PREC[f"recall_{_c}"] = f"CASE WHEN {ap} = 0 THEN 0.0 ELSE {tp} / ({ap})::DOUBLE END"
    PREC[f"f1_{_c}"] = f"CASE WHEN {pp} + {ap} = 0 THEN 0.0 ELSE 2 * {tp} / ({pp} + {ap})::DOUBLE END"
BRIER = "pow(p_home - (y = 0)::INT, 2) + pow(p_draw - (y = 1)::INT, 2) + pow(p_away - (y = 2)::INT, 2)"
LL = "-ln(greatest(py, 2.220446049250313e-16))"
CM = ", ".join(f"count(*) FILTER (WHERE y = {t} AND top = {p}) cm_{t}{p}" for t in range(3) for p in range(3))
MEANS = ", ".join(f"{r(f'avg({p})')} mean_{p}" for p in evaluate.PROBABILITIES)
FREQS = ", ".join(f"{r(f'avg((y = {k})::INT)')} freq_{c}" for k, c in enumerate(evaluate.CLASSES))


@register("k2_fold_metrics", PREDICTIONS + f""" SELECT config_id, fold, count(*) n_rows, {r(f'avg({LL})')} log_loss, {r(f'avg({BRIER})')} brier_score,
  {r('avg((top = y)::INT)')} accuracy, {CM}, {MEANS}, {FREQS}, {r(f'any_value({GAP})')} ece, """
          + ", ".join(f"{r(v)} {k}" for k, v in PREC.items())
          + f", {r('(' + ' + '.join(PREC[f'f1_{c}'] for c in evaluate.CLASSES) + ') / 3')} macro_f1 FROM scored s GROUP BY config_id, fold")
def fold_metrics(spark, sf):
    return evaluate.fold_metrics(predictions(spark, sf), ["config_id", "fold"])


@register("a12_log_loss", PREDICTIONS + f" SELECT config_id, fold, {r(f'avg({LL})')} log_loss FROM scored GROUP BY ALL")
def log_loss(spark, sf):
    return predictions(spark, sf).groupBy("config_id", "fold").agg(F.avg(evaluate.row_loss()).alias("log_loss"))


@register("a13_brier", PREDICTIONS + f" SELECT config_id, fold, {r(f'avg({BRIER})')} brier_score FROM scored GROUP BY ALL")
def brier(spark, sf):
    return predictions(spark, sf).groupBy("config_id", "fold").agg(F.avg(evaluate.brier()).alias("brier_score"))


@register("a14_confusion", PREDICTIONS + " SELECT config_id, fold, y, count(*) FILTER (WHERE top = 0) AS \"0\", count(*) FILTER (WHERE top = 1) AS \"1\", "
          "count(*) FILTER (WHERE top = 2) AS \"2\" FROM scored GROUP BY config_id, fold, y")
def confusion(spark, sf):
    rows = predictions(spark, sf).withColumn("top", evaluate.top_class())
    return rows.groupBy("config_id", "fold", "y").pivot("top", [0, 1, 2]).count().fillna(0)


@register("a15_precision_recall", PREDICTIONS + " SELECT config_id, fold, " + ", ".join(f"{r(v)} {k}" for k, v in PREC.items())
          + f", {r('(' + ' + '.join(PREC[f'f1_{c}'] for c in evaluate.CLASSES) + ') / 3')} macro_f1 FROM scored GROUP BY config_id, fold")
def precision_recall(spark, sf):
    m = evaluate.fold_metrics(predictions(spark, sf), ["config_id", "fold"])
    return m.select("config_id", "fold", *PREC, "macro_f1")


@register("a16_ece", PREDICTIONS + f" SELECT config_id, fold, {r(f'any_value({GAP})')} ece FROM scored s GROUP BY config_id, fold")
def ece(spark, sf):
    return evaluate.fold_metrics(predictions(spark, sf), ["config_id", "fold"]).select("config_id", "fold", "ece")


EDGES5 = evaluate.bin_edges(5)


@register("a17_reliability", PREDICTIONS + f""", e AS (SELECT config_id, y, 'H' AS class, 0 k, p_home p FROM scored UNION ALL SELECT config_id, y, 'D', 1, p_draw FROM scored
  UNION ALL SELECT config_id, y, 'A', 2, p_away FROM scored),
b(bin, lo, hi) AS (VALUES {", ".join(f"({i}, '{EDGES5[i]!r}'::DOUBLE, '{EDGES5[i + 1]!r}'::DOUBLE)" for i in range(5))})
SELECT config_id, class, bin, count(*) n, {r('avg(p)')} mean_predicted, {r('avg((y = k)::INT)')} observed_rate, {r('any_value(lo)')} bin_low, {r('any_value(hi)')} bin_high
FROM e JOIN b ON (p > lo OR (lo = 0 AND p >= 0)) AND p <= hi GROUP BY config_id, class, bin""")
def reliability(spark, sf):
    return evaluate.reliability(predictions(spark, sf), ["config_id"])


@register("a18_mean_vs_realised", PREDICTIONS + f" SELECT config_id, fold, {MEANS}, {FREQS} FROM scored GROUP BY config_id, fold")
def mean_vs_realised(spark, sf):
    m = evaluate.fold_metrics(predictions(spark, sf), ["config_id", "fold"])
    return m.select("config_id", "fold", *[f"mean_{p}" for p in evaluate.PROBABILITIES], *[f"freq_{c}" for c in evaluate.CLASSES])


DIFF = "-ln(greatest(a.py, 1e-15)) + ln(greatest(b.py, 1e-15))"


@register("a19_paired_comparison", PREDICTIONS + f""" SELECT a.config_id, {r(f'avg({DIFF})')} mean_diff, count(*) n, {r(f'stddev_samp({DIFF}) / sqrt(count(*))')} standard_error,
  abs(avg({DIFF})) < 2 * stddev_samp({DIFF}) / sqrt(count(*)) is_tie
FROM scored a JOIN scored b ON a.match_id = b.match_id AND a.fold = b.fold AND b.config_id = 'shots_strong' WHERE a.config_id <> 'shots_strong' GROUP BY a.config_id""")
def paired(spark, sf):
    p = predictions(spark, sf)
    return evaluate.paired_comparison(p.where("config_id <> 'shots_strong'"), p.where("config_id = 'shots_strong'"), ["match_id", "fold"], ["config_id"])


SUMMARY = PREDICTIONS + f""", pf AS (SELECT config_id, fold, avg({LL}) ll FROM scored GROUP BY ALL),
sm AS MATERIALIZED (SELECT config_id, avg(ll) mean_log_loss, max(ll) worst_log_loss, stddev_pop(ll) log_loss_std, count(*) n_folds FROM pf GROUP BY config_id)"""


@register("a20_config_summary", SUMMARY + f" SELECT config_id, {r('mean_log_loss')} mean_log_loss, {r('worst_log_loss')} worst_log_loss, {r('log_loss_std')} log_loss_std, n_folds FROM sm")
def config_summary(spark, sf):
    return evaluate.config_summary(predictions(spark, sf), ["config_id"])


@register("w11_config_ranking", SUMMARY + f" SELECT config_id, {r('mean_log_loss')} mean_log_loss, row_number() OVER (ORDER BY mean_log_loss) AS \"rank\" FROM sm")
def config_ranking(spark, sf):
    from pyspark.sql import Window as W

    # one row per configuration
    s = evaluate.config_summary(predictions(spark, sf), ["config_id"])
    return s.select("config_id", "mean_log_loss", F.row_number().over(W.orderBy("mean_log_loss")).alias("rank"))


@register("k3_selection", SUMMARY + f""", best AS (SELECT config_id FROM sm ORDER BY mean_log_loss LIMIT 1),
vs AS (SELECT a.config_id, avg({DIFF}) md, stddev_samp({DIFF}) / sqrt(count(*)) se FROM scored a JOIN scored b ON a.match_id = b.match_id AND a.fold = b.fold
  WHERE b.config_id = (SELECT config_id FROM best) AND a.config_id <> b.config_id GROUP BY a.config_id),
t AS (SELECT sm.*, md, se, sm.config_id = (SELECT config_id FROM best) is_best_mean, coalesce(abs(md) < 2 * se, true) is_tied FROM sm LEFT JOIN vs USING (config_id))
SELECT config_id, {r('mean_log_loss')} mean_log_loss, {r('worst_log_loss')} worst_log_loss, {r('log_loss_std')} log_loss_std, n_folds,
  {r('md')} mean_diff, {r('se')} standard_error, is_best_mean, is_tied, 99 complexity,
  config_id = (SELECT config_id FROM t WHERE is_tied ORDER BY worst_log_loss, log_loss_std LIMIT 1) selected FROM t""")
def selection(spark, sf):
    return evaluate.select_best(predictions(spark, sf), ["match_id", "fold"], evaluate.MODEL_RANK)


@register("p19_probability_contract", PREDICTIONS + """, broken AS (SELECT config_id, CASE WHEN match_id % 13 = 0 THEN 'nan'::DOUBLE ELSE p_home END p_home, p_draw,
  CASE WHEN match_id % 17 = 0 THEN -0.1 WHEN match_id % 19 = 0 THEN p_away + 0.01 ELSE p_away END p_away FROM preds)
SELECT config_id, count(*) n_rows, count(*) FILTER (WHERE isnan(p_home)) n_not_finite, count(*) FILTER (WHERE NOT isnan(p_home) AND p_away < -1e-9) n_negative,
  count(*) FILTER (WHERE NOT isnan(p_home) AND abs(p_home + p_draw + p_away - 1) > 1.1e-5) n_bad_sum FROM broken GROUP BY config_id""")
def probability_contract(spark, sf):
    id_ = F.col("match_id")
    broken = predictions(spark, sf).withColumns({
        "p_home": F.when(id_ % 13 == 0, float("nan")).otherwise(F.col("p_home")),
        "p_away": F.when(id_ % 17 == 0, -0.1).when(id_ % 19 == 0, F.col("p_away") + 0.01).otherwise(F.col("p_away"))})
    return evaluate.contract_problems(broken, ["config_id"])


@register("p20_probability_alignment", PREDICTIONS + f" SELECT match_id, fold, config_id, {r('p_home / (p_home + p_away)')} p_home, 0.0 p_draw, {r('p_away / (p_home + p_away)')} p_away FROM preds")
def probability_alignment(spark, sf):
    """A model that never saw a draw and lists its classes as away, home."""
    p = predictions(spark, sf)
    aligned = evaluate.align(F.array("p_away", "p_home"), [2, 0])
    return p.select("match_id", "fold", "config_id", *[v.alias(k) for k, v in aligned.items()])


@register("f18_config_ids", PREDICTIONS + " SELECT DISTINCT config_id || '[fold=' || fold || '_season=' || season || ']' config_id FROM preds")
def config_ids(spark, sf):
    p = predictions(spark, sf).select("config_id", "fold", "season").distinct()
    params = F.create_map(F.lit("season"), F.col("season").cast("string"), F.lit("fold"), F.col("fold").cast("string"))
    return p.select(labels.config_id(F.col("config_id"), params).alias("config_id"))


@register("s6_metrics_json", PREDICTIONS + f" SELECT config_id, fold, count(*) n_rows, {r(f'avg({LL})')} log_loss, {r('avg((top = y)::INT)')} accuracy FROM scored GROUP BY config_id, fold")
def metrics_json(spark, sf):
    """Metric rows written as JSON lines and read back under a declared schema."""
    from touchline.session import fresh_path
    from touchline.sources.prediction_files import write_metrics

    path = fresh_path(spark, "metrics")
    m = evaluate.fold_metrics(predictions(spark, sf), ["config_id", "fold"]).select("config_id", "fold", "n_rows", "log_loss", "accuracy")
    write_metrics(m, path)
    return spark.read.schema(m.schema).json(path)
