"""The meta layer: temperature scaling, pooling, chronological validation,
incumbent rule."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import evaluate
from touchline.operators.evaluate import PROBABILITIES

# --- Fixed values -----------------------------------------------------------
LOG_FLOOR = 1e-15
T_BOUNDS = (0.2, 5.0)
IDENTITY_TOLERANCE = 1e-9
INCUMBENT = "raw_trio"
# candidate: number of fitted parameters
CANDIDATES = {"raw_trio": 0, "temperature_trio": 1, "pool_raw_trio": 1, "pool_calibrated_trio": 2}
# --- End of fixed values ----------------------------------------------------

TRIO = ["p_home_trio", "p_draw_trio", "p_away_trio"]
DC = ["p_home_dc", "p_draw_dc", "p_away_dc"]


def temperature_scale(columns: list[str], temperature: Column) -> list[Column]:
    """softmax(log(p) / T), shifted by the largest term."""
    logits = [F.log(F.greatest(F.col(c), F.lit(LOG_FLOOR))) / temperature for c in columns]
    top = F.greatest(*logits)
    exps = [F.exp(z - top) for z in logits]
    total = exps[0] + exps[1] + exps[2]
    return [e / total for e in exps]


def convex_pool(a: list[Column], b: list[Column], weight: Column) -> list[Column]:
    return [weight * x + (1.0 - weight) * y for x, y in zip(a, b)]


def merge_predictions(a: DataFrame, b: DataFrame, key: list[str], approved: list[tuple[int, object]],
                      sealed_from=None) -> tuple[DataFrame, DataFrame]:
    """One-to-one merge of two prediction sets, and the reasons against using it.

    ``problems`` has one (problem, n) row per broken guard: unmatched rows,
    repeated keys, targets that disagree, sealed seasons, (fold, season) pairs
    outside the approved set.
    """
    left = a.select(*key, F.col("y").alias("y"), *[F.col(p).alias(t) for p, t in zip(PROBABILITIES, TRIO)], F.lit(True).alias("_l"))
    right = b.select(*key, F.col("y").alias("_y"), *[F.col(p).alias(t) for p, t in zip(PROBABILITIES, DC)], F.lit(True).alias("_r"))
    full = left.join(right, key, "full_outer")
    ok_pair = F.lit(False)
    for fold, season in approved:
        ok_pair = ok_pair | ((F.col("fold") == fold) & (F.col("season") == F.lit(season)))
    checks = {
        "unmatched": F.count_if(F.col("_l").isNull() | F.col("_r").isNull()),
        "target_disagrees": F.count_if(F.col("y") != F.col("_y")),
        "fold_season_not_approved": F.count_if(~ok_pair),
        "sealed_season": F.count_if(F.col("season") >= F.lit(sealed_from)) if sealed_from is not None else F.lit(0),
    }
    one = full.agg(*[v.cast("long").alias(k) for k, v in checks.items()])
    repeated = [
        d.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"repeated_key_{n}").alias("problem"), "n")
        for n, d in (("first", a), ("second", b))
    ]
    missing = a.sparkSession.createDataFrame(approved, f"fold int, season {dict(a.dtypes)['season']}").join(
        full.select("fold", "season").distinct(), ["fold", "season"], "left_anti").agg(F.count("*").alias("n")).select(
        F.lit("approved_pair_absent").alias("problem"), "n")
    problems = one.unpivot([], list(checks), "problem", "n")
    for more in (*repeated, missing):
        problems = problems.unionByName(more)
    merged = full.where("_l AND _r").drop("_l", "_r", "_y")
    return merged, problems.where("n > 0")


def meta_rows(merged: DataFrame, meta_folds: list[tuple[int, list, object]]) -> DataFrame:
    """Each row once per chronological meta-fold it trains or is evaluated in."""
    season = F.col("season")
    member = F.array_compact(F.array(*[
        F.when(season.isin(train), F.struct(F.lit(n).alias("meta_fold"), F.lit("train").alias("part")))
        .when(season == F.lit(evaluation), F.struct(F.lit(n).alias("meta_fold"), F.lit("evaluate").alias("part")))
        for n, train, evaluation in meta_folds]))
    return merged.withColumn("_m", F.explode(member)).select(*merged.columns, "_m.meta_fold", "_m.part")


def meta_order_violations(rows: DataFrame) -> DataFrame:
    """Meta-folds whose training rows are missing or not strictly earlier."""
    span = rows.groupBy("meta_fold").agg(
        F.max(F.when(F.col("part") == "train", F.col("match_date"))).alias("train_end"),
        F.min(F.when(F.col("part") == "evaluate", F.col("match_date"))).alias("evaluation_start"))
    return span.where("train_end IS NULL OR evaluation_start IS NULL OR train_end >= evaluation_start")


def _per_fold(values: dict[int, float]) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.create_map(*pairs)[F.col("meta_fold")]


def _pick(columns: list[Column]) -> Column:
    return F.when(F.col("y") == 0, columns[0]).when(F.col("y") == 1, columns[1]).otherwise(columns[2])


def _newton(train: DataFrame, start: float, bounds: tuple[float, float], moments, max_passes: int = 60) -> dict[int, float]:
    """Minimise a convex one-parameter mean loss for all meta-folds at once.

    Each pass is one aggregation of slope and curvature per fold; the bracket
    keeps the step safe. Only one number per fold reaches the driver.
    """
    folds = [r["meta_fold"] for r in train.select("meta_fold").distinct().collect()]
    value = {f: start for f in folds}
    bracket = {f: list(bounds) for f in folds}
    active = set(folds)
    for _ in range(max_passes):
        rows, slope, curvature = moments(_per_fold(value))
        got = rows.groupBy("meta_fold").agg(F.avg(slope).alias("g"), F.avg(curvature).alias("h")).collect()
        for row in got:
            f = row["meta_fold"]
            if f not in active:
                continue
            x, (lo, hi) = value[f], bracket[f]
            if row["g"] > 0:
                hi = x
            else:
                lo = x
            bracket[f] = [lo, hi]
            step = x - row["g"] / row["h"] if row["h"] > 0 else (bounds[0] if row["g"] > 0 else bounds[1])
            if not lo <= step <= hi:
                at_edge = (step < lo and lo == bounds[0]) or (step > hi and hi == bounds[1])
                step = (lo if step < lo else hi) if at_edge else 0.5 * (lo + hi)
            # Sums vary in their last digits with the order of rows, and so does the last step.
            if abs(step - x) < 1e-10 * max(1.0, abs(x)) or bracket[f][1] - bracket[f][0] < 1e-12:
                active.discard(f)
            value[f] = step
        if not active:
            return value
    raise RuntimeError(f"no convergence for meta-folds {sorted(active)} in {max_passes} passes")


def _losses(train: DataFrame, scored: list[Column]) -> dict[int, float]:
    loss = -F.log(F.greatest(_pick(scored), F.lit(evaluate.LOSS_FLOOR)))
    return {r["meta_fold"]: r["l"] for r in train.groupBy("meta_fold").agg(F.avg(loss).alias("l")).collect()}


def fit_temperature(train: DataFrame) -> dict[int, float]:
    """Temperature per meta-fold. Convex in 1/T, so Newton on 1/T; a result worse
    than T = 1 is an error."""
    def moments(beta: Column):
        return _with_scaled(train, beta), F.col("_mean") - F.col("_zy"), F.col("_spread")

    beta = _newton(train, 1.0, (1.0 / T_BOUNDS[1], 1.0 / T_BOUNDS[0]), moments)
    fitted = {f: 1.0 / b for f, b in beta.items()}
    after = _losses(train, temperature_scale(TRIO, _per_fold(fitted)))
    before = _losses(train, [F.col(c) for c in TRIO])
    for f, t in fitted.items():
        if after[f] > before[f] + IDENTITY_TOLERANCE:
            raise RuntimeError(f"temperature {t} of meta-fold {f} is worse than no scaling")
    return fitted


def fit_weight(train: DataFrame) -> dict[int, float]:
    """Pool weight per meta-fold; both endpoints are explicit candidates."""
    a, b = [F.col(c) for c in TRIO], [F.col(c) for c in DC]

    def moments(w: Column):
        m = F.greatest(_pick(convex_pool(a, b, w)), F.lit(LOG_FLOOR))
        d = (_pick(a) - _pick(b)) / m
        return train, -d, d * d

    inner = _newton(train, 0.5, (0.0, 1.0), moments)
    options = [dict.fromkeys(inner, 0.0), dict.fromkeys(inner, 1.0), inner]
    losses = [_losses(train, convex_pool(a, b, _per_fold(o))) for o in options]
    best = {}
    for f in inner:
        _, i = min((loss[f], i) for i, loss in enumerate(losses))
        best[f] = options[i][f]
    return best


def _with_scaled(train: DataFrame, beta: Column) -> DataFrame:
    """Scaled probabilities with their log-score mean and spread, in named steps
    so that shared terms are computed once per row."""
    c = F.col
    out = train.withColumns({"_b": beta, **{f"_z{i}": F.log(F.greatest(c(p), F.lit(LOG_FLOOR))) for i, p in enumerate(TRIO)}})
    out = out.withColumn("_top", F.greatest("_z0", "_z1", "_z2"))
    out = out.withColumns({f"_e{i}": F.exp((c(f"_z{i}") - c("_top")) * c("_b")) for i in range(3)})
    out = out.withColumn("_s", c("_e0") + c("_e1") + c("_e2"))
    moment = lambda k: sum((c(f"_e{i}") * c(f"_z{i}") ** k for i in range(1, 3)), c("_e0") * c("_z0") ** k) / c("_s")
    return out.withColumns({
        "_mean": moment(1), "_second": moment(2), "_zy": _pick([c(f"_z{i}") for i in range(3)]),
        "_qy": _pick([c(f"_e{i}") for i in range(3)]) / c("_s"), "_dy": _pick([c(x) for x in DC]),
    }).withColumn("_spread", c("_second") - c("_mean") * c("_mean"))


def _joint_moments(train: DataFrame, beta: Column, weight: Column) -> DataFrame:
    """Mean loss and its derivatives by (1 / T, w) per meta-fold."""
    c = F.col
    rows = _with_scaled(train, beta).withColumns({"_w": weight, "_u": c("_zy") - c("_mean"), "_gap": c("_qy") - c("_dy")})
    rows = rows.withColumns({
        "_m": F.greatest(c("_w") * c("_qy") + (1.0 - c("_w")) * c("_dy"), F.lit(LOG_FLOOR)), "_q1": c("_qy") * c("_u"),
        "_q2": c("_qy") * (c("_u") * c("_u") - c("_spread")),
    }).withColumns({"_rb": c("_w") * c("_q1") / c("_m"), "_rw": c("_gap") / c("_m")})
    return rows.groupBy("meta_fold").agg(
        F.avg(-F.log("_m")).alias("loss"), F.avg(-c("_rb")).alias("gb"), F.avg(-c("_rw")).alias("gw"),
        F.avg(c("_rb") * c("_rb") - c("_w") * c("_q2") / c("_m")).alias("hbb"),
        F.avg(c("_rw") * c("_rw")).alias("hww"),
        F.avg(c("_rb") * c("_rw") - c("_q1") / c("_m")).alias("hbw"))


def fit_joint(train: DataFrame, max_passes: int = 60) -> dict[int, tuple[float, float]]:
    """(T, w) per meta-fold, from the identity (1, 1) by damped Newton steps.

    One aggregation of six means per pass serves all folds. A step that does not
    lower the loss is taken back and shortened, so the result is never worse
    than the identity.
    """
    lo, hi = (1.0 / T_BOUNDS[1], 0.0), (1.0 / T_BOUNDS[0], 1.0)
    folds = [r["meta_fold"] for r in train.select("meta_fold").distinct().collect()]
    trial = {f: (1.0, 1.0) for f in folds}
    kept: dict[int, tuple] = {}
    damping = dict.fromkeys(folds, 1e-6)
    active = set(folds)
    for _ in range(max_passes):
        got = _joint_moments(train, _per_fold({f: p[0] for f, p in trial.items()}), _per_fold({f: p[1] for f, p in trial.items()})).collect()
        for row in got:
            f = row["meta_fold"]
            if f not in active:
                continue
            if f not in kept or row["loss"] <= kept[f][1]["loss"]:
                kept[f] = (trial[f], row)
                damping[f] = max(damping[f] / 10, 1e-12)
            else:
                damping[f] *= 100
            (b, w), m = kept[f]
            free = [not ((x <= l and g > 0) or (x >= h and g < 0)) for x, l, h, g in zip((b, w), lo, hi, (m["gb"], m["gw"]))]
            hbb, hww = abs(m["hbb"]) + damping[f], m["hww"] + damping[f]
            hbw = m["hbw"] if all(free) and hbb * hww > m["hbw"] ** 2 else 0.0
            det = hbb * hww - hbw * hbw
            step_b = -(hww * m["gb"] - hbw * m["gw"]) / det if all(free) else (-m["gb"] / hbb if free[0] else 0.0)
            step_w = -(hbb * m["gw"] - hbw * m["gb"]) / det if all(free) else (-m["gw"] / hww if free[1] else 0.0)
            nb, nw = min(max(b + step_b, lo[0]), hi[0]), min(max(w + step_w, lo[1]), hi[1])
            if max(abs(nb - b), abs(nw - w)) < 1e-9 or damping[f] > 1e12:
                active.discard(f)
            else:
                trial[f] = (nb, nw)
        if not active:
            return {f: (1.0 / p[0], p[1]) for f, (p, _) in kept.items()}
    raise RuntimeError(f"no convergence for meta-folds {sorted(active)} in {max_passes} passes")


def fit_candidates(train: DataFrame) -> dict[str, dict[int, tuple[float, float]]]:
    """(T, w) of every candidate and meta-fold; unfitted parameters stay at 1."""
    folds = [r["meta_fold"] for r in train.select("meta_fold").distinct().collect()]
    t, w, both = fit_temperature(train), fit_weight(train), fit_joint(train)
    return {
        "raw_trio": {f: (1.0, 1.0) for f in folds},
        "temperature_trio": {f: (t[f], 1.0) for f in folds},
        "pool_raw_trio": {f: (1.0, w[f]) for f in folds},
        "pool_calibrated_trio": both,
    }


def apply_candidates(rows: DataFrame, params: dict[str, dict[int, tuple[float, float]]]) -> DataFrame:
    """Long table of candidate predictions, one pass, no join."""
    variants = []
    for name, per_fold in params.items():
        t, w = (_per_fold({f: p[i] for f, p in per_fold.items()}) for i in (0, 1))
        scaled = temperature_scale(TRIO, t) if any(p[0] != 1.0 for p in per_fold.values()) else [F.col(c) for c in TRIO]
        mixed = convex_pool(scaled, [F.col(c) for c in DC], w) if any(p[1] != 1.0 for p in per_fold.values()) else scaled
        variants.append(F.struct(F.lit(name).alias("config_id"), *[m.alias(p) for m, p in zip(mixed, PROBABILITIES)]))
    return rows.withColumn("_v", F.explode(F.array(*variants))).select(
        *rows.columns, "_v.*").withColumn("fold", F.col("meta_fold"))


def incumbent_verdicts(predictions: DataFrame, key: list[str], incumbent: str = INCUMBENT,
                       n_params: dict[str, int] = CANDIDATES) -> DataFrame:
    """The four conditions of every challenger and the selected candidate.

    All must hold: lower mean, a paired improvement that is not a tie, better in
    every season, no worse in the worst season. Among those the lowest mean
    wins, then the fewest parameters; otherwise the incumbent stays.
    """
    per_fold = predictions.groupBy("config_id", "fold").agg(F.avg(evaluate.row_loss()).alias("log_loss"))
    ours = per_fold.where(F.col("config_id") == incumbent).select("fold", F.col("log_loss").alias("inc"))
    flags = per_fold.where(F.col("config_id") != incumbent).join(ours, "fold").groupBy("config_id").agg(
        F.avg("log_loss").alias("mean_log_loss"), F.avg("inc").alias("incumbent_mean"),
        (F.avg("log_loss") < F.avg("inc")).alias("lower_mean"),
        F.bool_and(F.col("log_loss") < F.col("inc")).alias("better_every_season"),
        (F.max("log_loss") <= F.max("inc")).alias("no_worse_worst_season"))
    versus = evaluate.paired_comparison(
        predictions.where(F.col("config_id") != incumbent), predictions.where(F.col("config_id") == incumbent), key, ["config_id"])
    params = F.create_map(*[x for k, v in n_params.items() for x in (F.lit(k), F.lit(v))])[F.col("config_id")]
    table = flags.join(versus, "config_id").withColumn("paired_improvement", ~F.col("is_tie") & (F.col("mean_diff") < 0)).withColumns({
        "passes": F.col("lower_mean") & F.col("paired_improvement") & F.col("better_every_season") & F.col("no_worse_worst_season"),
        "n_params": F.coalesce(params, F.lit(0)),
    })
    # one row: the first qualifying challenger, if any
    winner = table.where("passes").orderBy("mean_log_loss", "n_params", "config_id").limit(1).agg(
        F.coalesce(F.max("config_id"), F.lit(incumbent)).alias("selected"))
    return table.drop("is_tie").join(F.broadcast(winner))


def final_parameters(merged: DataFrame, selected: str, incumbent: str = INCUMBENT) -> tuple[float, float]:
    """(T, w) for later use: the identity if the incumbent stays, else one refit
    of the selected candidate on every row."""
    if selected == incumbent:
        return 1.0, 1.0
    rows = merged.withColumn("meta_fold", F.lit(0))
    if selected == "temperature_trio":
        return fit_temperature(rows)[0], 1.0
    if selected == "pool_raw_trio":
        return 1.0, fit_weight(rows)[0]
    return fit_joint(rows)[0]
