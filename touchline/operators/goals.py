"""Goal model: sufficient statistics, fit per league, scoring of fixtures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scorelines as P
from touchline.operators.folds import Fold
from touchline.operators.seasons import classify_team_seasons, season_index, team_rows, with_season_index
from touchline.session import spread_by

# --- Fixed values -----------------------------------------------------------
# config: (uses rho, prior sd on attack and defence, half-life in days, complexity rank)
CONFIGS = {
    "poisson": (False, None, None, 0),
    "poisson_l2": (False, 0.25, None, 1),
    "dixon_coles": (True, None, None, 2),
    "dixon_coles_l2": (True, 0.25, None, 3),
    "dixon_coles_l2_decay": (True, 0.25, 365.0, 4),
}
BOUND_INTERCEPT = 3.0
BOUND_HOME_ADVANTAGE = 1.0
BOUND_TEAM = 1.5
BOUND_RHO = 0.2
START_RHO = -0.05
# --- End of fixed values ----------------------------------------------------

DECAY_HALFLIFE = 365.0
#: Pairs whose rates a fit holds at once.
PAIR_BLOCK = 65_536
SUMS = ["w", "whg", "wag", "w00", "w01", "w10", "w11"]
FIT_SCHEMA = (
    "league int, fold int, config_id string, team {team}, attack double, defence double, intercept double, "
    "home_advantage double, rho double, gradient double, sweeps int, status string"
)


def decay_weights(rows: DataFrame, by: list[str], halflife_days: float | None) -> DataFrame:
    """``weight`` halving every ``halflife_days`` before the latest training
    date of each group; 1 without a half-life. The latest date is a tiny
    aggregate joined back, so a hot group is never one window."""
    if halflife_days is None:
        return rows.withColumn("weight", F.lit(1.0))
    latest = rows.groupBy(*by).agg(F.max("match_date").alias("_latest"))
    age = F.date_diff("_latest", "match_date")
    return rows.join(latest, by).withColumn(
        "weight", F.exp(F.lit(-math.log(2.0) / halflife_days) * age)).drop("_latest")


def _statistics(weight) -> dict:
    hg, ag = F.col("fthg"), F.col("ftag")

    def low(h, a):
        return F.sum(F.when((hg == h) & (ag == a), weight).otherwise(0.0))

    return {"w": F.sum(weight), "whg": F.sum(weight * hg), "wag": F.sum(weight * ag),
            "w00": low(0, 0), "w01": low(0, 1), "w10": low(1, 0), "w11": low(1, 1)}


def season_pair_statistics(matches: DataFrame, halflife_days: float = DECAY_HALFLIFE) -> DataFrame:
    """All the likelihood needs, per (league, season, home, away): plain sums and
    sums decayed to the season's last day. Any number of matches becomes at most
    teams x teams rows a season, summed map-side before the shuffle."""
    last = season_index(matches).select("league", "season", F.col("last_date"))
    fade = F.exp(F.lit(-math.log(2.0) / halflife_days) * F.date_diff("last_date", "match_date"))
    return matches.join(last, ["league", "season"]).groupBy("league", "season", "last_date", "home", "away").agg(
        *[c.alias(k) for k, c in _statistics(F.lit(1.0)).items()],
        *[c.alias(f"d_{k}") for k, c in _statistics(fade).items()],
    )


def fold_pair_statistics(season_pairs: DataFrame, folds: list[Fold], halflife_days: float = DECAY_HALFLIFE) -> DataFrame:
    """Training statistics per (league, fold, home, away). Decay factors over
    seasons, so the matches are read once whatever the number of folds."""
    member = F.explode(F.array_compact(F.array(*[
        F.when(F.col("season") <= F.lit(cutoff), F.lit(n)) for n, cutoff, _ in folds])))
    rows = season_pairs.withColumn("fold", member)
    ends = rows.groupBy("league", "fold").agg(F.max("last_date").alias("train_end"))
    shift = F.exp(F.lit(-math.log(2.0) / halflife_days) * F.date_diff("train_end", "last_date"))
    return rows.join(ends, ["league", "fold"]).groupBy("league", "fold", "home", "away").agg(
        *[F.sum(k).alias(k) for k in SUMS], *[F.sum(F.col(f"d_{k}") * shift).alias(f"d_{k}") for k in SUMS])


def _project(x: np.ndarray, curvature: np.ndarray, bound: float) -> np.ndarray:
    """Nearest point with zero sum inside the box, in the metric of the curvature."""
    lo, hi = -1.0, 1.0
    clip = lambda s: np.clip(x - s / curvature, -bound, bound)
    while clip(lo).sum() < 0:
        lo *= 2
    while clip(hi).sum() > 0:
        hi *= 2
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if clip(mid).sum() > 0 else (lo, mid)
        if hi - lo < 1e-15 * max(1.0, abs(hi)):
            break
    return clip(0.5 * (lo + hi))


def fit_pairs(home: np.ndarray, away: np.ndarray, n: int, s: dict[str, np.ndarray], use_rho: bool,
              sigma: float | None, max_sweeps: int = 3000, tol: float = 1e-9) -> dict:
    """Penalised maximum likelihood on pair sums by block Newton steps.

    Given the defences the attacks are independent of each other, and the other
    way round, so a block needs only diagonal curvature; the zero-sum and box
    constraints are met exactly in each step. Points with an infeasible
    low-score correction are rejected, never clipped.
    """
    ridge = 0.0 if sigma is None else 1.0 / sigma**2
    mean_home, mean_away = s["whg"].sum() / s["w"].sum(), s["wag"].sum() / s["w"].sum()
    if not (mean_home > 0 and mean_away > 0):
        return {"status": "no goals on one side"}
    p = {"c": math.log(mean_away), "g": math.log(mean_home / mean_away),
         "atk": np.zeros(n), "dfn": np.zeros(n), "rho": START_RHO if use_rho else 0.0}
    blocks = [(home[i : i + PAIR_BLOCK], away[i : i + PAIR_BLOCK], {k: v[i : i + PAIR_BLOCK] for k, v in s.items()})
              for i in range(0, len(home), PAIR_BLOCK)]

    def rates(q, h, a):
        log_h = q["c"] + q["g"] + q["atk"][h] + q["dfn"][a]
        log_a = q["c"] + q["atk"][a] + q["dfn"][h]
        return log_h, log_a, np.exp(log_h), np.exp(log_a)

    def low(lh, la, rho):
        return 1 - lh * la * rho, 1 + lh * rho, 1 + la * rho, np.full_like(lh, 1 - rho)

    def loss(q):
        value = 0.0
        for h, a, x in blocks:
            log_h, log_a, lh, la = rates(q, h, a)
            value -= (x["whg"] * log_h - x["w"] * lh + x["wag"] * log_a - x["w"] * la).sum()
            if use_rho:
                t = low(lh, la, q["rho"])
                if min(v.min() for v in t) < P.TAU_FLOOR:
                    return math.inf
                value -= sum((x[k] * np.log(v)).sum() for k, v in zip(("w00", "w01", "w10", "w11"), t))
        return value + 0.5 * ridge * ((q["atk"] ** 2).sum() + (q["dfn"] ** 2).sum())

    def slopes(q):
        """Per pair: derivative of the loss by log rate of each side, and its curvature; block by block."""
        for h, a, x in blocks:
            _, _, lh, la = rates(q, h, a)
            gh, ga = x["w"] * lh - x["whg"], x["w"] * la - x["wag"]
            if use_rho:
                t00, t01, t10, _ = low(lh, la, q["rho"])
                both = x["w00"] * lh * la * q["rho"] / t00
                gh, ga = gh + both - x["w01"] * lh * q["rho"] / t01, ga + both - x["w10"] * la * q["rho"] / t10
            yield h, a, gh, ga, x["w"] * lh, x["w"] * la

    def team_slopes(q, name):
        """Gradient and curvature of one block of team parameters."""
        grad, curve = 0.0, 0.0
        for h, a, gh, ga, wh, wa in slopes(q):
            hi, ai = (h, a) if name == "atk" else (a, h)
            grad, curve = grad + (total(hi, gh) + total(ai, ga)), curve + (total(hi, wh) + total(ai, wa))
        return grad + ridge * q[name], curve + ridge + 1e-9

    def sums_of(q):
        """Sums of the slopes and curvatures of each side."""
        return np.sum([[v.sum() for v in each[2:]] for each in slopes(q)], axis=0)

    def step(name, proposal):
        nonlocal current
        base, scale = p[name], 1.0
        for _ in range(40):
            trial = {**p, name: base + scale * (proposal - base)}
            value = loss(trial)
            if value <= current + 1e-12 * abs(current):
                p[name], current = trial[name], min(value, current)
                return np.max(np.abs(trial[name] - base))
            scale *= 0.5
        return 0.0

    current = loss(p)
    if not math.isfinite(current):
        p["rho"], current = 0.0, loss({**p, "rho": 0.0})
    total = lambda i, v: np.bincount(i, v, minlength=n)
    moved, sweeps = math.inf, 0
    while sweeps < max_sweeps and moved > tol:
        sweeps += 1
        moved = 0.0
        for name in ("atk", "dfn"):
            grad, curve = team_slopes(p, name)
            moved = max(moved, step(name, _project(p[name] - grad / curve, curve, BOUND_TEAM)))
        gh, ga, wh, wa = sums_of(p)
        moved = max(moved, step("g", float(np.clip(p["g"] - gh / wh, -BOUND_HOME_ADVANTAGE, BOUND_HOME_ADVANTAGE))))
        # the curvature is that before the step of the home advantage
        gh, ga, _, _ = sums_of(p)
        moved = max(moved, step("c", float(np.clip(p["c"] - (gh + ga) / (wh + wa), -BOUND_INTERCEPT, BOUND_INTERCEPT))))
        if use_rho:
            d = dd = 0.0
            for h, a, x in blocks:
                _, _, lh, la = rates(p, h, a)
                t00, t01, t10, t11 = low(lh, la, p["rho"])
                d += (x["w00"] * lh * la / t00 - x["w01"] * lh / t01 - x["w10"] * la / t10 + x["w11"] / t11).sum()
                dd += (x["w00"] * (lh * la / t00) ** 2 + x["w01"] * (lh / t01) ** 2 + x["w10"] * (la / t10) ** 2 + x["w11"] / t11**2).sum()
            if dd > 0:
                moved = max(moved, step("rho", float(np.clip(p["rho"] - d / dd, -BOUND_RHO, BOUND_RHO))))
    # Largest remaining step of either team block, a scale-free gradient.
    gap = 0.0
    for name in ("atk", "dfn"):
        grad, curve = team_slopes(p, name)
        gap = max(gap, np.max(np.abs(_project(p[name] - grad / curve, curve, BOUND_TEAM) - p[name])))
    return {"status": "fitted" if gap < 1e-5 else "not converged", **p, "gradient": gap, "sweeps": sweeps}


def fit_goal_models(pair_statistics: DataFrame, configs: dict = CONFIGS) -> DataFrame:
    """All configurations for all leagues and folds, one fit per task.

    A task receives the pair sums of its configuration's weights, nine numbers a pair, in Arrow batches, and keeps
    them as plain arrays; what is worked out from them exists for one block of pairs at a time. Failed fits carry
    a status and null parameters.
    """
    team_type = dict(pair_statistics.dtypes)["home"]
    team_type = "string" if team_type == "string" else "long"
    names, keys = list(configs), ["league", "fold", "_config"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, {k: [] for k in ["home", "away", *SUMS]}
        for batch in batches:
            if batch.num_rows:
                key = tuple(batch.column(k)[0].as_py() for k in keys)
                for k, part in parts.items():
                    part.append(batch.column(k).to_numpy(zero_copy_only=False).copy())
        league, fold, config = key
        use_rho, sigma, _, _ = configs[names[config]]
        teams = np.unique(np.concatenate([np.unique(x) for x in parts["home"] + parts["away"]]))
        home, away = (np.concatenate([np.searchsorted(teams, x).astype(np.int32) for x in parts.pop(k)]) for k in ("home", "away"))
        sums = {k: np.concatenate(parts.pop(k)).astype(float, copy=False) for k in SUMS}
        if len(teams) < 2:
            got = {"status": "fewer than two teams"}
        else:
            got = fit_pairs(home, away, len(teams), sums, use_rho, sigma)
        n = len(teams)
        one = lambda v, kind: pa.array([v] * n, kind)
        doubles = lambda v: pa.array(v, pa.float64()) if isinstance(v, np.ndarray) else one(v, pa.float64())
        yield pa.RecordBatch.from_arrays(
            [one(league, pa.int32()), one(fold, pa.int32()), one(names[config], pa.string()),
             pa.array(teams, pa.string() if team_type == "string" else pa.int64(), from_pandas=True),
             *[doubles(got.get(k)) for k in ("atk", "dfn", "c", "g")], doubles(got.get("rho") if use_rho else None), doubles(got.get("gradient")),
             one(got.get("sweeps", 0), pa.int32()), one(got["status"], pa.string())],
            names=[c.split()[0] for c in FIT_SCHEMA.split(", ")])

    decayed = F.col("_config").isin([i for i, v in enumerate(configs.values()) if v[2]])
    each = pair_statistics.withColumn("_config", F.explode(F.array(*[F.lit(i) for i in range(len(names))]))).select(
        *keys, "home", "away", *[F.when(decayed, F.col(f"d_{k}")).otherwise(F.col(k)).alias(k) for k in SUMS])
    fitted = each.groupBy(*keys).applyInArrow(fit, FIT_SCHEMA.format(team=team_type))
    doubles = ["attack", "defence", "intercept", "home_advantage", "rho", "gradient"]
    return fitted.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})


def score_identities(pair_statistics: DataFrame, fits: DataFrame, configs: dict = CONFIGS) -> DataFrame:
    """What the fitted models say that each team has scored and conceded in training: (league, fold, config_id, team, scored, conceded).

    At the optimum the derivative of the loss by a team's attack is zero, and so is the multiplier of the zero sum because the
    intercept is free: expected goals, low-score corrections and the pull of the penalty add up to the goals that there were. From
    pair sums and stored parameters alone; a team at the bound of its parameters is the exception."""
    c = F.col
    named = fits.where("status = 'fitted'").select("league", "fold", "config_id", "team", "attack", "defence", "intercept", "home_advantage", F.coalesce("rho", F.lit(0.0)).alias("rho"))
    side = lambda s: named.select("league", "fold", "config_id", c("team").alias(s), c("attack").alias(f"{s}_attack"), c("defence").alias(f"{s}_defence"), *(["intercept", "home_advantage", "rho"] if s == "home" else []))
    decayed = c("config_id").isin([k for k, v in configs.items() if v[2]])
    rows = pair_statistics.join(side("home"), ["league", "fold", "home"]).join(side("away"), ["league", "fold", "config_id", "away"])
    rows = rows.withColumns({f"_{k}": F.when(decayed, c(f"d_{k}")).otherwise(c(k)) for k in SUMS})
    rows = rows.withColumns({"lh": F.exp(c("intercept") + c("home_advantage") + c("home_attack") + c("away_defence")), "la": F.exp(c("intercept") + c("away_attack") + c("home_defence"))})
    both = c("_w00") * c("lh") * c("la") * c("rho") / (1 - c("lh") * c("la") * c("rho"))
    at_home = c("_w") * c("lh") + both - c("_w01") * c("lh") * c("rho") / (1 + c("lh") * c("rho"))
    away = c("_w") * c("la") + both - c("_w10") * c("la") * c("rho") / (1 + c("la") * c("rho"))
    each = rows.select("league", "fold", "config_id", F.explode(F.array(
        F.struct(c("home").alias("team"), at_home.alias("scored"), away.alias("conceded")), F.struct(c("away").alias("team"), away.alias("scored"), at_home.alias("conceded")))).alias("s"))
    sums = each.groupBy("league", "fold", "config_id", "s.team").agg(F.sum("s.scored").alias("scored"), F.sum("s.conceded").alias("conceded"))
    ridge = F.create_map(*[x for k, v in configs.items() for x in (F.lit(k), F.lit(0.0 if v[1] is None else 1.0 / v[1] ** 2))])[c("config_id")]
    return sums.join(named.select("league", "fold", "config_id", "team", "attack", "defence"), ["league", "fold", "config_id", "team"]).select(
        "league", "fold", "config_id", "team", (c("scored") + ridge * c("attack")).alias("scored"), (c("conceded") + ridge * c("defence")).alias("conceded"))


def promoted_offsets(matches: DataFrame, folds: list[Fold]) -> DataFrame:
    """Attack and defence of a club never seen in training: mean log ratio of
    debut team-seasons to their league's goals per team-match; 0 without any."""
    m = with_season_index(matches)
    goals = team_rows(m, "season_idx").groupBy("league", "season", "season_idx", "team").agg(
        F.avg("gf").alias("gf"), F.avg("ga").alias("ga"), F.sum("gf").alias("goals"), F.count("*").alias("n"))
    per_season = goals.groupBy("league", "season").agg((F.sum("goals") / F.sum("n")).alias("lg"))
    ts = classify_team_seasons(goals).join(per_season, ["league", "season"])
    member = F.explode(F.array_compact(F.array(*[F.when(F.col("season") <= F.lit(c), F.lit(n)) for n, c, _ in folds])))
    debut = F.col("is_debut") & (F.col("lg") > 0)
    ratio = lambda x: F.avg(F.when(debut & (F.col(x) > 0), F.log(F.col(x) / F.col("lg"))))
    return ts.withColumn("fold", member).groupBy("league", "fold").agg(
        F.coalesce(ratio("gf"), F.lit(0.0)).alias("promoted_attack"),
        F.coalesce(ratio("ga"), F.lit(0.0)).alias("promoted_defence"))


def attach_strengths(fixtures: DataFrame, fits: DataFrame, offsets: DataFrame, by: list[str]) -> DataFrame:
    """Expected goals of each fixture. Clubs without a fit take the promoted
    offsets. ``by`` names the columns shared by fixtures, fits and offsets."""
    keys = [*by, "config_id"]
    # A fit that did not succeed fails the job where its fixtures are rated; none of them is left out.
    failed = F.raise_error(F.concat(F.lit("goal model not fitted: "), F.coalesce(F.max("status"), F.lit("no status"))))
    header = fits.groupBy(*keys).agg(
        F.when(F.coalesce(F.min("status") == "fitted", F.lit(False)) & (F.max("status") == "fitted"), F.first("intercept")).otherwise(failed.cast("double")).alias("intercept"),
        F.first("home_advantage").alias("home_advantage"), F.first("rho").alias("rho"))
    out = fixtures.join(header, by).join(offsets, by)
    for side in ("home", "away"):
        s = fits.select(*keys, F.col("team").alias(side), F.col("attack").alias(f"{side}_attack"), F.col("defence").alias(f"{side}_defence"))
        out = out.join(s, [*keys, side], "left").withColumns({
            f"{side}_attack": F.coalesce(f"{side}_attack", "promoted_attack"),
            f"{side}_defence": F.coalesce(f"{side}_defence", "promoted_defence"),
        })
    c = F.col
    return out.withColumns({
        "rate_home": F.exp(c("intercept") + c("home_advantage") + c("home_attack") + c("away_defence")),
        "rate_away": F.exp(c("intercept") + c("away_attack") + c("home_defence")),
    })


def unfitted_teams(fixtures: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """Strict serving check: clubs of the fixtures that the model never saw."""
    teams = fixtures.select(*by, F.explode(F.array("home", "away")).alias("team")).distinct()
    return teams.join(fits.select(*by, "team").distinct(), [*by, "team"], "left_anti")


def with_marginals(rated: DataFrame, strict: bool = False) -> DataFrame:
    """Low-score factors, goal marginals and grid cap of every fixture.

    ``problem`` names an infeasible factor or rates too large for the widest
    grid; nothing is floored or clipped. ``strict`` fails the job instead.
    """
    c = F.col
    lh, la = c("rate_home"), c("rate_away")
    out = rated.withColumns(P.taus(lh, la, c("rho")))
    out = out.withColumns({"_ph": P.poisson_pmf(lh), "_pa": P.poisson_pmf(la)}).withColumn("cap", P.cap_for(c("_ph"), c("_pa")))
    inf = float("inf")
    out = out.withColumn(
        "problem",
        F.when(~F.coalesce((lh > 0) & (la > 0) & (lh < inf) & (la < inf), F.lit(False)), "rate not finite and positive")
        .when(F.least("tau00", "tau01", "tau10", "tau11") < P.TAU_FLOOR, "infeasible low-score correction")
        .when(c("cap").isNull(), "grid too small for the rates"),
    )
    if strict:
        out = out.withColumn("problem", F.when(c("problem").isNotNull(), F.raise_error(c("problem")).cast("string")))
    return out


def _cells(marginals: DataFrame, columns: list[str]) -> DataFrame:
    """One row per cell of every sound fixture's grid, not yet normalised."""
    size = F.col("cap") + 1
    each = marginals.where("problem is null").withColumn("_i", F.explode(F.sequence(F.lit(0), size * size - 1)))
    h, a = F.floor(F.col("_i") / size).cast("int"), (F.col("_i") % size).cast("int")
    p = F.get("_ph", h) * F.get("_pa", a) * P.correction(h, a)
    return each.select(*columns, h.alias("h"), a.alias("a"), p.alias("p"))


def _top_cells(rate_home, rate_away, n: int):
    """The best ``n`` cells, ties by home then away goals.

    Poisson masses fall away on both sides of floor(rate), so a side's best
    ``n + 2`` goal counts lie within ``n + 2`` of it. A cell outside that range
    is beaten in its own row or column by at least ``n`` cells without a
    low-score factor; the four cells that have one are always looked at.
    """
    c = F.col
    span = lambda rate: F.sequence(
        F.greatest(F.lit(0), (F.floor(rate) - n - 2).cast("int")), F.least(c("cap"), (F.floor(rate) + n + 2).cast("int")))
    cell = lambda h, a: F.struct(
        (-F.get(c("_ph"), h) * F.get(c("_pa"), a) * P.correction(h, a)).alias("np"), h.alias("h"), a.alias("a"))
    central = F.flatten(F.transform(span(rate_home), lambda h: F.transform(span(rate_away), lambda a: cell(h, a))))
    corner = F.array(*[cell(F.lit(h), F.lit(a)) for h in (0, 1) for a in (0, 1)])
    return F.slice(F.sort_array(F.array_union(central, corner)), 1, n)


def score_fixtures(rated: DataFrame, top_n: int = P.TOP_SCORELINES, strict: bool = False) -> DataFrame:
    """Outcome probabilities, expected goals and top scorelines of every row
    with ``rate_home``, ``rate_away`` and ``rho``.

    The matrix is a product of two marginals but for four cells, so its sums
    follow from one pass over the marginals. Nothing leaves the row.
    """
    c = F.col
    out = with_marginals(rated, strict)
    size = F.when(c("problem").isNull(), c("cap") + 1)
    out = out.withColumns({"_ph": F.slice("_ph", 1, size), "_pa": F.slice("_pa", 1, size)})
    start = F.struct(*[F.lit(0.0).alias(k) for k in ("ch", "ca", "home", "draw", "away", "eh", "ea")], F.lit(0).alias("k"))
    sums = F.aggregate(
        F.arrays_zip(c("_ph").alias("h"), c("_pa").alias("a")), start,
        lambda s, x: F.struct(
            (s["ch"] + x["h"]).alias("ch"), (s["ca"] + x["a"]).alias("ca"),
            (s["home"] + x["h"] * s["ca"]).alias("home"), (s["draw"] + x["h"] * x["a"]).alias("draw"),
            (s["away"] + x["a"] * s["ch"]).alias("away"),
            (s["eh"] + x["h"] * s["k"]).alias("eh"), (s["ea"] + x["a"] * s["k"]).alias("ea"), (s["k"] + 1).alias("k")),
    )
    at = lambda h, a: F.get("_ph", F.lit(h)) * F.get("_pa", F.lit(a))
    out = out.withColumns({"_m": sums, "_top": _top_cells(c("rate_home"), c("rate_away"), top_n)})
    out = out.withColumn("_z", c("_m.ch") * c("_m.ca"))
    return out.withColumns({
        "p_home": (c("_m.home") + at(1, 0) * (c("tau10") - 1)) / c("_z"),
        "p_draw": (c("_m.draw") + at(0, 0) * (c("tau00") - 1) + at(1, 1) * (c("tau11") - 1)) / c("_z"),
        "p_away": (c("_m.away") + at(0, 1) * (c("tau01") - 1)) / c("_z"),
        "expected_home_goals": c("_m.eh") / c("_m.ch"),
        "expected_away_goals": c("_m.ea") / c("_m.ca"),
        "top_scorelines": F.transform("_top", lambda x: F.struct(
            F.concat(x["h"].cast("string"), F.lit("-"), x["a"].cast("string")).alias("score"), (-x["np"] / c("_z")).alias("p"))),
        "most_likely_scoreline": F.concat(c("_top")[0]["h"].cast("string"), F.lit("-"), c("_top")[0]["a"].cast("string")),
    }).drop("_ph", "_pa", "_m", "_z", "_top", "tau00", "tau01", "tau10", "tau11")


def score_grid(rated: DataFrame, key: list[str]) -> DataFrame:
    """The normalised scoreline distribution as (home goals, away goals, p) rows."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    size = F.col("cap") + 1
    marginals = with_marginals(rated).withColumn("_z", total(F.slice("_ph", 1, size)) * total(F.slice("_pa", 1, size)))
    return _cells(marginals, [*key, "_z"]).select(
        *key, F.col("h").alias("home_goals"), F.col("a").alias("away_goals"), (F.col("p") / F.col("_z")).alias("p"))


def out_of_fold(matches: DataFrame, fits: DataFrame, offsets: DataFrame, folds: list[Fold]) -> DataFrame:
    """Validation predictions of every configuration and fold, one row per match.

    A prediction depends on the pairing only, so each distinct (fold, home,
    away) is scored once and joined back to its matches.
    """
    fold_of = F.create_map(*[x for n, _, v in folds for x in (F.lit(v), F.lit(n))])
    rows = matches.withColumn("fold", fold_of[F.col("season")]).where("fold is not null")
    pairs = rows.select("league", "fold", "home", "away").distinct()
    rated = attach_strengths(pairs, fits, offsets, ["league", "fold"])
    scored = score_fixtures(spread_by(rated, "league", "fold", "home", "away")).select(
        "league", "fold", "home", "away", "config_id", "p_home", "p_draw", "p_away",
        "expected_home_goals", "expected_away_goals", "most_likely_scoreline", "problem")
    return rows.select("match_id", "league", "season", "match_date", "home", "away", "fold", "ftr").join(
        scored, ["league", "fold", "home", "away"]).withColumn(
        "y", F.when(F.col("ftr") == "H", 0).when(F.col("ftr") == "D", 1).otherwise(2))
