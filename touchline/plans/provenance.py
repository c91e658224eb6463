"""Queries over provenance, parameter files and leakage probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import causal, elo, form, goals, seasons
from touchline.plans import sqltext as Q
from touchline.plans.goals import FOLDS, RATED, goals_scored_sql, moment_fits, rounded_scores
from touchline.plans.models import feature_table
from touchline.plans.registry import r, register
from touchline.session import fresh_path, refuse_if_any, written
from touchline.sources import provenance
from touchline.sources.contests import contests


@register("s7_provenance_record", f"WITH {Q.CONTESTS} SELECT count(*) n_rows, 35 n_features, true valid_for_evaluation, '2000' row_cap FROM contests WHERE season <= 2000")
def provenance_record(spark, sf):
    c = contests(spark, sf)
    capped = feature_table(spark, sf).where("season <= 2000")
    record = provenance.provenance_record(capped, causal.parameter_schedule(c), c, valid_for_evaluation=True, row_cap=2000, sealed=2001)
    return record.select("n_rows", "n_features", "valid_for_evaluation", "row_cap")


@register("s8_refuse_overwrite", f"WITH {Q.CONTESTS} SELECT count(*) n_rows, true refused, '' problems FROM contests WHERE season <= 2000")
def refuse_overwrite(spark, sf):
    """Write, write the same again, refuse different parameters, then audit the table."""
    c = contests(spark, sf)
    capped = feature_table(spark, sf).where("season <= 2000")
    # Written once: sums of doubles differ in their last bits from run to run, and then the same would be refused as different.
    record = written(provenance.provenance_record(capped, causal.parameter_schedule(c), c, valid_for_evaluation=True, row_cap=2000, sealed=2001), "provenance")
    path = fresh_path(spark, "feature-table")
    provenance.write_features(capped, record, path)
    provenance.write_features(capped, record, path)
    other = provenance.provenance_record(capped, causal.constant_schedule(c, 45, 0.8, -100), c, valid_for_evaluation=False, row_cap=2000)
    try:
        provenance.write_features(capped, other, path)
        refused = False
    except ValueError:
        refused = True
    problems = provenance.provenance_violations(spark, path, [1999, 2000])
    return spark.read.parquet(path).agg(F.count("*").alias("n_rows")).withColumns({"refused": F.lit(refused), "problems": F.lit("; ".join(problems))})


@register("s10_goal_parameters", RATED + f" SELECT league, home, away, {r('lh')} rate_home, {r('la')} rate_away FROM rated")
def goal_parameters(spark, sf):
    """Parameters written as JSON, read back, and used to rate every pairing. The rates are moments of all seasons, not a fit; that is ``final_goal_model``."""
    c = contests(spark, sf)
    path = fresh_path(spark, "goal-parameters")
    provenance.write_goal_parameters(moment_fits(spark, sf).where("team % 10 <> 3"), goals.promoted_offsets(c, FOLDS), path, c)
    fits, offsets = provenance.read_goal_parameters(spark, path)
    pairs = c.select("league", F.col("home").cast("string").alias("home"), F.col("away").cast("string").alias("away")).distinct().withColumn("fold", F.lit(3))
    rated = goals.attach_strengths(pairs, fits, offsets, ["league", "fold"])
    return rated.select("league", F.col("home").cast("long").alias("home"), F.col("away").cast("long").alias("away"), "rate_home", "rate_away")


FROZEN = "dixon_coles_l2_decay"
SEALED = 2001


@register("m14_s10_goal_model")
def final_goal_model(spark, sf):
    """Fit the frozen goal model on all contests before the sealed season, write it, read it back and check what it was fitted on."""
    c = contests(spark, sf).where(F.col("season") < SEALED)
    fold = [(4, SEALED - 1, SEALED)]
    pairs = goals.fold_pair_statistics(goals.season_pair_statistics(c), fold)
    fits = written(goals.fit_goal_models(pairs, {FROZEN: goals.CONFIGS[FROZEN]}), "final-goal-fit")
    refuse_if_any(fits.where("status <> 'fitted'"), "final-goal-unfitted", "goal model not fitted")
    path = fresh_path(spark, "final-goal-model")
    provenance.write_goal_parameters(fits, goals.promoted_offsets(c, fold), path, c)
    seen = provenance.checked_training(spark, path, str(SEALED - 1), c.count())
    read, offsets = provenance.read_goal_parameters(spark, path, sealed=str(SEALED))
    return read.join(offsets, ["league", "fold"]).join(F.broadcast(seen), ["league", "fold"]).drop("fold", "status").withColumn("team", F.col("team").cast("long"))


@register("m14_goal_model_identities", goals_scored_sql(f"(4, {SEALED - 1})", f"('{FROZEN}', {goals.CONFIGS[FROZEN][2]})"))
def final_model_identities(spark, sf):
    """The saved and reread parameters are at the optimum of all contests before the sealed season: their goals are those that were scored."""
    c = contests(spark, sf).where(F.col("season") < SEALED)
    pairs = goals.fold_pair_statistics(goals.season_pair_statistics(c), [(4, SEALED - 1, SEALED)])
    model = final_goal_model(spark, sf).withColumns({"fold": F.lit(4), "config_id": F.lit(FROZEN), "status": F.lit("fitted")})
    return rounded_scores(goals.score_identities(pairs, model))


def probe_state(matches, schedule=None):
    """Pre-match form and ratings of every team day."""
    m = seasons.with_season_index(matches)
    state = form.team_state(form.team_days(m))
    rated = elo.ratings(matches, causal.parameter_schedule(matches) if schedule is None else schedule)
    return state.join(rated, ["league", "season_idx", "match_date", "team"]).select(
        "league", "match_date", "team", F.round("elo", 6).alias("elo"), F.round("ewma_gf", 9).alias("ewma_gf"), F.round("ewma_ppg", 9).alias("ewma_ppg"),
        F.round("std_ppg", 9).alias("std_ppg"), F.round("sot_ratio", 9).alias("sot_ratio"), "history_depth", "rest_days")


@register("k7_leakage_probe", f"WITH {Q.TEAM_ROWS} SELECT count(DISTINCT (league, team, match_date)) n_before, 0 n_changed FROM tr WHERE season < 1999")
def leakage_probe(spark, sf):
    """Turning every later result round must not change one earlier row."""
    c = contests(spark, sf)
    later = F.col("season") >= 1999
    turned = c.withColumns({
        "fthg": F.when(later, F.col("ftag") + 1).otherwise(F.col("fthg")), "ftag": F.when(later, F.col("fthg")).otherwise(F.col("ftag")),
        "hst": F.when(later, F.col("ast")).otherwise(F.col("hst")),
    }).withColumn("ftr", F.when(F.col("fthg") > F.col("ftag"), "H").when(F.col("fthg") < F.col("ftag"), "A").otherwise("D"))
    before = F.col("match_date") < F.lit("1999-01-01").cast("date")
    a = written(probe_state(c).where(before), "probe-a")
    b = written(probe_state(turned).where(before), "probe-b")
    changed = a.exceptAll(b).count() + b.exceptAll(a).count()
    return a.agg(F.count("*").alias("n_before"), F.lit(changed).cast("long").alias("n_changed"))


@register("k7_truncation_probe", f"WITH {Q.TEAM_ROWS} SELECT count(DISTINCT (league, team, match_date)) n_before, 0 n_changed FROM tr WHERE season <= 1998")
def truncation_probe(spark, sf):
    """Cutting the history at a season boundary must not change the rows before it."""
    c = contests(spark, sf)
    before = F.col("match_date") < F.lit("1999-01-01").cast("date")
    a = written(probe_state(c).where(before), "probe-a")
    b = written(probe_state(c.where("season <= 1998")), "probe-b")
    changed = a.exceptAll(b).count() + b.exceptAll(a).count()
    return a.agg(F.count("*").alias("n_before"), F.lit(changed).cast("long").alias("n_changed"))


@register("k7_same_date_probe", f"WITH {Q.TEAM_ROWS} SELECT count(DISTINCT (league, team, match_date)) n_before, 0 n_changed FROM tr "
          "WHERE match_date = (SELECT max(match_date) FROM tr WHERE season = 2000)")
def same_date_probe(spark, sf):
    """Turning the results of one date, a row's own and those of the same day, and the order of the rows must not change that date's rows."""
    c = contests(spark, sf)
    day = c.where("season = 2000").agg(F.max("match_date")).first()[0]
    here = F.col("match_date") == F.lit(day)
    turned = c.withColumns({"fthg": F.when(here, F.col("ftag") + 3).otherwise(F.col("fthg")), "hst": F.when(here, F.col("ast") + 4).otherwise(F.col("hst"))}) \
        .withColumn("ftr", F.when(F.col("fthg") > F.col("ftag"), "H").when(F.col("fthg") < F.col("ftag"), "A").otherwise("D")).repartition(7, "away")
    schedule = causal.parameter_schedule(c)  # the season's own parameters come from earlier seasons
    a = written(probe_state(c, schedule).where(here), "probe-a")
    b = written(probe_state(turned, schedule).where(here), "probe-b")
    changed = a.exceptAll(b).count() + b.exceptAll(a).count()
    return a.agg(F.count("*").alias("n_before"), F.lit(changed).cast("long").alias("n_changed"))
