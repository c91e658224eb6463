import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from touchline import schema as S
from touchline.operators import causal, elo, features, form, seasons

PARAMS = dict(home_advantage=0.0, season_shrink=1.0, promoted_delta=-100.0)


def built(matches, **params):
    schedule = causal.constant_schedule(matches, **{**PARAMS, **params})
    return {(str(r["match_date"]), r["home"], r["away"]): r for r in features.build_features(matches, schedule).collect()}


def test_ewma_by_hand(make_matches):
    m = make_matches([(2019, f"2019-08-{d:02d}", "A", f"Z{d}", g, 0) for d, g in ((1, 1), (8, 2), (15, 3), (22, 9))])
    row = [r for r in features.build_features(m, causal.constant_schedule(m, **PARAMS)).collect() if str(r["match_date"]) == "2019-08-22"][0]
    d = 0.5 ** 0.1
    assert row["home_ewma_gf"] == pytest.approx((3 + 2 * d + d * d) / (1 + d + d * d))
    assert row["home_history_depth"] == 3 and row["home_is_cold_start"] == 0


def test_rating_moves_by_half_k_and_same_day_is_invisible(make_matches):
    c = make_matches.code
    m = make_matches([(2019, "2019-08-01", "A", "B", 1, 0), (2019, "2019-08-01", "B", "C", 5, 0), (2019, "2019-08-08", "A", "C", 0, 0)])
    rows = built(m)
    first, other, later = rows["2019-08-01", c("A"), c("B")], rows["2019-08-01", c("B"), c("C")], rows["2019-08-08", c("A"), c("C")]
    assert (first["home_elo"], first["away_elo"], other["home_elo"]) == (1500.0, 1500.0, 1500.0)
    assert later["home_elo"] == pytest.approx(1510.0) and later["away_elo"] == pytest.approx(1490.0)
    assert other["home_matches_played_season"] == 0 and other["home_std_ppg"] is None


@pytest.mark.parametrize("shrink,expected", [(1.0, 1510.0), (0.0, 1500.0)])
def test_season_shrink(make_matches, shrink, expected):
    c = make_matches.code
    m = make_matches([(2019, "2019-08-01", "A", "B", 1, 0), (2020, "2020-08-01", "A", "B", 1, 0)])
    assert built(m, season_shrink=shrink)["2020-08-01", c("A"), c("B")]["home_elo"] == pytest.approx(expected)


def test_stale_return_forgets_form_but_not_totals(make_matches):
    c = make_matches.code
    rows = [(2019, f"2019-08-0{d}", "X", "Y", 1, 0) for d in (1, 2, 3, 4)]
    rows += [(2020, f"2020-08-0{d}", "Y", "W", 1, 0) for d in (1, 2, 3, 4)]
    rows += [(2021, "2021-08-01", "X", "Y", 1, 0)]
    row = built(make_matches(rows))["2021-08-01", c("X"), c("Y")]
    assert row["home_is_returning"] and not row["away_is_returning"]
    assert row["home_history_depth"] == 0 and row["home_ewma_gf"] is None and row["home_prior_matches_all_time"] == 4
    assert row["away_history_depth"] == 8
    assert (row["home_elo"] + row["away_elo"]) / 2 == pytest.approx(1500.0)


def test_rest_days_and_efficiency(make_matches):
    c = make_matches.code
    m = make_matches([
        (2019, "2019-08-01", "A", "P", 1, 0, 10, 10, 5, 5), (2019, "2019-08-06", "A", "Q", 0, 0, 1, 10, 1, 5),
        (2019, "2019-08-11", "A", "R", 2, 0, 10, 10, 4, 5), (2019, "2019-10-01", "A", "P", 0, 0),
    ])
    rows = built(m)
    assert rows["2019-08-01", c("A"), c("P")]["home_rest_days"] is None
    assert rows["2019-08-06", c("A"), c("Q")]["home_rest_days"] == 5
    last = rows["2019-10-01", c("A"), c("P")]
    assert last["home_rest_days"] == 21
    assert last["home_sot_ratio"] == pytest.approx(10 / 21) and last["home_conversion"] == pytest.approx(3 / 10)


def test_zero_denominator_is_null(make_matches):
    c = make_matches.code
    rows = [(2019, f"2019-08-0{i + 1}", "A", "B", 0, 0, s, 5, 0, 5) for i, s in enumerate((6, 4, 5))]
    row = built(make_matches(rows + [(2019, "2019-08-09", "A", "B", 0, 0)]))["2019-08-09", c("A"), c("B")]
    assert row["home_conversion"] is None and row["home_sot_ratio"] == 0.0


def random_league(make_matches, n_seasons=5, seed=3):
    rng = random.Random(seed)
    rows = []
    for s in range(n_seasons):
        teams = [f"T{(s + k) % 8}" for k in range(6)]
        for k in range(40):
            h, a = rng.sample(teams, 2)
            day = dt.date(2010 + s, 1, 1) + dt.timedelta(days=k // 3)
            rows.append((2010 + s, day.isoformat(), h, a, rng.randint(0, 4), rng.randint(0, 3)))
    return make_matches(rows)


def test_blocks_equal_the_recurrence(make_matches, monkeypatch):
    """Many short blocks must give the plain exponentially weighted mean."""
    monkeypatch.setattr(form, "BLOCK_HALFLIVES", 20)
    halflife = 0.5  # ten matches a block; older blocks count for less than 2^-20
    m = seasons.with_season_index(random_league(make_matches))
    got = {(r["team"], r["match_date"]): r["ewma_gf"] for r in form.team_state(form.team_days(m, halflife), halflife=halflife).collect()}
    monkeypatch.undo()
    want = {(r["team"], r["match_date"]): r["ewma_gf"] for r in form.team_state(form.team_days(m, halflife), halflife=halflife).collect()}
    decay = 0.5 ** (1 / halflife)
    rows = seasons.team_rows(m, "season_idx").collect()
    spell = {(r["team"], r["match_date"]): r["spell"] for r in form.with_spells(form.team_days(m)).collect()}
    for (team, day), value in want.items():
        prior = sorted((r for r in rows if r["team"] == team and r["match_date"] < day and spell[team, r["match_date"]] == spell[team, day]),
                       key=lambda r: (r["match_date"], r["home"], r["away"], r["match_id"]))
        if len(prior) < 3:
            assert value is None
            continue
        num = den = 0.0
        for r in prior:
            num, den = r["gf"] + decay * num, 1 + decay * den
        assert value == pytest.approx(num / den, abs=1e-12)
        assert got[team, day] == pytest.approx(value, abs=1e-4)


def test_ratings_by_levels_equal_the_pass(make_matches):
    """Also where the pass gives way because a league's log is too long for one task."""
    m = random_league(make_matches, n_seasons=2)
    first = m.where("match_date < date_add(make_date(season, 1, 1), 25)")
    schedule = causal.constant_schedule(first, 60.0, 0.7, -80.0)
    key = ["league", "season_idx", "match_date", "team"]
    a = {tuple(r[k] for k in key): r["elo"] for r in elo.ratings(first, schedule).collect()}
    b = {tuple(r[k] for k in key): r["elo"] for r in elo.ratings(first, schedule, pass_rows=1).collect()}
    assert len(a) > 50 and a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    assert elo.ratings_by_levels(first.limit(0), schedule).count() == 0


def test_levels_of_contests(make_matches):
    """A level is one more than the highest of the sides' last earlier day; contests of one day do not wait for each other."""
    c = make_matches.code
    m = make_matches([(2019, "2019-08-01", "A", "B", 1, 0), (2019, "2019-08-01", "B", "C", 1, 0), (2019, "2019-08-02", "C", "D", 1, 0), (2019, "2019-08-03", "E", "F", 1, 0),
                      (2019, "2019-08-04", "D", "E", 1, 0), (2019, "2019-08-04", "D", "A", 1, 0), (2020, "2020-08-01", "A", "D", 1, 0)])
    got = {(str(r.match_date), r.home, r.away): r.level for r in elo.contest_levels(elo.pair_days(seasons.with_season_index(m))).collect()}
    want = {("2019-08-01", "A", "B"): 1, ("2019-08-01", "B", "C"): 1, ("2019-08-02", "C", "D"): 2, ("2019-08-03", "E", "F"): 1, ("2019-08-04", "D", "E"): 3,
            ("2019-08-04", "D", "A"): 3, ("2020-08-01", "A", "D"): 1}
    assert got == {(d, c(h), c(a)): k for (d, h, a), k in want.items()}


def test_levels_share_steps(make_matches, monkeypatch):
    """Small levels are played together, one larger than the bound alone; the ratings are those of the pass."""
    m = random_league(make_matches, n_seasons=2)
    first = m.where("match_date < date_add(make_date(season, 1, 1), 25)").unionByName(
        m.where("match_date < date_add(make_date(season, 1, 1), 12)").withColumn("league", F.lit(1)))
    schedule = causal.constant_schedule(first, 60.0, 0.7, -80.0)
    levels = elo.contest_levels(elo.pair_days(seasons.with_season_index(first)))
    sizes = [r["count"] for r in levels.groupBy("season_idx", "level").count().collect()]
    paths, fresh_path = [], elo.fresh_path
    monkeypatch.setattr(elo, "fresh_path", lambda spark, label: paths.append(fresh_path(spark, label)) or paths[-1])
    want = {tuple(r)[:4]: r["elo"] for r in elo.ratings(first, schedule).collect()}
    steps = {}
    for rows in (elo.LEVEL_ROWS, max(sizes), min(sizes)):
        got = elo.ratings_by_levels(first, schedule, level_rows=rows).select("league", "season_idx", "match_date", "team", "elo").collect()
        steps[rows] = len(list(Path(next(p for p in reversed(paths) if "rating-states" in p)).glob("step=*")))
        assert len(got) == len(want) and {tuple(r)[:4]: r["elo"] for r in got} == pytest.approx(want, abs=1e-9)
    assert steps[elo.LEVEL_ROWS] == 4 and len(sizes) + 2 >= steps[min(sizes)] > 4


def test_levels_by_pass_and_by_steps(make_matches):
    m = random_league(make_matches, n_seasons=1).where("match_date < date_add(make_date(season, 1, 1), 12)")
    m = m.unionByName(m.where("match_id = 0").withColumn("away", F.col("home")))  # a side against itself
    pairs = elo.pair_days(seasons.with_season_index(m))
    rows = lambda df: sorted(tuple(r) for r in df.select("league", "season_idx", "match_date", "home", "away", "level").collect())
    assert rows(elo.contest_levels(pairs)) == rows(elo.contest_levels(pairs, pass_rows=1))


def test_schedule_is_causal_and_names_failures(make_matches):
    m = random_league(make_matches)
    s = causal.parameter_schedule(m)
    rows = {r["season"]: r for r in s.collect()}
    assert [rows[y]["status"] for y in (2010, 2011, 2012)] == ["apriori"] * 3
    assert rows[2013]["estimated_from"] == [2010, 2011, 2012]
    assert causal.schedule_violations(s).count() == 0
    changed = m.withColumn("ftr", F.when(F.col("season") >= 2013, "H").otherwise(F.col("ftr")))
    again = {r["season"]: r for r in causal.parameter_schedule(changed).collect()}
    assert again[2013]["home_advantage"] == rows[2013]["home_advantage"]
    with pytest.raises(Exception, match="sealed"):
        causal.parameter_schedule(m, sealed_from=2012, strict=True).collect()
    only_home = m.withColumn("ftr", F.lit("H"))
    assert {r["status"] for r in causal.parameter_schedule(only_home).where("season >= 2013").collect()} == {"home score outside (0, 1)"}


def test_contract_names_each_breach(make_matches):
    m = make_matches([(2019, f"2019-08-0{d}", "A", "B", d % 3, 1) for d in range(1, 7)])
    f = features.build_features(m, causal.constant_schedule(m, **PARAMS))
    assert features.contract_violations(f, expected_rows=6).count() == 0
    bad = f.withColumns({"home_elo": F.lit(3000.0), "target": F.lit(7).cast("long"), "away_history_depth": F.lit(-1.0)})
    found = {r["check"] for r in features.contract_violations(bad).collect()}
    assert {"elo_band:home", "elo_drift", "target_disagrees", "target_unknown", "depth_range:away"} <= found
    assert "missing_column:home_elo" in {r["check"] for r in features.contract_violations(f.drop("home_elo")).collect()}
    assert len(S.FEATURE_COLUMNS) == 35 and len(S.LINEAR_COLUMNS) == 25


def test_a_feature_that_is_an_outcome_is_told(make_matches):
    """Found in the rows, whatever the column is called; a constant that agrees by chance is not."""
    m = random_league(make_matches, n_seasons=2)
    f = features.build_features(m, causal.constant_schedule(m, **PARAMS))
    assert features.leaked_columns(f, m).count() == 0
    own = f.drop("home_ewma_gf").join(m.select("match_id", F.col("fthg").cast("double").alias("home_ewma_gf")), "match_id").select(*f.columns)
    told = features.contract_violations(own, matches=m).where("check LIKE 'leaked%'").collect()
    assert [(r["check"], r["n"]) for r in told] == [("leaked_column:home_ewma_gf", m.count())]


def test_tasks_of_the_form_windows_follow_the_days(spark, monkeypatch):
    """120 team-days at 10 a task: 12 partitions, which AQE leaves alone, and the state of one partition."""
    rows = [(i, i % 3, 2000 + i // 30, dt.date(2000 + i // 30, 1, 1) + dt.timedelta(days=i % 30), 2 * (i % 5), 2 * (i % 5) + 1, i % 4, i % 3, 9, 8, 4, 3, "HDA"[i % 3])
            for i in range(60)]
    m = seasons.with_season_index(spark.createDataFrame(rows, S.CONTEST_SCHEMA))
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(form.team_state(form.team_days(m)))
    monkeypatch.setattr(form, "STATE_ROWS", 10)
    got = form.team_state(form.team_days(m))
    assert got.rdd.getNumPartitions() == 12 and len(whole) == 120
    assert key(got) == whole
