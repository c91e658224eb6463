"""Sequential ratings.

The update is a coupled recurrence over dates, so it cannot be a window
function. Spark first folds the matches into (day, home, away) totals: the sum
of the deltas of equal fixtures depends only on their number and total score.

Two forms give the same ratings. A pass reads one league's log as Arrow batches
in date order and keeps one number per team: few jobs, one task a league. The
form by levels plays all contests that do not need each other at once, in joins
and aggregations over all leagues; successive levels of few contests share a
step, in which a task plays one league's contests of those levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions.ratings import expectancy
from touchline.operators.seasons import classify_team_seasons, team_seasons, with_season_index
from touchline.session import fresh_path, written

RATING_SCHEMA = "league int, season_idx int, match_date date, team long, elo double"


def pair_days(matches_idx: DataFrame) -> DataFrame:
    """Matches per (day, home, away) with the total home score."""
    score = F.when(F.col("ftr") == "H", 1.0).when(F.col("ftr") == "D", 0.5).otherwise(0.0)
    return matches_idx.groupBy("league", "season_idx", "match_date", "home", "away").agg(
        F.count("*").alias("n"), F.sum(score).alias("score")
    )


def rating_events(matches: DataFrame, schedule: DataFrame) -> DataFrame:
    """One ordered log per league: a season's roster rows, then its pair-days.

    The whole roster comes first because the season's re-centring uses every
    club of the season, also those that have not played yet.
    """
    m = with_season_index(matches)
    params = schedule.select(
        "league", "season_idx", "home_advantage", "season_shrink", "promoted_delta", "k_factor", "initial_rating"
    )
    roster = classify_team_seasons(team_seasons(m)).select(
        "league", "season_idx", F.lit(0).alias("step"), F.lit(None).cast("date").alias("match_date"),
        F.col("team").alias("home"), F.lit(None).cast("long").alias("away"),
        F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score"),
        # 0 opening season, 1 newcomer or stale, 2 continuing
        F.when(F.col("season_idx") == 0, 0).when(F.col("is_newcomer"), 1).otherwise(2).alias("kind"),
    )
    games = pair_days(m).select(
        "league", "season_idx", F.lit(1).alias("step"), "match_date", "home", "away", "n", "score",
        F.lit(2).alias("kind"),
    )
    return roster.unionByName(games).join(params, ["league", "season_idx"])


def _rating_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rating: dict[int, float] = {}
    season = day = None
    opening: list[tuple[int, int]] = []
    today: list[tuple] = []
    out: list[tuple] = []
    league = None

    def open_season(p):
        _, shrink, delta, _, start = p
        for team, kind in opening:
            if kind == 0:
                rating[team] = start
            elif kind == 1:
                rating[team] = start + delta
            else:
                rating[team] = start + shrink * (rating[team] - start)
        shift = start - sum(rating[t] for t, _ in opening) / len(opening)
        for team, _ in opening:
            rating[team] += shift
        opening.clear()

    def close_day():
        deltas: dict[int, float] = {}
        for home, away, n, score, adv, k in today:
            rh, ra = rating[home], rating[away]
            change = k * (score - n / (1.0 + 10.0 ** (-(rh + adv - ra) / 400.0)))
            deltas[home] = deltas.get(home, 0.0) + change
            deltas[away] = deltas.get(away, 0.0) - change
        for team, change in deltas.items():
            out.append((league, season, day, team, rating[team]))
            rating[team] += change
        today.clear()

    def flush():
        cols = list(zip(*out))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.date32()),
             pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())],
            names=["league", "season_idx", "match_date", "team", "elo"],
        )
        out.clear()
        return batch

    names = ["league", "season_idx", "step", "match_date", "home", "away", "n", "score", "kind",
             "home_advantage", "season_shrink", "promoted_delta", "k_factor", "initial_rating"]
    params = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        for lg, s, step, d, home, away, n, score, kind, adv, shrink, delta, k, start in zip(*columns):
            if step == 0:
                if today:
                    close_day()
                league, season, day, params = lg, s, None, (adv, shrink, delta, k, start)
                opening.append((home, kind))
                continue
            if opening:
                open_season(params)
            if d != day and today:
                close_day()
            day = d
            today.append((home, away, n, score, adv, k))
        if len(out) >= 50_000:
            yield flush()
    if today:
        close_day()
    if out:
        yield flush()


#: Rows of one league's log up to which its pass runs in one task; beyond, all leagues go by levels.
PASS_ROWS = 2_000_000


def ratings(matches: DataFrame, schedule: DataFrame, pass_rows: int = PASS_ROWS) -> DataFrame:
    """Rating of every team before each of its match days: a pass a league, or by levels where a league's log is too long for one task."""
    log = written(rating_events(matches, schedule), "rating-log")
    longest = log.groupBy("league").count().agg(F.max("count")).first()[0]
    if (longest or 0) > pass_rows:
        return _by_levels(log)
    ordered = log.repartition("league").sortWithinPartitions("league", "season_idx", "step", "match_date")
    return ordered.groupBy("league").applyInArrow(_rating_pass, RATING_SCHEMA)


def _level_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: dict[int, tuple] = {}  # a team's latest day, its level before that day and after
    for batch in batches:
        levels = []
        for day, home, away in zip(*(batch.column(c).to_pylist() for c in ("match_date", "home", "away"))):
            level = 1
            for team in (home, away):
                seen = last.get(team)
                if seen:
                    level = max(level, 1 + (seen[1] if seen[0] == day else seen[2]))
            for team in (home, away):
                seen = last.get(team)
                if seen and seen[0] == day:
                    last[team] = (day, seen[1], max(seen[2], level))
                else:
                    last[team] = (day, seen[2] if seen else 0, level)
            levels.append(level)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(levels, pa.int32())], names=[*batch.schema.names, "level"])


#: Levels found by one plan, before its rows are written.
LEVELS_EACH = 4


def _write_levels(settled: DataFrame, path: str) -> None:
    # small levels share a task, large ones are split: few files a level, whatever its size
    settled.hint("rebalance", F.col("season_idx"), F.col("level")).write.partitionBy("season_idx", "level").mode("append").parquet(path)


def contest_levels(pairs: DataFrame, pass_rows: int = PASS_ROWS) -> DataFrame:
    """Each pair-day with its ``level`` in the season's graph of contests: one more than the highest level of the contests
    on the last earlier day of either side. Contests of one level need nothing of each other, whatever their dates.

    Seasons of up to ``pass_rows`` pair-days are each read once in order of date, by one task that keeps the levels of the
    season's teams. Where a season is longer, in every step the contests on the first open day of both their sides get the
    next level; all leagues and seasons take their steps together, and a step reads only what is still open. Levels are
    written as directories of one table."""
    pairs = written(pairs, "rating-pairs")
    spark = pairs.sparkSession
    path = fresh_path(spark, "rating-levels")
    game = ["league", "season_idx", "match_date", "home", "away"]
    columns = pairs.columns
    table = lambda: spark.read.schema(pairs.withColumn("level", F.lit(0)).schema).parquet(path)
    longest = pairs.groupBy("league", "season_idx").count().agg(F.max("count")).first()[0]
    if (longest or 0) <= pass_rows:
        ordered = pairs.repartition("league", "season_idx").sortWithinPartitions("league", "season_idx", "match_date")
        passed = ordered.groupBy("league", "season_idx").applyInArrow(_level_pass, pairs.withColumn("level", F.lit(None).cast("int")).schema)
        # as the steps tell it: once for each side that is the home side
        _write_levels(passed.withColumn("_side", F.explode(F.array("home", "away"))).where("_side = home").drop("_side"), path)
        return table()
    sides = pairs.withColumn("team", F.explode(F.array("home", "away"))).withColumn("level", F.lit(None).cast("int"))
    schema, k = sides.schema, 0
    while True:
        for _ in range(LEVELS_EACH):
            k += 1
            first_open = F.min(F.when(F.col("level").isNull(), F.col("match_date"))).over(W.partitionBy("league", "season_idx", "team"))
            ready = F.min(F.col("match_date") == F.col("_first")).over(W.partitionBy(*game))
            sides = sides.withColumn("_first", first_open).withColumn("level", F.when(F.col("level").isNull() & ready, k).otherwise(F.col("level"))).drop("_first")
        step = fresh_path(spark, "rating-open")
        sides.write.parquet(step)
        got = spark.read.schema(schema).parquet(step)
        settled = got.where("level IS NOT NULL AND team = home").select(*columns, "level")
        _write_levels(settled, path)
        sides = got.where("level IS NULL")
        if sides.isEmpty():
            return table()


#: Pair-days of successive levels that one step plays, a task a league; a level of more is a step of its own, spread over all tasks.
LEVEL_ROWS = 500_000


def _blocks(sizes: list[tuple[int, int]], rows: int) -> list[tuple[int, int, bool]]:
    """Runs (first level, last level, whether a task a league may play them) of the levels of a season and their sizes."""
    out, held = [], 0
    for level, n in sorted(sizes):
        if out and out[-1][2] and held + n <= rows:
            out[-1], held = (out[-1][0], level, True), held + n
        else:
            out.append((level, level, n <= rows))
            held = n
    return out


# A row that begins a day is fresh; a team's last row of a step is what the next one starts from.
_STATE = "league int, team long, base double, day date, change double, season_idx int, fresh boolean, last boolean"
_STATE_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]


def _block_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One league: the state of the teams that play (level 0), then their contests by level."""
    state: dict[int, list] = {}  # league, team, base, day, change, season_idx, fresh
    out: list[tuple] = []
    types = [pa.int32(), pa.int64(), pa.float64(), pa.date32(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()]

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=_STATE_COLUMNS)
        out.clear()
        return batch

    names = ["league", "season_idx", "level", "day", "home", "away", "n", "score", "home_advantage", "k_factor", "base", "change"]
    for batch in batches:
        for league, season, level, day, home, away, n, score, adv, k, base, change in zip(*(batch.column(c).to_pylist() for c in names)):
            if level == 0:
                state[home] = [league, home, base, day, change, season, False]
                continue
            sides = state[home], state[away]
            rh, ra = (s[2] if s[3] == day else s[2] + s[4] for s in sides)
            moved = k * (score - n / (1.0 + 10.0 ** (-(rh + adv - ra) / 400.0)))
            for s, more in zip(sides, (moved, -moved)):
                if s[3] == day:
                    s[4] += more
                    continue
                if s[6]:
                    out.append((*s, False))
                s[2:] = [s[2] + s[4], day, more, season, True]
        if len(out) >= 50_000:
            yield flush()
    out.extend((*s, True) for s in state.values())
    if out:
        yield flush()


def _by_levels(log: DataFrame, level_rows: int = LEVEL_ROWS, pass_rows: int = PASS_ROWS) -> DataFrame:
    """The recurrence over levels, season openings in between. A level of more than ``level_rows`` contests is one join and one
    aggregation; successive smaller ones, up to as many contests together, are one step in which a task plays a league's.

    A state row holds a team's rating before its latest day and that day's change so far. Each step writes the state after it
    into its own directory of one table, which is what the next step reads; rows that begin a day are the result."""
    spark = log.sparkSession
    games = contest_levels(log.where("step = 1").drop("step", "kind"), pass_rows)
    roster = log.where("step = 0").select("league", "season_idx", F.col("home").alias("team"), "kind", "season_shrink", "promoted_delta", "initial_rating")
    sizes: dict[int, list] = {}
    for r in games.groupBy("season_idx", "level").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r["season_idx"], []).append((r["level"], r["n"]))
    path, done = fresh_path(spark, "rating-states"), 0
    state = spark.createDataFrame([], _STATE)

    def store(df: DataFrame) -> DataFrame:
        nonlocal done
        done += 1
        step = f"{path}/step={done}"
        df.select(*_STATE_COLUMNS).write.parquet(step)
        return spark.read.schema(_STATE).parquet(step).where("last")

    now = (F.col("base") + F.col("change")).alias("now")
    for season in sorted(sizes):
        start = F.col("initial_rating")
        opening = roster.where(F.col("season_idx") == season).join(state.select("league", "team", now), ["league", "team"], "left").withColumn(
            "base", F.when(F.col("kind") == 0, start).when(F.col("kind") == 1, start + F.col("promoted_delta")).otherwise(start + F.col("season_shrink") * (F.col("now") - start)))
        mean = opening.groupBy("league").agg(F.avg("base").alias("mean"))
        opened = opening.join(mean, "league").select(
            "league", "team", (F.col("base") + start - F.col("mean")).alias("base"), F.lit(None).cast("date").alias("day"), F.lit(0.0).alias("change"),
            F.col("season_idx").cast("int").alias("season_idx"), F.lit(False).alias("fresh"), F.lit(True).alias("last"))
        resting = state.join(opened.select("league", "team"), ["league", "team"], "left_anti").withColumn("fresh", F.lit(False))
        state = store(resting.unionByName(opened))
        for first, final, small in _blocks(sizes[season], level_rows):
            g = games.where((F.col("season_idx") == season) & F.col("level").between(first, final))
            if small:
                playing = g.select("league", F.explode(F.array("home", "away")).alias("team")).distinct().withColumn("plays", F.lit(True))
                known = state.join(playing, ["league", "team"], "left")
                entering = known.where("plays").select("league", "season_idx", F.lit(0).alias("level"), "day", F.col("team").alias("home"), "base", "change")
                contests = g.withColumnRenamed("match_date", "day").unionByName(entering, allowMissingColumns=True)
                ordered = contests.repartition("league").sortWithinPartitions("league", "level")
                played = ordered.groupBy("league").applyInArrow(_block_pass, _STATE)
                state = store(known.where("plays IS NULL").withColumn("fresh", F.lit(False)).drop("plays").unionByName(played))
                continue
            before = F.when(F.col("day") == F.col("match_date"), F.col("base")).otherwise(F.col("base") + F.col("change"))
            side = lambda name: state.select("league", F.col("team").alias(name), "base", "day", "change")
            rated = g.join(side("home"), ["league", "home"]).withColumn("h_elo", before).drop("base", "day", "change")
            rated = rated.join(side("away"), ["league", "away"]).withColumn("a_elo", before)
            change = F.col("k_factor") * (F.col("score") - F.col("n") * expectancy(F.col("h_elo"), F.col("a_elo"), F.col("home_advantage")))
            moved = rated.select("league", "match_date", F.explode(F.array(
                F.struct(F.col("home").alias("team"), change.alias("moved")), F.struct(F.col("away").alias("team"), (-change).alias("moved")))).alias("s"))
            moved = moved.groupBy("league", "match_date", "s.team").agg(F.sum("s.moved").alias("moved"))
            begins = F.col("match_date").isNotNull() & ~F.col("day").eqNullSafe(F.col("match_date"))
            more = F.coalesce("moved", F.lit(0.0))
            state = store(state.drop("fresh").join(moved, ["league", "team"], "left").select(
                "league", "team", F.when(begins, F.col("base") + F.col("change")).otherwise(F.col("base")).alias("base"),
                F.when(begins, F.col("match_date")).otherwise(F.col("day")).alias("day"), F.when(begins, F.col("moved")).otherwise(F.col("change") + more).alias("change"),
                F.when(begins, F.lit(season)).otherwise(F.col("season_idx")).cast("int").alias("season_idx"), begins.alias("fresh"), F.lit(True).alias("last")))
    if not done:
        return spark.createDataFrame([], RATING_SCHEMA)
    return spark.read.schema(_STATE + ", step int").parquet(path).where("fresh").select("league", "season_idx", F.col("day").alias("match_date"), "team", F.col("base").alias("elo"))


def ratings_by_levels(matches: DataFrame, schedule: DataFrame, level_rows: int = LEVEL_ROWS) -> DataFrame:
    """As :func:`ratings`, without a pass over a league: no task plays more than ``level_rows`` contests, or its share of a level,
    and the number of steps is at most that of the levels, not of the days."""
    return _by_levels(written(rating_events(matches, schedule), "rating-log"), level_rows)
