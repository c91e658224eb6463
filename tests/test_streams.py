"""Stateful streams: the clock's timers, what a failed refresh leaves, upcoming fixtures without a trace."""

import datetime as dt
import time

from pyspark.sql import functions as F

from touchline.operators import seasons
from touchline.streaming import form, snapshots
from touchline.streaming.activity import split_late
from touchline.streaming.live import run_to_table

AT = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)
SNAPSHOT = "struct<status:string,stats:struct<home:struct<shots:int,held:double>>,events:array<struct<type:string,minute:int>>,lineups:map<string,array<string>>>"
SCHEMA = f"fixture_id long, fetched_at timestamp, tie long, ok boolean, snapshot {SNAPSHOT}"


def _source(spark, path, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _whole(k):
    return ("LIVE", ((k, None if k % 2 else 50.0),), [("GOAL", k), ("CARD", None)], {"home": ["A", "B"], "away": []})


def _row(fixture, seconds, tie, ok=True, k=7):
    return (fixture, AT + dt.timedelta(seconds=seconds), tie, ok, _whole(k) if ok else None)


def test_snapshots_come_back_whole(spark, tmp_path):
    parts = [[_row(1, 0, 1, k=3), _row(1, 0, 2, k=8), _row(2, 5, 1), _row(3, 5, 1, ok=False)],
             [_row(1, 20, 3, ok=False), _row(2, 6, 2, k=9), _row(2, 4, 3, k=1)], [_row(2, 30, 4, ok=False), _row(2, 31, 5, k=2)]]
    source = _source(spark, str(tmp_path / "in"), parts, SCHEMA)
    run_to_table(snapshots.latest_snapshots(source, 300), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    got = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.seq):
        got.setdefault(r.fixture_id, []).append(r)
    first, second, third = (got[k][-1] for k in (1, 2, 3))
    assert [r.reason for r in got[1]] == ["snapshot", "refresh failed"]
    assert first.snapshot.stats.home.shots == 8 and first.snapshot.events[1].minute is None and first.snapshot.lineups == {"home": ["A", "B"], "away": []}
    assert first.tie == 2 and first.is_stale and first.refresh_failed and first.last_successful_refresh == first.fetched_at
    assert second.tie == 5 and not second.is_stale and not second.refresh_failed and second.snapshot.stats.home.held == 50.0
    assert third.reason == "no snapshot" and third.snapshot is None and third.is_stale


def test_state_under_a_session_that_names_no_store(spark, tmp_path):
    """Spark's own default keeps one column family, stateful processors need several."""
    name = "spark.sql.streaming.stateStore.providerClass"
    mine, default = spark.conf.get(name), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, default)
    try:
        source = _source(spark, str(tmp_path / "in"), [[_row(1, 0, 1, k=3)], [_row(1, 20, 2, k=8), _row(2, 5, 1)]], SCHEMA)
        run_to_table(snapshots.latest_snapshots(source, 300), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
        assert spark.conf.get(name) == default
    finally:
        spark.conf.set(name, mine)
    assert sorted((r.fixture_id, r.tie) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_the_clock_makes_answers_stale(spark, tmp_path):
    source = _source(spark, str(tmp_path / "in"), [[_row(1, 0, 1)], [_row(2, 0, 1)]], SCHEMA)
    answers = snapshots.latest_snapshots(source, 2, keep_seconds=3600, by_clock=True)

    def store(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")

    query = answers.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            if query.exception():
                raise query.exception()
            told = spark.read.option("recursiveFileLookup", True).schema(snapshots._OUT.format(SNAPSHOT)).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
            if {r.fixture_id for r in told if r.reason == "expired"} == {1, 2}:
                break
    finally:
        query.stop()
    by = sorted((r.fixture_id, r.seq, r.reason, r.is_stale) for r in told)
    assert by == [(1, 1, "snapshot", False), (1, 2, "expired", True), (2, 1, "snapshot", False), (2, 2, "expired", True)]


def test_upcoming_fixtures_leave_no_trace(spark, make_matches, tmp_path):
    """Fixtures of a season two years on are answered as after a missed season; the results after them are not changed by it."""
    rows = [(2019, f"2019-08-{d:02d}", "A", f"Z{d}", g, 0) for d, g in ((1, 1), (8, 2), (15, 3), (22, 9))]
    m = seasons.with_season_index(make_matches(rows))
    known = form.results_of(seasons.team_rows(m, "season_idx"))
    team = make_matches.code("A")
    ask = known.where(F.col("team") == team).limit(1)
    asked = [ask.withColumns({"match_id": F.lit(k).cast("long"), "seen_at": F.lit(seen).cast("timestamp"), "match_date": F.lit(day).cast("date"), "season_idx": F.lit(season), "asks": F.lit(True), "gf": F.lit(None).cast("int")})
             for k, seen, day, season in ((100, "2019-08-15", "2019-08-22", 0), (101, "2019-08-15", "2021-08-01", 2), (102, "2019-08-20", "2019-09-30", 1))]
    ticks = known.limit(1).withColumns({"league": F.lit(form.CLOCK), "team": F.lit(form.CLOCK).cast("long"), "seen_at": F.lit("2030-01-01").cast("timestamp")})
    path = str(tmp_path / "in")
    for part in [known.select(*known.columns), *[a.select(*known.columns) for a in asked], ticks.select(*known.columns), ticks.select(*known.columns)]:
        part.coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run_to_table(form.live_form(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    told = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.team == team]
    played = {str(r.match_date): r for r in told if r.kind == "played"}
    answer = {r.match_id: r for r in told if r.kind == "upcoming"}
    assert len(played) == 4 and len(answer) == 3
    for c in form.FORM_COLUMNS:
        assert answer[100][c] == played["2019-08-22"][c]
    assert answer[101].is_returning and answer[101].history_depth == 0 and answer[101].ewma_gf is None and answer[101].prior_matches_all_time == 3 and answer[101].rest_days == 21
    assert answer[102].history_depth == 3 and answer[102].matches_played_season == 0 and answer[102].std_ppg is None and answer[102].ewma_gf == played["2019-08-22"].ewma_gf


def test_late_events_are_kept_apart(spark, tmp_path):
    hour = lambda h: AT + dt.timedelta(hours=h)
    parts = [[(1, hour(0)), (2, hour(5))], [(3, hour(4)), (4, hour(3)), (5, None)], [(6, hour(9))], [(7, hour(7))]]
    source = _source(spark, str(tmp_path / "in"), parts, "id long, at timestamp")
    split_late(source, "at", str(tmp_path / "out"), str(tmp_path / "cp"), "1 hour")
    read = lambda t: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/{t}").collect())
    assert read("late") == [4, 7] and read("on_time") == [1, 2, 3, 5, 6]


class _Kept:
    """A state that counts how often it is asked."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def get(self):
        self.calls.append("get")
        return iter(self.held or []) if isinstance(self.held, list) or self.held is None and self.many else self.held

    def exists(self):
        self.calls.append("exists")
        return self.held is not None

    def put(self, values):
        self.calls.append("put")
        self.held = list(values)

    update = lambda self, value: (self.calls.append("update"), setattr(self, "held", value))
    clear = lambda self: (self.calls.append("clear"), setattr(self, "held", None))
    appendList = lambda self, values: (self.calls.append("append"), setattr(self, "held", [*(self.held or []), *values]))


class _Handle:
    def __init__(self, calls):
        self.calls = calls

    def _of(self, many):
        kept = _Kept(self.calls)
        kept.many = many
        return kept

    getValueState = lambda self, *_: self._of(False)
    getListState = lambda self, *_: self._of(True)
    registerTimer = lambda self, _: self.calls.append("timer")


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_team_asks_its_state_a_few_times_a_batch():
    """However many rows come; of rows that come again the last one holds."""
    from pyspark.sql import Row

    calls, keep = [], 3650 * form.DAY_MS
    processor = form.FormProcessor(keep, 5.0, 3, 10, 30, 50)
    processor.init(_Handle(calls))
    day = lambda k: dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=k)
    stats = lambda g: dict.fromkeys(form.METRICS, 1) | {"gf": g}
    rows = [Row(league=0, team=1, season_idx=0, home=1, away=k, match_id=k, match_date=day(k).date(), seen_at=day(k), asks=False, **stats(1)) for k in range(300)]
    again = Row(**rows[299].asDict() | stats(9))
    first = list(processor.handleInputRows((0, 1), iter([*rows, again]), _Now(int(day(200).timestamp() * 1000) - keep)))
    assert [r.match_date for r in first] == [day(k).date() for k in range(200)] and len(calls) < 10
    calls.clear()
    rest = list(processor.handleExpiredTimer((0, 1), _Now(int(day(400).timestamp() * 1000) - keep), None))
    assert len(rest) == 100 and rest[-1].prior_matches_all_time == 299 and len(calls) < 10
    late = list(processor.handleInputRows((0, 1), iter(rows[7:8]), _Now(int(day(400).timestamp() * 1000) - keep)))
    assert [(r.kind, r.match_id, r.match_date) for r in late] == [("late", 7, day(7).date())]
    assert processor.value.held is not None and processor.recent.held[-1][2] == 9.0
    odd = [Row(**rows[0].asDict() | {"match_id": 900 + k, "match_date": day(401 + k).date(), "seen_at": day(401 + k), "gf": None if k == 0 else 1}) for k in range(2)]
    unknown = list(processor.handleInputRows((0, 1), iter(odd), _Now(int(day(500).timestamp() * 1000) - keep)))
    assert [(r.ewma_gf is None, r.std_gd is None, r.ewma_ga is None) for r in unknown] == [(False, False, False), (True, True, False)]
