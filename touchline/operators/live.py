"""Fixtures, live snapshots, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.functions import provider as P
from touchline.functions.text import normalize_names
from touchline.operators.teams import resolve_names
from touchline.session import BROADCAST_ROW_BOUND, written


def parse_schedule(matches: DataFrame, aliases: DataFrame, season: str, competition: str = "PL") -> DataFrame:
    """Schedule-feed match objects as fixtures. ``problem`` names what makes a row
    unusable: no id, no kickoff, no names, an unknown club, equal clubs."""
    name = lambda t: F.coalesce(F.nullif(F.col(f"{t}.name"), F.lit("")), F.nullif(F.col(f"{t}.shortName"), F.lit("")))
    rows = matches.select(
        F.col("id").cast("string").alias("fixture_id"), F.lit(competition).alias("competition"), F.lit(season).alias("season"),
        name("homeTeam").alias("home_name"), name("awayTeam").alias("away_name"),
        F.try_to_timestamp("utcDate").alias("kickoff"), P.map_status(F.col("status"), "football_data_org").alias("status"),
        "matchday", F.col("score.fullTime.home").alias("home_score"), F.col("score.fullTime.away").alias("away_score"))
    return _with_clubs(rows, aliases)


def _with_clubs(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    for side in ("home", "away"):
        rows = resolve_names(rows, f"{side}_name", aliases).withColumnRenamed("canonical_id", f"{side}_id").drop("has_history")
    return rows.withColumn("problem", _fixture_problem())


def _fixture_problem() -> Column:
    c = F.col
    return (F.when(c("fixture_id").isNull(), "no id").when(c("kickoff").isNull(), "no kickoff")
            .when(c("home_name").isNull() | c("away_name").isNull(), "no usable team names")
            .when(c("home_id").isNull() | c("away_id").isNull(), "unknown club")
            .when(c("home_id") == c("away_id"), "home and away must differ"))


def parse_live_fixtures(entries: DataFrame, aliases: DataFrame, season: str, competition: str = "39") -> DataFrame:
    """Live entries as fixtures with minute and score; date falls back to the epoch."""
    rows = entries.select(
        F.col("fixture.id").cast("string").alias("fixture_id"), F.lit(competition).alias("competition"), F.lit(season).alias("season"),
        F.nullif(F.col("teams.home.name"), F.lit("")).alias("home_name"), F.nullif(F.col("teams.away.name"), F.lit("")).alias("away_name"),
        P.kickoff(F.col("fixture.date"), F.col("fixture.timestamp")).alias("kickoff"),
        P.map_status(F.col("fixture.status.short"), "api_football").alias("status"),
        F.col("fixture.status.elapsed").alias("minute"), F.col("goals.home").alias("home_score"), F.col("goals.away").alias("away_score"),
        "fetched_at")
    return _with_clubs(rows, aliases)


KEY = ["fixture_id", "fetched_at"]


def _blocks(entries: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Array entries as rows with their place and resolved club."""
    rows = entries.select(F.col("fixture.id").cast("string").alias("fixture_id"), "fetched_at", F.posexplode(column).alias("place", "b"))
    return resolve_names(rows.withColumn("team_name", F.col("b.team.name")), "team_name", aliases).drop("has_history")


def parse_events(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per event. An unknown club leaves the id null."""
    b = F.col("b")
    return _blocks(entries, "events", aliases).where("b is not null").select(
        *KEY, "place", P.event_type(b["type"], b["detail"]).alias("type"), b["time"]["elapsed"].alias("minute"),
        F.col("canonical_id").alias("team_id"), b["player"]["name"].alias("player"), b["assist"]["name"].alias("assist"), b["detail"].alias("detail"))


def _players(entries: Column) -> Column:
    """Named players; an absent list is an empty one."""
    named = F.filter(entries, lambda e: F.coalesce(F.length(e["player"]["name"]) > 0, F.lit(False)))
    return F.coalesce(F.transform(named, lambda e: e["player"]), F.array().cast("array<struct<name:string,number:int,pos:string>>"))


def parse_lineups(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per lineup block with a team name. ``problem`` marks an unknown
    club: here, unlike in events and statistics, that is an error."""
    b = F.col("b")
    return _blocks(entries, "lineups", aliases).where("team_name <> ''").select(
        *KEY, "place", F.col("canonical_id").alias("team_id"), b["formation"].alias("formation"), b["coach"]["name"].alias("coach"),
        _players(b["startXI"]).alias("starting_xi"), _players(b["substitutes"]).alias("substitutes"),
        F.when(F.col("canonical_id").isNull(), "unknown club").alias("problem"))


def parse_statistics(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per statistics block of a known club; other blocks are skipped."""
    return _blocks(entries, "statistics", aliases).where("canonical_id is not null").select(
        *KEY, "place", F.col("canonical_id").alias("team_id"), P.match_statistics(F.col("b.statistics")).alias("stats"))


def _club_lookup(aliases: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(alias, canonical_id, every alias of that club) to join by, and one row with all aliases as a map; no such row if there are more
    aliases than a broadcast may have."""
    known = aliases.select("alias", "canonical_id")
    own = known.groupBy("canonical_id").agg(F.collect_list("alias").alias("spellings"))
    clubs = known.join(own, "canonical_id")
    if known.limit(BROADCAST_ROW_BOUND + 1).count() > BROADCAST_ROW_BOUND:
        return clubs, None
    return clubs, known.agg(F.map_from_entries(F.collect_list(F.struct("alias", "canonical_id"))).alias("_clubs"))


def _with_strangers(rows: DataFrame, clubs: DataFrame) -> DataFrame:
    """``_clubs``: the clubs of an entry's names ``_far``, by a shuffle. Equal lists of names are looked up once; an entry without
    such names has a key of its own that nothing meets, so that those entries do not gather."""
    lists = rows.where(F.size("_far") > 0).select(F.col("_far").alias("_list")).distinct()
    found = lists.select("_list", F.explode("_list").alias("alias")).join(clubs.select("alias", "canonical_id").hint("merge"), "alias")
    maps = found.groupBy("_list").agg(F.map_from_entries(F.collect_list(F.struct("alias", "canonical_id"))).alias("_clubs"))
    alone = F.array(F.xxhash64("fixture", "fetched_at").cast("string"), F.lit(None).cast("string"))
    return rows.withColumn("_list", F.when(F.size("_far") > 0, F.col("_far")).otherwise(alone)).join(maps.hint("merge"), "_list", "left").drop("_list")


#: Names of an entry, of neither of its sides, that are looked up by joins.
STRANGERS = 3


def parse_snapshots(entries: DataFrame, aliases: DataFrame, season: str, competition: str = "39") -> DataFrame:
    """Whole snapshots: fixture, both sides' statistics and lineups, events. One scan; no entry leaves its row, but where the club
    registry is beyond the bound of a broadcast: there entries and clubs meet by shuffles, once a side and once for all other names.

    All names of an entry are normalised together. The two sides meet the club table in broadcast joins and bring their
    clubs' spellings along, which settles nearly all blocks. Names of neither side are joined one by one, ``STRANGERS`` of them;
    only an entry with more gets the map of all clubs, which would otherwise be copied with every entry. Blocks find their side by resolved club; of several blocks for one side the last wins. A block that was never sent stays null.
    """
    clubs, every = _club_lookup(aliases)
    c, none = F.col, F.array().cast("array<string>")
    blocks = ["events", "lineups", "statistics"]
    of_blocks = [F.coalesce(F.transform(c(b), lambda x: x["team"]["name"]), none) for b in blocks]
    sides = [F.nullif(c(f"teams.{s}.name"), F.lit("")) for s in ("home", "away")]
    rows = entries.withColumn("_n", normalize_names(F.concat(F.array(*sides), *of_blocks)))
    rows = rows.withColumns({f"_{s}": F.get("_n", F.lit(i)) for i, s in enumerate(("home", "away"))})
    for s in ("home", "away"):
        side = clubs.select(c("alias").alias(f"_{s}"), c("canonical_id").alias(f"{s}_id"), c("spellings").alias(f"_{s}_all"))
        rows = rows.join(side.hint("merge") if every is None else F.broadcast(side), f"_{s}", "left")

    def ours(name):
        return [F.coalesce(F.array_contains(f"_{s}_all", name), F.lit(False)) for s in ("home", "away")]

    far = F.filter(F.slice("_n", F.lit(3), F.size("_n")), lambda n: n.isNotNull() & ~ours(n)[0] & ~ours(n)[1])
    rows = rows.withColumn("_far", F.array_distinct(far))
    joined = 0 if every is None else STRANGERS
    for i in range(joined):
        rows = rows.withColumn(f"_far_{i}", F.get("_far", F.lit(i)))
        known = clubs.select(c("alias").alias(f"_far_{i}"), c("canonical_id").alias(f"_far_{i}_id"))
        rows = rows.join(F.broadcast(known), f"_far_{i}", "left")
    rows = _with_strangers(rows, clubs) if every is None else rows.join(F.broadcast(every), F.size("_far") > STRANGERS, "left")

    def club(name):
        found = F.when(ours(name)[0], c("home_id")).when(ours(name)[1], c("away_id"))
        for i in range(joined):
            found = found.when(name == c(f"_far_{i}"), c(f"_far_{i}_id"))
        return found.otherwise(c("_clubs")[name])

    size = lambda b: F.when(c(b).isNull(), 0).otherwise(F.size(b))
    starts = {"events": F.lit(2), "lineups": F.lit(2) + size("events"), "statistics": F.lit(2) + size("events") + size("lineups")}

    def placed(b: str) -> Column:
        return F.transform(c(b), lambda x, i: F.struct(i.alias("place"), club(F.get("_n", starts[b] + i)).alias("team_id"), x.alias("b")))

    rows = rows.withColumns({f"_{b}": placed(b) for b in blocks}).withColumns({
        "_events": F.filter("_events", lambda e: e["b"].isNotNull()),
        "_lineups": F.filter("_lineups", lambda e: F.coalesce(F.length(e["b"]["team"]["name"]) > 0, F.lit(False)))})
    last = lambda b, s: F.try_element_at(F.filter(f"_{b}", lambda x: x["team_id"] == c(f"{s}_id")), F.lit(-1))
    events = F.transform("_events", lambda e: F.struct(
        e["place"], P.event_type(e["b"]["type"], e["b"]["detail"]).alias("type"), e["b"]["time"]["elapsed"].alias("minute"), e["team_id"],
        e["b"]["player"]["name"].alias("player"), e["b"]["assist"]["name"].alias("assist"), e["b"]["detail"].alias("detail")))

    def lineup(s):
        x = last("lineups", s)
        b = x["b"]
        found = F.struct(x["team_id"].alias("team_id"), b["formation"].alias("formation"), _players(b["startXI"]).alias("starting_xi"),
                         _players(b["substitutes"]).alias("substitutes"), b["coach"]["name"].alias("coach"))
        return F.when(x.isNotNull(), found).alias(f"{s}_lineup")

    home, away = (n.alias(f"{s}_name") for n, s in zip(sides, ("home", "away")))
    return rows.select(
        c("fixture.id").cast("string").alias("fixture_id"), "fetched_at", F.lit(competition).alias("competition"), F.lit(season).alias("season"), home, away,
        P.kickoff(c("fixture.date"), c("fixture.timestamp")).alias("kickoff"), P.map_status(c("fixture.status.short"), "api_football").alias("status"),
        c("fixture.status.elapsed").alias("minute"), c("goals.home").alias("home_score"), c("goals.away").alias("away_score"), "home_id", "away_id",
        *[P.match_statistics(last("statistics", s)["b"]["statistics"]).alias(f"{s}_stats") for s in ("home", "away")], lineup("home"), lineup("away"),
        F.when(F.size("_events") > 0, events).alias("events"),
        F.exists("_lineups", lambda x: x["team_id"].isNull()).alias("_stranger"),
    ).withColumn("problem", F.coalesce(_fixture_problem(), F.when(c("_stranger"), "unknown club in a lineup"))).drop("_stranger")


def in_play(status: Column) -> Column:
    return status.isin(P.IN_PLAY)


def not_played(status: Column) -> Column:
    return status.isin(P.NOT_PLAYED)


def filter_fixtures(fixtures: DataFrame, *, team=None, status: str | None = None, date_from=None, date_to=None, limit: int | None = None) -> DataFrame:
    """Typed filters, both dates inclusive, kickoff order, optional top rows."""
    out = fixtures
    if team is not None:
        out = out.where((F.col("home_id") == team) | (F.col("away_id") == team))
    if status is not None:
        out = out.where(F.col("status") == status)
    if date_from is not None:
        out = out.where(F.col("kickoff") >= F.lit(date_from))
    if date_to is not None:
        out = out.where(F.col("kickoff") <= F.lit(date_to))
    return _first(out.orderBy("kickoff", "fixture_id"), limit)


def _first(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def upcoming(fixtures: DataFrame, now, limit: int | None = None) -> DataFrame:
    return _first(fixtures.where(F.col("kickoff") >= F.lit(now)).orderBy("kickoff", "fixture_id"), limit)


def recent(fixtures: DataFrame, team=None, limit: int | None = None) -> DataFrame:
    return _first(filter_fixtures(fixtures, team=team, status="FINISHED").orderBy(F.desc("kickoff"), "fixture_id"), limit)


def constraint_violations(rules: dict[str, Column], rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per broken rule; null values break nothing."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


STATISTIC_COUNTS = ["shots", "shots_on_target", "corners", "fouls", "offsides", "yellow_cards", "red_cards"]


def live_rules() -> dict[str, Column]:
    c = F.col
    return {
        "same_club": c("home_id") == c("away_id"), "negative_minute": c("minute") < 0,
        "negative_score": (c("home_score") < 0) | (c("away_score") < 0),
        "negative_statistic": F.least(*[F.coalesce(c(n), F.lit(0)) for n in STATISTIC_COUNTS]) < 0,
        "percent_range": (c("possession") < 0) | (c("possession") > 100) | (c("pass_accuracy") < 0) | (c("pass_accuracy") > 100),
        "position_below_one": c("position") < 1,
        "fetched_after_read": c("fetched_at") > c("read_at"),
    }


def latest_snapshots(snapshots: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The last whole snapshot per key; never merged field by field."""
    rest = [c for c in snapshots.columns if c not in key]
    return snapshots.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("s")).select(*key, "s.*")


def with_freshness(rows: DataFrame, read_at: Column, fetched_at: str, ttl_seconds: int, provider: str, replay: bool = False,
                   source_kind: str | None = None, failed: Column | None = None) -> DataFrame:
    """Provider, source kind, age, ttl, stale flag and last success on every answer.

    ``failed``: true where a refresh was tried after the answer was fetched and did not succeed; the old value stays,
    is stale whatever its age, and keeps its own last success. ``source_kind``: such as LOCAL_MODEL for own forecasts."""
    age = P.age_seconds(read_at, F.col(fetched_at))
    stale = age >= ttl_seconds
    return rows.withColumns({
        "provider": F.lit(provider), "source_kind": F.lit(source_kind or ("REPLAY" if replay else "REAL_PROVIDER")), "cache_age_seconds": age,
        "ttl_seconds": F.lit(ttl_seconds), "is_stale": stale if failed is None else stale | F.coalesce(failed, F.lit(False)),
        "last_successful_refresh": F.col(fetched_at),
    })


def as_of(reads: DataFrame, snapshots: DataFrame, key: str, at: str, value: list[str], ttl_seconds: int, strict: bool = False,
          tie: str | None = None, parts: int | None = None) -> DataFrame:
    """For every read the latest snapshot of its key at or before it; of those at one time the greatest by ``tie``, or by
    their values if no column is named.

    A segmented scan: reads and snapshots are dealt together into ``parts`` ranges of (key, time), written so that the ranges
    stay, and inside each range a window finds the last snapshot. One row per (key, range) carries the last snapshot of earlier
    ranges forward. The ranges follow the rows, so a hot key, or one hot moment of it, spreads over as many as it fills.
    """
    n = parts or int(snapshots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    snap = F.struct(F.col(at).alias("snapshot_at"), *([F.col(tie).alias("_tie")] if tie else []), *value)
    s = snapshots.select(key, at, F.lit(0).alias("_is_read"), F.lit(None).cast("long").alias("read_id"), snap.alias("_snap"))
    r = reads.select(key, at, F.lit(1).alias("_is_read"), F.col("read_id").cast("long").alias("read_id"), F.lit(None).cast(s.schema["_snap"].dataType).alias("_snap"))
    order = [at, "_is_read", "_snap", "read_id"]
    log = written(s.unionByName(r).repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()), "as-of")
    inside = W.partitionBy(key, "_range").orderBy(*order)
    local = log.withColumn("_here", F.last("_snap", ignorenulls=True).over(inside)).where("_is_read = 1")
    ends = log.groupBy(key, "_range").agg(F.max("_snap").alias("_end"))
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    out = local.join(carried, [key, "_range"]).withColumn("_s", F.coalesce("_here", "_before"))
    age = P.age_seconds(F.col(at), F.col("_s.snapshot_at"))
    found = F.col("_s").isNotNull()
    out = out.select("read_id", key, F.col(at).alias("read_at"), "_s.snapshot_at", *[F.col(f"_s.`{v}`").alias(v) for v in value], F.when(found, age).alias("age_seconds"),
                     F.when(found, (age >= ttl_seconds).cast("int")).alias("is_stale"), F.when(~found, "no snapshot").alias("problem"))
    if strict:
        out = out.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("string")))
    return out


def league_table(matches: DataFrame) -> DataFrame:
    """Points table per league and season, ranked by points, difference, goals."""
    from touchline.operators.seasons import team_rows

    t = team_rows(matches).groupBy("league", "season", "team").agg(
        F.count("*").alias("played"), F.count_if(F.col("pts") == 3).alias("won"), F.count_if(F.col("pts") == 1).alias("drawn"),
        F.count_if(F.col("pts") == 0).alias("lost"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"),
        F.sum("pts").cast("long").alias("points")).withColumn("goal_difference", F.col("goals_for") - F.col("goals_against"))
    order = W.partitionBy("league", "season").orderBy(F.desc("points"), F.desc("goal_difference"), F.desc("goals_for"))
    return t.withColumn("position", F.rank().over(order))
