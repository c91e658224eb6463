import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.functions import provider as P
from touchline.functions import text as txt
from touchline.functions.labels import parse_raw_date, season_key, season_years
from touchline.operators import live, quality, questions, teams
from touchline.sources.clubs import club_table


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("raw,want", [
    ("Nott'm Forest", "nottm forest"), ("Manchester City FC", "manchester city"), ("Brighton & Hove Albion", "brighton hove albion"),
    ("Málaga CF", "malaga"), ("Straße FC AFC", "strasse"), ("ﬁne Club", "fine club"), ("a_b", "a b"), ("FC", ""),
])
def test_names(spark, raw, want):
    assert one(spark, raw, txt.normalize_name) == want


def test_questions_keep_signs(spark):
    assert one(spark, "What if +0.5, é?", txt.normalize_question) == "what if +0.5 e"
    assert one(spark, "Arsenal's and Nott'm", txt.strip_possessives) == "Arsenal and Nott'm"


def test_clubs_resolve_exactly(spark):
    clubs = club_table(spark)
    aliases = teams.alias_table(clubs)
    assert teams.registry_problems(clubs).count() == 0 and clubs.count() == 35
    rows = spark.createDataFrame([("Spurs",), ("Man. United",), ("Arsenall",), ("Coventry",)], "n string")
    got = {r["n"]: (r["canonical_id"], r["has_history"]) for r in teams.resolve_names(rows, "n", aliases).collect()}
    assert got == {"Spurs": ("tottenham", True), "Man. United": ("man_united", True), "Arsenall": (None, None), "Coventry": ("coventry_city", False)}
    with pytest.raises(ValueError, match="Arsenall"):
        teams.require_resolved(rows, "n", aliases)


def brute_tags(tokens, index, longest):
    taken, seen, out = set(), set(), []
    for span in range(min(longest, len(tokens)), 0, -1):
        for start in range(len(tokens) - span + 1):
            cells = set(range(start, start + span))
            club = index.get(" ".join(tokens[start:start + span]))
            if club is None or cells & taken:
                continue
            taken |= cells
            if club not in seen:
                seen.add(club)
                out.append((start, club))
    return [c for _, c in sorted(out)]


def test_entity_tags_against_brute_force(spark):
    rng = random.Random(11)
    index = {"a": "1", "b": "2", "a b": "3", "b c": "4", "c a b": "5", "d": "1"}
    docs = [(i, " ".join(rng.choice("abcdx") for _ in range(rng.randint(1, 40)))) for i in range(60)]
    aliases = spark.createDataFrame(list(index.items()), "alias string, canonical_id string")
    got = teams.tag_entities(spark.createDataFrame(docs, "id int, t string"), "id", "t", aliases, 3).orderBy("id", "mention").collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["id"], []).append(r["canonical_id"])
    assert by_doc == {i: w for i, t in docs if (w := brute_tags(t.split(), index, 3))}


def test_tags_are_made_a_few_texts_at_a_time():
    index = teams.first_words([("a", "1"), ("b c", "2")], 2)
    texts = ["a b c", None, "x", "c b", "b c a a"] * 200
    got = list(teams.tagged(iter([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(texts)], names=["k", "t"])]), index, "k"))
    assert max(len(set(b.column(0).to_pylist())) for b in got) <= teams.TEXTS_AT_ONCE
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [(k, n + 1, *m) for k, t in enumerate(texts) if t for n, m in enumerate(teams.mentions_of(t.split(" "), index))]


@pytest.mark.parametrize("text,intent,failure", [
    ("Who is top of the table?", "SIMPLE_FACT", None), ("What injuries affect Arsenal's next match?", "RESEARCH", None),
    ("Analyse their recent form considering injuries", "COMPLEX_SYNTHESIS", None), ("Compare injuries", None, "MULTIPLE_INTENTS"),
    ("Tell me some information", None, "NO_CLEAR_INTENT"), ("Why does the model predict this scoreline?", "PREDICTION_EXPLANATION", None),
])
def test_intents(spark, text, intent, failure):
    r = questions.tag_intents(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r["intent"], r["failure"]) == (intent, failure)


def test_live_reasoning(spark):
    r = questions.tag_intents(spark.createDataFrame([("Why are they struggling right now?",)], "t string"), "t").first()
    assert r["live_reasoning"] and r["codes"][-1] == "LIVE_REASONING_REQUESTED"


@pytest.mark.parametrize("raw,percent,want", [
    ("56%", True, 56.0), ("130%", True, 100.0), (None, False, None), ("", False, None), ("abc", False, None), ("-1", False, None), ("7.9", False, 7), ("true", False, None),
])
def test_statistic_values(spark, raw, percent, want):
    assert one(spark, raw, lambda c: P.parse_statistic(c, percent)) == want


def test_as_of_against_brute_force(spark):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    snaps = [(rng.choice([1, 1, 1, 2]), t0 + dt.timedelta(minutes=rng.randint(0, 6000)), i) for i in range(80)]
    reads = [(i, rng.choice([1, 2, 3]), t0 + dt.timedelta(minutes=rng.randint(0, 6000))) for i in range(80)]
    got = live.as_of(
        spark.createDataFrame(reads, "read_id long, k int, ts timestamp"), spark.createDataFrame(snaps, "k int, ts timestamp, v int"), "k", "ts", [], 3600, parts=5)
    for r in got.collect():
        _, k, at = reads[r["read_id"]]
        want = max((t for kk, t, _ in snaps if kk == k and t <= at), default=None)
        assert r["snapshot_at"] == want
        assert r["problem"] == (None if want else "no snapshot")
        if want:
            assert r["is_stale"] == int((at - want).total_seconds() >= 3600)


def test_as_of_splits_a_hot_moment(spark):
    """One key, one hour, many reads and snapshots at the same few moments: spread over all ranges, none lost."""
    t0 = dt.datetime(2024, 1, 1)
    snaps = spark.createDataFrame([(1, t0 + dt.timedelta(minutes=i % 6), i) for i in range(600)], "k int, ts timestamp, v int")
    reads = spark.createDataFrame([(i, 1, t0 + dt.timedelta(minutes=i % 7 - 1)) for i in range(1400)], "read_id long, k int, ts timestamp")
    got = live.as_of(reads, snaps, "k", "ts", ["v"], 3600, tie="v", parts=16).collect()
    assert len(got) == 1400
    for r in got:
        minute = r["read_id"] % 7 - 1
        assert r["v"] == (None if minute < 0 else max(i for i in range(600) if i % 6 <= minute and i % 6 == min(minute, 5))), minute


def test_as_of_ties_take_the_greatest_by_the_tie_column(spark):
    t = dt.datetime(2024, 1, 1)
    snaps = spark.createDataFrame([(1, t, 5, "old"), (1, t, 9, "a"), (1, t, 7, "z")], "k int, ts timestamp, v int, note string")
    for hours in (0, 30):  # within the bucket and carried forward
        reads = spark.createDataFrame([(1, 1, t + dt.timedelta(hours=hours))], "read_id long, k int, ts timestamp")
        assert live.as_of(reads, snaps, "k", "ts", ["note"], 60, tie="v").first()["note"] == "a"


def test_ambiguous_alias_fails(spark):
    schema = "canonical_id string, canonical_name string, historical_names array<string>, aliases array<string>, has_history boolean"
    clubs = spark.createDataFrame([("a", "Alpha", [], ["United"], True), ("b", "Beta", [], ["united"], True)], schema)
    assert [r["detail"] for r in teams.registry_problems(clubs).collect()] == ["united"]
    rows = spark.createDataFrame([("United",)], "n string")
    with pytest.raises(Exception, match="ambiguous alias: united"):
        teams.resolve_names(rows, "n", teams.alias_table(clubs)).collect()


def test_reports_are_whole(spark):
    from touchline.session import refuse_if_any

    with pytest.raises(ValueError, match="57 rows in"):
        refuse_if_any(spark.range(57), "report", "refused")
    refuse_if_any(spark.range(0), "report", "refused")


def test_failed_refresh_keeps_the_old_value_as_stale(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), True), (2, dt.datetime(2024, 1, 1), None)], "id int, at timestamp_ntz, failed boolean")
    read = F.lit("2024-01-01 00:00:10").cast("timestamp_ntz")
    got = {r["id"]: r for r in live.with_freshness(rows, read, "at", 60, "p", source_kind="LOCAL_MODEL", failed=F.col("failed")).collect()}
    assert got[1]["is_stale"] and not got[2]["is_stale"] and got[1]["last_successful_refresh"] == got[1]["at"]
    assert got[1]["source_kind"] == "LOCAL_MODEL" and got[1]["cache_age_seconds"] == 10


def test_dates_and_labels(spark):
    assert str(one(spark, "13/08/15", parse_raw_date)) == "2015-08-13" and str(one(spark, "08/08/2015", parse_raw_date)) == "2015-08-08"
    assert str(one(spark, "08/08/95", parse_raw_date)) == "1995-08-08" and one(spark, "nonsense", parse_raw_date) is None
    assert one(spark, "2015_16", season_years) == [2015, 2016]
    order = spark.createDataFrame([("zz",), ("2016_17",), ("2015_16",)], "t string").orderBy(season_key(F.col("t"))).collect()
    assert [r["t"] for r in order] == ["2015_16", "2016_17", "zz"]


def raw_row(**changes):
    base = dict(Season="2021_22", Date=dt.date(2021, 8, 15), HomeTeam="Newcastle", AwayTeam="West Ham", FTHG=2, FTAG=4, FTR="A", HTHG=2, HTAG=1, HTR="H",
                HS=17, AS=8, HST=3, AST=7, HF=4, AF=3, HC=7, AC=7, HY=1, AY=0, HR=0, AR=0, Referee="x")
    return {**base, **changes}


@pytest.mark.parametrize("rule,changes", [
    ("home_equals_away", dict(AwayTeam="Newcastle")), ("negative_statistic", dict(HC=-1)), ("ftr_inconsistent", dict(FTR="H")), ("htr_inconsistent", dict(HTR="D")),
    ("hst_exceeds_hs", dict(HST=18)), ("ast_exceeds_as", dict(AST=9)), ("hthg_exceeds_fthg", dict(HTHG=3)), ("htag_exceeds_ftag", dict(HTAG=5, HTR="A")),
])
def test_each_rule(spark, rule, changes):
    row = spark.createDataFrame([raw_row(**changes)])
    assert [r["rule"] for r in quality.row_violations(row).collect()] == [rule]
    assert quality.row_violations(spark.createDataFrame([raw_row()])).count() == 0
    with pytest.raises(ValueError, match=rule):
        quality.require_clean(quality.row_violations(row))


def test_known_correction(spark):
    rows = spark.createDataFrame([raw_row(AST=9)]).withColumns({c: F.col(c).cast("int") for c in ("AS", "AST")})
    fixed, log = quality.apply_corrections(rows, quality.corrections_table(spark))
    assert fixed.first()["AS"] == 18 and log.first()["old_value"] == 8
    with pytest.raises(ValueError, match="refusing"):
        quality.apply_corrections(rows.withColumn("AS", F.lit(9)), quality.corrections_table(spark))
    with pytest.raises(ValueError, match="refusing"):
        quality.apply_corrections(rows.unionByName(rows), quality.corrections_table(spark))


def test_missing_whitelisted_column(spark):
    with pytest.raises(ValueError, match="Referee"):
        quality.whitelist(spark.createDataFrame([raw_row()]).drop("Referee"))


def test_names_of_neither_side(spark):
    """Blocks of clubs that do not play are resolved however many an entry names: by joins, and beyond ``STRANGERS`` of them by the map."""
    aliases = spark.createDataFrame([(f"c{i}", f"id{i}") for i in range(12)], "alias string, canonical_id string")
    from touchline.sources.provider_json import LIVE_SCHEMA

    def entry(k, names):
        team = [{"team": {"name": n}} for n in names]
        return {"fixture": {"id": k}, "teams": {"home": {"name": "C0"}, "away": {"name": "C1"}}, "events": team}

    cases = {1: ["C0", "C1"], 2: ["C2", "nobody", None, "C2"], 3: ["C5", "C4", "C1", "C3"], 4: ["C2", "C3", "nobody", "C4", "C5", "C0", "C11"]}
    from pyspark.sql.types import _parse_datatype_string

    schema = LIVE_SCHEMA if not isinstance(LIVE_SCHEMA, str) else _parse_datatype_string(LIVE_SCHEMA)
    rows = spark.createDataFrame([entry(k, v) for k, v in cases.items()], schema)
    got = live.parse_snapshots(rows, aliases, "2024_25")
    want = {str(k): [n and {"nobody": None}.get(n, n.replace("C", "id")) for n in v] for k, v in cases.items()}
    assert {r["fixture_id"]: [e["team_id"] for e in r["events"]] for r in got.collect()} == want
    # no nested loop gives each entry a column of all clubs: the map is joined under a condition
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cross" not in plan


def test_a_club_registry_beyond_a_broadcast(spark, monkeypatch):
    """Snapshots are the same whether clubs are sent to the entries or both are dealt out by name; nothing is refused."""
    from touchline.sources.provider_json import LIVE_SCHEMA

    aliases = spark.createDataFrame([(f"c{i}", f"id{i // 2}") for i in range(24)], "alias string, canonical_id string")
    names = {1: ("C0", "C2", ["C1", "C2"]), 2: ("C4", None, ["C6", "nobody", None, "C6"]), 3: ("C0", "", ["C9", "C8", "C5", "C7", "nobody", "C0", "C11"]), 4: ("nobody", "C2", None), 5: ("C3", "C1", ["nobody"]), 6: (None, None, ["C9", "C8"])}
    rows = [{"fixture": {"id": k}, "teams": {"home": {"name": h}, "away": {"name": a}}, "events": n and [{"team": {"name": x}} for x in n],
             "lineups": [{"team": {"name": a}, "formation": "4-4-2"}, {"team": {"name": "C10"}}]} for k, (h, a, n) in names.items()]
    entries = spark.createDataFrame([*rows, rows[1]], LIVE_SCHEMA)
    told = []
    for bound in (live.BROADCAST_ROW_BOUND, 5):
        monkeypatch.setattr(live, "BROADCAST_ROW_BOUND", bound)
        got = live.parse_snapshots(entries, aliases, "2024_25")
        assert ("Broadcast" in got._jdf.queryExecution().executedPlan().toString()) == (bound > 5)
        told.append(sorted(map(str, got.collect())))
    assert told[0] == told[1] and len(told[0]) == 7
