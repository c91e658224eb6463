"""Registered queries against their SQL twins at the smallest scale, and stream against batch."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from touchline.operators import form, seasons
from touchline.plans import streams
from touchline.sources.contests import contests
from touchline.streaming import form as live
from touchline.streaming import live as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["w3_w7_team_form", "a7_parameter_schedule", "e1_elo_ratings", "features_full", "p4_row_rules", "k2_fold_metrics", "m5_match_prediction",
        "m10_linear_explanation", "x3_intent_tags", "j13_as_of_lookup", "k5_incumbent_rule", "r4_event_dedup_stream", "r2_r3_latest_snapshot_stream", "r6_form_stream", "p22_live_constraints"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, float) else str(v) for v in row)
                  for row in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, duck, name):
    assert canonical(entry.queries()[name](spark, SF).toPandas()) == canonical(duck.execute(entry.oracle_sql()[name]).df())


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def batch_form(spark):
    return {(r["league"], r["team"], r["match_date"]): r for r in form.team_state(form.team_days(seasons.with_season_index(contests(spark, SF)))).collect()}


def test_stream_form_equals_batch(spark):
    """Every form column of every team day."""
    rows = streams.form_result(live.results_of(streams.form_rows(spark, SF))).collect()
    batch = batch_form(spark)
    assert {(r["league"], r["team"], r["match_date"]) for r in rows} == set(batch) and len(rows) == len(batch)
    for r in rows:
        b = batch[r["league"], r["team"], r["match_date"]]
        for c in live.FORM_COLUMNS:
            assert (r[c] is None) == (b[c] is None), c
            assert r[c] is None or r[c] == pytest.approx(b[c], abs=1e-9), c


def test_late_days_are_found(spark, tmp_path):
    """A month that arrives after the watermark has passed it is reported, day by day, and row by row."""
    rows = live.results_of(streams.form_rows(spark, SF))
    late = F.col("match_date").between("1996-03-01", "1996-03-31")
    for part in (rows.where(~late & (F.col("season") <= 1997)), rows.where("season = 1998"), rows.where(late), rows.where("season > 1998")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.run_to_table(live.live_form(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    told = spark.read.parquet(str(tmp_path / "out"))
    missed = live.missed_days(rows, told.where("kind = 'played'"))
    assert missed.where(~late).count() == 0
    assert missed.count() == rows.where(late).select("league", "team", "match_date").distinct().count()
    assert told.where("kind = 'late'").count() == rows.where(late).count()
