"""A stored feature table and its record."""

from pyspark.sql import functions as F

from touchline.plans import provenance


def test_the_same_table_is_written_twice(spark, make_matches, monkeypatch):
    """A schedule whose sums come out differently in their last bits, as sums of doubles do, is still the same schedule."""
    c = make_matches([(s, f"{s}-08-0{d}", h, a, d, 1) for s in (1999, 2000) for d, h, a in ((1, "A", "B"), (2, "B", "C"), (3, "C", "A"))]).cache()
    schedule = provenance.causal.parameter_schedule
    monkeypatch.setattr(provenance, "contests", lambda *_: c)
    monkeypatch.setattr(provenance, "feature_table", lambda *_: c.select("match_id", "league", "season"))
    monkeypatch.setattr(provenance.causal, "parameter_schedule", lambda m: schedule(m).withColumn(
        "home_advantage", F.col("home_advantage") + F.expr("unix_micros(now()) % 1000003") * 1e-12))
    got = provenance.refuse_overwrite(spark, "unused").first()
    assert got.n_rows == 6 and got.refused
