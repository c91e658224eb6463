"""The saved goal model is a maximum on the rows before the sealed season, by SQL on the contests."""

import duckdb
import pytest

import __spark_entry__ as entry
from touchline.plans import sqltext as Q
from touchline.sources import provenance

SF = "/root/testdata/sf0.001"

GRADIENT = f"""WITH {Q.CONTESTS}, tr AS (SELECT * FROM contests WHERE season < 2001),
t AS (SELECT league, max(match_date) last FROM tr GROUP BY league),
x AS (SELECT league, fthg hg, ftag ag, h.rho, exp(-ln(2) / 365 * (last - match_date)) w,
        exp(h.intercept + h.home_advantage + h.attack + a.defence) lh, exp(h.intercept + a.attack + h.defence) la
      FROM tr JOIN t USING (league) JOIN fit h USING (league) JOIN fit a USING (league) WHERE h.team = tr.home AND a.team = tr.away),
y AS (SELECT *, CASE WHEN hg = 0 AND ag = 0 THEN -lh * la / (1 - lh * la * rho) WHEN hg = 0 AND ag = 1 THEN lh / (1 + lh * rho)
        WHEN hg = 1 AND ag = 0 THEN la / (1 + la * rho) WHEN hg = 1 AND ag = 1 THEN -1 / (1 - rho) ELSE 0 END dr FROM x)
SELECT league, count(*) n, sum(w) w, any_value(rho) rho,
  sum(w * (hg - lh + ag - la + rho * dr * CASE WHEN hg + ag = 0 THEN 2 WHEN hg + ag = 1 THEN 1 ELSE 0 END)),
  sum(w * (hg - lh + rho * dr * (hg = 0 AND ag <= 1)::INT)), sum(w * dr) FROM y GROUP BY league"""


def test_stationary_before_the_sealed_season(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()["m14_s10_goal_model"](spark, SF).toPandas()
    con.register("got", got.drop(columns=["config_id"]))
    con.execute("CREATE TABLE fit AS SELECT * FROM got")
    n, last = con.execute(f"WITH {Q.CONTESTS} SELECT count(*), max(season) FROM contests WHERE season < 2001").fetchone()
    assert set(got["training_matches"]) == {n} and set(got["training_cutoff_season"]) == {str(last)} == {"2000"}
    rows = con.execute(GRADIENT).fetchall()
    assert rows and sum(r[1] for r in rows) == n
    for _, _, w, rho, intercept, advantage, d_rho in rows:
        assert abs(intercept) < 1e-4 * w and abs(advantage) < 1e-4 * w
        assert abs(d_rho) < 1e-4 * w or abs(rho) == pytest.approx(0.2, abs=1e-6)
    assert (got.groupby("league")["attack"].sum().abs() < 1e-5).all()  # registered queries round to six places


def test_parameters_of_other_rows_are_refused(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"league": 0, "fold": 4, "metadata": {"training_cutoff_season": "2000", "training_seasons": ["1999", "2000"], "training_matches": 10, "sealed_final_test_scored": false}}')
    assert provenance.checked_training(spark, str(tmp_path / "p.json"), "2000", 10).count() == 1
    for cutoff, n in (("2001", 10), ("2000", 11)):
        with pytest.raises(ValueError, match="was not fitted"):
            provenance.checked_training(spark, str(tmp_path / "p.json"), cutoff, n)
