"""The gate counts every row that no rule names, by SQL of its own over the whole table."""

import duckdb

import __spark_entry__ as entry
from touchline import schema as S
from touchline.plans import sqltext as Q
from touchline.sources.raw_view import RAW_SQL

SF = "/root/testdata/sf0.001"


def test_gate_reads_every_row(spark):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    least = ", ".join(f'"{c}"' for c in S.RAW_COUNT_COLUMNS)
    sound = f"""WITH {Q.CONTESTS}, {RAW_SQL} SELECT count(*), count(*) FILTER (WHERE match_id % 211 = 0 OR match_id % 223 = 0) FROM raw
      WHERE "HST" <= "HS" AND "AST" <= "AS" AND "HTHG" <= "FTHG" AND "HTAG" <= "FTAG" AND least({least}) >= 0 AND "HomeTeam" <> "AwayTeam"
      AND "FTR" = CASE WHEN "FTHG" > "FTAG" THEN 'H' WHEN "FTHG" < "FTAG" THEN 'A' ELSE 'D' END
      AND "HTR" = CASE WHEN "HTHG" > "HTAG" THEN 'H' WHEN "HTHG" < "HTAG" THEN 'A' ELSE 'D' END"""
    n, with_ids = con.execute(sound).fetchone()
    assert with_ids > 0  # sound rows that were left out by their ids
    assert entry.queries()["p6_batch_gate"](spark, SF).first()["n_clean"] == n
